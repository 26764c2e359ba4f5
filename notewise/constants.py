"""Fixed values of the melody encoding.  They must not change: stored corpora depend on them."""

POS_PER_QUARTER = 12        # time grid: positions per quarter note
DUR_CODES = 96              # duration codes 0..95
DT_CODES = 96               # delta-time codes -96..95
MAX_DUR = 95
MIN_DT = -96
MAX_DT = 95
MAX_PITCH = 127
TRUNC_POS = 65536           # notes start before this position

MIN_NOTES_PER_VOICE = 40
MIN_UNIQUE_PITCHES = 5

WINDOW_NOTES = 512
WINDOW_STEP = 256
WINDOW_MIN_NOTES = 16
MAX_EVENTS = 514            # BOS + 512 notes + EOS

SPECIALS = ("<pad>", "<unk>", "<s>", "</s>", "<mask>")
PAD, UNK, BOS, EOS, MASK = 0, 1, 2, 3, 4
PITCH_BASE = 5              # global id of pitch 0
DUR_BASE = 133              # global id of duration 0
DT_BASE = 229               # global id of delta-time 0
DT_NEG_BASE = 325           # global id of delta-time -1
VOCAB_SIZE = 421

PI_INSERTED = -1
PI_PAD = -2

SCORE_EXTENSIONS = ("mid", "midi", "xml", "musicxml", "mxl", "krn")

# upper edges of the coarse duration bins
COARSE_EDGES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)

SPLITS = ("train", "valid", "test")
SPLIT_RATIOS = (0.90, 0.05, 0.05)

# retention grid of the cut curve
CUT_RHOS = (1 / 3, 5 / 12, 1 / 2, 7 / 12, 2 / 3, 3 / 4, 5 / 6, 11 / 12, 1.0)
# bucket edges of the retention report
RHO_BINS = (1 / 3, 1 / 2, 2 / 3, 5 / 6, 1.0 + 1e-6)
