"""Token counts of token lines by a compiled finite-state transducer.

The tokenizer's word splitting is a small deterministic transducer over character classes.  Each transition is annotated
with what it emits: the pretokens that it opens.  A text is cut into chunks of equal length; a chunk's state map says, for
every state it may start in, the state it ends in and the number of pretokens it emits.  Maps compose associatively, so a
segmented prefix scan gives every chunk its start state and all chunks run side by side.  Inside a pretoken the
transducer is compiled on demand into one arc per pretoken, annotated with its emitted tokens; like the cache of a lazy
automaton the arc table is emptied when it is full.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewise.llm.frames import picked, slices, text_of

CHUNK = 512
HEAD = 32
ARCS = 400_000
LONG_PRETOKEN = 64

SPACE, LETTER, NUMBER, OTHER, APOSTROPHE, ONE_LETTER, R, V, L, E, PAD = range(11)
CLASSES = 11
BETWEEN, IN_LETTERS, IN_OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
STATES = 7
OPENS, OPENED_BEFORE = 1, 2
#: Contractions that the splitting pattern knows: a quote with one of s, t, m, d, or with re, ve, ll.
SPECIAL_LETTERS = {"s": ONE_LETTER, "t": ONE_LETTER, "m": ONE_LETTER, "d": ONE_LETTER, "r": R, "v": V, "l": L, "e": E}


def byte_chars() -> list[str]:
    """Byte-level vocabularies write every byte as one printable character: itself, or the next free one from 256 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in itself]
    table = {b: chr(b) for b in itself} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [table[b] for b in range(256)]


BYTE_CHARS = byte_chars()
#: White space below U+0250; the normaliser turns all further kinds into blanks.
WHITE = " \t\n\r\x0b\x0c\x85\xa0"


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission of every (state, class)."""
    nxt = np.zeros((STATES, CLASSES), np.uint8)
    out = np.zeros((STATES, CLASSES), np.uint8)
    letters = (LETTER, ONE_LETTER, R, V, L, E)
    for s in (BETWEEN, IN_LETTERS, IN_OTHERS, QUOTE):
        nxt[s, SPACE] = BETWEEN
        nxt[s, NUMBER], out[s, NUMBER] = BETWEEN, OPENS
        for c in letters:
            nxt[s, c], out[s, c] = IN_LETTERS, 0 if s == IN_LETTERS else OPENS
        for c, to in ((OTHER, IN_OTHERS), (APOSTROPHE, QUOTE)):
            running = s in (IN_OTHERS, QUOTE)
            nxt[s, c], out[s, c] = (IN_OTHERS, 0) if running else (to, OPENS)
    nxt[QUOTE, ONE_LETTER], out[QUOTE, ONE_LETTER] = BETWEEN, 0
    for c, s, closing in ((R, QUOTE_R, E), (V, QUOTE_V, E), (L, QUOTE_L, L)):
        nxt[QUOTE, c], out[QUOTE, c] = s, 0
        # not a contraction after all: the letter before opened a pretoken of letters
        nxt[s], out[s] = nxt[IN_LETTERS], out[IN_LETTERS] | OPENED_BEFORE
        nxt[s, closing], out[s, closing] = BETWEEN, 0
    nxt[:, PAD], out[:, PAD] = np.arange(STATES), 0
    return nxt.reshape(-1), out.reshape(-1)


NEXT, EMIT = _transitions()
OPENED = np.array([0, 1, 1, 2], np.uint8)[EMIT]
#: Emitted when a text ends in the state.
AT_END = np.array([0, 0, 0, 0, 1, 1, 1], np.int64)


def _run(columns: np.ndarray, states: np.ndarray, flags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feed class columns to all lanes; final states and numbers of opened pretokens. states: lanes last."""
    opened = np.zeros(states.shape, np.int32)
    for j, column in enumerate(columns):
        key = states.astype(np.int16) * CLASSES + column
        states = NEXT.take(key)
        opened += OPENED.take(key)
        if flags is not None:
            flags[j] = EMIT.take(key)
    return states, opened


def _scan(end: np.ndarray, opened: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive prefix scan of the chunk maps (rows) within each unit."""
    step, longest = 1, int(np.bincount(unit).max())
    while step < longest:
        i = np.flatnonzero(unit[step:] == unit[:-step]) + step
        before = end[i - step]
        more = opened[i - step] + np.take_along_axis(opened[i], before, 1)
        end[i], opened[i] = np.take_along_axis(end[i], before, 1), more
        step *= 2
    return end, opened


def pretoken_starts(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where pretokens start in the joined units, and the number of pretokens of each unit."""
    chunks = -(-lengths // CHUNK)
    unit = np.repeat(np.arange(len(lengths)), chunks)
    counts = np.zeros(len(lengths), np.int64)
    if not len(unit):
        return np.zeros(0, np.int64), counts
    first = np.r_[True, unit[1:] != unit[:-1]]
    index = np.arange(len(unit)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    valid = np.arange(CHUNK) < (lengths[unit] - index * CHUNK)[:, None]
    block = np.full(valid.shape, PAD, np.uint8)
    block[valid] = classes
    lanes = np.ascontiguousarray(block.T)
    flags = np.zeros(lanes.shape, np.uint8)
    n = len(unit)

    # state maps: all states through the head; where they have met, one run serves for the rest
    every = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], n, 1)
    end, opened = _run(lanes[:HEAD], every)
    met = (end == end[0]).all(0)
    one, rest = np.flatnonzero(met), np.flatnonzero(~met)
    tail = np.zeros((CHUNK - HEAD, len(one)), np.uint8)
    last, more = _run(lanes[HEAD:, one], end[0, one], tail)
    flags[HEAD:, one] = tail
    end[:, one] = last
    opened[:, one] += more
    if len(rest):
        last, more = _run(lanes[HEAD:, rest], end[:, rest])
        end[:, rest] = last
        opened[:, rest] += more
    done, total = _scan(end.T.astype(np.int64), opened.T.astype(np.int64), unit)
    start = np.where(first, BETWEEN, np.r_[0, done[:-1, BETWEEN]]).astype(np.uint8)
    final = np.flatnonzero(np.r_[first[1:], True])
    counts[unit[final]] = total[final, BETWEEN] + AT_END[done[final, BETWEEN]]

    # emissions from the true start states
    head = np.zeros((HEAD, n), np.uint8)
    state, _ = _run(lanes[:HEAD], start, head)
    flags[:HEAD] = head
    if len(rest):
        tail = np.zeros((CHUNK - HEAD, len(rest)), np.uint8)
        _run(lanes[HEAD:, rest], state[rest], tail)
        flags[HEAD:, rest] = tail
    flat = flags.T[valid]
    opens = (flat & OPENS).astype(bool)
    opens[:-1] |= (flat[1:] & OPENED_BEFORE).astype(bool)
    ends = np.cumsum(lengths) - 1
    late = AT_END[done[final, BETWEEN]].astype(bool)
    opens[ends[unit[final]][late]] = True
    return np.flatnonzero(opens), counts


class Arcs(dict):
    """Compiles an arc when it is first taken; very long pretokens are not kept."""

    def __init__(self, compiled: Callable):
        super().__init__()
        self.compiled = compiled

    def __missing__(self, piece: str):
        arc = self.compiled(piece)
        if len(piece) <= LONG_PRETOKEN:
            self[piece] = arc
        return arc


class CountingTransducer:
    """Compiled from a word-end BPE tokenizer file whose splitting pattern is the one above."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.merge = self.tokenizer.model.tokenize
        specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.classes = np.full(0x110000, 255, np.uint8)
        self.arcs = Arcs(self._arc)

    def _class(self, char: str) -> int:
        """Found by asking the tokenizer how it splits the character from its neighbours."""
        if char == "'":
            return APOSTROPHE
        if char in SPECIAL_LETTERS:
            return SPECIAL_LETTERS[char]
        pieces = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{char}a"))
        if pieces < 3:
            return (SPACE, LETTER)[pieces == 1]
        return OTHER if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(char * 2)) == 1 else NUMBER

    def _classified(self, joined: str) -> np.ndarray:
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes[codes]
        if (classes == 255).any():
            for code in np.unique(codes[classes == 255]):
                self.classes[code] = self._class(chr(code))
            classes = self.classes[codes]
        return classes

    _SIMPLE = re.compile("[^\x00-ɏ‐-…]")

    def _normalised(self, text: str) -> str:
        if text.isascii() or not self._SIMPLE.search(text) and unicodedata.is_normalized("NFC", text):
            # here the tokenizer's own normaliser does no more than this; white space is dropped anyway
            return text.lower() if "İ" not in text else self.tokenizer.normalizer.normalize_str(text)
        return self.tokenizer.normalizer.normalize_str(text)

    def _arc(self, piece: str) -> int:
        """Emitted tokens of one pretoken and the white space behind it; none for white space."""
        pretoken = piece.rstrip(WHITE)
        if not pretoken:
            return 0
        known = pretoken.isascii() and pretoken.isprintable()
        return len(self.merge(pretoken if known else "".join(map(BYTE_CHARS.__getitem__, pretoken.encode()))))

    def _tokens(self, pieces: list[str]) -> np.ndarray:
        if len(self.arcs) > ARCS:
            self.arcs.clear()
        return np.fromiter(map(self.arcs.__getitem__, pieces), np.int64, len(pieces))

    def counts(self, texts: list[str]) -> np.ndarray:
        units, owner, specials = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            parts = [text] if self.specials is None or "<|" not in text else self.specials.split(text)
            specials[k] = len(parts) - 1
            for part in parts:
                if part:
                    units.append(self._normalised(part))
                    owner.append(k)
        joined = "".join(units)
        starts, opened = pretoken_starts(self._classified(joined), np.array([len(u) for u in units], np.int64))
        # pieces keep the white space behind them; it emits nothing
        marks = starts.tolist()
        tokens = self._tokens([joined[a:b] for a, b in zip(marks, [*marks[1:], len(joined)])])
        sums = np.r_[0, np.cumsum(tokens)]
        ends = np.cumsum(opened)
        np.add.at(specials, np.array(owner, np.int64), sums[ends] - sums[ends - opened])
        return specials


_compiled: dict[str, CountingTransducer] = {}


def token_counts(sequences: DataFrame, tokenizer_path: str, piece: str = "piece", token_line: str = "token_line",
                 max_events: int = 2048) -> DataFrame:
    """Token counts of whole token lines.

    ``sequences`` holds one melody (or any text) per row: its ``piece`` key and its ``token_line``.  Returns the key,
    ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``max_events`` tokens) for every row; rows are never
    merged, so repeated rows are counted each.  A null line is empty: no bytes, no tokens.  A null key stays null.  Other
    columns are not looked at.  No shuffle: a line is one row, its chunks run side by side in its task.
    """
    src = picked(sequences, piece=piece, line=token_line).select("piece", text_of("line").alias("line"))
    kind = src.schema["piece"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled.get(tokenizer_path) or _compiled.setdefault(tokenizer_path, CountingTransducer(tokenizer_path))
        for batch in slices(batches, "line"):
            n = machine.counts(batch.column("line").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["piece", "n_bytes", "n_tokens"])

    sized = src.select("piece", "line", F.octet_length("line").cast("long").alias("n_bytes"))
    counted = sized.mapInArrow(run, f"piece {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("piece").alias(piece), "n_bytes", "n_tokens", (F.col("n_tokens") > max_events).alias("over_limit"))
