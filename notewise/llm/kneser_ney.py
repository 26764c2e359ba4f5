"""Quality of token lines by an interpolated modified Kneser-Ney model trained on trusted ones.

Lines lie in blocks.  A block sends each of its different n-grams once, with its count in trusted lines; the model is a table
(style, gram) made by grouped sums and joins on grams, and its answers come back to the blocks, where lines are added up.  What is
shuffled is one row per block and different gram, so no gram is a hot key: it has at most one row a block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewise.llm.frames import picked, shared_folder
from notewise.session import checkpointed

#: Characters of an n-gram; each takes 16 bits of a long.
ORDER = 4
BITS = 16
#: A style has a model of its own from so many trusted characters on; lines of others are judged by the pooled model.
OWN_SYMBOLS = 20_000
QUANTILE = 0.995
#: The threshold is this much above the quantile.
MARGIN = 1.05
#: Characters of the style's mean that are added to every line, so that short lines are judged mildly.
SHRINK = 200
POOLED = "*"
BLOCK_CHARS = 1 << 23
BLOCK_LINES = 1 << 16


def stored(df: DataFrame) -> DataFrame:
    """A table in the shared folder, read again: its lineage is cut and its size is known."""
    path = f"{shared_folder(df.sparkSession)}/quality-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ngrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all lines after each other as longs, the last character lowest, and each line's length.

    Every character ends one n-gram; zeros stand before a line.  Characters above U+FFFF share the 2,048 surrogate codes.
    """
    lengths = np.array([len(x) for x in lines], np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    symbols = np.where(points > 0xFFFF, 0xD800 + points % 2048, np.maximum(points, 1)).astype(np.uint64)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams = symbols.copy()
    for k in range(1, ORDER):
        grams[k:] |= np.where(place[k:] >= k, symbols[:-k], 0).astype(np.uint64) << np.uint64(BITS * k)
    return grams.view(np.int64), lengths


class Blocks:
    """Rows of a frame in blocks of about BLOCK_CHARS characters or one longer line, compressed with all their columns."""

    def __init__(self, frame: DataFrame, piece: str, line: str, style: str):
        names = [c.lower() for c in frame.columns]
        self.frame, self.piece = frame, names.index(piece.lower())
        self.line, self.style = names.index(line.lower()), names.index(style.lower())
        self.kind = frame.schema[self.piece].dataType.simpleString()
        piece_at, line_at = self.piece, self.line

        def packed(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
                out.write_table(table)
            pieces = table.column(piece_at)
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([pieces.to_pylist()], pa.list_(pieces.type)), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                ["block", "pieces", "body"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held, chars, rows = TaskContext.get().partitionId() << 32, [], 0, 0
            for batch in batches:
                sizes = pc.fill_null(pc.utf8_length(batch.column(line_at).cast(pa.string())), 0).to_numpy(zero_copy_only=False)
                first = 0
                for k, size in enumerate(sizes.tolist()):
                    if rows and (chars + size > BLOCK_CHARS or rows == BLOCK_LINES):
                        yield packed(number, [*held, batch.slice(first, k - first)])
                        number, held, chars, rows, first = number + 1, [], 0, 0, k
                    chars += size
                    rows += 1
                if first < batch.num_rows:
                    held.append(batch.slice(first))
            if rows:
                yield packed(number, held)

        self.rows = checkpointed(frame.mapInArrow(run, f"block bigint, pieces array<{self.kind}>, body binary"))

    def keys(self) -> DataFrame:
        """(piece, block, at) of every row."""
        return self.rows.select("block", F.posexplode("pieces").alias("at", "piece")).select("piece", "block", "at")

    def joined(self, other: DataFrame, use, schema: str) -> DataFrame:
        """``use(table of the block's rows, table of other's rows of the block)`` for every block."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            # blocks are numbered once, so a group has one; rows of other always belong to one
            return use(left.column("block")[0].as_py(), pa.ipc.open_stream(left.column("body")[0].as_buffer()).read_all(), right)

        named = other.select(F.col("block").alias("of_block"), *[c for c in other.columns if c != "block"])
        return self.rows.select("block", "body").groupBy("block").cogroup(named.groupBy("of_block")).applyInArrow(run, schema)

    def by_style(self):
        """A function that gives (style, numbers of its rows, their lines) of a block's table."""
        line_at, style_at = self.line, self.style

        def split(table: pa.Table) -> Iterator[tuple[str | None, np.ndarray, list[str]]]:
            styles = table.column(style_at).cast(pa.string()).to_pylist()
            lines = table.column(line_at).cast(pa.string()).to_pylist()
            own: dict[str | None, list[int]] = {}
            for k, s in enumerate(styles):
                own.setdefault(s, []).append(k)
            for s, at in own.items():
                yield s, np.array(at), [lines[k] or "" for k in at]

        return split


#: Surprises of a gram: by its style's model, by that model's halves, by the halves of the pooled one.
SURPRISES = ("s", "s0", "s1", "p0", "p1")


def block_grams(blocks: Blocks, trusted: DataFrame) -> DataFrame:
    """(block, style, gram, n0, n1): every different n-gram of a block, and its counts in ``trusted`` lines (block, at, fold) of either fold."""
    split = blocks.by_style()

    def counted(block: int, table: pa.Table, right: pa.Table) -> pa.Table:
        fold = np.full(table.num_rows, -1)
        fold[right.column("at").to_numpy()] = right.column("fold").to_numpy()
        parts = []
        for style, at, lines in split(table):
            grams, lengths = ngrams(lines)
            every = np.unique(grams)
            counts = np.zeros((2, len(every)), np.int64)
            for k in (0, 1):
                known, n = np.unique(grams[np.repeat(fold[at] == k, lengths)], return_counts=True)
                counts[k, np.searchsorted(every, known)] = n
            parts.append(pa.table({"block": pa.array(np.full(len(every), block)), "style": pa.array([style], pa.string()).take(pa.array(np.zeros(len(every), np.int32))),
                                   "gram": pa.array(every), "n0": pa.array(counts[0]), "n1": pa.array(counts[1])}))
        return pa.concat_tables(parts)

    return blocks.joined(trusted, counted, "block bigint, style string, gram bigint, n0 bigint, n1 bigint")


def _part(k: int, column: str = "gram") -> Column:
    """The last k characters of a gram."""
    return F.col(column).bitwiseAND(F.lit((1 << BITS * k) - 1)) if k < ORDER else F.col(column)


def _context() -> Column:
    return F.shiftrightunsigned("gram", BITS)


def _discounts(counts: DataFrame, names: Iterable[str]) -> DataFrame:
    """(style, d1, d2, d3 of each name): discounts for counts of one, two, three and more, from the counts of counts of the style."""
    many = counts.groupBy("style").agg(*[F.sum(F.when(F.col(c) == k, 1).otherwise(0)).alias(f"{c}_{k}") for c in names for k in (1, 2, 3, 4)])
    y = "({c}_1 / greatest({c}_1 + 2 * {c}_2, 1))"
    rule = "greatest(0D, least({k}D, CASE WHEN {c}_{k} > 0 AND {c}_1 > 0 THEN {k} - {j} * " + y + " * {c}_{j} / {c}_{k} ELSE {k} * 0.5D END)) AS {c}_d{k}"
    return stored(many.selectExpr("style", *[rule.format(c=c, k=k, j=k + 1) for c in names for k in (1, 2, 3)]))


def kneser_ney(counts: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """(style, gram, surprise): negative log probability of every gram of ``counts`` (style, gram, n), n = 0 included.

    ``names`` gives several columns of counts and the names of their surprises; each is a model of its own.  Counts of the lower orders
    are numbers of different left neighbours, and the order below is asked only for grams that occur.  Its probabilities are joined
    first; a context's sums then come from its grams, of which there are not more than characters.
    """
    names = {"n": "surprise"} if names is None else names
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        levels.append(stored(levels[-1].groupBy("style", _part(k).alias("gram")).agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in names])))
    # the lowest order is shared evenly by the characters seen and one for all others
    lowest = levels[-1].groupBy("style").agg(*[(1.0 / (F.sum((F.col(c) > 0).cast("long")) + 1)).alias(f"{c}_p") for c in names])
    below, on, context = stored(lowest), ["style"], Window.partitionBy("style", "context")
    for k in range(1, ORDER + 1):
        rows = levels[ORDER - k].withColumns({"context": _context(), "part": _part(k - 1)}).join(below, on)
        rows = rows.join(_discounts(levels[ORDER - k], names), "style").withColumns({
            f"{c}_d": F.expr(f"CASE {c} WHEN 0 THEN 0D WHEN 1 THEN {c}_d1 WHEN 2 THEN {c}_d2 ELSE {c}_d3 END") for c in names})
        sums = rows.select("style", "gram", "context", *[x for c in names for x in (c, f"{c}_p", f"{c}_d")]).withColumns({
            x: f for c in names for x, f in ((f"{c}_total", F.sum(c).over(context)), (f"{c}_left", F.sum(f"{c}_d").over(context)))})
        below = sums.select("style", F.col("gram").alias("part"), *[
            F.expr(f"if({c}_total > 0, ({c} - {c}_d + {c}_left * {c}_p) / {c}_total, {c}_p)").alias(f"{c}_p") for c in names])
        below, on = (stored(below) if k < ORDER else below), ["style", "part"]
    return below.select("style", F.col("part").alias("gram"), *[(-F.log(F.greatest(f"{c}_p", F.lit(1e-12)))).alias(name) for c, name in names.items()])


def block_scores(blocks: Blocks, answers: DataFrame) -> DataFrame:
    """(piece, block, at, style, n) of every row and its sums of the SURPRISES of ``answers`` (block, style, gram)."""
    split, piece_at = blocks.by_style(), blocks.piece

    def scored(block: int, table: pa.Table, right: pa.Table) -> pa.Table:
        grams_of, surprises = right.column("gram").to_numpy(), [right.column(c).to_numpy() for c in SURPRISES]
        styles = right.column("style").combine_chunks().dictionary_encode() if right.num_rows else None
        names = {} if styles is None else {s: k for k, s in enumerate(styles.dictionary.to_pylist())}
        codes = np.zeros(0, np.int64) if styles is None else pc.fill_null(styles.indices, -1).to_numpy(zero_copy_only=False)
        totals, n, own = np.zeros((len(SURPRISES), table.num_rows)), np.zeros(table.num_rows, np.int64), [None] * table.num_rows
        for style, at, lines in split(table):
            mine = np.flatnonzero(codes == (-1 if style is None else names.get(style, -2)))
            mine = mine[np.argsort(grams_of[mine])]
            grams, lengths = ngrams(lines)
            place, ends = np.searchsorted(grams_of[mine], grams), np.cumsum(lengths)
            for total, surprise in zip(totals, surprises):
                sums = np.r_[0.0, np.cumsum(surprise[mine][place], dtype=np.float64)] if len(grams) else np.zeros(1)
                total[at] = sums[ends] - sums[ends - lengths]
            n[at] = lengths
            for k in at.tolist():
                own[k] = style
        return pa.table({"piece": table.column(piece_at), "block": pa.array(np.full(len(n), block)), "at": pa.array(np.arange(len(n), dtype=np.int32)),
                         "style": pa.array(own, pa.string()), "n": pa.array(n), **{c: pa.array(t) for c, t in zip(SURPRISES, totals)}})

    return blocks.joined(answers, scored, f"piece {blocks.kind}, block bigint, at int, style string, n bigint, " + ", ".join(f"{c} double" for c in SURPRISES))


def judged(blocks: Blocks, trusted: DataFrame, piece: str, quantile: float, margin: float) -> DataFrame:
    """(piece, block, at, style, n, perplexity, threshold, keep) of every row of ``blocks``.

    Counts and quantiles take in every line whose key is in ``trusted``; nothing is sampled.  A line that the model has been trained on
    surprises it less than a new one, so quantiles come from two models of half the trusted lines each (``fold``): every trusted line is
    measured by the model that has not seen it.
    """
    # joined by sorting at every size, as the list grows with the corpus
    keys = checkpointed(picked(trusted, piece=piece).where("piece IS NOT NULL").distinct().withColumn(
        "fold", F.xxhash64("piece").bitwiseAND(F.lit(1)).cast("int"))).hint("merge")
    grams = stored(block_grams(blocks, blocks.keys().join(keys, "piece").select("block", "at", "fold")))
    trained = stored(grams.where("style IS NOT NULL").groupBy("style").agg(F.sum(F.col("n0") + F.col("n1")).alias("symbols"))
                     .where(F.col("symbols") >= OWN_SYMBOLS).select("style", F.concat(F.lit("="), "style").alias("model")))

    def named(df: DataFrame) -> DataFrame:
        return df.join(trained, "style", "left").withColumn("model", F.coalesce("model", F.lit(POOLED)))

    def added(df: DataFrame, *by: str | Column) -> DataFrame:
        return df.groupBy(*by).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    own = stored(added(grams, "style", "gram"))
    counts = stored(named(own).where(F.col("model") != POOLED).select(F.col("model").alias("style"), "gram", "n0", "n1").unionByName(
        added(own, "gram").select(F.lit(POOLED).alias("style"), "gram", "n0", "n1")).withColumn("n", F.col("n0") + F.col("n1")))
    models = stored(kneser_ney(counts, {"n": "s", "n0": "s0", "n1": "s1"}).select(
        F.col("style").alias("model"), "gram", *[F.col(c).cast("float").alias(c) for c in ("s", "s0", "s1")]))
    pooled = models.where(F.col("model") == POOLED).select("gram", F.col("s0").alias("p0"), F.col("s1").alias("p1"))
    # only grams of trusted lines are looked up in the models of the other fold
    answers = named(grams).join(models.join(pooled, "gram"), ["model", "gram"]).select("block", "style", "gram", "s", *[
        F.when(F.col(f"n{1 - k}") > 0, F.col(f"{c}{k}")).otherwise(0).cast("float").alias(f"{c}{k}") for c in ("s", "p") for k in (0, 1)])
    scores = stored(block_scores(blocks, answers))
    unseen = named(scores.join(keys, "piece")).selectExpr("model", "n", "if(fold = 0, s1, s0) AS total", "if(fold = 0, p1, p0) AS pooled")
    good = unseen.where(F.col("model") != POOLED).select("model", "n", "total").unionByName(unseen.select(F.lit(POOLED).alias("model"), "n", F.col("pooled").alias("total")))
    means = stored(good.groupBy("model").agg((F.sum("total") / F.greatest(F.sum("n"), F.lit(1))).alias("mean")))
    rate = (F.col("total") + SHRINK * F.coalesce("mean", F.lit(0.0))) / (F.col("n") + SHRINK)
    limits = stored(good.join(means, "model").groupBy("model").agg(
        F.max("mean").alias("mean"), (F.exp(F.percentile_approx(rate, quantile, 10000)) * margin).alias("threshold")))
    out = named(scores).withColumnRenamed("s", "total").join(limits, "model", "left").withColumn("perplexity", F.exp(rate))
    return out.select("piece", "block", "at", "style", "n", "perplexity", F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
                      (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))).alias("keep"))


def line_quality(sequences: DataFrame, trusted: DataFrame, piece: str = "piece", token_line: str = "token_line", style: str = "style",
                 quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Perplexity of every token line and whether it is kept.

    ``sequences`` holds a melody (or any text) per row: its ``piece`` key, ``token_line`` and ``style`` (genre, tradition or language);
    ``trusted`` the keys of lines known to be good.  Returns the key, the style, ``n_symbols``, ``perplexity`` (per character, drawn
    to the style's mean by SHRINK characters), ``threshold`` (the style's quantile over trusted lines times the margin) and ``keep``.
    A null line is empty and kept: it has the style's mean.  A null style, or one with less than OWN_SYMBOLS trusted characters, is judged
    by the pooled model and its quantile.  Without any trusted line there is no model and all are kept (threshold 0).  Repeated rows
    return each; a null key is never trusted; other columns are not looked at.  A line is never split: one block holds it whole.
    """
    src = picked(sequences, piece=piece, line=token_line, style=style)
    out = judged(Blocks(src, "piece", "line", "style"), picked(trusted, piece=piece), "piece", quantile, margin)
    return out.select(F.col("piece").alias(piece), F.col("style").alias(style), F.col("n").alias("n_symbols"), "perplexity", "threshold", "keep")


def kept_lines(sequences: DataFrame, trusted: DataFrame, piece: str = "piece", token_line: str = "token_line", style: str = "style",
               quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """The rows of ``sequences`` that the model keeps, with all their columns."""
    blocks = Blocks(sequences, piece, token_line, style)
    keep = judged(blocks, picked(trusted, piece=piece), "piece", quantile, margin).where("keep").select("block", "at")

    def taken(block: int, table: pa.Table, right: pa.Table) -> pa.Table:
        return table.take(pa.array(np.sort(right.column("at").to_numpy())))

    return blocks.joined(keep, taken, sequences.schema)
