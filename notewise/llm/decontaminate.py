"""Benchmark fragments inside pieces: size-partitioned MinHash containment search, verified exactly.  SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.llm.frames import picked, text_of
from notewise.session import checkpointed

WORDS = 5
CONTAINMENT = 0.8
#: Bits of the membership table that shingles pass before anything is joined, as powers of two: 16 a shingle of the fragments
#: between 128 KB and 2 MB.
FILTER_BITS = (20, 24)
SALTS = 16


def words_of(line: str) -> Column:
    """Lower-case words: runs of letters and digits of any script (one empty word where there are none)."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.col(line)), r"[^\p{L}\p{N}]+", " ")), " ")


def computed(value: Column) -> Column:
    """The value computed once for each row: as a generator's output it isn't copied into the expressions and filters that use it."""
    return F.explode(F.array(value))


def _shingle(i: str) -> str:
    return f"concat_ws(' ', {', '.join(f'words[{i} + {k}]' for k in range(WORDS))})"


def _hash(i: str) -> str:
    return f"xxhash64({', '.join(f'words[{i} + {k}]' for k in range(WORDS))})"


def shingled_fragments(fragments: DataFrame, containment: float) -> DataFrame:
    """(fragment, shingle, h, n, in_sketch): distinct shingles, and whether they are in the fragment's MinHash sketch.

    The sketch is the bottom of the shingles' hashes.  Fragments are partitioned by size, [2^c, 2^(c+1)); the sketch of a
    class has one shingle more than its largest member may miss, so a piece that contains enough of a fragment contains
    one of its sketch at least: no fragment is lost.
    """
    words = fragments.select("fragment", computed(words_of("line")).alias("words")).where(f"size(words) >= {WORDS}")
    rows = words.select("fragment", "words", F.explode(F.expr(f"sequence(0, size(words) - {WORDS})")).alias("i")).selectExpr(
        "fragment", f"{_shingle('i')} AS shingle", f"{_hash('i')} AS h").distinct()
    sizes = rows.groupBy("fragment").agg(F.count("*").alias("n"))
    largest = "(CAST(pow(2, floor(log2(n)) + 1) AS BIGINT) - 1)"
    sketch = f"({largest} - CAST(ceil({containment}D * {largest} - 1e-9D) AS BIGINT) + 1)"
    return rows.join(sizes, "fragment").selectExpr(
        "fragment", "shingle", "h", "n", f"row_number() OVER (PARTITION BY fragment ORDER BY h, shingle) <= {sketch} AS in_sketch")


def table_bits(shingles: int) -> int:
    """Power of two of the membership table for so many shingles."""
    return max(FILTER_BITS[0], min(FILTER_BITS[1], (16 * shingles - 1).bit_length()))


def membership(shingles: DataFrame, power: int) -> DataFrame:
    """One row: a table of 2^power bits (array of longs) of the shingles' hashes."""
    slot = f"(h & {(1 << power) - 1}L)"
    bits = shingles.selectExpr(f"shiftright({slot}, 6) AS id", f"shiftleft(1L, CAST({slot} & 63L AS INT)) AS bit").groupBy("id").agg(
        F.bit_or("bit").alias("bits"))
    dense = shingles.sparkSession.range(1 << (power - 6)).join(bits, "id", "left").selectExpr("struct(id, coalesce(bits, 0L) AS bits) AS x")
    return dense.agg(F.sort_array(F.collect_list("x")).alias("x")).select(F.col("x.bits").alias("bits"))


def contained_fragments(sequences: DataFrame, fragments: DataFrame, piece: str = "piece", token_line: str = "token_line",
                        fragment: str = "query_id", fragment_line: str = "token_line", containment: float = CONTAINMENT) -> DataFrame:
    """Which pieces contain which benchmark fragments.

    ``sequences`` holds a melody (or any text) per row: its ``piece`` key and ``token_line``; ``fragments`` the query fragments that
    must not be in the training corpus: their ``query_id`` and ``token_line``.  A fragment is contained if at least
    ``containment`` of its distinct word five-shingles are in the piece.  Returns (piece key, fragment key, ``n_shingles``,
    ``n_shared``, ``containment``), one row for each pair.  Fragments and pieces of fewer than five words (null lines too) have no
    shingle and never match; rows that repeat a key are taken together; null keys take no part; other columns are not
    looked at.  Pieces are read once: their shingles pass a bit table, and only what passes is shuffled.  Candidates are the pairs
    that share a sketch shingle by its hash; exact shingles are counted for candidates alone.
    """
    items = picked(fragments, fragment=fragment, line=fragment_line).where("fragment IS NOT NULL").select("fragment", text_of("line").alias("line"))
    shingles = checkpointed(shingled_fragments(items, containment))
    power = table_bits(shingles.count())
    table = membership(shingles, power).scalar()
    lines = picked(sequences, piece=piece, line=token_line).where("piece IS NOT NULL").select("piece", text_of("line").alias("line"))
    words = lines.select("piece", computed(words_of("line")).alias("words")).where(f"size(words) >= {WORDS}")
    slot = f"{_hash('i')} & {(1 << power) - 1}L"
    passed = words.select("piece", "words", table.alias("bits")).select("piece", "words", computed(F.expr(
        f"filter(sequence(0, size(words) - {WORDS}), i -> transform(array({slot}), "
        "s -> shiftright(bits[CAST(shiftright(s, 6) AS INT)], CAST(s & 63L AS INT)) & 1L)[0] = 1L)")).alias("places")).where("size(places) > 0")
    shown = passed.select("piece", F.explode(F.expr(f"array_distinct(transform(places, i -> struct({_hash('i')} AS h, {_shingle('i')} AS shingle)))")).alias("x"))
    hits = checkpointed(shown.selectExpr("piece", "x.h", "x.shingle").distinct())
    salted = hits.select("piece", "h", F.pmod(F.xxhash64("piece"), F.lit(SALTS)).alias("salt"))
    spread = shingles.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    candidates = salted.join(spread.where("in_sketch").select("h", "salt", "fragment"), ["h", "salt"]).select("piece", "fragment", "salt").distinct()
    wanted = candidates.join(spread.select("fragment", "salt", "shingle", "n"), ["fragment", "salt"])
    shared = wanted.join(hits.select("piece", "shingle"), ["piece", "shingle"]).groupBy("piece", "fragment").agg(
        F.count("*").alias("n_shared"), F.max("n").alias("n_shingles"))
    verified = shared.where(f"n_shared >= {containment}D * n_shingles - 1e-9D")
    out = fragment if fragment != piece else f"{fragment}_fragment"
    return verified.select(F.col("piece").alias(piece), F.col("fragment").alias(out), "n_shingles", "n_shared",
                           (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def without_fragments(documents: DataFrame, fragments: DataFrame, piece: str = "piece", token_line: str = "token_line", fragment: str = "query_id",
                      fragment_line: str = "token_line", containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``documents`` that contain none of the fragments; rows with a null key stay."""
    found = contained_fragments(documents, fragments, piece, token_line, fragment, fragment_line, containment).select(piece).distinct()
    return documents.join(checkpointed(found), piece, "left_anti").select(documents.columns)
