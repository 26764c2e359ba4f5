"""Aligned pairs: onset mapping between two voices, reference and theme pairing, arcs and trees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.functions import names
from notewise.operators.ordered import dense_index, over
from notewise.operators.splits import dense_ids

# ------------------------------------------------------------------ two voices of one piece


def onset_mapping(dense: DataFrame, sparse: DataFrame, piece: str) -> DataFrame:
    """Map the last k dense notes of every shared onset, in order, to its k sparse notes.

    Both inputs hold piece, idx (note order) and st.  Adds ``pi`` to the dense notes: the
    position of the sparse note, -1 for an inserted note.  All windows are per (piece, onset).
    """
    at = [piece, "st"]
    ranked = dense.selectExpr("*", f"row_number() {over(at, ['idx DESC'])} AS __r")
    target = sparse.selectExpr(piece, "st", "idx AS pi", f"row_number() {over(at, ['idx DESC'])} AS __r")
    return ranked.join(target, [*at, "__r"], "left").withColumn("pi", F.coalesce("pi", F.lit(-1).cast("long"))).drop("__r")


def onset_sizes(dense: DataFrame, sparse: DataFrame, piece: str) -> DataFrame:
    """Notes per (piece, onset) in each voice."""
    both = dense.selectExpr(piece, "st", "1 AS d", "0 AS s").unionByName(sparse.selectExpr(piece, "st", "0 AS d", "1 AS s"))
    return both.groupBy(piece, "st").agg(F.sum("d").alias("n_dense"), F.sum("s").alias("n_sparse"))


def missing_onsets(dense: DataFrame, sparse: DataFrame, piece: str, show: int = 16) -> DataFrame:
    """Pieces with sparse onsets that the dense voice lacks: count and the first ones.

    The listed onsets come from a rank filter, so no piece gathers all of its onsets.
    """
    lost = onset_sizes(dense, sparse, piece).where("n_dense = 0")
    counts = lost.groupBy(piece).agg(F.count("*").alias("n_missing"))
    first = lost.selectExpr(piece, "st", f"row_number() {over([piece], ['st'])} AS r").where(F.col("r") <= show)
    listed = first.groupBy(piece).agg(F.expr("array_sort(collect_list(st)) AS missing"))
    return counts.join(listed, piece)


def out_of_order(mapped: DataFrame, piece: str, block: int = 4096) -> DataFrame:
    """Pieces whose mapped notes are not in the order of their targets.

    Targets are distinct, so the alignment is monotone exactly when ranking the mapped notes by
    position and by target gives the same ranks.
    """
    hit = mapped.where("pi >= 0").select(piece, "idx", "pi")
    by_idx = dense_index(hit, [piece], ["idx"], f"idx div {block}", idx="__a")
    both = dense_index(by_idx, [piece], ["pi"], f"pi div {block}", idx="__b")
    return both.groupBy(piece).agg(F.count_if(F.col("__a") != F.col("__b")).alias("n_wrong")).where("n_wrong > 0")


def common_prefix(mapped: DataFrame, piece: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """First ``budget`` dense notes, and per piece the dense and sparse prefix lengths (k_m, k_s)."""
    kept = mapped.where(F.col("idx") < budget)
    sizes = kept.groupBy(piece).agg(F.count("*").alias("k_m"), (F.max("pi") + 1).alias("k_s"))
    return kept, sizes


def label_pairs(dense: DataFrame, sparse: DataFrame, piece: str, budget: int, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Build aligned pairs: (mapped dense notes, one verdict row per piece).

    The verdict is NULL or the first failed check: onset_not_subset, shared_onset_group_too_small,
    pi_non_monotonic, rho_out_of_range.  rho counts BOS and EOS on both sides.
    """
    mapped = onset_mapping(dense, sparse, piece)
    kept, sizes = common_prefix(mapped, piece, budget)
    groups = onset_sizes(dense, sparse, piece).groupBy(piece).agg(
        F.count_if(F.expr("n_dense = 0")).alias("lost"), F.count_if(F.expr("n_dense > 0 AND n_dense < n_sparse")).alias("small"))
    wrong = out_of_order(mapped, piece)
    v = groups.join(sizes, piece, "left").join(wrong, piece, "left").selectExpr(
        piece, "lost", "small", "coalesce(n_wrong, 0) AS n_wrong", "coalesce(k_m, 0) AS k_m", "coalesce(k_s, 0) AS k_s",
        "(coalesce(k_s, 0) + 2) / CAST(coalesce(k_m, 0) + 2 AS DOUBLE) AS rho")
    reason = (
        "CASE WHEN lost > 0 THEN 'onset_not_subset' WHEN small > 0 THEN 'shared_onset_group_too_small' "
        f"WHEN n_wrong > 0 THEN 'pi_non_monotonic' WHEN NOT ({in_rho_range('rho', low, high)}) THEN 'rho_out_of_range' END")
    return kept, v.selectExpr(piece, "k_m", "k_s", "rho", f"{reason} AS skip_reason")


def in_rho_range(rho: str, low: float, high: float) -> str:
    return f"({rho} >= {low!r}D - 1e-9D AND {rho} <= {high!r}D + 1e-9D)"


def broken_alignments(mapped: DataFrame, piece: str) -> DataFrame:
    """Pieces whose non-negative ``pi`` are not exactly 0..k-1; must be empty for finished pairs."""
    per = mapped.where("pi >= 0").groupBy(piece).agg(
        F.count("*").alias("n"), F.min("pi").alias("lo"), F.max("pi").alias("hi"), F.expr("sum(pi) AS total"), F.expr("sum(pi * pi) AS squares"))
    return per.where("lo <> 0 OR hi <> n - 1 OR total <> n * (n - 1) div 2 OR squares <> (n - 1) * n * (2 * n - 1) div 6")


def uncovered_originals(variants: DataFrame, originals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Original positions that no variant note maps to."""
    return originals.join(variants.where("pi >= 0").selectExpr(*keys, "pi AS i"), [*keys, "i"], "left_anti")


def running_pi(notes: DataFrame, keys: Sequence[str], matched: str) -> DataFrame:
    """``pi`` of a sequence whose skeleton is its own matched notes: their running number, else -1."""
    return notes.selectExpr("*", f"CASE WHEN {matched} THEN sum(CASE WHEN {matched} THEN 1 ELSE 0 END) {over(keys, ['i'])} - 1 ELSE -1 END AS pi")


def resolve_voices(channels: DataFrame, piece: str, channel: str, dense_label: str, sparse_label: str) -> DataFrame:
    """Pick the dense and the sparse channel of a piece: by unique best name match, else, with exactly
    two sounding channels of different size, the larger is dense.  Channels need track_name,
    instrument_name and note_count."""
    text = [F.col("track_name"), F.col("instrument_name")]
    scored = channels.where("note_count > 0").withColumn("d", names.label_match(text, dense_label)).withColumn("s", names.label_match(text, sparse_label))
    aggs = [F.expr("count(*) AS n"), F.expr(f"max_by({channel}, note_count) AS big"), F.expr(f"min_by({channel}, note_count) AS small"),
            F.expr("max(note_count) <> min(note_count) AS differ")]
    for c in ("d", "s"):
        for level in (3, 2, 1):
            aggs.append(F.expr(f"struct(count_if({c} = {level}) AS n, max(CASE WHEN {c} = {level} THEN {channel} END) AS ch) AS {c}{level}"))
    pick = lambda c: (
        f"CASE WHEN {c}3.n > 0 THEN CASE WHEN {c}3.n = 1 THEN {c}3.ch END WHEN {c}2.n > 0 THEN CASE WHEN {c}2.n = 1 THEN {c}2.ch END "
        f"WHEN {c}1.n = 1 THEN {c}1.ch END")
    one = scored.groupBy(piece).agg(*aggs).selectExpr(piece, "n", "big", "small", "differ", f"{pick('d')} AS by_d", f"{pick('s')} AS by_s")
    named = "by_d IS NOT NULL AND by_s IS NOT NULL AND by_d <> by_s"
    return one.selectExpr(
        piece, f"CASE WHEN {named} THEN 'name' WHEN n = 2 AND differ THEN 'note_count' ELSE 'unresolved' END AS strategy",
        f"CASE WHEN {named} THEN by_d WHEN n = 2 AND differ THEN big END AS dense", f"CASE WHEN {named} THEN by_s WHEN n = 2 AND differ THEN small END AS sparse")


# ------------------------------------------------------------------ pairs of pieces


def reference_pairs(labels: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pair songs (song, family) with their family's first reference (family, reference, line).

    Returns the non-self pairs with the family's order and a one-row count of what was left out.
    """
    first = references.groupBy("family").agg(F.min_by("reference", "line").alias("reference"), F.min("line").alias("family_order"))
    joined = labels.join(first, "family", "left")
    stats = joined.agg(
        F.count("*").alias("songs_total"), F.count_if(F.col("reference").isNull()).alias("missing_reference"),
        F.count_if(F.col("reference") == F.col("song")).alias("self_pairs"))
    return joined.where("reference IS NOT NULL AND reference <> song"), stats


def with_files(pairs: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Keep pairs whose file exists."""
    return pairs.join(files.select(F.col("path").alias(column)).distinct(), column, "left_semi")


def theme_variation_pairs(files: DataFrame, name: str) -> DataFrame:
    """Pair every variation with the theme of the same opus and phrase base; the shortest theme key wins."""
    parsed = files.withColumn("p", names.catalogue_parts(F.col(name))).where("p IS NOT NULL").withColumn("base", names.phrase_base(F.col("p.phrase"))).where("base IS NOT NULL")
    themes = parsed.where("p.is_theme").groupBy(F.col("p.opus").alias("opus"), "base").agg(
        F.min(F.struct(F.length("p.phrase").alias("len"), F.col("p.phrase").alias("phrase"), F.col(name).alias("file"))).alias("t"))
    variations = parsed.where("NOT p.is_theme").select(
        F.col("p.opus").alias("opus"), "base", F.col("p.var_id").alias("variation"), F.col("p.phrase").alias("var_phrase"), F.col(name).alias("variation_file"))
    return variations.join(themes, ["opus", "base"]).select(
        "opus", "base", "variation", "var_phrase", "variation_file", F.col("t.file").alias("theme_file"))


def distinct_files(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct files over several pair columns."""
    out = pairs.select(F.col(columns[0]).alias("file"))
    for c in columns[1:]:
        out = out.union(pairs.select(F.col(c).alias("file")))
    return out.distinct()


#: Notes of each side that take part in silver labels.
SILVER_NOTES = 510


@dataclass(frozen=True)
class SilverLimits:
    """What a theme and variation pair must reach to become a labelled example."""

    notes: int = SILVER_NOTES
    theme_notes: int = 6
    variation_notes: int = 10
    skeleton_notes: int = 6
    score: float = 0.5
    matches: int = 6
    coverage: float = 0.7
    span: float = 0.8
    low_rho: float = 1 / 3
    high_rho: float = 1.0


def silver_labels(matches: DataFrame, lengths: DataFrame, pair: str, limits: SilverLimits = SilverLimits()) -> tuple[DataFrame, DataFrame]:
    """Labels and verdicts of aligned pairs.

    ``matches`` holds pair, theme_i, var_i, score of the first ``limits.notes`` notes of each side; ``lengths`` pair, n_theme, n_var
    of the whole sides and has a row for every candidate pair.  The matched variation notes of score enough are the skeleton.
    Labels: these matches of the accepted pairs with pi, their running number.  Verdicts: one row for every candidate with
    ``kept`` matches, ``coverage`` of the shorter side, ``rho`` (BOS and EOS counted on both sides) and ``skip_reason``: NULL or the
    first of parse_or_empty (a side without notes, or null), too_short, low_alignment, rho_out_of_range.
    """
    m = limits
    good = matches.where(F.col("score") >= m.score)
    found = good.groupBy(pair).agg(F.count("*").alias("kept"), F.countDistinct("var_i").alias("skeleton"), F.min("var_i").alias("lo"), F.max("var_i").alias("hi"))
    sized = lengths.join(found, pair, "left").selectExpr(
        pair, "n_theme", "n_var", "coalesce(kept, 0L) AS kept", "coalesce(skeleton, 0L) AS skeleton", "lo", "hi",
        f"least(coalesce(n_theme, 0), {m.notes}) AS t", f"least(coalesce(n_var, 0), {m.notes}) AS v")
    measured = sized.selectExpr(
        "*", "kept / CAST(greatest(1, least(t, v)) AS DOUBLE) AS coverage", "(skeleton + 2) / CAST(v + 2 AS DOUBLE) AS rho",
        "CASE WHEN v >= 2 AND skeleton >= 2 THEN (hi - lo) / CAST(v - 1 AS DOUBLE) ELSE 1D END AS reach")
    reason = (
        f"CASE WHEN t <= 0 OR v <= 0 THEN 'parse_or_empty' WHEN n_theme < {m.theme_notes} OR n_var < {m.variation_notes} THEN 'too_short' "
        f"WHEN kept < {m.matches} OR coverage < {m.coverage!r}D OR skeleton < {m.skeleton_notes} OR reach < {m.span!r}D THEN 'low_alignment' "
        f"WHEN NOT {in_rho_range('rho', m.low_rho, m.high_rho)} THEN 'rho_out_of_range' END")
    verdicts = measured.selectExpr(pair, "n_theme", "n_var", "kept", "coverage", "rho", f"{reason} AS skip_reason")
    accepted = verdicts.where("skip_reason IS NULL").select(pair)
    labels = good.join(accepted, pair, "left_semi").selectExpr("*", f"row_number() {over([pair], ['var_i'])} - 1 AS pi")
    return labels, verdicts


# ------------------------------------------------------------------ arcs and trees


def candidate_arc(head: str, dep: str, head_rest: str, dep_rest: str) -> str:
    """Rule of a possible arc: root loop, or distinct ends with a non-root dependent and no rests.

    The candidates of a piece are never listed: membership is this predicate, their number is
    a closed form of the notes.
    """
    return f"(({head} = 0 AND {dep} = 0) OR ({head} <> {dep} AND {dep} <> 0 AND NOT coalesce({head_rest}, false) AND NOT coalesce({dep_rest}, false)))"


def candidate_counts(nodes: DataFrame, arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates, gold arcs and gold arcs outside the candidates per piece.

    ``nodes``: keys, node (1..N), is_rest.  ``arcs``: keys, head, dep with root 0.
    """
    sizes = nodes.groupBy(*keys).agg(F.count_if(~F.col("is_rest")).alias("sounding"))
    head = nodes.selectExpr(*keys, "node AS head", "is_rest AS head_rest")
    dep = nodes.selectExpr(*keys, "node AS dep", "is_rest AS dep_rest")
    checked = arcs.join(head, [*keys, "head"], "left").join(dep, [*keys, "dep"], "left")
    gold = checked.groupBy(*keys).agg(
        F.count("*").alias("n_gold"), F.count_if(~F.expr(candidate_arc("head", "dep", "head_rest", "dep_rest"))).alias("n_outside"))
    # root or any sounding node to any other sounding node, plus the root loop
    return sizes.join(gold, list(keys)).selectExpr(*keys, "sounding * sounding + 1 AS n_candidates", "n_gold", "n_outside")


def many_headed(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dependents with more than one head."""
    return arcs.groupBy(*keys, "dep").agg(F.count("*").alias("n_heads")).where("n_heads <> 1")


def tree_depth(arcs: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Depth of every node of bounded trees (one window of notes each); the root's child has depth 0.

    Heads are laid out as one array per tree and every round doubles the jump, so the number of
    rounds follows from the tree's size.  Nodes that never reach the root get NULL.
    """
    heads = arcs.where("dep <> 0").groupBy(*keys, "dep").agg(F.min("head").alias("head"))
    tree = nodes.select(*keys, F.col("node").alias("dep")).join(heads, [*keys, "dep"], "left").groupBy(*keys).agg(
        F.expr("transform(array_sort(collect_list(struct(dep, head))), x -> x.head) AS anc"))
    jump = ("struct(transform(s.anc, a -> CASE WHEN a > 0 THEN s.anc[CAST(a - 1 AS INT)] ELSE a END) AS anc, "
            "transform(s.dist, (d, j) -> CASE WHEN s.anc[j] > 0 THEN d + s.dist[CAST(s.anc[j] - 1 AS INT)] ELSE d END) AS dist)")
    done = tree.selectExpr(*keys, f"aggregate(sequence(1, CAST(ceil(log2(size(anc) + 1)) AS INT) + 1), struct(anc, transform(anc, a -> 1) AS dist), (s, r) -> {jump}) AS t")
    return done.selectExpr(*keys, "posexplode(transform(t.dist, (d, j) -> CASE WHEN t.anc[j] = 0 THEN d - 1 END)) AS (j, depth)").selectExpr(
        *keys, "j + 1 AS node", "depth")


def token_depths(tokens: DataFrame, depths: DataFrame, keys: Sequence[str], temperature: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Gather tree depths to token rows.

    ``tokens``: keys, pos, note (position of the token's note, -1 for BOS, EOS and padding); ``depths``: keys, node (note + 1),
    depth.  Adds ``depth``, -1 where there is no note or the node never reaches the root, and ``score`` = exp(-depth /
    temperature), 0 there.  The second result holds the tokens whose note the tree does not have; it must be empty.
    """
    t = max(float(temperature), 1e-6)
    nodes = depths.selectExpr(*keys, "node", "depth AS __depth", "true AS __known")
    joined = tokens.withColumn("node", F.col("note") + 1).join(nodes, [*keys, "node"], "left").drop("node")
    unknown = joined.where("note >= 0 AND __known IS NULL").select(*tokens.columns)
    found = joined.selectExpr(*tokens.columns, "CASE WHEN note >= 0 THEN coalesce(__depth, -1) ELSE -1 END AS depth")
    return found.selectExpr("*", f"CASE WHEN depth >= 0 THEN exp(-depth / {t!r}D) ELSE 0D END AS score"), unknown


def ordinal_notes(notes: DataFrame, ids: DataFrame, piece: str) -> DataFrame:
    """Resolve (measure, ordinal) ids to note positions.

    Numbering may ignore the first one or two elements of a piece; the first of the three
    attempts that resolves every id of the piece is used.
    """
    tries = notes.selectExpr(piece, "idx", "measure", "explode(array(0, 1, 2)) AS skip").where("idx >= skip")
    numbered = tries.selectExpr("*", f"row_number() {over([piece, 'skip', 'measure'], ['idx'])} AS ordinal")
    found = ids.join(numbered, [piece, "measure", "ordinal"])
    wanted = ids.groupBy(piece).agg(F.count("*").alias("n_ids"))
    hit = found.groupBy(piece, "skip").agg(F.count("*").alias("n_hit")).join(wanted, piece).where("n_hit = n_ids")
    best = hit.groupBy(piece).agg(F.min("skip").alias("skip"))
    return found.join(best, [piece, "skip"])


def retrieval_corpus(pairs: DataFrame, melodies: DataFrame, member: str, reference: str, order: str,
                     min_doc: int, min_query: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries and skip counts of a member-to-reference retrieval set.

    ``melodies`` holds piece and n_notes.  References with enough notes get dense document ids in
    ``order``; members with enough notes whose reference stayed become queries.
    """
    ref = melodies.selectExpr(f"piece AS {reference}", "n_notes AS ref_notes")
    mem = melodies.selectExpr(f"piece AS {member}", "n_notes AS member_notes")
    sized = pairs.join(ref, reference, "left").join(mem, member, "left")
    reason = (f"CASE WHEN ref_notes IS NULL OR ref_notes < {min_doc} THEN 'short_document' "
              f"WHEN member_notes IS NULL OR member_notes < {min_query} THEN 'short_query' END")
    judged = sized.selectExpr("*", f"{reason} AS skip_reason")
    kept = judged.where("skip_reason IS NULL")
    docs = dense_ids(kept.select(reference, order).distinct(), [order, reference])
    queries = kept.join(docs.select(reference, "doc_id"), reference).withColumnRenamed("doc_id", "target_doc_id")
    skips = judged.where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))
    return docs, queries, skips
