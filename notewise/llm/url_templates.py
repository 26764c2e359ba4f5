"""URL filter by rules and by a tree of path templates with labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewise.llm.frames import picked
from notewise.session import checkpointed

DEPTH = 5
SALTS = 16
#: Weight of the node above in a node's smoothed purity, in labelled addresses.
PRIOR = 8.0
#: Branches less than this many standard errors from their siblings are merged.
APART = 3.0
BLOCK_PURITY = 0.9

Rule = tuple[str, str]


def host_of(url: str) -> Column:
    at = F.expr(f"instr({url}, '://')")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    rest = F.when(F.expr(f"instr({url}, '://')") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: str, path: str, rules: Sequence[Rule]) -> Column:
    """The longest rule (host, path) that fits: its host is the url's or above it, its path a prefix of the url's."""
    cases = [F.when(
        ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith("/" + p), F.lit(f"{h}/{p}"))
        for h, p in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r))]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def shape(segment: Column) -> Column:
    """Variable parts of a path segment as wildcards: numbers, long hexadecimal and mixed identifiers, extensions kept."""
    seg = F.regexp_replace(segment, r"(?i)\b[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\b", "{id}")
    seg = F.regexp_replace(seg, r"(?i)\b(?=[0-9a-f]*[0-9])[0-9a-f]{12,}\b", "{id}")
    return F.regexp_replace(seg, r"[0-9]+", "{n}")


def templates(addresses: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Give every distinct (host, path) its template: array ``steps`` of prefixes, root first.

    ``addresses``: host, path, n, bad, good (counts of addresses and of labelled ones).  Level by level a labelled
    branch stays on its own if no sibling is labelled or its share of bad labels differs from its siblings'; other labelled ones
    become the wildcard branch of their node.  Branches without labels are like no labelled one: they form a branch ``?``.
    Segments below ``depth`` form one last segment.
    """
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", depth)
    rows = addresses.select(
        "host", "path", "n", "bad", "good", F.transform(parts, shape).alias("segments"),
        F.col("host").alias("prefix"), F.array("host").alias("steps"), F.pmod(F.hash("path"), F.lit(SALTS)).alias("salt"))
    for level in range(depth):
        seg = F.get("segments", F.lit(level))
        here = checkpointed(rows.withColumn("seg", seg))
        branch = here.where("seg IS NOT NULL").groupBy("host", "prefix", "seg").agg(
            F.sum("bad").alias("bad"), (F.sum("bad") + F.sum("good")).alias("labelled"))
        node = branch.groupBy("host", "prefix").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
        others = "(all_labelled - labelled)"
        p, q = "(bad / labelled)", f"((all_bad - bad) / nullif({others}, 0))"
        error = f"sqrt((all_bad + 1) / (all_labelled + 2) * (1 - (all_bad + 1) / (all_labelled + 2)) * (1 / labelled + 1 / nullif({others}, 0)))"
        own = branch.where("labelled > 0").join(node, ["host", "prefix"])
        apart = F.expr(f"CASE WHEN {others} = 0 THEN seg WHEN abs({p} - {q}) > {APART} * {error} THEN seg ELSE '*' END")
        kept = own.select("host", "prefix", "seg", apart.alias("kept"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        grown = here.join(kept, ["host", "prefix", "seg", "salt"], "left")
        prefix = F.when(F.col("seg").isNull(), F.col("prefix")).otherwise(
            F.concat("prefix", F.lit("/"), F.coalesce("kept", F.lit("?"))))
        rows = grown.select("host", "path", "n", "bad", "good", "segments", prefix.alias("prefix"), "steps", "salt").withColumn(
            "steps", F.when(F.size("segments") > level, F.concat("steps", F.array("prefix"))).otherwise(F.col("steps")))
    return rows.select("host", "path", "n", "bad", "good", "steps", "salt")


def purities(rows: DataFrame) -> DataFrame:
    """(host, path, template, purity): share of bad labels of the template, smoothed by the nodes above it.

    The root is smoothed towards one half.  Without any label below a node it has one half as well: labels above it are all of
    branches that it isn't known to be like.
    """
    steps = rows.select("host", "path", "bad", "good", F.posexplode("steps").alias("level", "step"), "salt")
    counts = steps.groupBy("step", "level").agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
    spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = steps.select("host", "path", "level", "step", "salt").join(spread, ["step", "level", "salt"])
    way = joined.groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("level", "step", "all_bad", "all_good"))).alias("way"))
    purity = f"aggregate(way, 0.5D, (up, x) -> if(x.all_bad + x.all_good = 0, 0.5D, (x.all_bad + {PRIOR}D * up) / (x.all_bad + x.all_good + {PRIOR}D)))"
    return way.select("host", "path", F.expr("way[size(way) - 1].step").alias("template"), F.expr(purity).alias("purity"))


def url_verdicts(scores: DataFrame, rules_block: Sequence[Rule], rules_allow: Sequence[Rule], piece: str = "piece",
                 uri: str = "source_file", threshold: float = BLOCK_PURITY) -> DataFrame:
    """Judge where score files come from.

    ``scores`` holds a score file per row: its ``piece`` key and its address ``source_file``.  Host: after the first ``://`` up to
    a slash, question mark, hash or the end, A-Z lower-cased; path: from there to the next question mark or hash; a null
    address or one without ``://`` has neither (both empty).  A rule (host, path) fits its host and all hosts below it if the
    path starts with the rule's; the longest wins.  Where none fits, the template decides: what the rules say of other
    addresses are its labels, and a template whose smoothed share of blocked ones exceeds ``threshold`` is blocked.

    Returns per row: the key, ``host``, ``path``, ``rule`` (null if none), ``verdict`` (block, allow), ``template``, ``purity``.
    Repeated rows return each and count each; an address with an empty path has the host as template.  Other columns are not
    looked at.  A host with a third of all rows is aggregated to distinct paths first and its joins are salted.
    """
    src = picked(scores, piece=piece, uri=uri).select("piece", F.col("uri").cast("string").alias("uri"))
    named = src.select("piece", F.coalesce(host_of("uri"), F.lit("")).alias("host"), F.coalesce(path_of("uri"), F.lit("")).alias("path"))
    every = [*rules_block, *rules_allow]
    blocked = [f"{h}/{p}" for h, p in rules_block]
    judged = named.withColumn("rule", fitting_rule("host", "path", every))
    bad = F.col("rule").isin(blocked) if blocked else F.lit(False)
    # rules depend on host and path alone, so counts per distinct address hold all that the tree needs
    addresses = judged.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("rule").isNotNull() & ~bad, 1).otherwise(0)).alias("good"))
    # a table of its own, so that an address with very many rows can be split in the join
    scored = checkpointed(purities(templates(addresses)))
    return judged.join(scored, ["host", "path"], "left").select(
        F.col("piece").alias(piece), "host", "path", "rule",
        F.when(F.col("rule").isin(blocked) if blocked else F.lit(False), "block").when(F.col("rule").isNotNull(), "allow")
        .when(F.col("purity") > threshold, "block").otherwise("allow").alias("verdict"), "template", "purity")
