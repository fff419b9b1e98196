"""Iterative joins: trust levels and reverse-dependency closures. Each round is written to shared storage.

Where every node has one parent at most, pointers to ancestors double in each round, so that a chain of n nodes takes
log2(n) rounds; graphs whose nodes have several parents, or that hold cycles, are followed level by level.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylake.parsers.frames import verify_pairs
from keylake.session import materialize


#: So many levels, and then so many of their unions, are written again as one, so that a plan stays small at any depth.
MERGE = 8


class _Levels:
    """Written levels; all() is their union."""

    def __init__(self, first: DataFrame) -> None:
        self.tiers: list[list[DataFrame]] = [[first]]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [df for tier in self.tiers for df in tier])

    def add(self, level: DataFrame) -> None:
        self.tiers[0].append(level)
        for k, tier in enumerate(self.tiers):
            if len(tier) < MERGE:
                break
            if k + 1 == len(self.tiers):
                self.tiers.append([])
            self.tiers[k + 1].append(materialize(reduce(DataFrame.unionByName, tier), "levels"))
            self.tiers[k] = []


def _numbers(max_level: int | None):
    return count(1) if max_level is None else range(1, max_level + 1)


def _parents(edges: DataFrame) -> DataFrame | None:
    """(node, top): each node's parent, if no node has two and none is its own; else None."""
    pairs = materialize(edges.select(F.col("dst").alias("node"), F.col("src").alias("top")).where("node is not null and top is not null").distinct(), "parents")
    odd = pairs.groupBy("node").agg(F.count("*").alias("n"), F.bool_or(F.col("node") == F.col("top")).alias("own")).where("n > 1 or own")
    return pairs if odd.isEmpty() else None


def _doubled(state: DataFrame, joined) -> DataFrame | None:
    """The last state (node, top, ...) of pointer doubling; joined(state, state as (above, then, ...)) is one round. None for cycles."""
    rounds = max(1, state.count().bit_length()) + 1
    for _ in range(rounds):
        if state.where("top is not null").isEmpty():
            return state
        state = materialize(joined(state), "doubled")
    return None


def _distances(edges: DataFrame, seeds: DataFrame) -> DataFrame | None:
    """(node, level) by pointer doubling: the steps to the nearest seed among a node and its ancestors."""
    parents = _parents(edges)
    if parents is None:
        return None
    nodes = parents.unionByName(parents.select(F.col("top").alias("node")).unionByName(seeds.select("node")).distinct().join(parents, "node", "left_anti").withColumn("top", F.lit(None).cast(parents.schema["top"].dataType)))
    marked = nodes.join(seeds.select("node").distinct().withColumn("level", F.lit(0)), "node", "left")
    state = materialize(marked.withColumn("hops", F.lit(1)), "doubled")  # hops: how many nodes, its own included, are known

    def round_(s: DataFrame) -> DataFrame:
        above = s.select(F.col("node").alias("top"), F.col("top").alias("then"), F.col("level").alias("further"), F.col("hops").alias("more"))
        return s.join(above, "top", "left").select("node", F.col("then").alias("top"), F.coalesce("level", F.col("further") + F.col("hops")).alias("level"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))

    found = _doubled(state, round_)
    return None if found is None else found.where("level is not null").select("node", "level")


def _lines(edges: DataFrame) -> DataFrame | None:
    """(node, line) by pointer doubling: all ancestors of each node that has any, the nearest first."""
    parents = _parents(edges)
    if parents is None:
        return None

    def round_(s: DataFrame) -> DataFrame:
        above = s.select(F.col("node").alias("top"), F.col("top").alias("then"), F.col("line").alias("further"))
        return s.join(above, "top", "left").select("node", F.col("then").alias("top"), F.concat("line", F.coalesce("further", F.array().cast(s.schema["line"].dataType))).alias("line"))

    found = _doubled(materialize(parents.withColumn("line", F.array("top")), "doubled"), round_)
    return None if found is None else found.select("node", "line")


def reach(edges: DataFrame, seeds: DataFrame, max_level: int | None = None) -> DataFrame:
    """(node, level): nodes reached from seeds (node) along edges (src, dst) at their least level; cycles end by themselves.

    Without max_level, nodes of one parent each are reached in log2(depth) rounds; else there is a round for each level, up
    to the first without a new node, or to max_level.
    """
    found = _distances(edges, seeds) if max_level is None else None
    if found is not None:
        return found
    frontier = materialize(seeds.select("node").distinct().withColumn("level", F.lit(0)), "level")
    levels = _Levels(frontier)
    for level in _numbers(max_level):
        step = edges.join(frontier, edges.src == frontier.node).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(levels.all(), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            break
        levels.add(frontier)
    return levels.all()


def trust_levels(candidates: DataFrame, roots: DataFrame, max_level: int = 9) -> DataFrame:
    """(subject, level) of candidates (subject, issuer) that a chain of issuers leads from a root; roots are level 0."""
    edges = candidates.where("subject <> issuer").select(F.col("issuer").alias("src"), F.col("subject").alias("dst"))
    return reach(edges, roots.select(F.col("subject").alias("node")), max_level).withColumnRenamed("node", "subject")


def affected(deps: DataFrame, seeds: DataFrame) -> DataFrame:
    """(library, level): libraries that depend on seeds (library), directly at level 1 or through others; deps (library, needs)."""
    edges = deps.select(F.col("needs").alias("src"), F.col("library").alias("dst")).distinct()
    return reach(edges, seeds.select(F.col("library").alias("node"))).where("level > 0").withColumnRenamed("node", "library")


def verified_levels(candidates: DataFrame, roots: DataFrame, max_level: int = 9) -> DataFrame:
    """(fprint, parent, level) of parsed CA certificates, a level at a time: each verifies under one of a lower level.

    candidates and roots have fprint and the columns of parsed certificates. Expiry is ignored. Ends at the first level
    without a certificate.
    """
    placed = materialize(roots.withColumn("level", F.lit(0)).withColumn("parent", F.lit(None).cast("string")), "trust")
    out, frontier = placed.select("fprint", "parent", "level"), placed
    for level in range(1, max_level + 1):
        left = candidates.join(out.select("fprint"), "fprint", "left_anti")
        joined = verify_pairs(left, frontier, "fprint")
        rest = [c for c in left.columns if c != "fprint"]
        step = joined.groupBy("fprint").agg(F.min("parent").alias("parent"), *[F.any_value(c).alias(c) for c in rest]).withColumn("level", F.lit(level))
        frontier = materialize(step, "trust")
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier.select("fprint", "parent", "level"))
    return out


def paths(edges: DataFrame, seeds: DataFrame, max_level: int | None = None) -> DataFrame:
    """(seed, node, parent, level, path, nodes): one path, the least, to each node that a seed reaches; cycles end by themselves.

    Rounds are as in reach(). nodes is the seed, those between, and the node; path is these with slashes between.
    """
    lines = _lines(edges) if max_level is None else None
    if lines is not None:
        met = lines.select("node", F.posexplode("line").alias("pos", "seed")).join(seeds.select(F.col("node").alias("seed")).distinct(), "seed")
        own = met.join(lines, "node")
        below = own.select("seed", "node", F.col("line")[0].alias("parent"), (F.col("pos") + 1).alias("level"), F.concat(F.reverse(F.slice("line", 1, F.col("pos") + 1)), F.array("node")).alias("nodes"))
        start = seeds.select(F.col("node").alias("seed"), "node", F.lit(None).cast(seeds.schema["node"].dataType).alias("parent"), F.lit(0).alias("level"), F.array("node").alias("nodes")).distinct()
        return start.unionByName(below).select("seed", "node", "parent", "level", F.array_join(F.col("nodes").cast("array<string>"), "/").alias("path"), "nodes")
    start = seeds.select(F.col("node").alias("seed"), "node", F.lit(None).cast(seeds.schema["node"].dataType).alias("parent"), F.lit(0).alias("level"), F.col("node").cast("string").alias("path"), F.array("node").alias("nodes"))
    frontier = materialize(start.distinct(), "paths")
    levels = _Levels(frontier)
    for level in _numbers(max_level):
        step = frontier.join(edges, frontier.node == edges.src).select("seed", F.col("dst").alias("node"), F.col("node").alias("parent"), F.lit(level).alias("level"), F.concat("path", F.lit("/"), F.col("dst").cast("string")).alias("path"), F.concat("nodes", F.array("dst")).alias("nodes"))
        best = step.groupBy("seed", "node").agg(F.min_by(F.struct("parent", "level", "path", "nodes"), "path").alias("b")).select("seed", "node", "b.*")
        frontier = materialize(best.join(levels.all().select("seed", "node"), ["seed", "node"], "left_anti"), "paths")
        if frontier.isEmpty():
            break
        levels.add(frontier)
    return levels.all()


def to_tree_json(found: DataFrame) -> DataFrame:
    """(seed, tree): the nodes of paths() as one nested JSON object a seed, {"node": {"child": {...}, ...}}, children in order.

    Sorted by paths, nodes stand as a walk through the tree meets them; what to close and open before a node follows from
    its level and the one before, so a tree of any depth is one sort and one join of strings, without a round for each level.
    """
    name = F.to_json(F.array(F.col("node").cast("string")))
    rows = found.select("seed", F.struct("nodes", "level", F.substring(name, 2, F.length(name) - 2).alias("name")).alias("r"))
    walk = rows.groupBy("seed").agg(F.array_sort(F.collect_list("r")).alias("w"))  # a document is one row
    before = F.concat(F.array(F.lit(-1)), F.slice("w.level", 1, F.size("w") - 1))
    parts = F.zip_with("w", before, lambda x, level: F.concat(F.when(level < x["level"], F.lit("")).otherwise(F.concat(F.repeat(F.lit("}"), level - x["level"] + 1), F.lit(","))), x["name"], F.lit(":{")))
    return walk.select("seed", F.concat(F.lit("{"), F.array_join(parts, ""), F.repeat(F.lit("}"), F.element_at("w.level", -1) + 2)).alias("tree"))
