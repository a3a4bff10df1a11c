"""Graph operators over edges (src depends on dst): closures, components, levels, cycles and updates.

Closures grow by doubling: each round joins the pairs found so far with themselves, so a path of length n takes log n
rounds, and cycles end by themselves; only what must return a closure builds one. Walks, levels and colours take as many
rounds as the longest path. Rounds cut their lineage with checkpoint().
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> None:
    """A checkpoint folder: the cluster's; only in local mode a temporary one where none is set, elsewhere that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if folder is None:
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def merged(a: DataFrame, b: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """A join on columns, sorted and merged whatever the sides' sizes: both grow with the graph, and a broadcast would send one through the driver in each round.

    The first column is changed in the key, so that both sides are shuffled even where one is partitioned by it already:
    only then can adaptive execution split the partitions of hot nodes.
    """
    first = on[0]
    kind = {x.schema[first].dataType.typeName() for x in (a, b)}
    key = F.col(first)
    if kind <= {"byte", "short", "integer", "long"}:
        key = key.cast("long").bitwiseXOR(F.lit(0x5BD1E995))
    elif kind == {"string"}:
        key = F.concat(key, F.lit("\0"))
    out = [*a.columns, *(c for c in b.columns if c not in on and how not in ("left_anti", "left_semi"))]
    return a.withColumn("k_", key).join(b.withColumn("k_", key).drop(first).hint("merge"), ["k_", *on[1:]], how).select(*out)


def paths(edges: DataFrame) -> DataFrame:
    """(root, node) for every path of one edge or more."""
    ready(edges.sparkSession)
    found = edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct().checkpoint()
    n = found.count()
    while True:
        further = found.select("root", F.col("node").alias("mid")).join(found.select(F.col("root").alias("mid"), "node"), "mid").select("root", "node")
        found = found.union(further).distinct().checkpoint()
        m = found.count()
        if m == n:
            return found
        n = m


def forward_closure(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(root, node): everything that a node depends on, itself included."""
    everyone = nodes if nodes is not None else nodes_of(edges)
    return paths(edges).union(everyone.select(F.col("node").alias("root"), "node")).distinct()


def reverse_closure(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(root, node): everything that depends on a node, itself included."""
    return forward_closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes)


class Seen:
    """What a walk has found, round by round: each round's rows stay where they were written, and are put together again only now and then."""

    def __init__(self, first: DataFrame, parts: int = 12):
        self.parts, self.most = [first], parts

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)

    def add(self, more: DataFrame) -> None:
        self.parts.append(more)
        if len(self.parts) > self.most:
            self.parts = [self.all().checkpoint()]


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) reachable from the roots (node), roots included: a frontier walk, for few roots."""
    ready(edges.sparkSession)
    frontier = roots.select("node").distinct().checkpoint()
    seen = Seen(frontier)
    while not frontier.isEmpty():
        step = merged(frontier, edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct()
        frontier = merged(step, seen.all(), "node", how="left_anti").checkpoint()
        seen.add(frontier)
    return seen.all()


def closure_minus_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return merged(reached(edges, roots), roots.select("node"), "node", how="left_anti")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges whose ends both lie on longer and longer walks: no edge of a cycle goes, nearly all others do."""
    n = edges.count()
    while True:
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").checkpoint()
        m = edges.count()
        if m == n:
            return edges
        n = m


def colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches the node, itself included."""
    now = nodes_of(edges).select("node", F.col("node").alias("colour")).checkpoint()
    while True:
        told = edges.join(now.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("told"))
        new = now.join(told, "node", "left").select("node", F.least("colour", F.coalesce("told", "colour")).alias("colour"), (F.col("told") < F.col("colour")).alias("changed")).checkpoint()
        now = new.select("node", "colour")
        if new.where("changed").isEmpty():
            return now


def components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of strongly connected components with several nodes; named by their smallest node.

    Nodes off all cycles are trimmed first. Of the rest each node takes the smallest node that reaches it as its colour;
    the nodes of a colour that reach its namesake back are one component, and the others go into the next round. What is
    held is a row for each node and edge, never a closure.
    """
    ready(edges.sparkSession)
    left = trimmed(edges.select("src", "dst").where("src <> dst").distinct().checkpoint())
    out = None
    while not left.isEmpty():
        of = colours(left)
        side = lambda c: of.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_of"))  # noqa: B023,E731
        inside = left.join(side("src"), "src").join(side("dst"), "dst").where("src_of = dst_of").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = merged(reached(inside.checkpoint(), of.where("node = colour").select("node")), of, "node").checkpoint()
        out = found if out is None else out.union(found).checkpoint()
        gone = found.select("node")
        left = trimmed(left.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst").checkpoint())
    if out is None:
        return nodes_of(edges).where("false").select("node", F.col("node").alias("component"), F.lit(0).cast("long").alias("size"))
    sizes = out.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("size")).where("size > 1")
    return out.join(sizes, "colour").select("node", "component", "size")


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    return components(edges).select("node").union(edges.where("src = dst").select(F.col("src").alias("node"))).distinct()


def has_cycle(edges: DataFrame) -> bool:
    return not cycle_members(edges).isEmpty()


def without_cycle_edges(edges: DataFrame, updated: DataFrame) -> DataFrame:
    """Edges but those inside a component that leave an updated node."""
    c = components(edges)
    of = lambda k: c.select(F.col("node").alias(k), F.col("component").alias(f"{k}_c"))
    inside = edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").where("src_c = dst_c")
    cut = inside.join(updated.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")
    return edges.join(cut, ["src", "dst"], "left_anti")


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level): the longest path below a node of an acyclic graph; a cycle is an error."""
    ready(edges.sparkSession)
    everyone = nodes if nodes is not None else nodes_of(edges)
    out = everyone.select("node", F.lit(0).alias("level")).checkpoint()
    left = edges.select("src", "dst").distinct().checkpoint()
    done = None
    level = 0
    while True:
        blocked = left.select(F.col("src").alias("node")).distinct()
        now = out.join(blocked, "node", "left_anti").select("node", F.lit(level).alias("level"))
        now = now if done is None else now.join(done.select("node"), "node", "left_anti")
        now = now.checkpoint()
        if now.isEmpty():
            if not left.isEmpty():
                raise ValueError("the graph has a cycle")
            return done if done is not None else out
        done = now if done is None else done.union(now).checkpoint()
        left = left.join(now.select(F.col("node").alias("dst")), "dst", "left_anti").checkpoint()
        level += 1


def post_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes with dependencies before dependents."""
    return levels(edges, nodes).orderBy("level", "node")


def updated_graph(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges after changes (src, dst array): a node's new dependencies replace its own; a null array deletes the node."""
    kept = edges.join(changes.select("src").distinct(), "src", "left_anti")
    return kept.select("src", "dst").union(changes.where("dst is not null").select("src", F.explode("dst").alias("dst")))


def stale(edges: DataFrame, file_packages: DataFrame, changed: DataFrame) -> DataFrame:
    """Packages that changed files (file) make stale: their packages and everything that depends on those."""
    first = merged(changed, file_packages, "file").select(F.col("package").alias("node")).distinct()
    return reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), first)


def run_leaves_first(edges: DataFrame, nodes: DataFrame, step) -> DataFrame:
    """Runs ``step(nodes of a level, results so far)`` level by level, dependencies first, and unions the results."""
    order = levels(edges, nodes)
    deepest = order.agg(F.max("level")).first()[0]
    done = None
    for k in range(-1 if deepest is None else deepest + 1):
        out = step(order.where(F.col("level") == k).select("node"), done).checkpoint()
        done = out if done is None else done.union(out).checkpoint()
    return done


def reverse_dependencies(edges: DataFrame, of: DataFrame, transitive: bool = False) -> DataFrame:
    """Importers of the nodes (node), direct or all."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if transitive:
        return closure_minus_roots(back, of)
    return merged(of, back.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct()


def required(requires: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the roots and all that they require, directly or not; ``requires`` is (node, needs array)."""
    return reached(requires.select(F.col("node").alias("src"), F.explode("needs").alias("dst")), roots)


def fact_producers(requires: DataFrame, roots: DataFrame, declaring: DataFrame) -> DataFrame:
    """Of what the roots require, themselves included, those nodes that declare facts (node)."""
    return merged(required(requires, roots), declaring.select("node").distinct(), "node", how="left_semi")


def action_states(requires: DataFrame, failed: DataFrame) -> DataFrame:
    """(node, state) of each action of a graph, run once: failed, skipped if something that it needs failed, else done."""
    edges = requires.select(F.col("node").alias("src"), F.explode("needs").alias("dst"))
    hit = reached(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), failed)
    bad = failed.select("node").distinct().withColumn("failed", F.lit(True))
    told = merged(merged(requires.select("node").distinct(), hit.withColumn("hit", F.lit(True)), "node", how="left"), bad, "node", how="left")
    return told.select("node", F.when(F.col("failed"), "failed").when(F.col("hit"), "skipped").otherwise("done").alias("state"))


def reachable_symbols(edges: DataFrame, exported: DataFrame, imported: DataFrame) -> DataFrame:
    """(decl, symbol): the imported symbols (node) that each exported declaration (node) refers to, directly or not.

    Declarations that refer to each other in a circle reach the same, so circles are one node first; then only pairs that
    begin at an exported declaration are walked.
    """
    ready(edges.sparkSession)
    circles = components(edges).select("node", "component")
    of = lambda df, c: merged(df, circles.select(F.col("node").alias(c), "component"), c, how="left").withColumn(c, F.coalesce("component", c)).drop("component")
    short = of(of(edges.select("src", "dst"), "src"), "dst").where("src <> dst").distinct().checkpoint()
    front = of(exported.select(F.col("node").alias("decl"), "node"), "node").select("decl", "node").distinct().checkpoint()
    seen = Seen(front)
    while not front.isEmpty():
        step = merged(front, short.select(F.col("src").alias("node"), "dst"), "node").select("decl", F.col("dst").alias("node")).distinct()
        front = merged(step, seen.all(), "decl", "node", how="left_anti").checkpoint()
        seen.add(front)
    outside = of(imported.select(F.col("node").alias("symbol"), "node"), "node")
    return merged(seen.all(), outside, "node").where("decl <> symbol").select("decl", "symbol")
