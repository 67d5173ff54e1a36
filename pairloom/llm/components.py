"""Connected components of match pairs: one group key per record.

Two methods over the same edge form (``src``, ``dst``: both directions,
distinct, no loops):

* ``peeled_components``: the component of the highest-degree vertex is walked
  by frontier breadth-first joins and anti-joined away, the rest is labelled by
  minimum propagation with contraction.
* ``frontier_components``: many seeds grow at once, and seed labels that meet
  are merged in the (much smaller) graph of seeds.

Nothing but single counts and the one start vertex comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.skew import hot_keys, hot_of, repeat_rows, salted_lookup, spread_rows
from pairloom.scratch import Scratch


def links(df: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every distinct link; null ends and self-links are none.

    Each unordered pair is made distinct once, before it is mirrored.
    """
    ends = df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).alias("ok"))
    one = ends.where("ok").select("u", "v").distinct()
    return mirrored(one)


def mirrored(one: DataFrame) -> DataFrame:
    """``src, dst`` in both directions of ``u, v``."""
    both = F.explode(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))
    return one.select(both.alias("e")).select("e.src", "e.dst")


def propagate_minimum(adj: DataFrame, scratch: Scratch, jumps: int = 1) -> DataFrame:
    """``(id, label)``: the least vertex of each component.

    A round points every vertex at the least of itself and its neighbours
    (aggregated before the shuffle), doubles those pointers ``jumps``
    times, and contracts the edges to the vertices pointed at. At least half of
    the vertices of every unfinished component vanish each round, so rounds
    grow with the logarithm of the largest component, also for long chains.
    Vertices that very many edges or pointers lead to are split in every join.
    """
    rounds: list[DataFrame] = []
    edges, own = adj, False
    while True:
        least = edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("n")).select("id", F.least("id", "m").alias("to"), "n")
        point = scratch.save(least)
        # edges go both ways, so a vertex has as many as source and as destination
        hubs = scratch.save(hot_of(point, ["id"], "n"))
        point = point.select("id", "to")
        for _ in range(jumps):
            # a pointer that leads to itself ends there
            further = point.where("id <> to").select(F.col("id").alias("to"), F.col("to").alias("to2"))
            jumped = salted_lookup(point, further, ["to"], F.col("id"), "left").select("id", F.coalesce("to2", "to").alias("to"))
            point = scratch.save(jumped)
        rounds.append(point)
        src = point.select(F.col("id").alias("src"), F.col("to").alias("s"))
        dst = point.select(F.col("id").alias("dst"), F.col("to").alias("d"))
        moved = salted_lookup(edges, src, ["src"], F.col("dst"), hot=hubs.withColumnRenamed("id", "src")).where("s <> dst")
        moved = salted_lookup(moved, dst, ["dst"], F.col("src"), hot=hubs.withColumnRenamed("id", "dst")).where("s <> d")
        nxt = scratch.save(moved.select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct())
        if own:
            scratch.drop(edges)
        edges, own = nxt, True
        if edges.isEmpty():
            break
    # from the last round, which holds fewest vertices, back to the first
    out = rounds[-1].select("id", F.col("to").alias("label"))
    for point in rounds[-2::-1]:
        # vertices that the next round no longer holds are finished
        later = out.select(F.col("id").alias("to"), "label")
        out = salted_lookup(point, later, ["to"], F.col("id"), "left").select("id", F.coalesce("label", "to").alias("label"))
    return scratch.save(out)


class Adjacency:
    """Edges partitioned by the hash of their source, hubs spread over salts by their destination.

    The hubs (at most ``parts`` of them) are found once; a frontier is joined
    with its hubs repeated for each salt, so no task walks a hub's edges alone.
    """

    def __init__(self, adj: DataFrame, scratch: Scratch, parts: int = 1000):
        self.hubs = scratch.save(hot_keys(adj, ["src"], parts))
        self.edges = scratch.save(spread_rows(adj, self.hubs, ["src"], F.col("dst"), parts))

    def step(self, frontier: DataFrame) -> DataFrame:
        """The edges out of ``frontier`` (``id`` and whatever else it carries)."""
        return self.edges.join(repeat_rows(frontier.withColumnRenamed("id", "src"), self.hubs, ["src"]), ["src", "__salt"]).drop("__salt")

    def without(self, seen: DataFrame) -> DataFrame:
        """The edges that do not start in ``seen``."""
        return self.edges.join(repeat_rows(seen.withColumnRenamed("id", "src"), self.hubs, ["src"]), ["src", "__salt"], "left_anti").drop("__salt")


def breadth_first(adj: Adjacency, start: DataFrame, scratch: Scratch, max_rounds: int) -> DataFrame:
    """``(id)`` of all vertices reached from ``start`` within ``max_rounds``.

    Links go both ways, so a frontier's neighbours lie in itself, the frontier
    before or the next one: a round compares with those two alone, however many
    vertices have been reached.
    """
    levels = [start]
    for _ in range(max_rounds):
        step = adj.step(levels[-1]).select(F.col("dst").alias("id")).distinct()
        for old in levels[-2:]:
            step = step.join(old, "id", "left_anti")
        new = scratch.save(step)
        if new.isEmpty():
            break
        levels.append(new)
    return reduce(DataFrame.unionByName, levels)


def peeled_components(adj: DataFrame, scratch: Scratch, max_rounds: int = 30) -> DataFrame:
    """``(id, label)``: every vertex of ``adj`` with the least vertex it is linked to.

    Frontiers walk from the vertex of highest degree (ties: the least one). What
    they reach is anti-joined away, edges that lead back into it are led to the
    start vertex, and minimum propagation labels what is left. ``max_rounds``
    bounds the walk, not the result: of a component that is deeper, the rest
    still hangs on the start vertex. No edges give no rows.
    """
    adj = scratch.save(adj)
    top = adj.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")).orderBy(F.desc("deg"), "id").limit(1).select("id")
    start = scratch.save(top)
    walk = Adjacency(adj, scratch)
    seen = scratch.save(breadth_first(walk, start, scratch, max_rounds))
    root = start.select("id").scalar()
    outside = walk.without(seen)
    back = seen.select(F.col("id").alias("dst"), F.lit(True).alias("__in"))
    ends = scratch.save(salted_lookup(outside, back, ["dst"], F.col("src"), "left", hot=walk.hubs.withColumnRenamed("src", "dst")))
    kept = ends.where("__in IS NULL").select("src", "dst")
    hung = ends.where("__in").select(F.col("src").alias("u"), root.alias("v")).distinct()
    labels = propagate_minimum(scratch.save(kept.unionByName(mirrored(hung))), scratch)
    ours = labels.where(F.col("id") == root).select("label").scalar()
    low = seen.agg(F.min("id").alias("m")).scalar()
    least = F.least(low, F.coalesce(ours, low))
    walked = seen.select("id", least.alias("label"))
    others = labels.where(F.col("id") != root).select("id", F.when(F.col("label") == ours, least).otherwise(F.col("label")).alias("label"))
    return walked.unionByName(others)


def frontier_components(adj: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, label)``: every vertex with the least vertex of its component.

    Seeds are the vertices whose hash is below all their neighbours' hashes:
    every component has one, and from any vertex falling hashes lead to one in
    a few steps, also along chains. All seeds expand at once over the hashed
    adjacency; a vertex takes the least label that reaches it first. Edges
    between different labels form the seed graph, at most half as many
    vertices, in which minimum propagation merges colliding seeds.
    """
    adj = scratch.save(adj)
    mine, other = F.struct(F.xxhash64("src"), F.col("src")), F.struct(F.xxhash64("dst").alias("h"), F.col("dst").alias("v"))
    low = adj.groupBy("src").agg(F.min(other).alias("m"))
    seeds = scratch.save(low.where(mine < F.col("m")).select(F.col("src").alias("id"), F.col("src").alias("label")))
    hashed = Adjacency(adj, scratch)
    levels = [seeds]
    while True:
        reach = hashed.step(levels[-1]).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("label"))
        for old in levels[-2:]:  # as in ``breadth_first``
            reach = reach.join(old, "id", "left_anti")
        new = scratch.save(reach)
        if new.isEmpty():
            break
        levels.append(new)
    labelled = scratch.save(reduce(DataFrame.unionByName, levels))
    s, d = labelled.select(F.col("id").alias("src"), F.col("label").alias("s")), labelled.select(F.col("id").alias("dst"), F.col("label").alias("d"))
    hubs = hashed.hubs
    ends = salted_lookup(adj.where("src < dst"), s, ["src"], F.col("dst"), hot=hubs)
    ends = salted_lookup(ends, d, ["dst"], F.col("src"), hot=hubs.withColumnRenamed("src", "dst"))
    met = ends.where("s <> d").select(F.least("s", "d").alias("u"), F.greatest("s", "d").alias("v")).distinct()
    merged = propagate_minimum(scratch.save(mirrored(met)), scratch).select(F.col("id").alias("label"), F.col("label").alias("root"))
    labelled = salted_lookup(labelled, merged, ["label"], F.col("id"), "left").select("id", F.coalesce("root", "label").alias("label"))
    labelled = scratch.save(labelled)
    least = labelled.groupBy("label").agg(F.min("id").alias("least"))
    return salted_lookup(labelled, least, ["label"], F.col("id")).select("id", F.col("least").alias("label"))


def link_groups(df: DataFrame, a: str, b: str, max_rounds: int = 30) -> DataFrame:
    """``(id, group_key)`` of every record linked to another, by ``peeled_components``."""
    scratch = Scratch(df.sparkSession, "links")
    return peeled_components(links(df, a, b), scratch, max_rounds).select("id", F.col("label").alias("group_key"))
