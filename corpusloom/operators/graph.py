"""Graph operators over an edge list: degrees, capped neighbours, bounded search, integrity, co-occurrence.

Edges are undirected for traversal. Loops are bounded by a depth of at most 3 or 6 and each round is
one join of the frontier with the edges; every round's frontier is materialised in shared storage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.sources.staging import staged

NEIGHBOUR_CAP = 50
MAX_DEPTH, MAX_PATH = 3, 6


#: Members of a group that one task pairs with as many others.
BLOCK = 1000


def cooccurrence(members: DataFrame, *, group: str, item: str, least: int = 2) -> DataFrame:
    """Pairs of items that share groups: a < b, shared, score = min(1, shared / 5).

    Items of fewer groups than `least` are in no pair and go first. A group of more than BLOCK members is paired
    block against block, each pair of blocks by itself, so no task holds the pairs of a whole large group.
    """
    rows = members.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    often = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("i")
    rows = rows.join(often, "i") if least > 1 else rows
    sized = rows.join(rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "g")
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks").cast("bigint")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", F.least("own", "j").alias("bi"), F.greatest("own", "j").alias("bj"), "own", "i")
    other = dealt.select("g", "bi", "bj", F.col("own").alias("other"), F.col("i").alias("b"))
    pairs = dealt.withColumnRenamed("i", "a").join(other, ["g", "bi", "bj"]).where("a < b and (own <> other or bi = bj)")
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    return counted.withColumn("score", F.round(F.least(F.lit(1.0), F.col("shared") / F.lit(5)), 4))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, *, node: str) -> DataFrame:
    """Nodes, edges, highest and mean degree, isolated nodes, branching (mean over nodes with edges)."""
    d = nodes.select(F.col(node).alias("node")).join(degrees(edges), "node", "left")
    counted = d.agg(
        F.count(F.lit(1)).alias("nodes"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        F.round(F.avg(F.coalesce("degree", F.lit(0))), 4).alias("mean_degree"), F.count_if(F.col("degree").isNull()).alias("isolated"),
        F.round(F.coalesce(F.avg("degree"), F.lit(0.0)), 4).alias("branching"),
    )
    return counted.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))


def capped_neighbours(edges: DataFrame, cap: int = NEIGHBOUR_CAP) -> DataFrame:
    """The first `cap` neighbours of every node in order of id: node, neighbour, n."""
    order = Window.partitionBy("a").orderBy("b")
    return both_ways(edges).withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "n")


def adjacency(edges: DataFrame, cap: int = NEIGHBOUR_CAP) -> DataFrame:
    """Steps of a search: what capped_neighbours gave, stored before, or made of edges (a, b) and stored now."""
    return edges if "neighbour" in edges.columns else staged(capped_neighbours(edges, cap), "steps")


def within_depth(edges: DataFrame, start: int, depth: int, cap: int = NEIGHBOUR_CAP, *, budget: int | None = None) -> DataFrame:
    """Nodes that lie within `depth` steps (clamped to 1..3) of the start: node, depth.

    edges: a, b, or stored steps (node, neighbour). A budget stops the search after the round in which
    it is reached and keeps as many nodes, nearest first, then by id.
    """
    steps = adjacency(edges, cap)
    seen = steps.sparkSession.createDataFrame([(start, 0)], "node bigint, depth int")
    front, held = seen, 0
    for d in range(1, max(1, min(depth, MAX_DEPTH)) + 1):
        reached = front.select("node").join(steps, "node").select(F.col("neighbour").alias("node")).distinct()
        front = staged(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(front)
        if budget is not None:
            held += front.count()
            if held >= budget:
                break
    found = seen.where("depth > 0")
    return found if budget is None else found.orderBy("depth", "node").limit(budget)


def shortest_path(edges: DataFrame, start: int, goal: int, depth: int = MAX_PATH, cap: int = NEIGHBOUR_CAP) -> DataFrame:
    """One shortest path within the bound (clamped to 1..6), the least in order of ids: length, path; no row if none. edges as for within_depth."""
    steps = adjacency(edges, cap)
    spark = steps.sparkSession
    front = spark.createDataFrame([(start, [start])], "node bigint, path array<bigint>")
    if start == goal:
        return front.select(F.lit(0).alias("length"), F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))
    seen = front.select("node")
    for d in range(1, max(1, min(depth, MAX_PATH)) + 1):
        grown = front.join(steps, "node").select(F.col("neighbour").alias("node"), F.concat("path", F.array("neighbour")).alias("path"))
        front = staged(grown.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")), "frontier")
        found = front.where(F.col("node") == goal).select(F.lit(d).alias("length"), F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"))
        if found.limit(1).count():
            return found
        seen = seen.union(front.select("node"))
    return found


def findings(code: str, rows: DataFrame, subject: Column) -> DataFrame:
    """Integrity findings of one kind: code, subject."""
    return rows.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"))
