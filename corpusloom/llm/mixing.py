"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Tokens are words. The corpus total is shared among the sources by weight, no source above
MAX_REPEATS times its size; blocks of BLOCK tokens go to the sources by highest quotients
(target / 1, 3, 5, ...), and each source's quota goes in the same way to its shards, in proportion
to their tokens. A shard is a seeded hash bucket of documents laid end to end in seeded order: its
quota is as many whole passes over the line as fit, and then the blocks from a seeded start round
the line. So the words taken of a document follow from its place in the line alone, and documents stay whole
but for two a shard; blocks drawn one by one would leave snippets of BLOCK words.

At most MAX_SHARDS shards a source bound what apportionment sees. Up to SOURCES_AT_ONCE sources are planned
in one task; more of them (domains, say) by the same rules in sums over all sources, with ranks from the totals of partitions. Only document keys and sizes are shuffled (and columns asked to be carried).

Defined results: a null text has size 0 and is taken 0 words; null is a source of its own, last in
order; a corpus without words has targets of 0; texts of any length count with all their words; rows of one key,
size and text are interchangeable, so repeated rows give a defined multiset; an empty table gives no rows; nothing is
read but the named columns, and mixed_documents passes others on whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import OWN, SPACES, lookup, staged, table, words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK = 8
SHARD_DOCS = 256
MAX_SHARDS = 1 << 18
#: Sources that one task plans, some hundred bytes each.
SOURCES_AT_ONCE = 1_000_000
#: Divisors that are tried in one pass over the sources.
TRIED = 31
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACES}]+")), F.lit(0)).cast("bigint")


def capped_shares(total: float, weights: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Share `total` by weight, no share above its cap, the excess reshared by weight among the rest."""
    shares, free = np.zeros(len(weights)), np.ones(len(weights), dtype=bool)
    left = float(total)
    while free.any() and left > 0:
        level = left / weights[free].sum()
        over = free & (weights * level > caps)
        if not over.any():
            shares[free] = weights[free] * level
            return shares
        shares[over] = caps[over]
        free &= ~over
        left = float(total) - shares[~free].sum()
    return shares


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1), none above its cap; ties go to the earlier entry.

    A divisor below which all quotients are served is found by bisection, so the work does not grow
    with the seats; the few seats left at the divisor are handed out one by one.
    """
    weights, caps = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = int(min(seats, caps[weights > 0].sum()))
    if seats <= 0:
        return np.zeros(len(weights), dtype=np.int64)

    def held(d: float) -> np.ndarray:
        return np.minimum(caps, np.floor((weights / d + 1) / 2).astype(np.int64))

    high = float(weights.max()) * 2
    low = high
    while held(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if held(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = held(high)
    queue = [(-weights[i] / (2 * int(got[i]) + 1), i) for i in range(len(weights)) if got[i] < caps[i] and weights[i] > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * int(got[i]) + 1), i))
    return got


def plan_sources(sources: pd.DataFrame, weights: tuple[float, ...], block: int) -> pd.DataFrame:
    """Targets and block quotas of all sources; sources in code point order, null last."""
    names = [None if s is None or s != s else s for s in sources["source"]]
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
    sources = sources.iloc[order].reset_index(drop=True)
    size = sources["source_size"].to_numpy(dtype=np.int64)
    w = np.array([weights[i % len(weights)] for i in range(len(size))])
    target = capped_shares(float(size.sum()), w, MAX_REPEATS * size.astype(float))
    quota = sainte_lague(target, round(int(size.sum()) / block), -(-MAX_REPEATS * size // block))
    shards = np.clip(-(-sources["docs"].to_numpy(dtype=np.int64) // SHARD_DOCS), 1, MAX_SHARDS)
    return pd.DataFrame({"source": [names[i] for i in order], "src": np.arange(len(size)), "source_size": size, "target": target, "source_quota": quota, "n_shards": shards})


def numbered(rows: DataFrame, *order: Column, into: str) -> DataFrame:
    """The rows with their place (from 0) in an order that no two share, from the counts of partitions; no task sees all rows."""
    held = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "in-order")
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return held.join(F.broadcast(counts), "_part").withColumn(into, F.col("_before") + at).drop("_part", "_before")


def plan_many_sources(sources: DataFrame, weights: tuple[float, ...], block: int) -> DataFrame:
    """plan_sources for any number of sources: the same columns, from sums over all of them."""
    rows = numbered(sources, F.col("source").isNull(), F.col("source"), into="src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("src", F.lit(len(weights))) + 1).cast("int"))
    size = F.col("source_size")
    rows = staged(rows.select("*", w.alias("_w"), (size * MAX_REPEATS).alias("_most"), F.ceil(size * MAX_REPEATS / block).cast("bigint").alias("_cap")), "weighed")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        # what the level caps stays capped, as the level only rises
        over = F.col("_w") * level > F.col("_most") if capped >= 0 else F.lit(False)
        n, fixed, free = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("_most"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        level, capped = (float(total) - float(fixed)) / free, n
    over = F.col("_w") * level > F.col("_most")
    rows = rows.withColumn("target", F.when(over, F.col("_most").cast("double")).otherwise(F.col("_w") * level))
    seats = min(round(total / block), rows.agg(F.coalesce(F.sum(F.when(F.col("target") > 0, F.col("_cap"))), F.lit(0))).first()[0])

    def held(d: float) -> Column:
        return F.least(F.col("_cap"), F.floor((F.col("target") / F.lit(d) + 1) / 2))

    high = float(rows.agg(F.coalesce(F.max("target"), F.lit(0.0))).first()[0]) * 2
    low = high
    while seats > 0 and rows.agg(F.sum(held(low))).first()[0] < seats:
        low /= 1024
    # the least divisor that serves no more than the seats, many tried in one pass
    while seats > 0 and math.nextafter(low, high) < high:
        tried = sorted({t for i in range(1, TRIED + 1) if low < (t := low + (high - low) * i / (TRIED + 1)) < high}) or [math.nextafter(low, high)]
        sums = rows.agg(*[F.sum(held(t)) for t in tried]).first()
        fits = [t for t, n in zip(tried, sums) if n <= seats]
        low, high = max([low, *[t for t, n in zip(tried, sums) if n > seats]]), min([high, *fits])
    got = held(high) if seats > 0 else F.lit(0).cast("bigint")
    rows = rows.withColumn("_got", got)
    left = seats - (rows.agg(F.coalesce(F.sum("_got"), F.lit(0))).first()[0]) if seats > 0 else 0
    quota = F.col("_got")
    if left > 0:
        # sources that the next divisor would serve stand level with each other; the first in order get one more
        tied = numbered(rows.where(held(low) > F.col("_got")).select(F.col("src").alias("_src")), F.col("_src"), into="_at").where(F.col("_at") < left)
        rows = rows.join(tied.select("_src", F.lit(1).alias("_more")), F.col("src") == F.col("_src"), "left")
        quota = F.col("_got") + F.coalesce("_more", F.lit(0))
    shards = F.least(F.greatest(F.ceil(F.col("docs") / SHARD_DOCS), F.lit(1)), F.lit(MAX_SHARDS)).cast("bigint")
    return rows.select("source", F.col("src").cast("bigint").alias("src"), "source_size", "target", quota.cast("bigint").alias("source_quota"), shards.alias("n_shards"))


def plan_shards(shards: pd.DataFrame, block: int) -> pd.DataFrame:
    """Block quotas of the shards of one source, in proportion to their tokens."""
    shards = shards.sort_values("shard").reset_index(drop=True)
    tokens = shards["shard_tokens"].to_numpy(dtype=np.int64)
    quota = sainte_lague(tokens.astype(float), int(shards["source_quota"].iloc[0]), -(-MAX_REPEATS * tokens // block))
    key = shards["src"].to_numpy(dtype=np.int64) * MAX_SHARDS + shards["shard"].to_numpy(dtype=np.int64)
    return pd.DataFrame({"shard_key": key, "shard_tokens": tokens, "shard_quota": quota})


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", carry: tuple[str, ...] = (),
        weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """What the mix takes of every document.

    Columns: key, those carried, size, source_size, target, taken, passes (whole copies), and
    pieces: up to two ranges of words [start, end) taken once more.
    """
    rows = docs.select(F.col(key).alias("_k"), F.col(source).alias("_source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    slim = staged(rows.select("_k", "_source", "size", "_t"), "sizes")
    by_source = slim.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_source = staged(by_source, "sizes-of-sources")
    kind = slim.schema["_source"].dataType.simpleString()
    if by_source.count() > SOURCES_AT_ONCE:
        planned = plan_many_sources(by_source, weights, block)
    else:
        planned = by_source.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(
            lambda p: plan_sources(p, weights, block),
            f"source {kind}, src bigint, source_size bigint, target double, source_quota bigint, n_shards bigint",
        )
    sources = staged(planned, "sources")

    def placed(some: DataFrame) -> DataFrame:
        found = lookup(some, sources, F.col("_source"), "source")
        return found.withColumn("shard", F.pmod(F.xxhash64("_k", "size", F.lit(seed)), F.col("n_shards")))

    tokens = placed(slim).groupBy("src", "shard").agg(F.sum("size").alias("shard_tokens"), F.max("source_quota").alias("source_quota"))
    shards = staged(
        tokens.groupBy("src").applyInPandas(lambda p: plan_shards(p, block), "shard_key bigint, shard_tokens bigint, shard_quota bigint"),
        "shards",
    )
    full = placed(rows if carry else slim)
    full = lookup(full.withColumn("_at", F.col("src") * F.lit(MAX_SHARDS) + F.col("shard")), shards, F.col("_at"), "shard_key")
    line = Window.partitionBy("_at").orderBy(F.xxhash64("_k", F.lit(seed + 1)), "_k", "size", "_t")
    n = F.col("shard_tokens")
    asked = F.least(F.col("shard_quota") * F.lit(block), n * F.lit(MAX_REPEATS))
    passes = F.expr(f"if(shard_tokens > 0, least(shard_quota * {block}, shard_tokens * {MAX_REPEATS}) div shard_tokens, 0L)")
    full = full.withColumn("_end", F.sum("size").over(line)).withColumn("_passes", passes)
    rest = asked - F.col("_passes") * n
    start = F.pmod(F.xxhash64("_at", F.lit(seed + 2)), F.greatest(F.floor((n + F.lit(block - 1)) / F.lit(block)), F.lit(1))) * F.lit(block)
    full = full.withColumn("_rest", rest).withColumn("_from", start).withColumn("_begin", F.col("_end") - F.col("size"))
    begin, stop = F.col("_from"), F.col("_from") + F.col("_rest")

    def piece(a: Column, b: Column) -> Column:
        low = F.greatest(a, F.col("_begin")) - F.col("_begin")
        high = F.least(b, F.col("_end")) - F.col("_begin")
        return F.struct(low.cast("bigint").alias("start"), high.cast("bigint").alias("end"))

    pieces = F.filter(F.array(piece(F.lit(0), stop - n), piece(begin, F.least(stop, n))), lambda p: p["end"] > p["start"])
    full = full.withColumn("pieces", pieces)
    taken = F.col("_passes") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["end"] - p["start"])
    return full.select(
        F.col("_k").alias(key), *[F.col(f"_c_{c}").alias(c) for c in carry], "size", "source_size", "target",
        taken.alias("taken"), F.col("_passes").alias("passes"), "pieces",
    )


def mixed_documents(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The mixed corpus itself: a row for every whole copy, and one with the words of every further piece; texts without words give none."""
    row = OWN + "row"
    held = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"), F.struct(*[F.col(c) for c in docs.columns if c != text]).alias(row))
    taken = mix(held, key="k", source="s", text="t", carry=("t", row))
    whole = F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"))
    parts = taken.where("size > 0").withColumn("part", F.explode(F.concat(F.array_repeat(whole, F.col("passes").cast("int")), F.col("pieces"))))
    cut = F.slice(words(F.col("t")), (F.col("part.start") + 1).cast("int"), (F.col("part.end") - F.col("part.start")).cast("int"))
    parts = parts.withColumn("new", F.when(F.col("part.start") < 0, F.col("t")).otherwise(F.array_join(cut, " ")))
    shown = {text: F.col("new")} | ({chars: F.char_length("new").cast(docs.schema[chars].dataType)} if chars in docs.columns else {})
    return parts.select(*[shown.get(c, F.col(row).getField(c)).alias(c) for c in docs.columns])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; all cases as the module says."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_source_mixing": op3_source_mixing}
ORACLES: dict[str, str] = {}
