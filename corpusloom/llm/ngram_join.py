"""N-gram Jaccard join by chosen paths.

A document is the set of its word shingles, and KEYS seeded hashes sample a token each from it (the
shingle of least value), on which two sets agree with a probability equal to their similarity. A run
starts from the token of one hash. A node of the recursion that holds at most MEMBERS sets (and
SHINGLES shingles) is compared by brute force; a larger one draws, from a seed of its own, one
hash or two (1 / similarity on average), and every set goes down to the child of each of its
tokens there, so a pair at the threshold meets in one child on average while unrelated ones part.
Runs are repeated until the chance to miss a pair at the threshold, even one that is split at every
level, is below 1 - TARGET_RECALL by the extinction of that branching.

What is still large after LEVELS levels is a true crowd. Its least node is a star; members within half the
allowed distance of their star are its core, and by the triangle inequality of Jaccard distances all
of one core are linked, which needs sums and no comparison. Only pairs with a member outside are
compared, block against block, so a crowd of close copies costs its size and not its square.

Copies of one text are one node from the start, so crowds of copies cost one set. Nodes are compared
first on sketches (a byte of every sampled hash); only documents with a partner that they meet here
first, and that their sketches do not rule out, send their whole sets, which settle the link exactly.
A pair that meets in several leaves counts in the least of them only, which each task can tell by itself from
the leaves of both, so no pair is ever emitted: a task hands on, for each of its nodes, a link count
and the least node it is linked to.

Result: per document its class (the least key of all documents that links connect with it) and its number
of links (other documents at the threshold or above, copies included).

Defined results: texts of fewer words than a shingle have one shingle of all their words; texts
without words, and null texts, have no shingle, no links and a class of their own; texts of any length
are compared by all their shingles, as 64-bit hashes; rows of one text
are copies whatever their keys; null keys name no class unless nothing else does; extra columns are
not read by the join and pass through one_of_each_class whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import OWN, lookup, packed, staged, table, unpacked, words

WORDS = 5
THRESHOLD = (4, 5)  # 0.8 as a ratio of whole numbers
TARGET_RECALL = 0.9998
KEYS = 48
LEVELS = 3
#: A node draws a second hash in one of so many cases: 1.25 hashes on average, one over the threshold.
SECOND = 4
MEMBERS = 256
SHINGLES = 2_000_000
#: Share of equal sketch bytes below which a pair is ruled out: over four deviations under the threshold.
SKETCH_SHARE = 0.5
SEED = 7


def missed(similarity: float, levels: int) -> float:
    """The chance that a pair shares no node after so many levels of one run."""
    lost = 0.0
    for _ in range(levels - 1):
        one = 1 - similarity + similarity * lost
        lost = (1 - 1 / SECOND) * one + one * one / SECOND
    return 1 - similarity + similarity * lost


def runs_needed(similarity: float, recall: float, levels: int) -> int:
    """Runs after which a pair that is split at every level is missed with a chance of at most 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(missed(similarity, levels)))


RUNS = runs_needed(THRESHOLD[0] / THRESHOLD[1], TARGET_RECALL, LEVELS)


def _odd(n: int, salt: int) -> np.ndarray:
    return np.random.default_rng(SEED * 1000 + salt).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# arrays, so that they travel with the functions that use them
_WORD_WEIGHTS, _MULTIPLIERS, _OFFSETS = _odd(WORDS, 1), _odd(KEYS, 2), _odd(KEYS, 3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_values(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts given as word hashes one after another; shingles per text."""
    weights, n = _WORD_WEIGHTS, WORDS
    ends = np.cumsum(counts)
    out_counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    total = len(flat)
    value = np.zeros(total, dtype=np.uint64)
    padded = np.concatenate([flat, np.zeros(n, np.uint64)])
    left = np.repeat(ends, counts) - np.arange(total)  # words from here to the end of the text
    for k in range(n):
        value += np.where(left > k, padded[k : k + total] * weights[k], np.uint64(0))
    first = np.zeros(total, dtype=bool)
    first[(ends - counts)[counts > 0]] = True
    return _mixed(value[(left >= n) | (first & (left < n))]), out_counts


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every set (none empty) the least value under each of KEYS hash functions."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.empty((len(counts), KEYS), dtype=np.uint64)
    for k in range(KEYS):
        out[:, k] = np.minimum.reduceat(_mixed((values ^ _OFFSETS[k]) * _MULTIPLIERS[k]), starts)
    return out


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def node_of(text: Column) -> Column:
    """The node of a text: its MD5, 16 bytes."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(column.offsets.to_numpy())


def _nodes(docs: DataFrame) -> DataFrame:
    """One row per distinct text: node, min_doc, copies, n_sh, keys, sketch; docs has doc_id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                flat, counts = _lists(b, "w")
                values, n = shingle_values(flat, counts)
                some = n > 0
                keys = np.zeros((len(n), KEYS), dtype=np.uint64)
                if some.any():
                    keys[some] = signatures(values, n[some])
                sketch = (keys >> np.uint64(40)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), b.column("node"), pa.array(n, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * KEYS, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                        pa.array([r.tobytes() for r in sketch], pa.binary()),
                    ],
                    names=["doc_id", "node", "n_sh", "keys", "sketch"],
                )

    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"), _word_hashes(F.col("text")).alias("w"))
    signed = rows.mapInArrow(run, "doc_id bigint, node binary, n_sh bigint, keys array<bigint>, sketch binary")
    return signed.groupBy("node").agg(
        F.min("doc_id").alias("min_doc"), F.count(F.lit(1)).alias("copies"), F.first("n_sh").alias("n_sh"),
        F.first("keys").alias("keys"), F.first("sketch").alias("sketch"),
    )


def _leaves(nodes: DataFrame) -> DataFrame:
    """One row per node and leaf that it shares: node, n_sh, leaf, blocks (more than one in crowds)."""
    roots = np.random.default_rng(SEED).permutation(KEYS)[:RUNS].tolist()
    starts = F.array(*[F.xxhash64(F.lit(r), F.lit(p), F.get("keys", F.lit(p))) for r, p in enumerate(roots)])
    rows = nodes.where("n_sh > 0").select("node", "n_sh", F.explode(starts).alias("leaf"))
    found = []
    for level in range(1, LEVELS + 1):
        shared = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("members"), F.sum("n_sh").alias("shingles"))
        shared = staged(shared.where("members > 1").withColumnRenamed("leaf", "_leaf"), f"shared-{level}")
        rows = staged(lookup(rows, shared, F.col("leaf"), "_leaf", how="inner"), f"paths-{level}")
        blocks = F.greatest(F.ceil(F.col("members") / MEMBERS), F.ceil(F.col("shingles") / SHINGLES)).cast("int")
        sized = rows.withColumn("blocks", blocks)
        last = level == LEVELS
        found.append((sized if last else sized.where("blocks = 1")).select("node", "n_sh", "leaf", "blocks"))
        if not last:
            wide = sized.where("blocks > 1").select("node", "n_sh", "leaf").join(nodes.select("node", "keys"), "node")
            drawn = lambda salt, n: F.pmod(F.xxhash64("leaf", F.lit(100 * level + salt)), F.lit(n)).cast("int")
            wide = wide.withColumn("p", drawn(1, KEYS)).withColumn("q", F.pmod(F.col("p") + 1 + drawn(2, KEYS - 1), F.lit(KEYS)))
            child = lambda at: F.xxhash64("leaf", at, F.get("keys", at))
            both = F.when(drawn(3, SECOND) == 0, F.array(child(F.col("p")), child(F.col("q")))).otherwise(F.array(child(F.col("p"))))
            rows = wide.select("node", "n_sh", F.explode(both).alias("leaf"))
    return functools.reduce(DataFrame.unionByName, found)


def _stars(docs: DataFrame, nodes: DataFrame, leaves: DataFrame) -> DataFrame | None:
    """The cores of crowds: node, star, copies. Two nodes of one star are linked for certain. None where nothing is crowded."""
    crowd = leaves.where("blocks > 1").select("leaf", "node")
    if not crowd.limit(1).count():
        return None
    least = staged(crowd.groupBy("leaf").agg(F.min("node").alias("star")).withColumnRenamed("leaf", "_leaf"), "crowds")
    stars = staged(lookup(crowd, least, F.col("leaf"), "_leaf", how="inner").groupBy("node").agg(F.min("star").alias("star")), "members")
    both = staged(stars.select("node").union(stars.select("star")).distinct(), "crowded")
    sets = staged(_sets(docs, nodes, both).dropDuplicates(["node"]), "crowded-sets")
    centres = staged(sets.join(stars.select(F.col("star").alias("node")).distinct(), "node").select(F.col("node").alias("_star"), F.col("shingles").alias("centre")), "centres")
    rows = stars.join(nodes.select("node", "copies"), "node").join(sets, "node")
    rows = lookup(rows, centres, F.col("star"), "_star", how="inner").select("node", "star", "copies", "shingles", "centre")
    # half of the distance 1 - THRESHOLD, as a ratio of whole numbers
    near, of = THRESHOLD[1] - THRESHOLD[0], 2 * THRESHOLD[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            for i, (x, c) in enumerate(zip(b.column("shingles"), b.column("centre"))):
                x, c = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(c.as_py(), dtype=np.uint64)
                common = len(np.intersect1d(x, c, assume_unique=True))
                every = len(x) + len(c) - common
                keep[i] = of * (every - common) <= near * every
            yield b.select(["node", "star", "copies"]).filter(pa.array(keep))

    return staged(rows.mapInArrow(run, "node binary, star binary, copies bigint"), "cores")


def _core_links(cores: DataFrame) -> DataFrame:
    """The links within cores: node, root, links."""
    whole = staged(cores.groupBy(F.col("star").alias("_star")).agg(F.min("node").alias("root"), F.sum("copies").alias("all")), "core-sizes")
    found = lookup(cores, whole, F.col("star"), "_star", how="inner")
    return found.select("node", "root", (F.col("all") - F.col("copies")).alias("links")).where("links > 0")


def _placed(leaves: DataFrame, cores: DataFrame | None) -> DataFrame:
    """Where each node is compared: node, leaf, bi, bj, b. A leaf's greatest core takes negative block numbers and is compared with the rest only."""
    some = leaves.where("blocks = 1").select("node", "leaf", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("b"))
    if cores is None:
        return some
    crowd = staged(leaves.where("blocks > 1").join(cores.select("node", "star"), "node", "left"), "crowd")
    cores_of = crowd.where("star is not null").groupBy("leaf", "star").agg(F.count(F.lit(1)).alias("n"))
    first = cores_of.groupBy(F.col("leaf").alias("_leaf")).agg(F.max_by("star", F.struct("n", "star")).alias("main"))
    crowd = staged(lookup(crowd, staged(first, "main-cores"), F.col("leaf"), "_leaf").withColumn("inner", F.coalesce(F.col("star") == F.col("main"), F.lit(False))), "sided")
    side = lambda c, inner: F.coalesce(F.sum(F.when(F.col("inner") == inner, c)), F.lit(0))
    n_blocks = lambda inner: F.greatest(F.ceil(side(F.lit(1), inner) / MEMBERS), F.ceil(side(F.col("n_sh"), inner) / SHINGLES)).cast("int")
    sizes = staged(crowd.groupBy(F.col("leaf").alias("_leaf")).agg(n_blocks(True).alias("n_in"), n_blocks(False).alias("n_out")), "crowd-sizes")
    crowd = lookup(crowd, sizes, F.col("leaf"), "_leaf", how="inner").where("n_out > 0")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("n_in")).otherwise(F.col("n_out")).cast("bigint")).cast("int")
    crowd = crowd.withColumn("b", F.when(F.col("inner"), -1 - own).otherwise(own))
    count = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), lambda i: i < F.col(n))
    others = F.when(F.col("inner"), count("n_out")).otherwise(F.concat(count("n_out"), F.transform(count("n_in"), lambda i: -1 - i)))
    crowd = crowd.withColumn("j", F.explode(others))
    return some.unionByName(crowd.select("node", "leaf", F.least("b", "j").alias("bi"), F.greatest("b", "j").alias("bj"), "b"))


def _meetings(nodes: DataFrame, leaves: DataFrame, cores: DataFrame | None) -> DataFrame:
    """What each leaf (or pair of blocks of a crowd) is to compare; vec holds all leaves of a node, star is 0 outside of cores."""
    held = leaves.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("vec"))  # RUNS * 2 ** (LEVELS - 1) leaves at most
    facts = held.join(nodes.select("node", "copies", "sketch"), "node")
    if cores is None:
        facts = facts.withColumn("star", F.lit(0).cast("bigint"))
    else:
        facts = facts.join(cores.select("node", F.xxhash64("star").alias("star")), "node", "left").fillna(0, ["star"])
    return _placed(leaves, cores).join(facts, "node").select("leaf", "bi", "bj", "b", "node", "copies", "vec", "sketch", "star")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, with the rows at which the groups start and the end."""
    held: pa.Table | None = None

    def bounds(t: pa.Table) -> np.ndarray:
        a = [t.column(c).to_numpy() for c in ("leaf", "bi", "bj")]
        change = np.zeros(t.num_rows, dtype=bool)
        change[0] = True
        for x in a:
            change[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(change), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        cut = bounds(t)
        if len(cut) > 2:
            yield t.slice(0, cut[-2]).combine_chunks(), cut[:-1]
            t = t.slice(cut[-2])
        held = t
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])


class Met:
    """The facts of a table of groups that say which pairs are to be compared in it."""

    def __init__(self, t: pa.Table) -> None:
        vec = t.column("vec").combine_chunks()
        self.leaves, self.counts = vec.flatten().to_numpy(zero_copy_only=False), np.diff(vec.offsets.to_numpy())
        self.ends = np.cumsum(self.counts)
        self.sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(t.num_rows, KEYS)
        self.leaf, self.b, self.star = (t.column(c).to_numpy() for c in ("leaf", "b", "star"))
        self.within = t.column("bi").to_numpy() == t.column("bj").to_numpy()
        self.node = np.array(t.column("node").to_pylist(), dtype=object)

    def earlier(self, start: int, end: int) -> np.ndarray:
        """For the members of a group: which leaves below this one that several of them share (members x leaves)."""
        low, high = self.ends[start] - self.counts[start], self.ends[end - 1]
        leaves, row = self.leaves[low:high], np.repeat(np.arange(end - start), self.counts[start:end])
        before = leaves < self.leaf[start]
        _, column, often = np.unique(leaves[before], return_inverse=True, return_counts=True)
        row, useful = row[before], often > 1
        keep = useful[column]
        out = np.zeros((end - start, int(useful.sum())), dtype=np.float32)
        out[row[keep], (np.cumsum(useful) - 1)[column[keep]]] = 1
        return out

    def pairs(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the group that meet here first, are not linked by a core, and whose sketches do not rule them out."""
        held, out = self.earlier(start, end), []
        i, j = np.triu_indices(end - start, 1)
        for at in range(0, len(i), 65536):
            x, y = i[at : at + 65536] + start, j[at : at + 65536] + start
            ok = (self.star[x] != self.star[y]) | (self.star[x] == 0)
            if not self.within[start]:
                ok &= self.b[x] != self.b[y]
            x, y = x[ok], y[ok]
            ok = (self.sketch[x] == self.sketch[y]).sum(axis=1) >= SKETCH_SHARE * KEYS
            x, y = x[ok], y[ok]
            if held.shape[1] and len(x):
                ok = np.einsum("ij,ij->i", held[x - start], held[y - start]) == 0
                x, y = x[ok], y[ok]
            ok = self.node[x] != self.node[y] if len(x) else np.zeros(0, dtype=bool)
            out.append((x[ok], y[ok]))
        return np.concatenate([o[0] for o in out] or [i]), np.concatenate([o[1] for o in out] or [j])


def _by_group(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return rows.repartition("leaf", "bi", "bj").sortWithinPartitions("leaf", "bi", "bj").mapInArrow(run, schema)


_MEETING = "leaf bigint, bi int, bj int, b int, node binary, copies bigint, vec array<bigint>, sketch binary, star bigint"


def _needed(meetings: DataFrame) -> DataFrame:
    """The meetings in which a node has a partner to be compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _grouped(batches):
            met, need = Met(t), np.zeros(t.num_rows, dtype=bool)
            for a, z in zip(cut[:-1], cut[1:]):
                x, y = met.pairs(a, z)
                need[x] = need[y] = True
            yield from t.filter(pa.array(need)).to_batches()

    return _by_group(meetings, run, _MEETING)


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets (sorted, distinct) x[i] and y[i]."""
    if len(x) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y)], dtype=np.int64)
    counts = np.array([len(s) for s in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, useful = np.repeat(np.arange(len(sets)), counts), often > 1
    rank = np.cumsum(useful) - 1
    keep = useful[column]
    row, column = row[keep], rank[column[keep]]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(useful.sum()), 4096):
        low, high = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[row[low:high], column[low:high] - at] = 1
        common += (part @ part.T).astype(np.int64)
    return common[x, y]


def _links(compared: DataFrame) -> DataFrame:
    """Exact links within each group: node, root (least node that links lead to here), links (copies counted)."""
    times, of = THRESHOLD[1], THRESHOLD[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _grouped(batches):
            met, copies, packed = Met(t), t.column("copies").to_numpy(), t.column("shingles")
            nodes, roots, links = [], [], []
            for a, z in zip(cut[:-1], cut[1:]):
                # rows that a repeated document doubled count once
                seen: set[bytes] = set()
                once = np.array([not (n in seen or seen.add(n)) for n in met.node[a:z]])
                x, y = met.pairs(a, z)
                ok = once[x - a] & once[y - a]
                x, y = x[ok] - a, y[ok] - a
                if not len(x):
                    continue
                sets = [np.frombuffer(packed[i].as_py(), dtype=np.uint64) for i in range(a, z)]
                sizes = np.array([len(s) for s in sets])
                close = np.minimum(sizes[x], sizes[y]) * times >= np.maximum(sizes[x], sizes[y]) * of
                x, y = x[close], y[close]
                common = overlaps(sets, x, y)
                linked = common * times >= (sizes[x] + sizes[y] - common) * of
                x, y = x[linked], y[linked]
                count = np.zeros(z - a, dtype=np.int64)
                np.add.at(count, x, copies[a:z][y])
                np.add.at(count, y, copies[a:z][x])
                parent = list(range(z - a))

                def root(i: int, parent=parent) -> int:
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for p, q in zip(x.tolist(), y.tolist()):
                    p, q = root(p), root(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                for i in np.flatnonzero(count):
                    nodes.append(met.node[a + i])
                    roots.append(met.node[a + root(int(i))])
                    links.append(int(count[i]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(roots, pa.binary()), pa.array(links, pa.int64())], names=["node", "root", "links"])

    return _by_group(compared, run, "node binary, root binary, links bigint")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The whole shingle sets of the nodes of `wanted`, made again from the texts: node, shingles. Rows that repeat a key and text repeat theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                flat, counts = _lists(b, "w")
                values, n = shingle_values(flat, counts)
                ends = np.cumsum(n)
                packed = [np.unique(values[e - c : e]).tobytes() for e, c in zip(ends, n)]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(packed, pa.binary())], names=["node", "shingles"])

    wanted = staged(wanted.join(nodes.select("node", "min_doc"), "node").withColumnRenamed("node", "_wanted"), "wanted")
    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"), "text")
    rows = lookup(rows, wanted, F.col("node"), "_wanted", how="inner").where(F.col("doc_id").eqNullSafe(F.col("min_doc")))
    return rows.select("node", _word_hashes(F.col("text")).alias("w")).mapInArrow(run, "node binary, shingles binary")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (node, root): one row per node with its label, the least node.

    Each round points every node at its least neighbour, follows pointers twice, and contracts;
    what is left of the edges shrinks at least by half a round and ends at none.
    """
    links = staged(edges.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b").distinct(), "edges")
    labels = edges.select("node").union(edges.select("root")).distinct().select("node", F.col("node").alias("label"))
    while links.limit(1).count():
        both = links.union(links.select("b", "a"))
        up = staged(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")), "parents")
        over = up.select(F.col("a").alias("a2"), F.col("p").alias("p2"))
        up = staged(up.join(over, F.col("p") == F.col("a2")).select("a", F.col("p2").alias("p")), "parents")
        left, right = up.select("a", F.col("p").alias("pa")), up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        links = staged(links.join(left, "a").join(right, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a != b").distinct(), "edges")
        labels = staged(labels.join(up.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
    return labels


def similar_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts that have a copy or a link: node, class_id, n_links, min_doc, copies, label (of the component). Small beside the corpus."""
    slim = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    nodes = staged(_nodes(slim), "nodes")
    leaves = staged(_leaves(nodes), "leaves")
    cores = _stars(slim, nodes, leaves)
    needed = staged(_needed(_meetings(nodes, leaves, cores)), "needed")
    sets = _sets(slim, nodes, needed.select("node").distinct())
    links = _links(lookup(sets, needed.withColumnRenamed("node", "_node"), F.col("node"), "_node", how="inner", salts=1))
    if cores is not None:
        links = links.unionByName(_core_links(cores))
    links = staged(links, "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(links)
    some = nodes.where("n_sh > 0").select("node", "min_doc", "copies").join(counts, "node", "left").where("copies > 1 or links is not null")
    some = staged(some.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "linked")
    least = some.groupBy("label").agg(F.min("min_doc").alias("class_id"))
    out = some.join(least, "label")
    return staged(out.select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "min_doc", "copies", "label"), "classes")


def jaccard_join(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, class_id, n_links."""
    classes = similar_classes(docs, key=key, text=text).select(F.col("node").alias("_node"), "class_id", "n_links")
    rows = docs.select(F.col(key).alias("_k"), node_of(F.col(text)).alias("node"))
    joined = lookup(rows, classes, F.col("node"), "_node")
    return joined.select(F.col("_k").alias(key), F.coalesce("class_id", F.col("_k").cast("bigint")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each_class(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without those of a class but the one of its least key; the columns stay as they are, whatever their names.

    A class is a component of texts, as classes of null keys or of one key have the same class_id. Null
    keys come last, and of several texts of the least key the one of the least node stays. Only texts that have a copy or a link are looked up. Where whole rows repeat (same key and text),
    one of them stays.
    """
    classes = similar_classes(docs, key=key, text=text)
    rows = docs.select(packed(docs), F.col(key).alias("_k"), node_of(F.col(text)).alias("_node"))
    least = classes.where(F.col("min_doc").eqNullSafe(F.col("class_id"))).groupBy(F.col("label").alias("_label")).agg(F.min("node").alias("_first"))
    known = classes.join(least, F.col("label") == F.col("_label")).select(
        F.col("node").alias("_known"), (F.col("node") == F.col("_first")).alias("_stays"), F.col("class_id").alias("_class"), F.col("copies").alias("_copies")
    )
    joined = lookup(rows, staged(known, "known"), F.col("_node"), "_known")
    fit = F.col("_stays").isNull() | (F.col("_stays") & F.col("_k").eqNullSafe(F.col("_class")))
    alone = joined.where(fit)
    again = alone.where("_copies > 1").groupBy("_node").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_node").alias("_again"))
    again = staged(again, "repeated-rows")
    if not again.limit(1).count():
        return alone.select(*unpacked(docs.columns))
    marked = lookup(alone, again.withColumn("_twice", F.lit(True)), F.col("_node"), "_again")
    single = marked.where(F.col("_twice").isNull()).select(OWN + "row")
    row = F.col(OWN + "row")
    hashable = "map<" not in docs.schema.simpleString() and "variant" not in docs.schema.simpleString()
    one = marked.where("_twice").groupBy("_node").agg((F.min_by(row, F.xxhash64(row)) if hashable else F.first(row)).alias(OWN + "row")).select(OWN + "row")
    return single.unionByName(one).select(*unpacked(docs.columns))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document; all cases as the module says."""
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLES: dict[str, str] = {}
