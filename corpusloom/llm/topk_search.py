"""Exact top-k by inner product: columnar branch-and-bound over dimension blocks.

Candidates lie in vertical layout (one row of the matrix per dimension). For each query the score
is accumulated block of dimensions by block; after each block a candidate stays only if its score
so far plus the most that the remaining dimensions can add (the product of the remaining norms of
query and candidate) reaches the query's k-th best score so far. Survivors are compacted, so later
blocks touch few columns. Bounds only ever discard candidates that lie strictly below, so results
and ties are exact.

Dimensions are taken in order of the energy that the queries of a block have in them, so that the bounds fall as
soon as they can. Every query starts with the k-th best score among SEEDS candidates, the same in all tasks,
so bounds discard from the first candidate of a task on.

Queries are a stated subset; they are read in blocks of QUERY_BLOCK rows (fewer of long vectors, BLOCK_BYTES in all), each block is sent to
every task of one pass over the candidates, and a task hands on at most k rows per query. The passes are
bounded by arithmetic and not by reading: a pass does QUERY_BLOCK products for each candidate that it reads.

Defined results: vectors that are null, or hold null or non-finite components, take no part; equal
vectors tie to the smaller id; vectors of other lengths than the query's are never its candidates; a vector of any
length is compared whole; null ids take no part; ids that repeat are compared by row, and only rows of the query's own id are
left out; two vectors of one queried id are two queries, each with a ranking of its own, and equal ones are one;
other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import staged, table

K = 10
SCALE = 1024
QUERY_EVERY = 100
#: Queries sent to the tasks at once, and the bytes that they take at most.
QUERY_BLOCK, BLOCK_BYTES = 16_384, 32 << 20
#: Candidates whose scores give the first bounds.
SEEDS = 4096
DIM_BLOCK = 8
#: Candidates that a task holds at once.
CHUNK = 4096
#: Rows of a task's first chunk, which is scored whole and gives the bounds for the rest.
FIRST_CHUNK = 256


class Best:
    """The k best (score, id) of one query so far; k candidates are known to reach `least`."""

    __slots__ = ("ids", "scores", "k", "least")

    def __init__(self, k: int, least: float = -np.inf) -> None:
        self.k, self.ids, self.scores, self.least = k, np.empty(0, np.int64), np.empty(0, np.int64), least

    def floor(self) -> float:
        return max(self.least, float(self.scores[-1])) if len(self.scores) == self.k else self.least

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def remaining_norms(columns: np.ndarray, block: int = DIM_BLOCK) -> np.ndarray:
    """For each block start: the norm of the components from there on, for every column."""
    squares = columns.astype(float) ** 2
    tail = np.zeros((-(-columns.shape[0] // block) + 1, columns.shape[1]))
    for i in range(len(tail) - 2, -1, -1):
        tail[i] = tail[i + 1] + squares[i * block : (i + 1) * block].sum(axis=0)
    return np.sqrt(tail)


def search_chunk(query: np.ndarray, query_id: int, columns: np.ndarray, ids: np.ndarray, norms: np.ndarray, best: Best, block: int = DIM_BLOCK) -> int:
    """Fold one chunk of candidates into `best`; returns how many components were touched."""
    alive = np.flatnonzero(ids != query_id)
    score = np.zeros(len(alive), dtype=columns.dtype)
    left = remaining_norms(query[:, None], block)[:, 0]
    touched = 0
    for i in range(len(left) - 1):
        part = columns[i * block : (i + 1) * block]
        part = part if len(alive) == part.shape[1] else part[:, alive]
        score = score + query[i * block : (i + 1) * block] @ part
        touched += part.size
        low = best.floor()
        if low > -np.inf:
            most = score + left[i + 1] * norms[i + 1][alive] * (1 + 1e-9) + 1
            keep = most >= low
            if not keep.all():
                alive, score = alive[keep], score[keep]
            if not len(alive):
                return touched
    best.add(ids[alive], score.astype(np.int64))
    return touched


def _clean(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """Rows that take part: id, and the components turned into whole numbers."""
    v = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(key).isNotNull() & F.col(embedding).isNotNull() & finite).select(F.col(key).cast("bigint").alias("_id"), v.alias("_v"))


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vertical matrix of each vector length in the batch. Doubles hold the whole numbers exactly below 2**53."""
    lists = batch.column(1)
    lengths = np.diff(lists.offsets.to_numpy())
    flat, ids = lists.flatten().to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        columns = flat[(starts[rows][None, :] + np.arange(n)[:, None])]
        big = len(flat) and float(np.abs(flat.astype(float)).max()) ** 2 * max(1, int(n)) >= 2**53
        yield ids[rows], columns.astype(np.int64 if big else np.float64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in chunks, the first one short: without a k-th best score yet, no bound discards anything."""
    size = FIRST_CHUNK
    for b in batches:
        at = 0
        while at < b.num_rows:
            yield b.slice(at, size)
            at += size
            size = CHUNK


def first_bounds(ids: np.ndarray, queries: np.ndarray, seeds: list[tuple[int, list[int]]], k: int) -> np.ndarray:
    """For each query a score that k of the seeds (rows of one length) reach, -inf where fewer are candidates."""
    out = np.full(len(ids), -np.inf)
    if len(seeds) < k:
        return out
    own, vectors = np.array([i for i, _ in seeds]), np.array([v for _, v in seeds], dtype=np.int64)
    for at in range(0, len(ids), 1024):
        scores = (queries[at : at + 1024].astype(object if np.abs(vectors).max(initial=0) >= 2**20 else np.int64) @ vectors.T).astype(float)
        scores[ids[at : at + 1024, None] == own[None, :]] = -np.inf
        out[at : at + 1024] = np.partition(scores, -k, axis=1)[:, -k]
    # a float stands for a whole number that may lie a little above it
    return out - np.abs(out) * 1e-9 - 1


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, *, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k best other rows of `vectors` for every row of `queries`: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    asked = staged(_clean(queries, key, embedding).distinct().withColumn("_hash", F.xxhash64("_id", "_v")), "queries")
    n_asked, longest = asked.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    per_block = max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * max(1, longest or 1))))
    numbered = asked.withColumn("_block", F.pmod(F.col("_hash"), F.lit(max(1, -(-n_asked // per_block)))))
    candidates = _clean(vectors, key, embedding)
    seeds: dict[int, list[tuple[int, list[int]]]] = {}
    for r in candidates.limit(max(k, min(SEEDS, BLOCK_BYTES // (8 * max(1, longest or 1))))).collect() if n_asked else []:
        seeds.setdefault(len(r["_v"]), []).append((r["_id"], r["_v"]))
    found: list[DataFrame] = []
    for (number,) in numbered.select("_block").distinct().orderBy("_block").collect():
        by_length: dict[int, list] = {}
        for r in numbered.where(F.col("_block") == number).orderBy("_id", "_hash").collect():
            by_length.setdefault(len(r["_v"]), []).append(r)
        held = {}
        for n, rows in by_length.items():
            ids, q = np.array([r["_id"] for r in rows], np.int64), np.array([r["_v"] for r in rows], np.int64).reshape(len(rows), n)
            order = np.argsort(-(q.astype(float) ** 2).sum(axis=0), kind="stable")
            held[n] = ids, np.array([r["_hash"] for r in rows], np.int64), q[:, order], order, first_bounds(ids, q, seeds.get(n, []), k)
        sent = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = sent.value
            best = {n: [Best(k, x) for x in least.tolist()] for n, (_, _, _, _, least) in held.items()}
            for part in chunks(batches):
                for ids, columns in _matrix(part):
                    n = columns.shape[0]
                    if n not in held:
                        continue
                    q_ids, _, q, order, _ = held[n]
                    columns = columns[order]
                    if columns.dtype == np.float64 and q.size and float(np.abs(q).max()) * float(np.abs(columns).max(initial=0)) * max(1, n) >= 2**53:
                        columns = columns.astype(np.int64)
                    q = q.astype(columns.dtype)
                    norms = remaining_norms(columns)
                    for i, q_id in enumerate(q_ids):
                        search_chunk(q[i], int(q_id), columns, ids, norms, best[n][i])
            for n, (q_ids, hashes, _, _, _) in held.items():
                for q_id, h, x in zip(q_ids, hashes, best[n]):
                    if len(x.ids):
                        size = len(x.ids)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(size, q_id)), pa.array(np.full(size, h)), pa.array(x.ids), pa.array(x.scores)], names=["query_id", "query", "vec_id", "score"]
                        )

        found.append(staged(candidates.mapInArrow(run, "query_id bigint, query bigint, vec_id bigint, score bigint"), "partial-top"))
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every vector whose id is divisible by QUERY_EVERY; all cases as the module says."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0))


QUERIES = {"op7_topk_search": op7_topk_search}
ORACLES = {
    "op7_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""
}
