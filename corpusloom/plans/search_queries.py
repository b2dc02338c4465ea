"""Search queries over documents and embeddings, and the SQL that they are checked against."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.search import B, IDF_FLOOR, K1, Index, best_span, filtered_search, query_phrases, span_filter, title_boost, top_k, write_index
from corpusloom.operators.vectors import compare_runs, cosine_to, hybrid_minmax, hybrid_product, nearest, score_labelled, semantic_only, summarize
from corpusloom.sources.staging import shared_folder, staged
from corpusloom.sources.tables import table

OR_QUERY = "the erin que auf"
AND_QUERY = "the of was"
PHRASE_QUERY = "of-the que-de"
PREFIX_QUERY = "auf ere"
LIMIT = 10
WEIGHT = 0.5
BOOST = 1.5
#: The labelled queries: every row whose id is divisible by this; its vector is the query and its label names what is relevant.
EVAL_EVERY = 20
#: Dimensions that the sweep compares.
SWEEP = (4, 8, 16, 64)


#: A batch of queries as users ask them: words, all of them or some, phrases, letters with marks.
BATCH = (
    "the erin", "que de la", "auf", "of-the", "señor ción", "SENOR CION", "ing that", "the-of", "ere", "er es en", "und", "é", "que-de", "thth", "ble thre",
    "nothing-like-it", "la", "was her", "eaux", "tion", "with from", "are-is", "ous", "Ÿ",
)

_indexes: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the documents of a folder, written once a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _indexes:
        path = f"{shared_folder(spark).rstrip('/')}/corpusloom/{uuid.uuid4().hex}-index"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        write_index(_docs(spark, sf_dir), path)
        _indexes[at] = Index(spark, path)
    return _indexes[at]


def _found(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", F.round("score", 6).alias("score"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def bm25_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(top_k(index_of(spark, sf_dir).one(OR_QUERY), LIMIT))


def bm25_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(top_k(index_of(spark, sf_dir).one(AND_QUERY, mode="and"), LIMIT))


def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(top_k(index_of(spark, sf_dir).one(PHRASE_QUERY), LIMIT))


def bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(top_k(index_of(spark, sf_dir).one(PREFIX_QUERY, prefix=True), LIMIT))


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = index_of(spark, sf_dir).best(list(BATCH), LIMIT)
    return best.select("qid", "rank", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(filtered_search(index_of(spark, sf_dir).one(OR_QUERY), _docs(spark, sf_dir), F.col("lang") == "en", LIMIT))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as spans: the source and language make locator and headings, the key the page."""
    kind, tier = F.when(F.col("lang") == "en", "page").otherwise("note"), F.when(F.col("source") < "src3", "high").otherwise("low")
    return _docs(spark, sf_dir).select(
        "doc_id", F.concat_ws("/", F.lit("./Vault"), "source", "lang").alias("locator"), kind.alias("kind"), tier.alias("trust_tier"),
        F.pmod("doc_id", F.lit(3)).alias("page"), F.array(F.initcap("source"), F.upper("lang")).alias("heading_path"), "source",
    )


#: Each filter alone, and all together.
FILTERS = {
    "source": {"source": "VAULT/src1"}, "exclude": {"exclude": ("./Vault/src0", "Vault/src2/en")}, "kind": {"kinds": ("note",)}, "trust": {"trust": ("high", "user")}, "page": {"page": 2},
    "heading": {"heading": "src4 > e"}, "all": {"source": "src", "exclude": ("Vault/src5",), "kinds": ("page",), "trust": ("high",), "page": 1, "heading": " > en"},
}


def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of the fifty best that each set of filters lets pass."""
    scored, located = top_k(index_of(spark, sf_dir).one(OR_QUERY), 5 * LIMIT), _located(spark, sf_dir)
    parts = [_found(filtered_search(scored, located, span_filter(**f), LIMIT, candidates=0)).withColumn("filter", F.lit(name)) for name, f in FILTERS.items()]
    return reduce(DataFrame.unionByName, parts)


def best_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each source, as the best span of a document."""
    return best_span(index_of(spark, sf_dir).one(OR_QUERY, key="span_id"), _docs(spark, sf_dir).select(F.col("doc_id").alias("span_id"), F.col("source").alias("document_id"))).withColumn("score", F.round("score", 6))


def bm25_title_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(top_k(title_boost(index_of(spark, sf_dir).one(OR_QUERY), _docs(spark, sf_dir), OR_QUERY, BOOST), LIMIT))


def _cos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_to(table(spark, sf_dir, "embeddings"), [0]).select(F.col("vec_id").alias("doc_id"), "cos")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_k(_cos(spark, sf_dir), LIMIT, score="cos")
    return best.select(F.col("doc_id").alias("vec_id"), F.round("cos", 6).alias("score"))


def semantic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as spans of documents, seven of each."""
    spans = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("span_id"), F.floor(F.col("vec_id") / 7).alias("document_id"))
    return semantic_only(_cos(spark, sf_dir).withColumnRenamed("doc_id", "span_id"), spans, LIMIT).withColumn("score", F.round("score", 6))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(index_of(spark, sf_dir).one(OR_QUERY), 5 * LIMIT).withColumnRenamed("score", "lex")


def hybrid_product_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(top_k(hybrid_product(_lexical(spark, sf_dir), _cos(spark, sf_dir), WEIGHT, LIMIT), LIMIT))


def hybrid_minmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(top_k(hybrid_minmax(_lexical(spark, sf_dir), _cos(spark, sf_dir), WEIGHT), LIMIT))


def _scored(spark: SparkSession, sf_dir: str, dims: tuple[int | None, ...] = (None,)) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    ranking = staged(nearest(vectors, F.pmod("vec_id", F.lit(EVAL_EVERY)) == 0, LIMIT, dims=dims), "ranking")
    return score_labelled(ranking, vectors.select("vec_id", "label"), "dims")


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    by = summarize(scored, "label").withColumn("category", F.col("label").cast("string")).drop("label")
    return by.unionByName(summarize(scored).withColumn("category", F.lit("all")))


def metrics_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = staged(_scored(spark, sf_dir, (8, None)), "scored")
    return compare_runs(summarize(scored.where("dims = 8")), summarize(scored.where("dims IS NULL")))


def dimension_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries by the first so many dimensions."""
    return summarize(_scored(spark, sf_dir, SWEEP), "dims").withColumnRenamed("dims", "dimensions")


def bm25_sql(query: str, mode: str = "or", prefix: bool = False) -> str:
    """A query `s(doc_id, score)` in SQL."""
    phrases = query_phrases(query)
    tf = []
    for i, p in enumerate(phrases):
        go_on = prefix and i == len(phrases) - 1
        if len(p) == 1:
            test = f"starts_with(x, '{p[0]}')" if go_on else f"x = '{p[0]}'"
            tf.append(f"len(list_filter(t, lambda x: {test})) AS tf{i}")
        else:
            test = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(p))
            tf.append(f"len(list_filter(range(1, len(t) - {len(p) - 2}), lambda i: {test})) AS tf{i}")
    terms = " + ".join(
        f"CASE WHEN tf{i} > 0 THEN (CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN {IDF_FLOOR} ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
        f" * tf{i} * {K1 + 1} / (tf{i} + {K1} * ({1 - B} + {B} * len / avg_len)) ELSE 0.0 END"
        for i in range(len(phrases))
    )
    join = " AND " if mode == "and" else " OR "
    return rf"""
tk AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
tfs AS (SELECT doc_id, len(t) AS len, {', '.join(tf)} FROM tk),
tot AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avg_len, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(phrases)))} FROM tfs),
s AS (SELECT doc_id, ({terms})::DOUBLE AS score FROM tfs, tot WHERE {join.join(f'tf{i} > 0' for i in range(len(phrases)))})"""


def _top(source: str = "s", n: int = LIMIT) -> str:
    return f"SELECT doc_id, round(score, 6) AS score FROM {source} ORDER BY {source}.score DESC, doc_id LIMIT {n}"


_COS = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings),
c AS (SELECT e.vec_id AS doc_id, list_cosine_similarity(q.v, e.v) AS cos FROM e, e q WHERE q.vec_id = 0 AND e.vec_id <> 0)"""
_LEX = f"lx AS (SELECT doc_id, score AS lex FROM s ORDER BY score DESC, doc_id LIMIT {5 * LIMIT})"


def _metrics_sql(name: str, dims: str) -> str:
    return f"""
e{name} AS (SELECT vec_id, list_transform(embedding{dims}, lambda x: x::DOUBLE) AS v, label FROM embeddings),
rk{name} AS (SELECT q.vec_id AS query_id, e.vec_id, q.label = e.label AS rel, q.label,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, e.v) DESC, e.vec_id) AS rank
       FROM e{name} q JOIN e{name} e ON q.vec_id <> e.vec_id WHERE q.vec_id % {EVAL_EVERY} = 0),
sc{name} AS (SELECT query_id, label, count(*) FILTER (rel) AS n, count(*) FILTER (rel AND rank <= 5) AS h5,
       count(*) FILTER (rel AND rank <= 10) AS h10, coalesce(1.0 / min(rank) FILTER (rel AND rank <= 10), 0.0) AS mrr FROM rk{name} GROUP BY ALL),
q{name} AS (SELECT query_id, label, h5 / n AS recall_5, h10 / n AS recall_10, h5 / 5 AS precision_5, mrr::DOUBLE AS mrr, h10 = 0 AS miss FROM sc{name})"""


def _batch_sql() -> str:
    """The batch, each query by itself."""
    parts = [f"SELECT {i} AS qid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (WITH {bm25_sql(q)} SELECT doc_id, score FROM s)" for i, q in enumerate(BATCH)]
    return f"SELECT qid, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM ({' UNION ALL '.join(parts)}) WHERE rank <= {LIMIT}"


_LOCATED = """
l AS (SELECT doc_id, './Vault/' || source || '/' || lang AS loc, CASE WHEN lang = 'en' THEN 'page' ELSE 'note' END AS kind, CASE WHEN source < 'src3' THEN 'high' ELSE 'low' END AS tier,
      doc_id % 3 AS page, lower(source || ' > ' || lang) AS head FROM documents)"""
_FILTER_SQL = {
    "source": "contains(lower(loc), 'vault/src1')", "exclude": "NOT starts_with(loc, './Vault/src0') AND NOT starts_with(loc, './Vault/src2/en')", "kind": "kind = 'note'",
    "trust": "tier = 'high'", "page": "page = 2", "heading": "contains(head, 'src4 > e')",
    "all": "contains(loc, 'src') AND NOT starts_with(loc, './Vault/src5') AND kind = 'page' AND tier = 'high' AND page = 1 AND contains(head, ' > en')",
}

_SUMMARY = "count(*) AS queries, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(precision_5), 6) AS precision_5, round(avg(mrr), 6) AS mrr, count(*) FILTER (miss) AS misses"
_TERMS = [t for t in OR_QUERY.split() if len(t) > 2]

QUERIES = {
    "bm25_or_topk": bm25_or_topk,
    "bm25_and_topk": bm25_and_topk,
    "bm25_phrase": bm25_phrase,
    "bm25_prefix": bm25_prefix,
    "bm25_batch": bm25_batch,
    "bm25_filtered": bm25_filtered,
    "search_filters": search_filters,
    "best_spans": best_spans,
    "bm25_title_boost": bm25_title_boost,
    "vector_topk": vector_topk,
    "hybrid_product": hybrid_product_topk,
    "hybrid_minmax": hybrid_minmax_topk,
    "retrieval_metrics": retrieval_metrics,
    "metrics_compare": metrics_compare,
    "dimension_sweep": dimension_sweep,
    "semantic_documents": semantic_documents,
}
ORACLES = {
    "bm25_or_topk": f"WITH {bm25_sql(OR_QUERY)} {_top()}",
    "bm25_and_topk": f"WITH {bm25_sql(AND_QUERY, 'and')} {_top()}",
    "bm25_phrase": f"WITH {bm25_sql(PHRASE_QUERY)} {_top()}",
    "bm25_prefix": f"WITH {bm25_sql(PREFIX_QUERY, prefix=True)} {_top()}",
    "bm25_filtered": f"""WITH {bm25_sql(OR_QUERY)},
p AS (SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 50),
f AS (SELECT p.* FROM p JOIN documents USING (doc_id) WHERE lang = 'en') {_top('f')}""",
    "bm25_batch": _batch_sql(),
    "search_filters": f"WITH {bm25_sql(OR_QUERY)}, {_LOCATED}, p AS (SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT {5 * LIMIT}), "
    + "m AS (" + " UNION ALL ".join(f"SELECT '{n}' AS filter, doc_id, score FROM p JOIN l USING (doc_id) WHERE {c}" for n, c in _FILTER_SQL.items())
    + f") SELECT filter, doc_id, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY filter ORDER BY m.score DESC, doc_id) <= {LIMIT}",
    "best_spans": f"WITH {bm25_sql(OR_QUERY)} SELECT source AS document_id, doc_id AS span_id, round(score, 6) AS score FROM s JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY source ORDER BY s.score DESC, doc_id) = 1",
    "bm25_title_boost": f"""WITH {bm25_sql(OR_QUERY)},
b AS (SELECT doc_id, score * CASE WHEN {' OR '.join(f"contains(lower(string_split(text, chr(10))[1]), '{t}')" for t in _TERMS)} THEN {BOOST} ELSE 1 END AS score
      FROM s JOIN documents USING (doc_id)) {_top('b')}""",
    "vector_topk": f"WITH {_COS} SELECT doc_id AS vec_id, round(cos, 6) AS score FROM c ORDER BY cos DESC, doc_id LIMIT {LIMIT}",
    "semantic_documents": f"""WITH {_COS}, t AS (SELECT doc_id AS span_id, cos, doc_id // 7 AS document_id FROM c ORDER BY cos DESC, doc_id LIMIT 90),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY cos DESC, span_id) = 1) SELECT document_id, span_id, round(cos, 6) AS score FROM b ORDER BY b.cos DESC, document_id LIMIT {LIMIT}""",
    "hybrid_product": f"""WITH {bm25_sql(OR_QUERY)}, {_COS}, {_LEX},
x AS (SELECT doc_id, cos FROM c ANTI JOIN lx USING (doc_id) ORDER BY cos DESC, doc_id LIMIT {max(LIMIT, 10)}),
u AS (SELECT doc_id, lex, cos FROM lx LEFT JOIN c USING (doc_id) UNION ALL SELECT doc_id, NULL, cos FROM x),
h AS (SELECT doc_id, {WEIGHT} * coalesce(cos, 0) + {1 - WEIGHT} * coalesce(lex / (SELECT max(lex) FROM lx), 0) AS score FROM u) {_top('h')}""",
    "hybrid_minmax": f"""WITH {bm25_sql(OR_QUERY)}, {_COS}, {_LEX},
a AS (SELECT doc_id, CASE WHEN max(lex) OVER () = min(lex) OVER () THEN 1.0 ELSE (lex - min(lex) OVER ()) / (max(lex) OVER () - min(lex) OVER ()) END AS v FROM lx),
b AS (SELECT doc_id, CASE WHEN max(cos) OVER () = min(cos) OVER () THEN 1.0 ELSE (cos - min(cos) OVER ()) / (max(cos) OVER () - min(cos) OVER ()) END AS v FROM c),
h AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, {WEIGHT} * coalesce(b.v, 0) + {1 - WEIGHT} * coalesce(a.v, 0) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id) {_top('h')}""",
    "retrieval_metrics": f"WITH {_metrics_sql('', '')} SELECT label::VARCHAR AS category, {_SUMMARY} FROM q GROUP BY label UNION ALL SELECT 'all', {_SUMMARY} FROM q",
    "dimension_sweep": "WITH " + ", ".join(_metrics_sql(f"w{n}", f"[1:{n}]") for n in SWEEP) + " " + " UNION ALL ".join(f"SELECT {n} AS dimensions, {_SUMMARY} FROM qw{n}" for n in SWEEP),
    "metrics_compare": f"""WITH {_metrics_sql('0', '[1:8]')}, {_metrics_sql('1', '')},
d AS (SELECT (SELECT round(avg(recall_10), 6) FROM q1) - (SELECT round(avg(recall_10), 6) FROM q0) AS r, (SELECT round(avg(mrr), 6) FROM q1) - (SELECT round(avg(mrr), 6) FROM q0) AS m)
SELECT round(r, 6) AS delta_recall_10, round(m, 6) AS delta_mrr,
       CASE WHEN r > 0.01 THEN 'better' WHEN r < -0.01 THEN 'worse' WHEN m > 0.01 THEN 'better' WHEN m < -0.01 THEN 'worse' ELSE 'same' END AS verdict FROM d""",
}
