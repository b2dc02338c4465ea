"""Corpus and link queries, and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators import links as L
from corpusloom.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    groups = C.duplicates(docs).agg(F.countDistinct("content_hash").alias("duplicate_groups"), F.count(F.lit(1)).alias("duplicate_documents"))
    sources = docs.agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"))
    return C.stats(docs).join(F.broadcast(groups)).join(F.broadcast(sources))


def stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stats(_docs(spark, sf_dir), "source")


def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    total = docs.agg(F.count(F.lit(1)).alias("_all"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents")).join(F.broadcast(total)).select("lang", "documents", F.round(F.lit(100.0) * F.col("documents") / F.col("_all"), 1).alias("percent"))


def doc_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.hashed(_docs(spark, sf_dir))


def duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicates(_docs(spark, sf_dir))


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fingerprint(_docs(spark, sf_dir))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the corpus: one source not yet there, one gone since, and the texts of one language revised."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang", "source")
    after = docs.where("source <> 'src5'").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("\nrevised"))).otherwise(F.col("text")))
    return docs.where("source <> 'src3'"), after


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.snapshot_diff(*_snapshots(spark, sf_dir))


def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


def largest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", C.line_count(F.col("text")).alias("lines"))
    return docs.orderBy(F.col("lines").desc(), "doc_id").limit(10)


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without headings are one span from the first to the last line; blank ones have none."""
    docs = _docs(spark, sf_dir).where(F.trim(F.col("text")) != "")
    return docs.select("doc_id", F.lit(0).alias("ordinal"), F.lit(1).alias("start_line"), C.line_count(F.col("text")).alias("end_line"), C.content_hash(F.col("text")).alias("content_hash"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the path of the URL with .md."""
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(bare, F.lit(".md")).alias("path"))


def filename_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy(C.filename_style(F.substring_index("path", "/", -1)).alias("style")).agg(F.count(F.lit(1)).alias("files"))


def ambiguity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ambiguous_stems(_pages(spark, sf_dir).select("path"))


def convention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    english = F.col("path").contains("/en/")
    return C.conventions(_pages(spark, sf_dir), {"english": english, "everywhere": F.lit(True)}, {"english": C.filename_style(name) == "kebab-case", "everywhere": name.rlike(r"^[0-9]+\.md$")})


def extraction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extracting each document would cost: cached sources, documents that were not ingested (here: not labelled), texts too short, copies after the first, the rest pending with two calls."""
    docs = _docs(spark, sf_dir)
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("ingested")).distinct()
    rows = docs.join(known, "doc_id", "left").select("doc_id", "source", "ingested", C.content_hash(F.col("text")).alias("h"), F.char_length(F.trim(F.coalesce("text", F.lit("")))).alias("size"))
    first = rows.where("source <> 'src1' and ingested").groupBy("h").agg(F.min("doc_id").alias("first_id"))
    status = F.when(F.col("source") == "src1", "cached").when(F.col("ingested").isNull(), "not_ingested").when(F.col("size") < 40, "no_spans").when(F.col("doc_id") != F.col("first_id"), "duplicate").otherwise("pending")
    out = rows.join(first, "h", "left").select("source", status.alias("status"))
    return out.groupBy("source", "status").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(F.col("status") == "pending", 2).otherwise(0)).alias("calls"))



_HASH = r"sha256(regexp_replace(text, '\r\n?', chr(10), 'g'))"
_LINES_N = "(length(text) - length(replace(text, chr(10), '')) + 1)"
_STATS = f"count(*) AS documents, coalesce(sum(length(text)), 0)::BIGINT AS chars, coalesce(sum({_LINES_N}), 0)::BIGINT AS lines, count(*) FILTER (coalesce(trim(text), '') = '') AS empty, max(length(text))::BIGINT AS longest"
_DIFF = f"""
a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src3'),
b AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || chr(10) || 'revised' ELSE text END) AS h FROM documents WHERE source <> 'src5'),
f AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS status
      FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""
_PAGES = r"pg AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '.md' AS path FROM pages), nm AS (SELECT *, string_split(path, '/')[-1] AS name FROM pg)"
_STYLE = r"CASE WHEN regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)*\.md$') THEN 'kebab-case' WHEN regexp_matches(name, '^[A-Z0-9_]+\.md$') THEN 'SHOUT_CASE' WHEN contains(name, ' ') THEN 'Title Case with spaces' ELSE 'other' END"
QUERIES = {
    f.__name__: f
    for f in (corpus_stats, stats_by_source, language_histogram, doc_hashes, duplicate_docs, corpus_fingerprint, snapshot_diff, change_summary, largest_documents, line_spans, filename_styles, ambiguity_index,
              convention_report, extraction_plan)
}
ORACLES = {
    "corpus_stats": f"WITH g AS (SELECT {_HASH} AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT {_STATS}, (SELECT count(*) FROM g) AS duplicate_groups, (SELECT coalesce(sum(n), 0)::BIGINT FROM g) AS duplicate_documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages FROM documents",
    "stats_by_source": f"SELECT source, {_STATS} FROM documents GROUP BY source",
    "language_histogram": "SELECT lang, count(*) AS documents, round(100.0 * count(*) / (SELECT count(*) FROM documents), 1) AS percent FROM documents GROUP BY lang",
    "doc_hashes": f"SELECT doc_id, {_HASH} AS content_hash FROM documents",
    "duplicate_docs": f"WITH h AS (SELECT doc_id, {_HASH} AS content_hash FROM documents) SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY content_hash) AS copies, min(doc_id) OVER (PARTITION BY content_hash) AS first_id FROM h) WHERE copies > 1",
    "corpus_fingerprint": f"SELECT count(*) AS documents, sha256(count(*)::VARCHAR || ':' || sum(('0x' || substr(sha256(doc_id::VARCHAR || ':' || {_HASH}), 1, 15))::BIGINT)::VARCHAR) AS fingerprint FROM documents",
    "snapshot_diff": f"WITH {_DIFF} SELECT * FROM f",
    "change_summary": f"WITH {_DIFF} SELECT status, count(*) AS documents FROM f GROUP BY status",
    "largest_documents": f"SELECT doc_id, {_LINES_N} AS lines FROM documents ORDER BY lines DESC, doc_id LIMIT 10",
    "line_spans": f"SELECT doc_id, 0 AS ordinal, 1 AS start_line, {_LINES_N} AS end_line, {_HASH} AS content_hash FROM documents WHERE trim(text) <> ''",
    "filename_styles": f"WITH {_PAGES} SELECT {_STYLE} AS style, count(*) AS files FROM nm GROUP BY 1",
    "ambiguity_index": rf"WITH {_PAGES}, s AS (SELECT path, regexp_replace(lower(regexp_replace(name, '\.md$', '')), '[^a-z0-9]+', '', 'g') AS norm FROM nm) SELECT norm, count(DISTINCT path) AS paths FROM s WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT path) > 1",
    "convention_report": rf"""WITH {_PAGES}, s AS (SELECT 'english' AS system, count(*) AS files, count(*) FILTER (({_STYLE}) = 'kebab-case') AS conforming FROM nm WHERE contains(path, '/en/')
UNION ALL SELECT 'everywhere', count(*), count(*) FILTER (regexp_matches(name, '^[0-9]+\.md$')) FROM nm) SELECT *, round(100.0 * conforming / greatest(files, 1), 1) AS percent FROM s""",
    "extraction_plan": f"""WITH r AS (SELECT doc_id, source, {_HASH} AS h, length(trim(coalesce(text, ''))) AS size, doc_id IN (SELECT doc_id FROM labels) AS ing FROM documents),
f AS (SELECT h, min(doc_id) AS first_id FROM r WHERE source <> 'src1' AND ing GROUP BY h),
s AS (SELECT source, CASE WHEN source = 'src1' THEN 'cached' WHEN NOT ing THEN 'not_ingested' WHEN size < 40 THEN 'no_spans' WHEN doc_id <> first_id THEN 'duplicate' ELSE 'pending' END AS status FROM r LEFT JOIN f USING (h))
SELECT source, status, count(*) AS documents, (2 * count(*) FILTER (status = 'pending'))::BIGINT AS calls FROM s GROUP BY ALL""",
}
