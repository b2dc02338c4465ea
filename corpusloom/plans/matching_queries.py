"""Markdown and matching queries, and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import markdown as M
from corpusloom.operators import matching as X
from corpusloom.operators.vectors import cosine
from corpusloom.sources.tables import table

NAMES = (("Union find",), ("hash map",), ("HashMap",), ("Retrieval Augmentd Generation",), ("heap",), ("nothing like it",), ("BFS",))
KNOWN = (("Union Find", ["DSU"]), ("Hash-Map", ["HashMap"]), ("Retrieval Augmented Generation", ["RAG"]), ("Breadth First Search", ["BFS"]), ("Heap", []), ("Heap (memory)", []))
DECIDED = (("heap", "Heap"),)


def rows_structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document as blocks; a line of at most three words counts as a heading."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).where("trim(text) <> ''")
    head = F.size(F.split(F.trim("text"), " ")) <= 3
    return M.structural_chunks(lines.select("doc_id", "ordinal", "text", head.alias("is_heading"), F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("page")))


def concept_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.concept_clusters(table(spark, sf_dir, "part"), name="p_name")


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.match_names(
        spark.createDataFrame(list(NAMES), "name string"), spark.createDataFrame(list(KNOWN), "concept string, aliases array<string>"),
        spark.createDataFrame(list(DECIDED), "norm string, concept string"),
    )


#: Names and concepts made of parts; every stage but the fuzzy one can be told by SQL, so names differ too much for it.
_ASKED = """CASE p_partkey % 9 WHEN 0 THEN upper(p_name) || ' X' || CAST(p_partkey AS STRING) WHEN 1 THEN replace(p_name, ' ', '_') || '_x' || CAST(p_partkey AS STRING) WHEN 2 THEN 'alias of ' || CAST(p_partkey AS STRING) WHEN 3 THEN 'Decided-' || CAST(p_partkey % 5 AS STRING)
 WHEN 4 THEN 'shared ' || CAST(p_partkey % 4 AS STRING) WHEN 5 THEN 'Proposed ' || CAST(p_partkey AS STRING) WHEN 6 THEN 'configured ' || CAST(p_partkey % 3 AS STRING) ELSE '##' END"""


def match_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every stage but the fuzzy one."""
    parts = table(spark, sf_dir, "part")
    asked = parts.selectExpr(f"{_ASKED} AS name").distinct()
    known = parts.where("p_partkey % 9 < 3").selectExpr("p_name || ' x' || CAST(p_partkey AS STRING) AS concept", "array('Alias of ' || CAST(p_partkey AS STRING)) AS aliases")
    one = lambda n, norm, concept: spark.range(n).selectExpr(f"'{norm}' || CAST(id AS STRING) AS norm", f"'{concept} ' || CAST(id AS STRING) AS concept")
    return X.match_names(
        asked, known, one(4, "decided", "Chosen"), config=one(2, "configured", "Set"), collisions=one(3, "shared", "x").select("norm"),
        proposed=parts.where("p_partkey % 9 = 5 and p_partkey % 2 = 0").selectExpr("'proposed ' || CAST(p_partkey AS STRING) AS concept"),
    ).where("stage <> 'fuzzy'")


def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages as candidates: the two best concepts of each name."""
    rows = table(spark, sf_dir, "part").selectExpr("p_brand AS name", "p_type AS concept", "1 AS rank", "CAST(p_size % 20 AS DOUBLE) / 20 AS score")
    return X.top_matches(rows, 2)


def rows_claim_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.claim_clusters(table(spark, sf_dir, "conversations"), group="conv_id", order="turn", text="text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a quote with the turn before it as evidence."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t"), F.col("text").alias("evidence"))
    return turns.join(before, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t"))).select("conv_id", "turn", "text", "evidence")


def quote_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(X.quote_presence(F.col("text"), F.col("evidence")), 6).alias("presence"))


def rows_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.grounded(_turns(spark, sf_dir), quote="text", text="evidence").select("conv_id", "turn", "in_order", "overlap", "grounded")


def benchmark_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text verbatim. Texts meet on the hash of eight words, then are compared whole."""
    n = 8
    split = lambda c: F.filter(F.split(c, r"[ \n\t]+"), lambda w: w != "")
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), split(F.col("text")).alias("w")).where(F.size("w") > n + 1)
    bench = bench.select("item_id", "quote", F.xxhash64(F.slice("w", 2, n)).alias("h"))
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", split(F.col("text")).alias("w")).where(F.size("w") >= n)
    windows = words.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n))))).alias("h"))
    # only keys meet; the few pairs that do fetch their texts
    met = windows.join(bench.select("item_id", "h"), "h").select("item_id", "doc_id").distinct()
    return met.join(bench.select("item_id", "quote"), "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "quote")).select("item_id", "doc_id")


def rows_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns compared by hashed embeddings."""
    rows = _turns(spark, sf_dir).withColumn("a", X.hash_embedding("text")).withColumn("b", X.hash_embedding("evidence"))
    return rows.select("conv_id", "turn", F.round(cosine(F.col("a"), F.col("b")), 6).alias("cos"))


_NORM = "regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g')"
_STEM = "CASE " + " ".join(f"WHEN length(n) > {len(s) + 3} AND ends_with(n, '{s}') THEN left(n, length(n) - {len(s)})" for s in X.SUFFIXES) + " ELSE n END"
_FLAT = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"

QUERIES = {
    f.__name__: f
    for f in (rows_structural_chunks, concept_clusters, match_cascade, match_stages, top_matches, rows_claim_clusters, quote_presence, rows_grounding, benchmark_quotes, rows_hash_embedding)
}
#: Fixture queries are checked against rows worked out by hand.
ORACLES = {
    "match_cascade": """SELECT name, stage, concept, score::DOUBLE AS score FROM (VALUES ('Union find', 'exact', 'Union Find', 1.0), ('hash map', 'normalised', 'Hash-Map', 0.95), ('HashMap', 'alias', 'Hash-Map', 0.98),
('Retrieval Augmentd Generation', 'fuzzy', 'Retrieval Augmented Generation', 0.9818), ('heap', 'decision', 'Heap', 1.0), ('nothing like it', 'none', NULL, NULL), ('BFS', 'alias', 'Breadth First Search', 0.98)) v(name, stage, concept, score)""",
    "match_stages": f"""WITH a AS (SELECT DISTINCT {_ASKED} AS name, p_partkey % 9 AS c, CASE WHEN p_partkey % 9 IN (0, 1, 2, 5) THEN p_partkey WHEN p_partkey % 9 = 3 THEN p_partkey % 5 WHEN p_partkey % 9 = 4 THEN p_partkey % 4 WHEN p_partkey % 9 = 6 THEN p_partkey % 3 END AS k FROM part),
n AS (SELECT DISTINCT name, CASE WHEN c >= 7 THEN 7 ELSE c END AS c, k FROM a)
SELECT name, CASE c WHEN 0 THEN 'exact' WHEN 1 THEN 'normalised' WHEN 2 THEN 'alias' WHEN 3 THEN CASE WHEN k < 4 THEN 'decision' ELSE 'none' END WHEN 4 THEN CASE WHEN k < 3 THEN 'ambiguous' ELSE 'none' END WHEN 5 THEN CASE WHEN k % 2 = 0 THEN 'proposed' ELSE 'none' END
WHEN 6 THEN CASE WHEN k < 2 THEN 'config_alias' ELSE 'none' END ELSE 'none' END AS stage,
CASE c WHEN 0 THEN (SELECT max(p_name) || ' x' || k FROM part WHERE p_partkey = k) WHEN 1 THEN (SELECT max(p_name) || ' x' || k FROM part WHERE p_partkey = k) WHEN 2 THEN (SELECT max(p_name) || ' x' || k FROM part WHERE p_partkey = k) WHEN 3 THEN CASE WHEN k < 4 THEN 'Chosen ' || k END
WHEN 5 THEN CASE WHEN k % 2 = 0 THEN 'proposed ' || k END WHEN 6 THEN CASE WHEN k < 2 THEN 'Set ' || k END END AS concept,
CASE c WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.98 WHEN 3 THEN CASE WHEN k < 4 THEN 1.0 END WHEN 4 THEN CASE WHEN k < 3 THEN 0.0 END WHEN 5 THEN CASE WHEN k % 2 = 0 THEN 0.99 END WHEN 6 THEN CASE WHEN k < 2 THEN 1.0 END END::DOUBLE AS score FROM n""",
    "top_matches": "WITH m AS (SELECT p_brand AS name, p_type AS concept, max((p_size % 20)::DOUBLE / 20) AS score FROM part GROUP BY 1, 2) SELECT name, row_number() OVER (PARTITION BY name ORDER BY score DESC, concept)::INTEGER AS n, concept, score FROM m QUALIFY n <= 2",
    "concept_clusters": f"WITH s AS (SELECT p_name, {_STEM} AS stem FROM (SELECT p_name, {_NORM} AS n FROM part)) SELECT stem, count(DISTINCT p_name) AS labels, count(*) AS members, arg_max(p_name, (length(p_name), p_name)) AS suggested FROM s GROUP BY stem HAVING count(*) > 1",
    "quote_presence": f"""WITH t AS (SELECT a.conv_id, a.turn, {_FLAT.format('a.text')} AS q, {_FLAT.format('b.text')} AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
SELECT conv_id, turn, round(CASE WHEN q = '' THEN 0.0 WHEN contains(h, q) THEN 1.0 ELSE len(list_filter(string_split(q, ' '), lambda w: contains(h, w))) / len(string_split(q, ' ')) END, 6)::DOUBLE AS presence FROM t""",
    "benchmark_quotes": r"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len(list_filter(regexp_split_to_array(b.text, '[ \n\t]+'), lambda w: w <> '')) > 9",
}
