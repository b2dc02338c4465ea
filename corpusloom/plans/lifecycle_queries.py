"""Lifecycle queries, and the SQL or hand-worked rows that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, entity_id
from corpusloom.operators import graph as G
from corpusloom.operators import lifecycle as Y
from corpusloom.operators import links as L
from corpusloom.operators.search import top_k
from corpusloom.plans.search_queries import bm25_sql, index_of
from corpusloom.sources.tables import table
from corpusloom.sources.vault import to_ingest, upsert

QUESTION = "erin ingre their onthe"
ASKS = ("17", "Customer#000000003", "customer#00000000", "nobody", "000000042")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return Y.latest(events, key="user_id", order=["ts", "event_id"]).select("user_id", "event_id", "event_type")


def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    batch = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select("s_suppkey", F.upper("s_name").alias("s_name"))
    return upsert(stored, batch, key="s_suppkey")


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to ingest when those of other sources are stored and English ones have changed since."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", content_hash(F.col("text")).alias("content_hash"))
    stored = docs.where("source <> 'src2'").select("doc_id", F.when(F.col("lang") == "en", "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return to_ingest(docs, stored, key="doc_id").select("doc_id")


_MOVE = "CASE WHEN event_id % 11 = 0 THEN 'superseded' WHEN event_type = 'view' THEN 'approved' WHEN event_type = 'click' THEN 'activated' ELSE 'rejected' END"
#: Replies of a model: bare, fenced, within a sentence, none, a list.
_REPLY = """CASE p_partkey % 5 WHEN 0 THEN '{"a": ' || CAST(p_partkey AS STRING) || '}' WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || '{"b": "' || p_name || '"}' || chr(10) || '```' || chr(10) || 'bye'
 WHEN 2 THEN 'so {"c": {"d": ' || CAST(p_size AS STRING) || '}} it is' WHEN 3 THEN 'nothing of ' || p_name ELSE ' [1, ' || CAST(p_size AS STRING) || '] ' END"""


def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", entity_id("concept", F.lower("c_name")).alias("id"))


def derivation_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", content_hash(F.col("text")).alias("h"))
    return docs.join(docs.where("source = 'src1'").select("h").distinct(), "h", "left_anti").select("doc_id")


def proposal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as moves of a proposal."""
    moves = table(spark, sf_dir, "events").select(F.col("user_id").alias("proposal"), F.struct("ts", "event_id").alias("at"), F.expr(_MOVE).alias("move"))
    return Y.fold_states(moves, key="proposal", order="at", move="move")


def create_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    ids = customers.select(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("identity"), "c_acctbal")
    return Y.create_if_absent(ids.where("c_acctbal < 0").select("identity"), ids.select("identity"), key="identity")


def supersede_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    claims = orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("statement"), F.lit("ACTIVE").alias("status"))
    new = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_orderkey") + 10_000_000_000).alias("new_id"), F.lit("refined").alias("statement"))
    return Y.supersede(claims, new, at="2024-01-31")


def relationship_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.cooccurrence(table(spark, sf_dir, "lineitem"), group="l_orderkey", item="l_partkey", least=1)
    found = Y.relationship_gates(edges, table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("node")))
    return found.groupBy(F.coalesce("refused", F.lit("activated")).alias("outcome")).agg(F.count(F.lit(1)).alias("edges"))


def capped_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(12)
    places = spark.createDataFrame([(r.c_custkey, i) for i, r in enumerate(ranked.collect())], "concept_id bigint, place int")
    return Y.capped_claims(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("concept_id")), places)


def candidate_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as concepts; some of their names and aliases, written otherwise, are the evidence."""
    parts = table(spark, sf_dir, "part")
    name = "p_name || ' ' || cast(p_partkey as string) || 'z'"
    concepts = parts.selectExpr(f"{name} as concept", "array(p_brand || ' kind ' || cast(p_partkey as string) || 'q') as aliases")
    spans = parts.where("p_partkey % 60 = 7").selectExpr(f"'On ' || upper(replace({name}, ' ', '-')) || ' and ' || lower(p_brand) || '_kind_' || cast(p_partkey + 1 as string) || 'q.' as text", f"'About {{}}' || replace({name}, '7z', '8z') as heading")
    edges = parts.where("p_partkey > 2").selectExpr(f"{name} as a", "p_partkey as k").join(parts.selectExpr(f"{name} as b", "p_partkey + 3 as k"), "k").select("a", "b")
    return Y.narrow(concepts, spans, edges, cap=1000)


def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn quoted against the turn before: assistants support, users refine, the rest conflict."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("quote"), "role")
    before = turns.select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t"), F.col("quote").alias("evidence"))
    rows = turns.join(before, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")))
    kind = F.when(F.col("role") == "assistant", "SUPPORTS").when(F.col("role") == "user", "REFINES").otherwise("CONFLICT")
    return Y.demote_uncorroborated(rows.withColumn("classification", kind)).groupBy("role", "classification").agg(F.count(F.lit(1)).alias("turns"))


def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "supplier").where("s_nationkey <> 3").select("s_suppkey", "s_name", "s_nationkey")
    after = table(spark, sf_dir, "supplier").where("s_nationkey <> 4").select("s_suppkey", F.when(F.col("s_acctbal") < 0, F.lower("s_name")).otherwise(F.col("s_name")).alias("s_name"), F.when(F.col("s_acctbal") > 9000, -1).otherwise(F.col("s_nationkey")).alias("s_nationkey"))
    return Y.changed_fields(before, after, ("s_name", "s_nationkey"), key="s_suppkey")


def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_REPLY} AS reply").select("id", Y.extract_json(F.col("reply")).alias("json"))


def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "'As [' || cast(p_partkey % 11 as string) || '] and [' || cast(p_size as string) || '], but not [x] nor [' || cast(p_partkey % 11 as string) || '].'"
    return Y.citations(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{body} AS body"), text="body", passages=8).select("id", "n", "valid")


def upstream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as repositories: their nation is the commit that is pinned, some have none, of some no head is known."""
    s = table(spark, sf_dir, "supplier")
    pinned = s.selectExpr("s_name AS repo", "CASE WHEN s_suppkey % 5 <> 0 THEN cast(s_nationkey AS STRING) END AS commit")
    heads = s.where("s_suppkey % 7 <> 0").selectExpr("s_name AS repo", "cast(CASE WHEN s_acctbal > 5000 THEN s_nationkey ELSE s_nationkey + 1 END AS STRING) AS head")
    return Y.drift(pinned, heads)


def resolve_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return Y.resolve_names(spark.createDataFrame([(a,) for a in ASKS], "ask string"), concepts)


def extraction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.rates(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "N", F.col("l_linestatus") == "F", "l_linenumber")


def question_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for a question's words, without those of the source it already cites."""
    docs = table(spark, sf_dir, "documents")
    cited = docs.where("source = 'src0'").select("doc_id")
    return top_k(index_of(spark, sf_dir).one(QUESTION).join(cited, "doc_id", "left_anti"), 10).select("doc_id", F.round("score", 6).alias("score"))


def seed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bootstrapping from page names would do: stems of one page become concepts, colliding ones stay out."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    named = pages.groupBy(L.normalize(L.stem(F.col("path"))).alias("stem")).agg(F.countDistinct("path").alias("n"))
    kind = F.when(F.col("stem") == "", "skipped").when(F.col("n") == 1, "concept").otherwise("undecided_collision")
    return named.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("stems"))


def explain_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every concept with its claims by status, its evidence, its sources and its latest claim."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("evidence"))
    facts = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("claims"), F.coalesce(F.sum("evidence"), F.lit(0)).alias("evidence"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest")
    )
    return table(spark, sf_dir, "customer").join(facts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("evidence", F.lit(0)).alias("evidence"), "latest")


def recent_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id", "event_type", "user_id")


_FLAT = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
_FLATN = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_H = r"sha256(regexp_replace(text, '\r\n?', chr(10), 'g'))"
QUERIES = {
    f.__name__: f
    for f in (upsert_latest, upsert_batch, incremental_ingest, entity_ids, derivation_misses, proposal_states, create_if_absent, supersede_claims, relationship_activation, capped_claims, candidate_narrowing,
              corroboration, changed_fields, model_json, answer_citations, upstream_drift, resolve_concepts, extraction_rates, question_evidence, seed_plan, explain_concept, recent_revisions)
}
ORACLES = {
    "upsert_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "upsert_batch": "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN upper(s_name) ELSE s_name END AS s_name FROM supplier",
    "incremental_ingest": "SELECT doc_id FROM documents WHERE source = 'src2' OR lang = 'en'",
    "entity_ids": r"SELECT c_custkey, substr(sha256('concept' || chr(31) || lower(c_name) || chr(31)), 1, 26) AS id FROM customer",
    "derivation_misses": f"SELECT doc_id FROM documents WHERE {_H} NOT IN (SELECT {_H} FROM documents WHERE source = 'src1')",
    "proposal_states": f"""WITH m AS (SELECT user_id AS proposal, list({_MOVE} ORDER BY ts, event_id) AS ms FROM events GROUP BY user_id),
f AS (SELECT proposal, list_reduce(list_prepend('pending|0', ms), lambda a, m: CASE WHEN (string_split(a, '|')[1] = 'pending' AND m IN ('approved', 'rejected', 'superseded')) OR (string_split(a, '|')[1] = 'approved' AND m IN ('activated', 'superseded'))
  OR (string_split(a, '|')[1] IN ('activated', 'rejected') AND m = 'superseded') THEN m || '|' || string_split(a, '|')[2] ELSE string_split(a, '|')[1] || '|' || (string_split(a, '|')[2]::INTEGER + 1) END) AS s FROM m)
SELECT proposal, string_split(s, '|')[1] AS state, string_split(s, '|')[2]::INTEGER AS refused FROM f""",
    "create_if_absent": "WITH i AS (SELECT c_mktsegment || '/' || c_nationkey AS identity, c_acctbal FROM customer) SELECT DISTINCT identity FROM i WHERE identity NOT IN (SELECT identity FROM i WHERE c_acctbal < 0)",
    "supersede_claims": """SELECT o_orderkey AS claim_id, o_orderpriority AS statement, CASE WHEN u THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, CASE WHEN u THEN o_orderkey + 10000000000 END AS superseded_by, CASE WHEN u THEN '2024-01-31' END AS valid_to
FROM (SELECT *, o_orderpriority = '1-URGENT' AS u FROM orders) UNION ALL SELECT o_orderkey + 10000000000, 'refined', 'ACTIVE', NULL, NULL FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "relationship_activation": """WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS p FROM lineitem), e AS (SELECT x.p AS a, y.p AS b, count(*) AS n FROM m x JOIN m y ON x.g = y.g AND x.p < y.p GROUP BY ALL), k AS (SELECT p_partkey FROM part WHERE p_size > 10)
SELECT CASE WHEN a NOT IN (SELECT * FROM k) OR b NOT IN (SELECT * FROM k) THEN 'missing_concept' WHEN n < 2 THEN 'too_few_spans' ELSE 'activated' END AS outcome, count(*) AS edges FROM e GROUP BY 1""",
    "capped_claims": """WITH c AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1)::INTEGER AS place FROM customer QUALIFY place < 12),
s AS (SELECT o_orderkey AS claim_id, o_custkey AS concept_id, place FROM orders JOIN c ON c_custkey = o_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5) SELECT * FROM s ORDER BY place, claim_id LIMIT 20""",
    "candidate_narrowing": f"""WITH p AS (SELECT p_partkey AS k, p_name || ' ' || p_partkey || 'z' AS c, {_FLATN.format("p_name || ' ' || p_partkey || 'z'")} AS n, {_FLATN.format("p_brand || ' kind ' || p_partkey || 'q'")} AS al FROM part),
sp AS (SELECT {_FLATN.format("'On ' || p_name || p_partkey || 'z and ' || p_brand || 'kind' || (p_partkey + 1) || 'q.'")} AS t, {_FLATN.format("'About {}' || replace(p_name || ' ' || p_partkey || 'z', '7z', '8z')")} AS h FROM part WHERE p_partkey % 60 = 7),
d AS (SELECT c, CASE WHEN EXISTS (SELECT 1 FROM sp WHERE contains(t, n)) THEN 'exact_name' WHEN EXISTS (SELECT 1 FROM sp WHERE contains(t, al)) THEN 'alias' WHEN EXISTS (SELECT 1 FROM sp WHERE contains(h, n)) THEN 'heading' END AS selector, k FROM p),
f AS (SELECT c, selector FROM d WHERE selector IS NOT NULL UNION ALL SELECT c, 'graph_neighbour' FROM d WHERE selector IS NULL AND EXISTS (SELECT 1 FROM d x WHERE x.selector IS NOT NULL AND abs(x.k - d.k) = 3))
SELECT c AS concept, selector FROM f ORDER BY list_position(['exact_name', 'alias', 'identity', 'heading', 'lexical', 'graph_neighbour'], selector), c LIMIT 1000""",
    "corroboration": f"""WITH t AS (SELECT a.role, {_FLAT.format('a.text')} AS q, {_FLAT.format('b.text')} AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
p AS (SELECT role, CASE role WHEN 'assistant' THEN 'SUPPORTS' WHEN 'user' THEN 'REFINES' ELSE 'CONFLICT' END AS k, CASE WHEN q = '' THEN 0.0 WHEN contains(h, q) THEN 1.0 ELSE len(list_filter(string_split(q, ' '), lambda w: contains(h, w))) / len(string_split(q, ' ')) END AS pr FROM t)
SELECT role, CASE WHEN k <> 'CONFLICT' AND pr < 0.8 THEN 'INSUFFICIENT_EVIDENCE' ELSE k END AS classification, count(*) AS turns FROM p GROUP BY ALL""",
    "changed_fields": """WITH b AS (SELECT * FROM supplier WHERE s_nationkey <> 3), a AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN lower(s_name) ELSE s_name END AS n, CASE WHEN s_acctbal > 9000 THEN -1 ELSE s_nationkey END AS k FROM supplier WHERE s_nationkey <> 4),
j AS (SELECT coalesce(b.s_suppkey, a.s_suppkey) AS s_suppkey, concat_ws(',', CASE WHEN s_name IS DISTINCT FROM n THEN 's_name' END, CASE WHEN s_nationkey IS DISTINCT FROM k THEN 's_nationkey' END) AS changed FROM b FULL JOIN a ON a.s_suppkey = b.s_suppkey) SELECT * FROM j WHERE changed <> ''""",
    "model_json": f"SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN r WHEN 1 THEN string_split(r, chr(10))[3] WHEN 2 THEN substr(r, 4, length(r) - 9) WHEN 4 THEN trim(r) END AS json FROM (SELECT p_partkey, {_REPLY} AS r FROM part)",
    "answer_citations": "SELECT DISTINCT id, n, n BETWEEN 1 AND 8 AS valid FROM (SELECT p_partkey AS id, unnest([p_partkey % 11, p_size])::INTEGER AS n FROM part)",
    "upstream_drift": "SELECT s_name AS repo, CASE WHEN s_suppkey % 7 = 0 THEN 'unreachable' WHEN s_suppkey % 5 = 0 THEN 'unpinned' WHEN s_acctbal > 5000 THEN 'current' ELSE 'drifted' END AS status FROM supplier",
    "resolve_concepts": f"""WITH a AS (SELECT unnest({list(ASKS)}) AS ask)
SELECT ask, coalesce((SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey::VARCHAR = ask), (SELECT min(c_custkey)::VARCHAR FROM customer WHERE lower(c_name) = lower(ask) HAVING count(*) = 1),
       (SELECT min(c_custkey)::VARCHAR FROM customer WHERE contains(lower(c_name), lower(ask)) HAVING count(*) = 1)) AS id FROM a""",
    "extraction_rates": "SELECT l_linenumber, count(*) AS rows, count(*) FILTER (l_linestatus = 'F') AS measured, round(coalesce(count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') / nullif(count(*) FILTER (l_linestatus = 'F'), 0), 0.0), 6) AS rate FROM lineitem GROUP BY l_linenumber",
    "question_evidence": f"WITH {bm25_sql(QUESTION)}, f AS (SELECT * FROM s WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')) SELECT doc_id, round(score, 6) AS score FROM f ORDER BY f.score DESC, doc_id LIMIT 10",
    "seed_plan": r"""WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS path FROM pages), s AS (SELECT regexp_replace(lower(regexp_replace(string_split(path, '/')[-1], '\.md$', '')), '[^a-z0-9]+', '', 'g') AS stem, count(DISTINCT path) AS n FROM p GROUP BY 1)
SELECT CASE WHEN stem = '' THEN 'skipped' WHEN n = 1 THEN 'concept' ELSE 'undecided_collision' END AS outcome, count(*) AS stems FROM s GROUP BY 1""",
    "explain_concept": """WITH l AS (SELECT l_orderkey, count(*) AS evidence FROM lineitem GROUP BY 1), f AS (SELECT o_custkey, count(*) AS claims, coalesce(sum(evidence), 0)::BIGINT AS evidence, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, c_name, coalesce(claims, 0) AS claims, coalesce(evidence, 0) AS evidence, latest FROM customer LEFT JOIN f ON o_custkey = c_custkey""",
    "recent_revisions": "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
}
