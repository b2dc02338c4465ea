"""Queries over typed relationships, changes and seeding, and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import relations as R
from corpusloom.plans import vault_queries as V
from corpusloom.plans.model_queries import _model, _sql
from corpusloom.sources.staging import staged
from corpusloom.sources.tables import table

SINCE, UNTIL = "2024-01-05 00:00:00", "2024-01-25 00:00:00"
START, DEPTH = "c1", 2

_REVISIONS = """SELECT event_id AS seq, ts AS at, CASE WHEN event_id % 3 = 0 THEN 'Claim' ELSE 'Concept' END AS entity_type, 'u' || CAST(user_id AS STRING) AS entity_id, event_type AS op,
    CASE WHEN event_id % 4 <> 0 THEN 'w' || CAST(event_id % 6 AS STRING) END AS cause FROM {events}"""
_PROPOSED = """SELECT 'r' || CAST(o_orderkey AS STRING) AS id, 'c' || CAST(o_custkey AS STRING) AS from_id, 'c' || CAST((o_custkey * 7 + o_orderkey % 3) % 1600 AS STRING) AS to_id,
    CASE o_orderkey % 4 WHEN 0 THEN 'RELATED_TO' WHEN 1 THEN 'PART_OF' WHEN 2 THEN 'CITES' ELSE 'RELATED_TO' END AS type, o_orderkey AS k FROM {orders}"""
_SPAN_IDS = "'s' || CAST(k % 300 AS STRING), 's' || CAST(k % 97 * 97 AS STRING), 's' || CAST(k % 300 AS STRING)"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir, "links")


def typed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.typed_neighbours(_links(spark, sf_dir), _model(spark, sf_dir, "concepts"), types=("RELATED_TO", "PART_OF"), cap=3)


def neighbours_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.typed_neighbours(_links(spark, sf_dir), _model(spark, sf_dir, "concepts"), direction="in", cap=2)


def related_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = _model(spark, sf_dir, "concepts")
    near = staged(R.typed_neighbours(_links(spark, sf_dir), concepts).select("node", "neighbour").distinct(), "near")
    return R.related_concepts(near, concepts, START, DEPTH)


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.metrics(_model(spark, sf_dir, "concepts"), _links(spark, sf_dir))


def relationship_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed = spark.sql(_PROPOSED, orders=table(spark, sf_dir, "orders")).withColumn("span_ids", F.expr(f"array({_SPAN_IDS})"))
    return R.gated(proposed, _model(spark, sf_dir, "concepts"), _model(spark, sf_dir, "spans"))


def concept_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "part").selectExpr("upper(replace(p_name, ' ', '-')) AS name").distinct()
    spans = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "'a ' || p_name || ', of ' || lower(p_type) || ' and some' AS text")
    return R.mentions(concepts, spans)


def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    revisions = spark.sql(_REVISIONS, events=table(spark, sf_dir, "events"))
    out = R.changes_since(revisions, SINCE, UNTIL, scan=700)
    return out.withColumn("ids", F.array_join("ids", ",")).withColumn("causes", F.array_join("causes", ","))


def states_entered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.entered(spark.sql(_REVISIONS, events=table(spark, sf_dir, "events")), "error")


def workflow_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trace(spark.sql(_REVISIONS, events=table(spark, sf_dir, "events")), "w3").select("seq", "entity_id", "op")


def dependents_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    resting = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS synthesis_id", "'o' || CAST(l_orderkey AS STRING) AS claim_id")
    return R.dependents_stale(resting, _model(spark, sf_dir, "claims").where("status = 'SUPERSEDED'"))


def seed_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V._files(spark, sf_dir)
    return R.seed_concepts(files.select("path"), files.where("k % 30 = 0").select("path"))


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return R.seed_links(V._resolved(spark, sf_dir), seed_concepts(spark, sf_dir))


def seed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir)[0]


def seed_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir)[1]


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blocks(table(spark, sf_dir, "documents")).select("doc_id", "line", "char_start", "char_end")


def citations_of_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.expr("CASE WHEN p_partkey % 2 = 0 THEN array(p_brand, p_name) ELSE cast(array() AS array<string>) END")
    first, last = F.expr("CASE WHEN p_partkey % 3 > 0 THEN p_size END"), F.expr("CASE WHEN p_partkey % 3 = 2 THEN p_size + 1 END")
    return table(spark, sf_dir, "part").select("p_partkey", R.citation(first, last, heads, F.col("p_type")).alias("citation"))


def source_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", R.source_status(k % 7 != 0, k % 5 != 0, k % 3 == 0, k % 11 == 0, k % 2 == 0).alias("status"))


def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to ingest where some changed and some were cut by another chunker."""
    parts = table(spark, sf_dir, "part")
    now = parts.selectExpr("p_partkey AS path", "p_name AS content_hash")
    stored = parts.where("p_partkey % 4 <> 0").selectExpr("p_partkey AS path", "CASE WHEN p_partkey % 5 = 0 THEN 'old' ELSE p_name END AS content_hash")
    spans = parts.where("p_partkey % 6 <> 0").selectExpr("p_partkey AS path", "CASE WHEN p_partkey % 7 = 0 THEN 'heading' ELSE 'structural' END AS chunk_strategy")
    return R.to_ingest(now, stored, spans, "structural").select("path")


def _neighbours_sql(where: str, both: bool, cap: int) -> str:
    out = "SELECT from_id AS node, to_id AS neighbour, type, from_id, to_id FROM live"
    into = "SELECT to_id AS node, from_id AS neighbour, type, from_id, to_id FROM live"
    return f"""{_sql('links', 'concepts')}, live AS (SELECT * FROM m_links WHERE active AND {where}), ends AS ({out + ' UNION ' + into if both else into}),
nb AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY type, to_id, from_id) AS n FROM ends QUALIFY n <= {cap})"""


_SEEDED = rf"""{V._CASCADE}, sn AS (SELECT path, {V._STEM} AS name, {V._NORM.format(V._STEM)} AS norm, k FROM f),
sd AS (SELECT path, name, CASE WHEN regexp_matches(name, '(?i)^(_.*|readme|index|roadmap|\d\d-.*)$') OR norm = '' THEN 'structural' WHEN count(*) OVER (PARTITION BY norm) = 1 THEN 'concept' WHEN k % 30 = 0 THEN 'namespaced' ELSE 'undecided_collision' END AS outcome FROM sn),
nd AS (SELECT path FROM sd WHERE outcome IN ('concept', 'namespaced'))"""

QUERIES = {
    q.__name__: q
    for q in (typed_neighbours, neighbours_into, related_concepts, model_metrics, relationship_gates, concept_mentions, changes_since, states_entered, workflow_trace, dependents_stale, seed_concepts, seed_links, seed_left_out, text_blocks,
              citations_of_spans, source_statuses, rechunk)
}
_REV = _REVISIONS.replace("{events}", "events")
ORACLES = {
    "typed_neighbours": f"WITH {_neighbours_sql("type IN ('RELATED_TO', 'PART_OF')", True, 3)} SELECT node, n::INTEGER AS n, neighbour, type, c.name FROM nb LEFT JOIN m_concepts c ON c.id = neighbour",
    "neighbours_into": f"WITH {_neighbours_sql('true', False, 2)} SELECT node, n::INTEGER AS n, neighbour, type, c.name FROM nb LEFT JOIN m_concepts c ON c.id = neighbour",
    "related_concepts": f"""WITH RECURSIVE {_neighbours_sql('true', True, 50)}, r AS (SELECT '{START}' AS node, 0 AS depth UNION SELECT neighbour, depth + 1 FROM r JOIN nb USING (node) WHERE depth < {DEPTH}),
d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT c.id, c.name, depth::INTEGER AS depth FROM d JOIN m_concepts c ON c.id = d.node WHERE depth > 0""",
    "model_metrics": f"""WITH {_sql('links', 'concepts')}, live AS (SELECT * FROM m_links WHERE active), dg AS (SELECT id, count(*) AS d FROM (SELECT from_id AS id FROM live UNION ALL SELECT to_id FROM live) GROUP BY id),
b AS (SELECT c.id AS c, coalesce(d, 0) AS d FROM m_concepts c FULL JOIN dg ON dg.id = c.id)
SELECT 'nodes' AS metric, count(c)::DOUBLE AS value FROM b UNION ALL SELECT 'max_degree', max(d) FROM b UNION ALL SELECT 'mean_degree', round(avg(d), 4) FROM b UNION ALL SELECT 'isolated', count(*) FILTER (d = 0) FROM b
UNION ALL SELECT 'branching', round(avg(d) FILTER (d > 0), 4) FROM b UNION ALL SELECT 'type:' || type, count(*) FROM live GROUP BY type UNION ALL SELECT 'edges', count(*) FROM live""",
    "relationship_gates": f"""WITH {_sql('concepts', 'spans')}, pr AS ({_PROPOSED.replace('{orders}', 'orders')}), ss AS (SELECT DISTINCT id, unnest([{_SPAN_IDS}]) AS s FROM pr), sc AS (SELECT id, count(*) AS n FROM ss WHERE s IN (SELECT id FROM m_spans) GROUP BY id)
SELECT pr.id, round(least(1.0, coalesce(n, 0) / 5), 4)::DOUBLE AS score, CASE WHEN type = 'CITES' THEN 'unsupported_type' WHEN from_id = to_id THEN 'self_link' WHEN from_id NOT IN (SELECT id FROM m_concepts) OR to_id NOT IN (SELECT id FROM m_concepts) THEN 'missing_end'
WHEN n IS NULL THEN 'no_span_resolves' WHEN type = 'RELATED_TO' AND n < 2 THEN 'too_few_spans' END AS refused FROM pr LEFT JOIN sc ON sc.id = pr.id""",
    "concept_mentions": """WITH n AS (SELECT DISTINCT upper(replace(p_name, ' ', '-')) AS concept, replace(lower(p_name), ' ', '') AS n FROM part), s AS (SELECT p_partkey AS span_id, regexp_replace(lower('a' || p_name || 'of' || p_type || 'andsome'), '[^a-z0-9]+', '', 'g') AS t FROM part)
SELECT concept, span_id FROM n JOIN s ON contains(t, n) WHERE length(n) >= 6""",
    "changes_since": f"""WITH v AS ({_REV}), nw AS (SELECT * FROM v ORDER BY "at" DESC, seq DESC LIMIT 700), i AS (SELECT * FROM nw WHERE "at" BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}')
SELECT entity_type, op, count(*) AS revisions, count(DISTINCT entity_id) AS entities, string_agg(entity_id, ',' ORDER BY "at" DESC, seq DESC) AS ids, coalesce(array_to_string(list_sort(list(DISTINCT cause) FILTER (cause IS NOT NULL)), ','), '') AS causes, (SELECT count(*) > 700 FROM v) AS truncated FROM i GROUP BY 1, 2""",
    "states_entered": f"WITH v AS ({_REV}) SELECT entity_id, seq FROM v QUALIFY op = 'error' AND lag(op) OVER (PARTITION BY entity_id ORDER BY seq) IS DISTINCT FROM 'error'",
    "workflow_trace": f"WITH v AS ({_REV}) SELECT seq, entity_id, op FROM v WHERE cause = 'w3'",
    "dependents_stale": f"WITH {_sql('claims')} SELECT l_suppkey AS synthesis_id, count(DISTINCT l_orderkey) AS claims FROM lineitem WHERE 'o' || l_orderkey IN (SELECT id FROM m_claims WHERE status = 'SUPERSEDED') GROUP BY 1",
    "seed_concepts": f"WITH {_SEEDED} SELECT path, name, outcome FROM sd",
    "seed_links": f"WITH {_SEEDED} SELECT DISTINCT source_path AS from_path, resolved_path AS to_path, 'RELATED_TO' AS type, 1.0::DOUBLE AS score FROM r WHERE source_path IN (SELECT path FROM nd) AND resolved_path IN (SELECT path FROM nd) AND source_path <> resolved_path",
    "seed_left_out": f"""WITH {_SEEDED}, y AS (SELECT CASE WHEN resolved_path IS NULL THEN status WHEN source_path NOT IN (SELECT path FROM nd) OR resolved_path NOT IN (SELECT path FROM nd) THEN 'outside_the_graph' WHEN source_path = resolved_path THEN 'self' END AS reason FROM r)
SELECT reason, count(*) AS links FROM y WHERE reason IS NOT NULL GROUP BY reason""",
    "text_blocks": """WITH l AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
c AS (SELECT doc_id, line, s, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(s) - 1 AS a FROM l) SELECT doc_id, line::INTEGER AS line, a::INTEGER AS char_start, (a + length(s))::INTEGER AS char_end FROM c WHERE trim(s) <> ''""",
    "citations_of_spans": """WITH c AS (SELECT p_partkey, p_type, concat_ws(' | ', CASE p_partkey % 3 WHEN 1 THEN 'p.' || p_size WHEN 2 THEN 'pp.' || p_size || '-' || (p_size + 1) END, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' > ' || p_name END) AS c FROM part)
SELECT p_partkey, CASE WHEN c = '' THEN p_type ELSE c END AS citation FROM c""",
    "source_statuses": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'not_found' WHEN p_partkey % 5 = 0 THEN 'unsupported' WHEN p_partkey % 3 = 0 THEN 'unchanged' WHEN p_partkey % 11 = 0 THEN 'parse_failed' WHEN p_partkey % 2 = 1 THEN 'ocr_required' ELSE 'ingested' END AS status FROM part",
    "rechunk": "SELECT p_partkey AS path FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0 OR p_partkey % 6 = 0 OR p_partkey % 7 = 0",
}
