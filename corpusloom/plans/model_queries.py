"""Queries over the knowledge model, and the SQL that they are checked against.

The tables of the model are made of the order tables and events by the same expressions on both sides:
customers are concepts, orders are claims and links, order lines are evidence, parts are spans, events
are proposals and questions. Every kind of defect is among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import model as D
from corpusloom.operators.markdown import navigation
from corpusloom.plans import reports
from corpusloom.sources.tables import table

NOW = "2024-03-01 00:00:00"

#: The model's tables; the same text is read by both sides.
MODEL = {
    "concepts": """SELECT 'c' || CAST(c_custkey AS STRING) AS id, c_mktsegment || ' ' || CAST(c_custkey % 400 AS STRING) AS name, CASE WHEN c_custkey % 2 = 0 THEN 'main' ELSE 'side' END AS namespace,
        CASE WHEN c_custkey % 3 = 0 THEN 'V/' || CAST(c_custkey AS STRING) || '.md' END AS vault_path, CASE WHEN c_custkey % 6 = 0 THEN 'DETERMINISTIC' ELSE 'MODEL' END AS derivation,
        CASE WHEN c_custkey % 4 = 0 THEN 'p' || CAST(c_custkey AS STRING) END AS origin_proposal_id FROM {customer}""",
    "claims": """SELECT 'o' || CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 5 <> 0 THEN 'c' || CAST(o_custkey AS STRING) END AS subject_concept_id, o_orderpriority || ' of ' || CAST(o_orderkey AS STRING) AS statement,
        CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'DISPUTED' ELSE 'SUPERSEDED' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'USER_ASSERTION' WHEN 1 THEN 'MODEL_INFERENCE' ELSE 'EXTRACTED_CLAIM' END AS tier,
        CASE WHEN o_orderkey % 2 = 0 THEN 'MODEL' ELSE 'HUMAN' END AS derivation FROM {orders} WHERE o_orderkey % 3 <> 1""",
    "evidence": """SELECT 'e' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS id, 'o' || CAST(l_orderkey AS STRING) AS claim_id, 's' || CAST(l_partkey AS STRING) AS span_id,
        l_suppkey % 5 AS source_id FROM {lineitem} WHERE l_orderkey % 7 <> 0""",
    "spans": "SELECT 's' || CAST(p_partkey AS STRING) AS id, p_name || '  of type ' || p_type AS text FROM {part} WHERE p_partkey % 97 <> 0",
    "links": """SELECT 'l' || CAST(o_orderkey AS STRING) AS id, 'c' || CAST(o_custkey AS STRING) AS from_id, 'c' || CAST((o_custkey * 7 + o_orderkey % 3) % 1600 AS STRING) AS to_id,
        CASE o_orderkey % 7 WHEN 1 THEN 'PART_OF' WHEN 2 THEN 'DEPENDS_ON' WHEN 3 THEN 'IMPLEMENTS' WHEN 4 THEN 'EXPLAINS' WHEN 5 THEN 'MENTIONS' ELSE 'RELATED_TO' END AS type,
        CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'bootstrap' ELSE 'user' END END AS agent, o_orderkey % 13 <> 0 AS active FROM {orders}""",
    "proposals": """SELECT 'p' || CAST(event_id AS STRING) AS id, CASE event_type WHEN 'signup' THEN 'NEW_CONCEPT' WHEN 'view' THEN 'CONCEPT_MATCH' WHEN 'click' THEN 'CLAIM_CONFLICT' WHEN 'purchase' THEN 'NEW_CLAIM' ELSE 'METADATA_REPAIR' END AS type,
        CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 3 THEN CASE WHEN event_id % 8 = 3 THEN 'activated' ELSE 'rejected' END ELSE 'approved' END AS status,
        CASE event_id % 3 WHEN 0 THEN 'SAFE' WHEN 1 THEN 'REVIEW' ELSE 'AMBIGUOUS' END AS safety, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'c' || CAST(user_id AS STRING) ELSE 'o' || CAST(user_id AS STRING) END AS target_id,
        ts AS created_at, 'src' || CAST(user_id % 5 AS STRING) AS source_id, event_id, user_id FROM {events}""",
    "questions": "SELECT 'q' || CAST(event_id AS STRING) AS id, CASE WHEN event_id % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status, ts AS created_at FROM {events} WHERE event_type = 'signup'",
    "answers": "SELECT 'q' || CAST(event_id AS STRING) AS question_id FROM {events} WHERE event_type = 'signup' AND event_id % 5 = 0",
    "inbound": "SELECT 'c' || CAST(c_custkey AS STRING) AS concept_id, c_custkey % 3 AS inbound FROM {customer} WHERE c_custkey % 2 = 0",
}
_TABLES = ("customer", "orders", "lineitem", "part", "events")


def _model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = MODEL[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in sql})


def _sql(*names: str) -> str:
    return ", ".join(f"m_{n} AS ({MODEL[n].format(**{t: t for t in _TABLES})})" for n in names)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.integrity(*(_model(spark, sf_dir, n) for n in ("concepts", "claims", "evidence", "spans", "links")))


def model_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)


def integrity_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("findings"))


def _gaps(spark: SparkSession, sf_dir: str, counted: bool) -> DataFrame:
    m = {n: _model(spark, sf_dir, n) for n in MODEL}
    sources = m["evidence"].join(m["spans"].select(F.col("id").alias("span_id")), "span_id").select("claim_id", "source_id")
    return D.gaps(m["concepts"], m["claims"], sources, m["links"], m["inbound"] if counted else None, m["questions"], m["answers"], m["proposals"], now=NOW)


def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir, True)


def knowledge_gaps_uncounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation by the edges of concepts, as nobody counted inbound links."""
    return _gaps(spark, sf_dir, False).where("kind = 'isolated_concept'")


def belief_dissent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dissent(*(_model(spark, sf_dir, n) for n in ("concepts", "claims", "proposals")))


def unreferenced_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unreferenced(_model(spark, sf_dir, "concepts"), _model(spark, sf_dir, "inbound"))


def pruned_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _model(spark, sf_dir, "links")
    return D.vanished(links, links.where("cast(substring(from_id, 2) as int) % 4 <> 0"), "bootstrap")


def stale_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = _model(spark, sf_dir, "concepts")
    return D.stale_concepts(concepts, concepts.where("origin_proposal_id is not null"))


def proposals_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.listed(_model(spark, sf_dir, "proposals"), status="approved", type="NEW_CLAIM", source="src1", offset=5, limit=20).select("id", "created_at")


def proposals_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.listed(_model(spark, sf_dir, "proposals"), prefix="p12", limit=10).select("id")


def proposals_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model(spark, sf_dir, "proposals")
    return D.bulk_approvable(rows, "SAFE").unionByName(D.bulk_approvable(rows, "AMBIGUOUS", include_ambiguous=True)).groupBy("safety", "type").agg(F.count(F.lit(1)).alias("proposals"))


def concepts_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = _model(spark, sf_dir, "concepts")
    parts = {"exact": D.by_name(concepts, "BUILDING 7"), "side": D.by_name(concepts, "BUILDING 7", namespace="side"), "any_case": D.by_name(concepts, "machinery 12", any_case=True)}
    part = D.containing(concepts.withColumn("aliases", F.array(F.concat(F.lit("Alias-"), "id"))), "ALIAS-c13")
    out = part.select(F.lit("alias").alias("asked"), "id")
    for name, rows in parts.items():
        out = out.unionByName(rows.select(F.lit(name).alias("asked"), "id"))
    return out


def _claim_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir, "proposals").where("type in ('NEW_CLAIM', 'METADATA_REPAIR')").select(
        "id", "type", "status", "safety", "created_at", F.expr("' User ' || cast(user_id % 50 as string) || ' bought '").alias("statement"), F.col("target_id").alias("subject_concept_id"),
        F.expr("array('s' || cast(user_id * 97 % 300 as string), 's' || cast(event_id % 150 as string))").alias("span_ids"), F.expr("case when event_id % 2 = 0 then ' OF  TYPE ' else 'of kind' end").alias("quote"),
    )


def _activated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return D.activate_claims(_claim_proposals(spark, sf_dir), _model(spark, sf_dir, "spans"), spark.createDataFrame([], "id string"))


def claims_activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _activated(spark, sf_dir)["outcomes"].select("id", "outcome", "reason")


def evidence_activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _activated(spark, sf_dir)
    return made["evidence"].join(made["claims"].select(F.col("id").alias("claim_id"), "origin_proposal_id"), "claim_id").select("origin_proposal_id", "span_id", "relation")


def claims_activated_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same proposals once more: nothing is created."""
    stored = _activated(spark, sf_dir)["claims"].select("id")
    again = D.activate_claims(_claim_proposals(spark, sf_dir), _model(spark, sf_dir, "spans"), stored)
    return again["outcomes"].groupBy("outcome").agg(F.count(F.lit(1)).alias("proposals"), F.lit(again["claims"].count()).alias("created"))


def _matches(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = _model(spark, sf_dir, "proposals").where("type = 'CONCEPT_MATCH'").select(
        "id", "type", "status", "safety", "created_at", F.expr("case when event_id % 2 = 0 then ' Alias ' else 'ALIAS ' end || cast(event_id % 7 as string)").alias("alias"),
        F.expr("case when event_id % 9 = 0 then 'BUILDING 7' else 'c' || cast(user_id * 3 as string) end").alias("target"),
    )
    concepts = _model(spark, sf_dir, "concepts").select("id", "name", F.array(F.lit("alias 3")).alias("aliases"))
    return D.activate_matches(rows, concepts)


def matches_activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)["outcomes"]


def aliases_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)["concepts"].where(F.size("aliases") > 1).select("id", F.array_join(F.transform("aliases", lambda a: F.lower(a)), "|").alias("aliases"))


def concepts_activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model(spark, sf_dir, "proposals").where("type = 'NEW_CONCEPT'").select(
        "id", "type", "status", "safety", "created_at", F.expr("case user_id % 3 when 0 then 'Building-' when 1 then ' new ' else '- ' end || case when user_id % 3 = 2 then '' else cast(user_id % 40 as string) end").alias("name"), F.expr("user_id % 2 = 0").alias("resolved"),
    )
    return D.activate_concepts(rows, _model(spark, sf_dir, "concepts"))["outcomes"].select("id", "outcome", "reason")


def _evolved(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    approved = _model(spark, sf_dir, "proposals").where("status = 'approved' and target_id like 'o%'").select(
        "id", F.expr("case event_id % 3 when 0 then 'ADD_EVIDENCE' when 1 then 'REFINE_CLAIM' else 'MARK_CONFLICT' end").alias("type"), F.col("target_id").alias("claim_id"),
        F.expr("array('s' || cast(event_id % 20 as string))").alias("span_ids"), F.expr("'refined by ' || id").alias("refined"),
    )
    claims = _model(spark, sf_dir, "claims").select("id", "statement", "status", F.lit(None).cast("string").alias("superseded_by"))
    return D.activate_evolution(claims, _model(spark, sf_dir, "evidence").select("claim_id", "span_id").distinct(), approved, at=NOW)


def claims_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir)["claims"].groupBy("status", F.col("superseded_by").isNotNull().alias("replaced"), F.col("statement").startswith("refined by").alias("refined")).agg(F.count(F.lit(1)).alias("claims"))


def evidence_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evolved(spark, sf_dir)
    named = rows["claims"].select(F.col("id").alias("claim_id"), "statement")
    return rows["evidence"].join(named, "claim_id").where("statement like 'refined by%'").select("statement", "span_id")


def revisions_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir)["revisions"].groupBy("op").agg(F.count(F.lit(1)).alias("revisions"))


def model_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dashboard shows, and what the next steps follow from."""
    m = {n: _model(spark, sf_dir, n) for n in ("concepts", "claims", "links", "proposals", "questions", "evidence")}
    return reports.state({
        "concepts": m["concepts"], "claims": m["claims"], "relationships": m["links"].where("active"), "pending_proposals": m["proposals"].where("status = 'pending'"),
        "disputed_claims": m["claims"].where("status = 'DISPUTED'"), "open_questions": m["questions"].where("status = 'OPEN'"),
        "unevidenced_claims": m["claims"].join(m["evidence"].select(F.col("claim_id").alias("id")), "id", "left_anti"),
    })


# -- evaluation

_CASES = """SELECT p_partkey AS case_id, {list}(p_name, 'B-tree ' || p_brand, 'b tree ' || p_brand, p_type) AS expected, {list}('Table of Contents', 'Section ' || CAST(p_size AS STRING)) AS forbidden,
    {list}(CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE 'other' END, CASE WHEN p_partkey % 2 = 0 THEN 'B_Tree ' || p_brand ELSE ' ' END, CASE WHEN p_partkey % 5 = 0 THEN 'section ' || CAST(p_size AS STRING) ELSE 'More' END) AS concepts FROM {part}"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CASES.replace("{list}", "array"), part=table(spark, sf_dir, "part"))


def _case_scores(spark: SparkSession, sf_dir: str, emitted: str = "true") -> DataFrame:
    rows = _cases(spark, sf_dir)
    return E.score_cases(rows.select("case_id", "expected", "forbidden"), rows.where(emitted).select("case_id", "concepts"))


def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_scores(spark, sf_dir).select("case_id", *[F.array_join(c, "|").alias(c) for c in ("found", "missed", "junk", "extra")])


def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(_case_scores(spark, sf_dir, "case_id % 4 <> 0"))


def extraction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compare_cases(_case_scores(spark, sf_dir, "case_id % 4 <> 0").where("case_id % 10 <> 1"), _case_scores(spark, sf_dir, "case_id % 6 <> 0").where("case_id % 10 <> 2"))


def _page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    pages = parts.selectExpr("p_partkey as path", "p_type as name", "array(p_type, p_name) as targets")
    emitted = parts.selectExpr("p_partkey as path", "explode(array(case when p_partkey % 3 = 0 then upper(p_name) else 'nothing' end, 'Index', lower(p_brand), case when p_partkey % 2 = 0 then 'Home' else 'index' end)) as concept")
    return E.score_pages(pages, emitted, parts.selectExpr("p_brand as name"), parts.selectExpr("'INDEX' as name"))


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_scores(spark, sf_dir)


def recovery_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recovery_by_shape(_page_scores(spark, sf_dir).withColumn("name", F.when(F.col("path") % 2 == 0, F.replace("name", F.lit(" "), F.lit("_"))).otherwise(F.concat("name", F.lit(" - "), "path"))))


# -- selection of text


def extraction_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as spans: the three longest of each."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return D.extraction_spans(lines, navigation(F.col("text")), most=3).select("document_id", "ordinal")


def quotes_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as k", "concat_ws('\\n', case when p_partkey % 3 = 0 then 'The ' || p_name || ' here' else 'prose' end, case when p_partkey % 2 = 0 then '```py' else ' ~~~' end, 'x = ' || upper(p_name), "
        "case when p_partkey % 5 = 0 then 'open' else '```' end, case when p_partkey % 7 = 0 then p_name else 'end' end) as text", "replace(p_name, ' ', '  ') as quote",
    )
    return rows.select("k", D.from_code(F.col("quote"), F.col("text")).alias("code"))


def gap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(D.question_words(F.col("text"), ("the", "and", "que")), " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("words"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", D.excerpt(F.col("text"), 60).alias("excerpt"))


_ALL = _sql("concepts", "claims", "evidence", "spans", "links")
_INTEGRITY = f"""{_ALL}, live AS (SELECT * FROM m_links WHERE active), known AS (SELECT id FROM m_concepts UNION SELECT id FROM m_claims),
fi AS (SELECT 'GR001' AS code, 'error' AS severity, id AS entity_id FROM live WHERE from_id NOT IN (SELECT id FROM known) UNION ALL SELECT 'GR002', 'error', id FROM live WHERE to_id NOT IN (SELECT id FROM known)
UNION ALL SELECT 'GR003', 'warning', min(id) FROM live GROUP BY from_id, to_id, type HAVING count(*) > 1 UNION ALL SELECT 'GR004', 'warning', id FROM live WHERE type = 'MENTIONS' UNION ALL SELECT 'GR005', 'warning', id FROM live WHERE agent IS NULL
UNION ALL SELECT 'GR006', 'error', id FROM m_evidence WHERE span_id NOT IN (SELECT id FROM m_spans) UNION ALL SELECT 'GR007', 'error', id FROM m_claims WHERE tier <> 'USER_ASSERTION' AND id NOT IN (SELECT claim_id FROM m_evidence)
UNION ALL SELECT 'GR008', 'warning', id FROM m_concepts WHERE origin_proposal_id IS NULL AND NOT (vault_path IS NOT NULL AND derivation = 'DETERMINISTIC') AND id NOT IN (SELECT subject_concept_id FROM m_claims WHERE subject_concept_id IS NOT NULL)
UNION ALL SELECT 'GR009', 'error', id FROM live WHERE from_id = to_id)"""
_DAYS = f"floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at::TIMESTAMP)) / 86400000000)"
_REASON = """CASE WHEN status = 'activated' THEN NULL WHEN status <> 'approved' THEN 'not_approved:' || status WHEN type = 'METADATA_REPAIR' THEN 'repairs_are_applied' WHEN safety = 'AMBIGUOUS'{settled} THEN 'ambiguous' END"""
_ACTIVATED = f"""{_sql('proposals', 'spans')}, cp AS (SELECT *, user_id % 50 AS u, ['s' || (user_id * 97 % 300), 's' || (event_id % 150)] AS ss FROM m_proposals WHERE type IN ('NEW_CLAIM', 'METADATA_REPAIR')),
sl AS (SELECT list(id) AS ids FROM m_spans),
jc AS (SELECT *, coalesce({_REASON.format(settled='')}, CASE WHEN len(ok) = 0 THEN 'no_span_resolves' END) AS reason FROM (SELECT cp.*, list_filter(ss, lambda x: list_contains(sl.ids, x)) AS ok FROM cp, sl)),
nc AS (SELECT *, row_number() OVER (PARTITION BY u, ok[1] ORDER BY created_at, id) AS nth FROM jc WHERE reason IS NULL)"""
_MATCHES = f"""{_sql('proposals', 'concepts')}, mp AS (SELECT p.*, trim(CASE WHEN event_id % 2 = 0 THEN ' Alias ' ELSE 'ALIAS ' END || (event_id % 7)) AS alias,
       CASE WHEN event_id % 9 = 0 THEN (SELECT min(id) FROM m_concepts WHERE name = 'BUILDING 7') ELSE (SELECT max(id) FROM m_concepts c WHERE c.id = 'c' || (user_id * 3)) END AS cid FROM m_proposals p WHERE type = 'CONCEPT_MATCH'),
mj AS (SELECT *, coalesce({_REASON.format(settled='')}, CASE WHEN cid IS NULL THEN 'target_is_no_concept' END) AS reason FROM mp),
mn AS (SELECT *, row_number() OVER (PARTITION BY cid, lower(alias) ORDER BY created_at, id) AS nth FROM mj WHERE reason IS NULL)"""
_EVOLVED = f"""{_sql('proposals', 'claims', 'evidence')}, ap AS (SELECT p.id, event_id % 3 AS t, target_id AS cid, 's' || (event_id % 20) AS span, 'refined by ' || p.id AS refined FROM m_proposals p JOIN m_claims c ON c.id = p.target_id WHERE p.status = 'approved'),
rf AS (SELECT cid, arg_min(refined, id) AS refined, arg_min(span, id) AS span FROM ap WHERE t = 1 GROUP BY cid), cf AS (SELECT DISTINCT cid FROM ap WHERE t = 2)"""
_NORMS = lambda c: f"list_distinct(list_transform(list_filter({c}, lambda x: trim(x) <> ''), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')))"
_KEPT = lambda c: f"list_filter(list_filter({c}, lambda x, i: trim(x) <> '' AND NOT list_contains(list_transform({c}[i + 1:], lambda y: regexp_replace(lower(y), '[^a-z0-9]+', '', 'g')), regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'))), lambda x: {{0}})"
_N = "regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')"


def _scores_sql(name: str, emitted: str, where: str = "true") -> str:
    e = f"CASE WHEN {emitted} THEN concepts ELSE []::VARCHAR[] END"
    return f"""{name} AS (SELECT case_id, list_sort({_KEPT('expected').format(f'list_contains(en, {_N})')}) AS found, list_sort({_KEPT('expected').format(f'NOT list_contains(en, {_N})')}) AS missed,
list_sort({_KEPT('cs').format(f'list_contains(fn, {_N})')}) AS junk, list_sort({_KEPT('cs').format(f'NOT list_contains(xn, {_N}) AND NOT list_contains(fn, {_N})')}) AS extra
FROM (SELECT *, {_NORMS('cs')} AS en, {_NORMS('expected')} AS xn, {_NORMS('forbidden')} AS fn FROM (SELECT *, {e} AS cs FROM ({_CASES.replace('{list}', 'list_value').replace('{part}', 'part')}) c) d) g WHERE {where})"""


_PAGES = """pe AS (SELECT DISTINCT path, regexp_replace(lower(c), '[^a-z0-9]+', '', 'g') AS n FROM (SELECT p_partkey AS path, unnest([CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE 'nothing' END, 'Index', lower(p_brand), CASE WHEN p_partkey % 2 = 0 THEN 'Home' ELSE 'index' END]) AS c FROM part)),
pv AS (SELECT DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS n FROM part),
ps AS (SELECT p_partkey AS path, p_type AS name, p_partkey % 3 = 0 AS recovered, (SELECT count(*) FROM pe WHERE pe.path = p_partkey AND n = 'index') AS junk,
       (SELECT count(*) FROM pe WHERE pe.path = p_partkey AND n <> 'index' AND n IN (SELECT n FROM pv)) AS known, (SELECT count(*) FROM pe WHERE pe.path = p_partkey AND n <> 'index' AND n NOT IN (SELECT n FROM pv)) AS off FROM part)"""

QUERIES = {
    q.__name__: q
    for q in (model_integrity, integrity_by_code, knowledge_gaps, knowledge_gaps_uncounted, belief_dissent, unreferenced_concepts, pruned_links, stale_concepts, proposals_listed, proposals_by_prefix, proposals_bulk, concepts_by_name,
              claims_activated, evidence_activated, claims_activated_again, matches_activated, aliases_grown, concepts_activated, claims_evolved, evidence_evolved, revisions_evolved, model_state, extraction_scores, extraction_summary,
              extraction_runs, page_scores, recovery_by_shape, extraction_spans, quotes_of_code, gap_words, excerpts)
}
ORACLES = {
    "model_integrity": f"WITH {_INTEGRITY} SELECT * FROM fi",
    "integrity_by_code": f"WITH {_INTEGRITY} SELECT code, severity, count(*) AS findings FROM fi GROUP BY code, severity",
    "knowledge_gaps": f"""WITH {_sql(*MODEL)} SELECT 'concept_without_claims' AS kind, id AS subject_id, CASE WHEN vault_path IS NOT NULL THEN 0.6 ELSE 0.4 END::DOUBLE AS weight FROM m_concepts WHERE id NOT IN (SELECT subject_concept_id FROM m_claims WHERE subject_concept_id IS NOT NULL)
UNION ALL SELECT 'isolated_concept', concept_id, 0.3 FROM m_inbound WHERE inbound = 0
UNION ALL SELECT 'question_without_answers', id, round(least(1.0, 0.7 + 0.05 * floor(greatest({_DAYS}, 0) / 7)), 6) FROM m_questions WHERE status = 'OPEN' AND id NOT IN (SELECT question_id FROM m_answers)
UNION ALL SELECT 'claim_with_single_source', id, CASE WHEN derivation = 'MODEL' THEN 0.5 ELSE 0.25 END FROM m_claims WHERE status = 'ACTIVE' AND id IN (SELECT claim_id FROM m_evidence WHERE span_id IN (SELECT id FROM m_spans) GROUP BY claim_id HAVING count(DISTINCT source_id) = 1)
UNION ALL SELECT 'unresolved_dispute', id, 0.9 FROM m_claims WHERE status = 'DISPUTED'
UNION ALL SELECT 'unresolved_dispute', coalesce(target_id, id), round(least(1.0, 0.9 + 0.005 * ({_DAYS} - 14)), 6) FROM m_proposals WHERE type = 'CLAIM_CONFLICT' AND status = 'pending' AND {_DAYS} >= 14""",
    "knowledge_gaps_uncounted": f"WITH {_sql('concepts', 'links')} SELECT 'isolated_concept' AS kind, id AS subject_id, 0.3::DOUBLE AS weight FROM m_concepts WHERE id NOT IN (SELECT from_id FROM m_links UNION SELECT to_id FROM m_links)",
    "belief_dissent": f"""WITH {_sql('concepts', 'claims', 'proposals')}, po AS (SELECT id, target_id FROM m_proposals WHERE type = 'CLAIM_CONFLICT' AND status = 'pending')
SELECT c.subject_concept_id AS concept_id, po.id AS proposal_id, c.id AS claim_id FROM po JOIN m_claims c ON c.id = po.target_id WHERE c.subject_concept_id IS NOT NULL UNION ALL SELECT c.id, po.id, NULL FROM po JOIN m_concepts c ON c.id = po.target_id""",
    "unreferenced_concepts": "SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey % 6 = 0",
    "pruned_links": f"WITH {_sql('links')} SELECT id FROM m_links WHERE agent = 'bootstrap' AND substr(from_id, 2)::INT % 4 = 0",
    "stale_concepts": f"WITH {_sql('concepts')} SELECT id FROM m_concepts WHERE vault_path IS NOT NULL AND derivation = 'DETERMINISTIC' AND origin_proposal_id IS NULL",
    "proposals_listed": f"WITH {_sql('proposals')} SELECT id, created_at FROM m_proposals WHERE status = 'approved' AND type = 'NEW_CLAIM' AND source_id = 'src1' ORDER BY created_at, id LIMIT 20 OFFSET 5",
    "proposals_by_prefix": f"WITH {_sql('proposals')} SELECT id FROM m_proposals WHERE starts_with(id, 'p12') ORDER BY created_at, id LIMIT 10",
    "proposals_bulk": f"WITH {_sql('proposals')} SELECT safety, type, count(*) AS proposals FROM m_proposals WHERE status = 'pending' AND safety IN ('SAFE', 'AMBIGUOUS') GROUP BY safety, type",
    "concepts_by_name": f"WITH {_sql('concepts')} SELECT 'alias' AS asked, id FROM m_concepts WHERE starts_with(id, 'c13') UNION ALL SELECT 'exact', id FROM m_concepts WHERE name = 'BUILDING 7' UNION ALL SELECT 'side', id FROM m_concepts WHERE name = 'BUILDING 7' AND namespace = 'side' UNION ALL SELECT 'any_case', id FROM m_concepts WHERE name = 'MACHINERY 12'",
    "claims_activated": f"WITH {_ACTIVATED} SELECT id, CASE WHEN nth > 1 THEN 'already_active' ELSE 'created' END AS outcome, NULL AS reason FROM nc UNION ALL SELECT id, 'refused', reason FROM jc WHERE reason IS NOT NULL",
    "evidence_activated": f"WITH {_ACTIVATED} SELECT DISTINCT id AS origin_proposal_id, unnest(ok) AS span_id, CASE WHEN event_id % 2 = 0 THEN 'QUOTES' ELSE 'PARAPHRASES' END AS relation FROM nc WHERE nth = 1",
    "claims_activated_again": f"WITH {_ACTIVATED} SELECT CASE WHEN reason IS NULL THEN 'already_active' ELSE 'refused' END AS outcome, count(*) AS proposals, 0 AS created FROM jc GROUP BY 1",
    "matches_activated": f"WITH {_MATCHES} SELECT id, CASE WHEN lower(alias) = 'alias 3' OR nth > 1 THEN 'already_active' ELSE 'created' END AS outcome, NULL AS reason FROM mn UNION ALL SELECT id, 'refused', reason FROM mj WHERE reason IS NOT NULL",
    "aliases_grown": f"WITH {_MATCHES} SELECT cid AS id, 'alias 3|' || string_agg(lower(alias), '|' ORDER BY created_at, id) AS aliases FROM mn WHERE nth = 1 AND lower(alias) <> 'alias 3' GROUP BY cid",
    "concepts_activated": f"""WITH {_sql('proposals', 'concepts')}, kp AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'building' || (user_id % 40) WHEN 1 THEN 'new' || (user_id % 40) ELSE '' END AS norm FROM m_proposals WHERE type = 'NEW_CONCEPT'),
kj AS (SELECT *, coalesce({_REASON.format(settled=' AND user_id % 2 <> 0')}, CASE WHEN norm = '' THEN 'no_name' END) AS reason FROM kp),
kn AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY created_at, id) AS nth FROM kj WHERE reason IS NULL)
SELECT id, CASE WHEN nth > 1 OR norm IN (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') FROM m_concepts) THEN 'already_active' ELSE 'created' END AS outcome, NULL AS reason FROM kn UNION ALL SELECT id, 'refused', reason FROM kj WHERE reason IS NOT NULL""",
    "claims_evolved": f"""WITH {_EVOLVED}, ns AS (SELECT CASE WHEN rf.cid IS NOT NULL THEN 'SUPERSEDED' WHEN cf.cid IS NOT NULL THEN 'DISPUTED' ELSE c.status END AS status, rf.cid IS NOT NULL AS replaced, false AS refined
FROM m_claims c LEFT JOIN rf ON rf.cid = c.id LEFT JOIN cf ON cf.cid = c.id UNION ALL SELECT 'ACTIVE', false, true FROM rf) SELECT status, replaced, refined, count(*) AS claims FROM ns GROUP BY ALL""",
    "evidence_evolved": f"WITH {_EVOLVED} SELECT refined AS statement, span AS span_id FROM rf",
    "revisions_evolved": f"""WITH {_EVOLVED}, sp AS (SELECT DISTINCT cid FROM ap WHERE t = 0 AND (cid, span) NOT IN (SELECT (claim_id, span_id) FROM m_evidence)), ch AS (SELECT cid FROM cf WHERE cid NOT IN (SELECT cid FROM rf) UNION SELECT cid FROM sp)
SELECT 'CREATE' AS op, count(*) AS revisions FROM rf UNION ALL SELECT 'SUPERSEDE', count(*) FROM rf UNION ALL SELECT 'CHANGE', count(*) FROM ch""",
    "model_state": f"""WITH {_sql('concepts', 'claims', 'links', 'proposals', 'questions', 'evidence')} SELECT 'concepts' AS name, count(*) AS value FROM m_concepts UNION ALL SELECT 'claims', count(*) FROM m_claims UNION ALL SELECT 'relationships', count(*) FROM m_links WHERE active
UNION ALL SELECT 'pending_proposals', count(*) FROM m_proposals WHERE status = 'pending' UNION ALL SELECT 'disputed_claims', count(*) FROM m_claims WHERE status = 'DISPUTED' UNION ALL SELECT 'open_questions', count(*) FROM m_questions WHERE status = 'OPEN'
UNION ALL SELECT 'unevidenced_claims', count(*) FROM m_claims WHERE id NOT IN (SELECT claim_id FROM m_evidence)""",
    "extraction_scores": f"WITH {_scores_sql('sc', 'true')} SELECT case_id, " + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ("found", "missed", "junk", "extra")) + " FROM sc",
    "extraction_summary": f"WITH {_scores_sql('sc', 'case_id % 4 <> 0')} SELECT count(*) AS cases, round(sum(len(found)) / sum(len(found) + len(missed)), 6) AS recall, round(sum(len(junk)) / sum(len(found) + len(junk) + len(extra)), 6) AS junk_rate FROM sc",
    "extraction_runs": f"""WITH {_scores_sql('sa', 'case_id % 4 <> 0', 'case_id % 10 <> 1')}, {_scores_sql('sb', 'case_id % 6 <> 0', 'case_id % 10 <> 2')}
SELECT CASE WHEN sa.case_id IS NULL THEN 'added' WHEN sb.case_id IS NULL THEN 'removed' WHEN len(sb.found) > len(sa.found) THEN 'gained' WHEN len(sb.found) < len(sa.found) THEN 'lost' WHEN sa.found = sb.found THEN 'same' ELSE 'changed' END AS change, count(*) AS cases
FROM sa FULL JOIN sb ON sa.case_id = sb.case_id GROUP BY 1""",
    "page_scores": f"WITH {_PAGES} SELECT * FROM ps",
    "recovery_by_shape": f"WITH {_PAGES} SELECT CASE WHEN path % 2 = 0 THEN 'screaming case' ELSE 'compound pair' END AS shape, count(*) FILTER (recovered) AS recovered, count(*) AS pages FROM ps GROUP BY 1",
    "extraction_spans": r"""WITH li AS (SELECT doc_id AS document_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS ordinal FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
SELECT document_id, ordinal::INTEGER AS ordinal FROM li WHERE length(trim(regexp_replace(text, '^\s+|\s+$', '', 'g'))) >= 40 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY length(text) DESC, ordinal) <= 3""",
    # a block is closed by any next fence; an open one takes the rest
    "quotes_of_code": "SELECT p_partkey AS k, p_partkey % 3 <> 0 AND NOT (p_partkey % 7 = 0 AND p_partkey % 5 <> 0) AS code FROM part",
    "gap_words": "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'que')))), ' ') AS words FROM conversations",
    "excerpts": r"SELECT doc_id, CASE WHEN length(t) > 60 THEN left(t, 59) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)",
}
