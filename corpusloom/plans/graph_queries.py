"""Graph and knowledge queries over the order tables and events, and the SQL that they are checked against.

Parts that share orders stand for concepts that share spans; customers for concepts, orders for claims
(open: held, pending: disputed, finished: superseded), order lines for evidence, suppliers for sources,
events for revisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import knowledge as K
from corpusloom.sources.staging import staged
from corpusloom.sources.tables import table

SINCE, UNTIL = "2024-01-10 00:00:00", "2024-01-20 00:00:00"
ALLOWED = (("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"))
START, GOAL = 1, 2


_stored: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, made) -> DataFrame:
    """A table of a folder that is written once a session and read again."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _stored:
        _stored[at] = staged(made(), name)
    return _stored[at]


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "edges", lambda: cooccurrence_edges(spark, sf_dir))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjacency of the graph, sorted by node, so that a search reads only the row groups of its frontier."""
    return _once(spark, sf_dir, "steps", lambda: G.capped_neighbours(_edges(spark, sf_dir)).repartitionByRange("node").sortWithinPartitions("node", "n"))


def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cooccurrence(table(spark, sf_dir, "lineitem"), group="l_orderkey", item="l_partkey")


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir))


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir)).orderBy(F.col("degree").desc(), "node").limit(5)


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_metrics(table(spark, sf_dir, "part"), _edges(spark, sf_dir), node="p_partkey")


def neighbours_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.capped_neighbours(_edges(spark, sf_dir))


def related_within_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.within_depth(_steps(spark, sf_dir), START, 3)


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortest_path(_steps(spark, sf_dir), START, GOAL)


def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings: edges without an end, doubled edges, self links, claims without evidence, concepts without claims."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customers, parts, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    found = [
        G.findings("GR001", orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_anti"), F.col("o_orderkey")),
        G.findings("GR002", lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_anti"), F.col("l_orderkey")),
        G.findings("GR003", lines.groupBy("l_orderkey", "l_partkey", "l_suppkey").count().where("count > 1"), F.col("l_orderkey")),
        G.findings("GR004", orders.where(~F.col("o_orderstatus").isin("O", "P", "F")), F.col("o_orderkey")),
        G.findings("GR005", lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti"), F.col("l_orderkey")),
        G.findings("GR006", lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), F.col("l_orderkey")),
        G.findings("GR007", orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), F.col("o_orderkey")),
        G.findings("GR008", customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), F.col("c_custkey")),
        G.findings("GR009", orders.where("o_orderkey = o_custkey"), F.col("o_orderkey")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim to evidence to source to where the source is; claims without evidence stay with nulls."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("source"), "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    chain = orders.join(lines, F.col("claim_id") == F.col("l_orderkey"), "left").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return chain.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("claim_id", "line", "source", "nation")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "P", "DISPUTED").when(F.col("o_orderstatus") == "F", "SUPERSEDED")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("concept_id"), status.alias("status"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("source_id"))


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("concept_id"))


def belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.beliefs(_concepts(spark, sf_dir), _claims(spark, sf_dir), _evidence(spark, sf_dir))


def gaps_without_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.gap("no_claims", _concepts(spark, sf_dir).join(_claims(spark, sf_dir).where("status = 'ACTIVE'"), "concept_id", "left_anti"), F.col("concept_id"))


def gaps_unevidenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.gap("unevidenced", _claims(spark, sf_dir).join(_evidence(spark, sf_dir), "claim_id", "left_anti"), F.col("claim_id"))


def gaps_single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.gap("single_source", K.single_source(_evidence(spark, sf_dir)), F.col("claim_id"))


def gaps_disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.gap("disputed", _claims(spark, sf_dir).where("status = 'DISPUTED'"), F.col("claim_id"))


def gap_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty heaviest gaps: weight first, then kind and subject."""
    every = gaps_without_claims(spark, sf_dir)
    for f in (gaps_unevidenced, gaps_single_source, gaps_disputed):
        every = every.unionByName(f(spark, sf_dir))
    return every.orderBy(F.col("weight").desc(), "kind", "subject_id").limit(20)


def gap_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = gaps_without_claims(spark, sf_dir)
    for f in (gaps_unevidenced, gaps_single_source, gaps_disputed):
        gaps = gaps.unionByName(f(spark, sf_dir))
    concepts = _concepts(spark, sf_dir).agg(F.count(F.lit(1)).alias("population"))
    claims = _claims(spark, sf_dir).agg(F.count(F.lit(1)).alias("population"))
    kinds = claims.select(F.explode(F.array(*[F.lit(k) for k in ("unevidenced", "single_source", "disputed")])).alias("kind"), "population")
    return K.saturation(gaps, kinds.unionByName(concepts.select(F.lit("no_claims").alias("kind"), "population")))


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("revision_id"), F.col("ts").alias("at"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("op"))


def changes_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.changes_between(_revisions(spark, sf_dir), SINCE, UNTIL)


def changes_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = ["click", "error", "purchase", "signup", "view"]
    return _revisions(spark, sf_dir).groupBy("entity_id").pivot("op", ops).count().select("entity_id", *[F.coalesce(o, F.lit(0)).alias(o) for o in ops])


def revision_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.timeline(_revisions(spark, sf_dir)).select("entity_id", "seq", "op", "previous_op")


def proposal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.transitions(K.timeline(_revisions(spark, sf_dir)), spark.createDataFrame(list(ALLOWED), "previous_op string, op string"))


def synthesis_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as a synthesis saw them against the claims now: one priority gone, one status changed, dear ones repriced."""
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    orders = table(spark, sf_dir, "orders").where("o_orderpriority <> '1-URGENT'")
    after = orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "2-HIGH", "F").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_totalprice") > 400000, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return K.staleness(before, after, ("o_orderstatus", "o_totalprice"), key="o_orderkey")


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("customer", "orders", "lineitem", "part", "supplier", "events", "documents", "pages")
    out = None
    for n in names:
        one = table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def concept_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of concepts whose name holds a needle in any case, with the total before paging."""
    hit = table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("customer#0000000"))).where("c_mktsegment = 'HOUSEHOLD'")
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    page = hit.orderBy(F.lower("c_name"), "c_custkey").offset(2).limit(5)
    return page.join(F.broadcast(total)).select("c_custkey", "c_name", "total")


def impact_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of each order's lines as assessments: returned lines conflict, discounted ones refine, shipped ones support."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "CONFLICT").when(F.col("l_discount") >= 0.05, "REFINES").when(F.col("l_linestatus") == "F", "SUPPORTS")
    examined = table(spark, sf_dir, "orders").join(lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return K.impact(lines.select("l_orderkey", kind.alias("classification")).withColumnRenamed("l_orderkey", "o_orderkey"), examined.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("claims")), key="o_orderkey")




_TIER = "CASE {0} WHEN 0 THEN 'SOURCE_FACT' WHEN 1 THEN 'EXTRACTED_CLAIM' WHEN 2 THEN 'USER_ASSERTION' WHEN 3 THEN 'MODEL_INFERENCE' ELSE 'SYNTHESIS' END"


def provenance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, their lines as inputs; the keys give the tiers."""
    items = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS item_id", _TIER.format("o_orderkey % 5") + " AS tier")
    inputs = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS item_id", _TIER.format("l_partkey % 5") + " AS tier")
    return K.floor_violations(items, inputs)


_E = """
m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS p FROM lineitem),
e AS (SELECT x.p AS a, y.p AS b, count(*) AS shared, round(least(1.0, count(*) / 5), 4) AS score FROM m x JOIN m y ON x.g = y.g AND x.p < y.p GROUP BY ALL HAVING count(*) >= 2),
b2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
nb AS (SELECT a AS node, b AS neighbour, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM b2 QUALIFY n <= 50),
dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)"""
_CL = "cl AS (SELECT o_orderkey AS claim_id, o_custkey AS concept_id, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'DISPUTED' WHEN 'F' THEN 'SUPERSEDED' END AS status FROM orders)"
_GAPS = f"""{_CL},
g AS (SELECT 'no_claims' AS kind, c_custkey AS subject_id, 0.4::DOUBLE AS weight FROM customer WHERE c_custkey NOT IN (SELECT concept_id FROM cl WHERE status = 'ACTIVE')
 UNION ALL SELECT 'unevidenced', claim_id, 0.5 FROM cl WHERE claim_id NOT IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT 'single_source', l_orderkey, 0.25 FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1
 UNION ALL SELECT 'disputed', claim_id, 0.9 FROM cl WHERE status = 'DISPUTED')"""
_TL = "tl AS (SELECT user_id AS entity_id, row_number() OVER w AS seq, event_type AS op, lag(event_type) OVER w AS previous_op FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"

QUERIES = {
    f.__name__: f
    for f in (cooccurrence_edges, graph_degree, hubs, graph_metrics, neighbours_capped, related_within_depth, shortest_path, integrity_report, evidence_chain, belief, gaps_without_claims, gaps_unevidenced,
              gaps_single_source, gaps_disputed, gap_ranking, gap_saturation, changes_window, changes_pivot, revision_timeline, proposal_transitions, synthesis_staleness, table_counts, concept_page,
              impact_classification, provenance_floor)
}
ORACLES = {
    "cooccurrence_edges": f"WITH {_E} SELECT a, b, shared, score FROM e",
    "graph_degree": f"WITH {_E} SELECT * FROM dg",
    "hubs": f"WITH {_E} SELECT * FROM dg ORDER BY degree DESC, node LIMIT 5",
    "graph_metrics": f"WITH {_E}, d AS (SELECT p_partkey, degree FROM part LEFT JOIN dg ON node = p_partkey) SELECT count(*) AS nodes, coalesce(max(degree), 0) AS max_degree, round(avg(coalesce(degree, 0)), 4) AS mean_degree, count(*) FILTER (degree IS NULL) AS isolated, round(coalesce(avg(degree), 0), 4) AS branching, (SELECT count(*) FROM e) AS edges FROM d",
    "neighbours_capped": f"WITH {_E} SELECT * FROM nb",
    "related_within_depth": f"WITH RECURSIVE {_E}, r AS (SELECT {START}::BIGINT AS node, 0 AS depth UNION SELECT neighbour, depth + 1 FROM r JOIN nb USING (node) WHERE depth < 3) SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node HAVING min(depth) > 0",
    "shortest_path": f"""WITH RECURSIVE {_E}, r AS (SELECT {START}::BIGINT AS node, [{START}::BIGINT] AS path, 0 AS d
 UNION ALL SELECT node, path, d FROM (SELECT neighbour AS node, list_append(path, neighbour) AS path, d + 1 AS d, row_number() OVER (PARTITION BY neighbour ORDER BY list_append(path, neighbour)) AS k FROM r JOIN nb USING (node) WHERE d < 6 AND NOT list_contains(path, neighbour)) WHERE k = 1)
SELECT d::INTEGER AS length, array_to_string(path, '>') AS path FROM r WHERE node = {GOAL} ORDER BY d, r.path LIMIT 1""",
    "integrity_report": """SELECT 'GR001' AS code, o_orderkey::VARCHAR AS subject FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'GR002', l_orderkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'GR003', l_orderkey::VARCHAR FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey HAVING count(*) > 1
UNION ALL SELECT 'GR004', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus NOT IN ('O', 'P', 'F')
UNION ALL SELECT 'GR005', l_orderkey::VARCHAR FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'GR006', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'GR007', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'GR008', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'GR009', o_orderkey::VARCHAR FROM orders WHERE o_orderkey = o_custkey""",
    "evidence_chain": "SELECT o_orderkey AS claim_id, l_linenumber AS line, s_name AS source, n_name AS nation FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey",
    "belief": f"""WITH {_CL}, s AS (SELECT concept_id, count(DISTINCT l_suppkey) AS sources, count(DISTINCT claim_id) FILTER (l_orderkey IS NULL) AS unevidenced FROM cl LEFT JOIN lineitem ON l_orderkey = claim_id WHERE status = 'ACTIVE' GROUP BY concept_id),
c AS (SELECT concept_id, count(*) FILTER (status = 'ACTIVE') AS held, count(*) FILTER (status = 'DISPUTED') AS disputed, count(*) FILTER (status = 'SUPERSEDED') AS superseded FROM cl GROUP BY concept_id)
SELECT c_custkey AS concept_id, coalesce(held, 0) AS held, coalesce(disputed, 0) AS disputed, coalesce(superseded, 0) AS superseded, coalesce(sources, 0) AS sources, coalesce(unevidenced, 0) AS unevidenced,
       coalesce(held, 0) > 0 AND coalesce(disputed, 0) = 0 AS settled FROM customer LEFT JOIN c ON c.concept_id = c_custkey LEFT JOIN s ON s.concept_id = c_custkey""",
    "gaps_without_claims": f"WITH {_GAPS} SELECT * FROM g WHERE kind = 'no_claims'",
    "gaps_unevidenced": f"WITH {_GAPS} SELECT * FROM g WHERE kind = 'unevidenced'",
    "gaps_single_source": f"WITH {_GAPS} SELECT * FROM g WHERE kind = 'single_source'",
    "gaps_disputed": f"WITH {_GAPS} SELECT * FROM g WHERE kind = 'disputed'",
    "gap_ranking": f"WITH {_GAPS} SELECT * FROM g ORDER BY weight DESC, kind, subject_id LIMIT 20",
    "gap_saturation": f"WITH {_GAPS} SELECT kind, count(*) AS gaps, population, population >= 5 AND count(*) / population >= 0.5 AS collapsed FROM (SELECT kind, CASE kind WHEN 'no_claims' THEN (SELECT count(*) FROM customer) ELSE (SELECT count(*) FROM orders) END AS population FROM g) GROUP BY kind, population",
    "changes_window": f"SELECT event_type AS op, count(*) AS revisions, count(DISTINCT user_id) AS entities, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE ts BETWEEN TIMESTAMP '{SINCE}' AND TIMESTAMP '{UNTIL}' GROUP BY event_type",
    "changes_pivot": "SELECT user_id AS entity_id, " + ", ".join(f"count(*) FILTER (event_type = '{o}') AS {o}" for o in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
    "revision_timeline": f"WITH {_TL} SELECT entity_id, seq::INTEGER AS seq, op, previous_op FROM tl",
    "proposal_transitions": f"WITH {_TL} SELECT previous_op, op, count(*) AS n, (previous_op, op) IN ({', '.join(map(str, ALLOWED))}) AS allowed FROM tl WHERE previous_op IS NOT NULL GROUP BY previous_op, op",
    "synthesis_staleness": """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN 'F' ELSE o_orderstatus END AS s, CASE WHEN o_totalprice > 400000 THEN o_totalprice * 2 ELSE o_totalprice END AS p FROM orders WHERE o_orderpriority <> '1-URGENT'),
r AS (SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'missing' WHEN o_orderstatus <> s THEN 'o_orderstatus' WHEN o_totalprice <> p THEN 'o_totalprice' END AS reason FROM orders o LEFT JOIN n USING (o_orderkey)) SELECT * FROM r WHERE reason IS NOT NULL""",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("customer", "orders", "lineitem", "part", "supplier", "events", "documents", "pages")),
    "concept_page": "WITH h AS (SELECT * FROM customer WHERE contains(lower(c_name), 'customer#0000000') AND c_mktsegment = 'HOUSEHOLD') SELECT c_custkey, c_name, (SELECT count(*) FROM h) AS total FROM h ORDER BY lower(c_name), c_custkey LIMIT 5 OFFSET 2",
    "impact_classification": """WITH a AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_discount >= 0.05 THEN 2 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS w FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN w = 3 THEN 'CONFLICT' WHEN w = 2 THEN 'REFINES' WHEN w = 1 THEN 'SUPPORTS' WHEN w IS NULL THEN 'NEW_KNOWLEDGE' ELSE 'NO_MATERIAL_CHANGE' END AS impact FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""",
    "provenance_floor": f"""WITH i AS (SELECT o_orderkey AS item_id, {_TIER.format('o_orderkey % 5')} AS tier FROM orders), l AS (SELECT l_orderkey AS item_id, {_TIER.format('l_partkey % 5')} AS t FROM lineitem),
w AS (SELECT item_id, min(CASE t WHEN 'SOURCE_FACT' THEN 4 WHEN 'EXTRACTED_CLAIM' THEN 3 WHEN 'USER_ASSERTION' THEN 3 WHEN 'MODEL_INFERENCE' THEN 2 ELSE 1 END) AS floor FROM l GROUP BY 1) SELECT item_id, tier FROM i JOIN w USING (item_id) WHERE CASE tier WHEN 'SOURCE_FACT' THEN 4 WHEN 'EXTRACTED_CLAIM' THEN 3 WHEN 'USER_ASSERTION' THEN 3 WHEN 'MODEL_INFERENCE' THEN 2 ELSE 1 END > floor""",
}
