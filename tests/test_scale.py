"""Work that must not grow with the square of the input, and that what narrows it loses nothing."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import matching as X


def _grams(t):
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))}


def _spoilt(r, text, letters):
    out = list(text)
    for _ in range(r.randrange(5)):
        i = r.randrange(len(out) + 1)
        out[i : i + r.randrange(2)] = r.choice(letters) if r.random() < 0.6 else ""
    return "".join(out)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh1"])
def test_fuzzy_pairs_are_all_that_are_alike(spark, letters):
    r = random.Random(5)
    known = {"".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 14, 20, 38, 41, 52]))) for _ in range(160)} | {"abab", "abcd"}
    asked = sorted({_spoilt(r, k, letters) for k in known for _ in range(3)} | {"abcab", "abxcd", ""})
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = {(a, b): ratio(a, b) for a in asked for b in known if _grams(a) & _grams(b) and ratio(a, b) >= X.FUZZY}
    none = spark.createDataFrame([], "norm string, concept string")
    found = X.match_candidates(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame([(k, []) for k in sorted(known)], "concept string, aliases array<string>"), none)
    assert {(f.name, f.concept): f.score for f in found.where(F.col("rank") == len(X.STAGES)).collect()} == want


def test_names_that_are_found_are_not_compared(spark, monkeypatch):
    """One family of names, all exact, and names that share only digits with it."""
    seen, ratio = spark.sparkContext.accumulator(0), X.ratio.func

    @F.pandas_udf("double")
    def counted(a: "pd.Series", b: "pd.Series") -> "pd.Series":
        seen.add(len(a))
        return ratio(a, b)

    monkeypatch.setattr(X, "ratio", counted)
    known = spark.range(300).selectExpr("'blue ring x' || id AS concept", "array('also ' || id) AS aliases")
    asked = known.selectExpr("upper(concept) AS name").union(spark.range(300).selectExpr("'proposed ' || id AS name"))
    got = X.match_names(asked, known, spark.createDataFrame([], "norm string, concept string")).groupBy("stage").count().collect()
    assert {r.stage: r["count"] for r in got} == {"exact": 300, "none": 300} and seen.value < 600


def _rows_joined(df):
    """Rows that each join of an executed plan gives, joins of stages included."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        if "Join" in kind:
            found.append(p.metrics().apply("numOutputRows").value())
    return found


def test_names_of_one_beginning_meet_as_wholes(spark):
    names = spark.range(500).selectExpr("'brandname' || id || 'q' AS name")
    texts = spark.range(400).selectExpr("id AS key", "'on brandname' || id || 'q' AS hay").selectExpr("key", "replace(hay, ' ', '') AS hay")
    got = X.held_names(names, texts, least=4)
    assert max(_rows_joined(got)) <= 400 * 3
    assert {(r.name, r.key) for r in got.collect()} == {(f"brandname{i}q", i) for i in range(400)}


@pytest.mark.parametrize("sent", [0, 1000])
def test_held_names_are_all_that_occur(spark, monkeypatch, sent):
    monkeypatch.setattr(X, "SENT", sent)
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab") for _ in range(n))
    names, texts = {word(r.randrange(12)) for _ in range(200)}, {i: word(r.randrange(30)) for i in range(80)}
    got = X.held_names(spark.createDataFrame([(n,) for n in [*names, *list(names)[:9], None]], "name string"), spark.createDataFrame([*texts.items(), (99, None)], "key int, hay string"), least=4).collect()
    want = sorted((n, k) for n in names if len(n) >= 4 for k, t in texts.items() if n in t)
    assert sorted((g.name, g.key) for g in got) == want


def test_narrowing_does_not_pair_names_of_one_beginning(spark):
    from corpusloom.operators import lifecycle as Y

    concepts = spark.range(400).selectExpr("'Blue Ring ' || id || 'z' AS concept", "array('Brand kind ' || id || 'q', NULL) AS aliases")
    spans = spark.range(300).selectExpr("'on blue-ring ' || id || 'z and brand kind ' || (id + 50) || 'q' AS text", "NULL AS heading")
    seen = spark.sparkContext.accumulator(0)
    contains = F.contains
    F_contains = F.udf(lambda hay, name: (seen.add(1), name in hay)[1], "boolean")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(F, "contains", lambda a, b: F_contains(a, b))
        got = {r.concept: r.selector for r in Y.narrow(concepts, spans, spark.createDataFrame([("Blue Ring 399z", "Blue Ring 1z")], "a string, b string"), cap=1000).collect()}
    assert F.contains is contains and seen.value < 3000
    want = {f"Blue Ring {i}z": "exact_name" for i in range(300)} | {f"Blue Ring {i}z": "alias" for i in range(300, 350)} | {"Blue Ring 399z": "graph_neighbour"}
    assert got == want


def test_mentions_send_no_texts_to_all_tasks(spark):
    """Texts that repeat are small as files, so that their size there says nothing of what they take in memory."""
    from corpusloom.operators import relations as R

    spans = spark.range(3000).selectExpr("id", "'the ' || CASE WHEN id % 2 = 0 THEN 'Union-Find' ELSE 'Hash map' END || ' and more' AS text")
    concepts = spark.createDataFrame([("union find",), ("UNION FIND",), ("Hash Map",), ("map",), ("more or less",), (None,)], "name string")
    df = R.mentions(concepts, spans)
    got = df.collect()
    assert len(got) == 4500 and {(r.concept, r.span_id % 2) for r in got} == {("union find", 0), ("UNION FIND", 0), ("Hash Map", 1)}
    todo, sent = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        if kind == "BroadcastExchangeExec":
            sent.append(p.metrics().apply("numOutputRows").value())
    assert sent and max(sent) < 10


def test_nearest_equals_all_pairs_on_hard_rows(spark):
    from corpusloom.operators.vectors import cosine_of, nearest, ranked

    r = random.Random(8)
    vectors = [[r.choice([-1.0, 0.5, 0.1, 0.3, 2.0]) for _ in range(6)] for _ in range(60)]
    vectors += [[0.1, 0.2, 0.3, 0.4, 0.5, 0.6]] * 40 + [[x * 3 for x in vectors[5]], None, [], [0.0] * 6, [None, 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 1.0, 1.0, 1.0, 1.0, None], [1.0] * 4, [1.0] * 9]
    vectors += [[float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [1e-200] * 6, [1e200] * 6]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").repartition(3)
    asked = F.pmod("vec_id", F.lit(3)) == 0
    got = {}
    for x in nearest(df, asked, 7, dims=(2, 4, None)).collect():
        got.setdefault(x.dims, set()).add((x.query_id, x.vec_id, str(x.cos).replace("-0.0", "0.0") if x.cos == 0 else str(x.cos), x["rank"]))
    for d in (2, 4, None):
        used = df if d is None else df.withColumn("embedding", F.slice("embedding", 1, d))
        want = {(x.query_id, x.vec_id, str(x.cos).replace("-0.0", "0.0") if x.cos == 0 else str(x.cos), x["rank"]) for x in ranked(cosine_of(used, asked), 7).collect()}
        assert got[d] == want


def test_nearest_hands_on_one_row_a_query_and_tells_close_vectors_apart(spark):
    """Clusters whose members differ by less than single precision shows, some of other lengths; a task hands on no row for each of the best."""
    import numpy as np

    from corpusloom.operators.vectors import cosine_of, nearest, ranked

    r = np.random.default_rng(4)
    middles, near = r.standard_normal((12, 8)), r.standard_normal((900, 8)) * 10.0 ** -r.integers(3, 12, 900)[:, None]
    vectors = [[float(x) for x in middles[i % 12] * (1 + i % 3) + near[i]][: 7 if i % 50 == 3 else 8] for i in range(900)] + [None, [0.0] * 8]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").repartition(2)
    asked = F.pmod("vec_id", F.lit(9)) == 0
    got = nearest(df, asked, 10, dims=(4, None))
    rows = got.collect()
    for d in (4, None):
        used = df if d is None else df.withColumn("embedding", F.slice("embedding", 1, d))
        want = {(x.query_id, x["rank"]): (x.vec_id, x.cos) for x in ranked(cosine_of(used, asked), 10).collect()}
        assert {(x.query_id, x["rank"]): (x.vec_id, x.cos) for x in rows if x.dims == d} == want
    todo, handed = [got._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        if kind == "MapInArrowExec":
            handed.append(p.metrics().apply("pythonNumRowsReceived").value())
    assert handed and sum(handed) <= 2 * 101 * 2 * spark.sparkContext.defaultParallelism


def test_true_places_are_all_whatever_lies_beyond():
    import numpy as np

    from corpusloom.operators.vectors import true_places

    r = np.random.default_rng(1)
    for n in (1, 7, 64, 65, 1000, 4095, 4096):
        for share in (0, 0.001, 0.3, 1):
            flags = r.random(4096) < share
            want = np.flatnonzero(flags[:n])
            flags[n:] = True
            assert sorted(true_places(flags, n)) == list(want)


@pytest.mark.parametrize("name", ["dimension_sweep", "metrics_compare", "retrieval_metrics"])
def test_retrieval_makes_no_row_for_each_pair(spark, tmp_path, name):
    """Copies of vectors, and labels that one row or none has; no join pairs queries with rows."""
    import duckdb
    from compare import same

    from corpusloom.plans.registry import ORACLES, QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    n = rows.count()
    lonely = rows.limit(1).selectExpr("100020L AS vec_id", "embedding", "77 AS label").union(rows.limit(1).selectExpr("100040L AS vec_id", "embedding", "CAST(NULL AS INT) AS label"))
    rows.union(rows.withColumn("vec_id", F.col("vec_id") + 3 * n)).union(lonely).coalesce(1).write.parquet(str(tmp_path / "e"))
    next((tmp_path / "e").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString() or name == "metrics_compare"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    same(df, con, ORACLES[name])
