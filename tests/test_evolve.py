"""A run from evidence to proposals with a scripted assessor, identity, reports."""

import pandas as pd

from corpusloom.operators import evolve as E
from corpusloom.plans import reports


def scripted_assessor():
    """Made inside a function, so that it travels to the workers by value."""

    def scripted(pairs: pd.DataFrame) -> pd.DataFrame:
        kind = {"k1": "SUPPORTS", "k2": "REFINES", "k3": "CONFLICT", "k4": "SUPPORTS"}
        quote = {"k4": "words that are nowhere to be found"}
        return pd.DataFrame({
            "claim_id": pairs.claim_id, "span_id": pairs.span_id, "quote": pairs.claim_id.map(lambda c: quote.get(c, "search is fast")),
            "classification": pairs.claim_id.map(kind), "refined": pairs.claim_id.map(lambda c: None if c == "k2" else "r"),
        })

    return scripted


def test_run(spark):
    concepts = spark.createDataFrame([("Graph search", []), ("Queue", ["FIFO list"]), ("Elsewhere", [])], "concept string, aliases array<string>")
    claims = spark.createDataFrame([("k1", "Graph search", "s", "ACTIVE"), ("k2", "Graph search", "t", "ACTIVE"), ("k3", "Queue", "u", "DISPUTED"), ("k4", "Queue", "v", "ACTIVE"), ("k5", "Queue", "w", "SUPERSEDED"), ("k6", "Elsewhere", "x", "ACTIVE")], "claim_id string, concept_id string, statement string, status string")
    edges = spark.createDataFrame([("Graph search", "Queue")], "a string, b string")
    spans = spark.createDataFrame([("p1", "Graph  search is fast", "h")], "span_id string, text string, heading string")
    cached = spark.createDataFrame([], "key string, claim_id string, span_id string, quote string, classification string, refined string")
    got = {k: v.collect() for k, v in E.evolve(concepts, claims, edges, spans, scripted_assessor(), cached).items()}
    assert [(r.concept, r.selector) for r in got["candidates"]] == [("Graph search", "exact_name"), ("Queue", "graph_neighbour")]
    assert sorted(r.claim_id for r in got["examined"]) == ["k1", "k2", "k3", "k4"]
    assert {r.claim_id: r.rejected for r in got["assessments"]} == {"k1": None, "k2": "no_refined_statement", "k3": None, "k4": None}
    assert got["impact"][0].impact == "CONFLICT"
    assert sorted((r.type, r.claim_id, r.evidence) for r in got["proposals"]) == [("ADD_EVIDENCE", "k1", ["p1"]), ("MARK_CONFLICT", "k3", ["p1"])]
    # a second run finds everything in the cache and asks nobody
    again = spark.createDataFrame([tuple(r[c] for c in ("key", "claim_id", "span_id", "quote", "classification", "refined")) for r in got["assessments"]], cached.schema)

    def nobody(pairs):
        raise AssertionError("asked again")

    assert E.evolve(concepts, claims, edges, spans, nobody, again)["assessments"].count() == 4


def test_states_are_bounded():
    assert E.advance("registered", 0, 0) == "narrowed" and E.advance("awaiting_review", 2, 3) == "awaiting_review"
    assert E.advance("awaiting_review", 2, 25) == "failed" and E.advance("finished", 0, 0) == "finished"


def test_identity(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = E.resolve_identity(frame([("a",), ("b",), ("c",), ("d",)], "norm string"), frame([("a", "A")], "norm string, concept string"), frame([("a", "X"), ("b", "B")], "norm string, concept string"), frame([("a",), ("b",), ("c",)], "norm string"))
    assert {r.norm: (r.concept, r.status) for r in got.collect()} == {"a": ("A", "alias"), "b": ("B", "decided"), "c": (None, "ambiguous"), "d": (None, "unknown")}


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 1), ("<i>", None)], "name string, n int")
    assert "| a\\|b | 1 |" in reports.markdown("T", {"S": df}) and "&lt;i&gt;" in reports.page("T", {"S": df})
    assert reports.next_steps({"open_questions": 2, "unresolved_links": 1}) == ["repair unresolved links (1)", "answer open questions (2)"]
    assert reports.next_steps({}) == ["nothing to do"]
