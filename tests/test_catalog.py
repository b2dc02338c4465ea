"""The read capabilities and the model's rules on a small state worked out by hand."""

import pytest

from corpusloom.plans.catalog import Catalog
from corpusloom.sources.schema import SCHEMAS, empty, violations

FACT = ("SOURCE_FACT", "DETERMINISTIC", "a", None, [])
WEAK = ("SOURCE_FACT", "MODEL", "a", None, [("x", "MODEL_INFERENCE")])


@pytest.fixture(scope="module")
def tables(spark):
    rows = {
        "sources": [("s1", "md", "a.md", "h", "OWN", "A", None), ("s2", "md", "b.md", "h", "OWN", "B", None)],
        "documents": [("d1", "s1", 1, "h", "p"), ("d2", "s2", 1, "h", "p"), ("d3", "s2", 2, "i", "p")],
        "spans": [("p1", "d1", 0, 1, 3, 3, ["A", "B"], "graph search is fast", "x"), ("p2", "d2", 0, 1, 2, None, [], "graph of words", "x"), ("p3", "d2", 1, 5, 4, None, [], "other", "x")],
        "concepts": [(c, n, "topic", None, None, [], FACT) for c, n in (("c1", "Graph"), ("c2", "Queue"), ("c3", "heap"), ("c4", "Zed"))],
        "claims": [("k1", "s", "c1", "ACTIVE", None, None, None, FACT), ("k2", "t", "c1", "DISPUTED", None, None, None, FACT), ("k3", "u", "c2", "SUPERSEDED", None, None, None, WEAK)],
        "evidence": [("e1", "k1", "p1", "QUOTES"), ("e2", "k1", "p2", "QUOTES")],
        "links": [("l1", "c1", "c2", "RELATED_TO", 1.0, True, FACT), ("l2", "c2", "c3", "RELATED_TO", 1.0, True, FACT), ("l3", "c3", "c4", "RELATED_TO", 1.0, False, FACT), ("l4", "c4", "c4", "X", 1.0, True, FACT)],
        "questions": [("q1", "graph words", "OPEN", [], None), ("q2", "x", "ANSWERED", [], None)],
        "answers": [("q1", "k1")],
        "syntheses": [("y1", "concept", "c1", "b", None), ("y2", "concept", "c2", "b", None)],
        "synthesis_claims": [("y1", "k1", "s", "ACTIVE", None), ("y2", "k2", "old", "DISPUTED", None), ("y2", "k9", "z", "ACTIVE", None)],
    }
    return empty(spark) | {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()}


def ids(df, name="id"):
    return [r[name] for r in df.collect()]


def test_capabilities(tables):
    c = Catalog(tables)
    assert {r.name: r.rows for r in c.get_stats().collect()}["claims"] == 3
    assert ids(c.list_concepts()) == ["c1", "c3", "c2", "c4"] and ids(c.list_concepts(limit=1, offset=1)) == ["c3"]
    assert c.list_concepts(contains="E", limit=1).first().total == 3
    row = c.get_concept("c2").first()
    assert (row.claims, row.links) == (1, 2)
    assert ids(c.list_concept_neighbors("c2"), "neighbour") == ["c1", "c3"]
    assert ids(c.list_claims(concept_id="c1", status="ACTIVE")) == ["k1"] and ids(c.get_claim("k2")) == ["k2"]
    assert sorted((r.id, r.citation) for r in c.get_claim_evidence("k1").collect()) == [("p1", "p.3 | A > B"), ("p2", "b.md")]
    assert c.get_span("p2").first().locator == "b.md" and c.get_source("s2").first().latest == 2
    assert ids(c.list_sources(contains="B")) == ["s2"]
    assert ids(c.search_spans("graph search")) == ["p1"]
    assert c.find_path("c1", "c3").first().path == ["c1", "c2", "c3"] and c.find_path("c1", "c4").count() == 0
    b = c.get_belief("c1").first()
    assert (b.held, b.disputed, b.sources, b.settled) == (1, 1, 2, False)
    assert ids(c.list_questions(open_only=True)) == ["q1"] and c.get_question("q1").first().answers == 1
    assert ids(c.get_question_evidence("q1")) == [] and c.get_question_evidence("none").count() == 0
    assert [(r.kind, r.subject_id) for r in c.list_gaps().collect()] == [("disputed", "k2"), ("unevidenced", "k2"), ("unevidenced", "k3"), ("no_claims", "c3"), ("no_claims", "c4")]
    assert c.get_changes("2024-01-01", "2024-01-02").count() == c.list_recent_revisions().count() == c.list_entity_revisions("c1").count() == 0
    assert {r.id: r.stale_reason for r in c.list_syntheses().collect()} == {"y1": None, "y2": "statement"} and c.get_synthesis("y1").count() == 1


def test_rules(tables):
    found = sorted((r.rule, r.id) for r in violations(tables).collect())
    assert found == [
        ("claim_without_evidence", "k2"), ("claim_without_evidence", "k3"), ("claims_model_without_id", "k3"), ("claims_stronger_than_inputs", "k3"),
        ("self_link", "l4"), ("span_ends_before_start", "p3"), ("superseded_without_successor", "k3"),
    ]


def test_whole_model_reads(spark, tables):
    t = tables | {
        "proposals": spark.createDataFrame([("x1", "CLAIM_CONFLICT", "pending", "k1", None), ("x2", "CLAIM_CONFLICT", "pending", "c2", None), ("y3", "NEW_CLAIM", "approved", None, None)], SCHEMAS["proposals"]),
    }
    c = Catalog(t)
    assert ids(c.list_proposals(status="pending")) == ["x1", "x2"] and ids(c.list_proposals(prefix="y")) == ["y3"]
    assert [(r.neighbour, r.type, r.name) for r in c.list_typed_neighbors("c2").collect()] == [("c1", "RELATED_TO", "Graph"), ("c3", "RELATED_TO", "heap")]
    assert [r.neighbour for r in c.list_typed_neighbors("c2", direction="out").collect()] == ["c3"] and c.list_typed_neighbors("c2", types=("X",)).count() == 0
    found = {(r.code, r.entity_id) for r in c.get_integrity().collect()}
    assert found == {("GR004", "l4"), ("GR009", "l4"), ("GR007", "k2"), ("GR007", "k3"), ("GR008", "c3"), ("GR008", "c4")}
    kinds = [(r.kind, r.subject_id) for r in c.list_knowledge_gaps("2024-03-01 00:00:00").collect()]
    assert ("unresolved_dispute", "k2") in kinds and ("concept_without_claims", "c3") in kinds and not any(k == "claim_with_single_source" for k, _ in kinds)
    assert [(r.proposal_id, r.claim_id) for r in c.get_dissent("c1").collect()] == [("x1", "k1")] and [r.claim_id for r in c.get_dissent("c2").collect()] == [None]
    assert ids(c.list_sources(contains="b")) == ["s2"] and c.list_sources(contains="A").first().id == "s1"
