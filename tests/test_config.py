"""Identities, labelled sets and settings."""

import pytest

from corpusloom.operators.evolve import resolve_identity
from corpusloom.sources import config as G


def test_identities_survive_a_round_trip_and_decide_names(spark):
    text = "collisions:\n  Heap:\n    identities: [DSA/Heap.md, Notes/Heap.md]\n    default: DSA/Heap.md\n  Two Sum:\n    identities: [a.md, b.md]\naliases:\n  D-S-U: Union Find\n"
    found = G.load_identities(text)
    assert G.load_identities(G.dump_identities(found)) == found and found.aliases == {"dsu": "Union Find"}
    found.add_collision("heap", ["Notes/Heap.md", "X/Heap.md"])
    assert found.collisions["heap"]["default"] is None
    found.decide("HEAP", "X/Heap.md")
    with pytest.raises(ValueError):
        found.decide("heap", "nowhere.md")
    with pytest.raises(ValueError):
        G.load_identities("collisions: {x: {identities: [a.md], default: b.md}}")
    asked = spark.createDataFrame([("heap",), ("twosum",), ("dsu",), ("other",)], "norm string")
    t = found.tables(spark)
    got = {r.norm: (r.concept, r.status) for r in resolve_identity(asked, t["aliases"], t["decisions"], t["collisions"]).collect()}
    assert got == {"heap": ("X/Heap.md", "decided"), "twosum": (None, "ambiguous"), "dsu": ("Union Find", "alias"), "other": (None, "unknown")}
    found.clear("heap")
    assert found.tables(spark)["decisions"].count() == 0


def test_labelled_sets_are_strict(spark):
    good = "- {id: q1, category: a, query: words, relevant: [x.md]}\n- {id: q2, category: b, query: more, relevant: [y.md, z.md]}\n"
    assert [r.relevant for r in G.load_labelled(spark, good, "retrieval").orderBy("id").collect()] == [["x.md"], ["y.md", "z.md"]]
    assert G.load_labelled(spark, "cases:\n- {id: c, text: t, expected: [A]}", "extraction").first().forbidden is None
    for bad in (good + "- {id: q1, category: a, query: w, relevant: [x]}", "- {id: q, query: w, relevant: [x]}", "- {id: q, category: a, query: w, relevant: [x], odd: 1}", "nothing: here"):
        with pytest.raises(ValueError):
            G.load_labelled(spark, bad, "retrieval")


def test_the_environment_beats_the_file():
    text = "# comment\nCORPUSLOOM_TOP = 7\nCORPUSLOOM_SAFE='no'\nCORPUSLOOM_NAME=\"from file\"\n"
    got = G.settings({"top": 5, "safe": True, "name": "x", "rate": 0.5}, text, {"CORPUSLOOM_NAME": "from env"})
    assert got == {"top": 7, "safe": False, "name": "from env", "rate": 0.5}
