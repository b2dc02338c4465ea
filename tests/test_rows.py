"""Queries without SQL against plain versions of them, over the smallest tables."""

import math
import re
from difflib import SequenceMatcher

import pytest

from corpusloom.operators import matching as X
from corpusloom.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def turns(spark):
    return {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()}


def test_claim_clusters(spark, turns):
    def alike(a, b):
        x, y = ({w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 2} for t in (a, b))
        return ((len(x & y) / len(x | y) if x | y else 0.0) + SequenceMatcher(None, a.lower(), b.lower()).ratio()) / 2 >= 0.35

    want = {}
    for conv in {c for c, _ in turns}:
        places = sorted(t for c, t in turns if c == conv)
        for i, seed in enumerate(places):
            if (conv, seed) not in want:
                want[conv, seed] = seed
                for other in places[i + 1 :]:
                    if (conv, other) not in want and alike(turns[conv, seed], turns[conv, other]):
                        want[conv, other] = seed
    assert {(r.conv_id, r.turn): r.seed for r in QUERIES["rows_claim_clusters"](spark, FOLDER).collect()} == want


def test_hash_embedding(spark, turns):
    vectors = dict(zip(turns, X.embedded(__import__("pandas").Series(list(turns.values())))))
    for r in QUERIES["rows_hash_embedding"](spark, FOLDER).collect():
        a, b = vectors[r.conv_id, r.turn], vectors[r.conv_id, r.turn - 1]
        assert abs(r.cos - float(a @ b)) < 1e-6 or math.isclose(r.cos, 0, abs_tol=1e-9)


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_grounding(spark, turns):
    rows = QUERIES["rows_grounding"](spark, FOLDER).collect()
    assert len(rows) == sum((c, t - 1) in turns for c, t in turns)
    for r in rows:
        quote, text = turns[r.conv_id, r.turn], turns[r.conv_id, r.turn - 1]
        squashed = lambda t: re.sub("[^a-z0-9]+", "", t.lower())
        at, parts = 0, [p for p in map(squashed, re.split(r"\.\.\.|…", quote)) if p]
        for p in parts:
            at = squashed(text).find(p, at) + len(p) if at >= 0 and squashed(text).find(p, at) >= 0 else -1
        assert r.in_order == (bool(parts) and at >= 0)
        if not r.in_order:
            q, t = (re.findall("[a-z0-9]+", x.lower()) for x in (quote, text))
            width = max(3 * len(q), 16)
            starts = [0] if len(t) <= width else [s for s in range(0, len(t), max(1, width // 4)) if s == 0 or len(t) - s >= len(q)]
            want = max((longest_common(q, t[s : s + width]) for s in starts), default=0) / len(q) if q else 0.0
            assert abs(r.overlap - want) < 1e-3 and r.grounded == (r.overlap >= 0.9)


def test_structural_chunks_cover_every_block_in_order(spark):
    rows = QUERIES["rows_structural_chunks"](spark, FOLDER).collect()
    held = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk)):
        assert r.first == held.get(r.doc_id, (-1, -1))[1] + 1 or r.chunk == 0
        assert r.last >= r.first and (r.first == r.last or r.chars <= 2400)
        held[r.doc_id] = (r.chunk, r.last)
    assert len(held) > 0
