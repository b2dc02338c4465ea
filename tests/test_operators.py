"""Single operators on small cases worked out by hand or by brute force."""

import itertools

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import markdown as M
from corpusloom.operators import matching as X
from corpusloom.operators.search import bm25, query_phrases, top_k
from corpusloom.streaming.revisions import changes_per_window, first_seen


def test_query_phrases_are_split_at_punctuation():
    assert query_phrases("off-by-one the THE ...") == [["off", "by", "one"], ["the"]]


def test_bm25_hand_computed(spark):
    import math

    docs = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "c c"), (4, None), (5, "d e f")], "doc_id int, text string")
    got = {r.doc_id: r.score for r in bm25(docs, "a").collect()}
    idf, avg = math.log((5 - 1 + 0.5) / 1.5), 8 / 5
    assert got.keys() == {1} and abs(got[1] - idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg))) < 1e-12
    assert bm25(docs, "...").count() == 0 and bm25(docs.where("false"), "a").count() == 0
    assert [r.doc_id for r in top_k(bm25(docs, "c d"), 1).collect()] == [3]


def _brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=20))
def test_common_run_is_the_longest_common_subsequence(a, b):
    assert X.common_run(a, b) == _brute_lcs(a, b)


def test_reversed_quote_is_not_grounded(spark):
    rows = [("the cat sat on a mat", "so the Cat sat, on a mat."), ("the cat ... a mat", "the cat sat on a mat"), ("mat a on sat cat the", "the cat sat on a mat"), ("", "x")]
    got = X.grounded(spark.createDataFrame(rows, "q string, t string"), quote="q", text="t").collect()
    assert [r.grounded for r in got] == [True, True, False, False]


def test_claim_clusters_follow_the_seed(spark):
    rows = [(1, 0, "retrieval improves accuracy a lot"), (1, 1, "retrieval improves accuracy"), (1, 2, "zzz qqq"), (2, 0, "retrieval improves accuracy")]
    got = {(r.g, r.o): r.seed for r in X.claim_clusters(spark.createDataFrame(rows, "g int, o int, t string"), group="g", order="o", text="t").collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (2, 0): 0}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=14), max_size=9))
def test_claim_clusters_equal_the_mean_of_both_measures(texts):
    from difflib import SequenceMatcher

    def alike(a, b):
        x, y = ({w for w in t.split() if len(w) > 2} for t in (a, b))
        return ((len(x & y) / len(x | y) if x | y else 0.0) + SequenceMatcher(None, a, b).ratio()) / 2

    words = [X.Wording(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert words[j].joins(words[i], 0.35) == (alike(texts[i], texts[j]) >= 0.35)


def test_hashed_embedding_by_its_definition(spark):
    import hashlib
    import math
    from collections import Counter

    texts = ["Retrieval of retrieval, the Augmented generation a b", "", None, "the and of", "word word WORD four", "x9 y8"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.hash_embedding("t")).collect()]
    for text, vector in zip(texts, got):
        kept = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if len(w) > 1 and w not in ("the", "and", "of")]
        line, want = " ".join(kept), [0.0] * 256
        for f, n in Counter(kept + [line[i : i + 4] for i in range(len(line) - 3)]).items():
            at = int(hashlib.blake2b(f.encode(), digest_size=8).hexdigest(), 16) % 256
            odd = hashlib.blake2b(f.encode(), digest_size=1, person=b"sign").digest()[0] % 2
            want[at] += (1 if odd else -1) * (1 + math.log(n))
        size = math.sqrt(sum(v * v for v in want))
        assert vector == [v / size if size else 0.0 for v in want] or max(abs(a - b / (size or 1)) for a, b in zip(vector, want)) < 1e-12


def test_structural_chunks():
    b = pd.DataFrame({"text": ["Head", "Sub", "x" * 100, "y" * 2400, "z" * 50, "End"], "is_heading": [True, True, False, False, False, True], "heading_path": [["h"]] * 6, "page": [1] * 6})
    # the two headings are too short to stand alone, so they go with what follows; a group over the limit is cut between blocks
    assert M.grouped_blocks(b)[0] == [0, 1, 2]
    assert sorted(i for g in M.grouped_blocks(b) for i in g) == list(range(6))


def test_masking_keeps_lines():
    text = "a `b` c\n~~~\n```\nx\n~~~\nend"
    assert M.masked(text).split("\n") == ["a     c", "", "", "", "", "end"]


def test_paths_are_bounded_and_capped(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 10)], "a bigint, b bigint")
    assert G.shortest_path(edges, 1, 7).collect()[0].length == 6
    assert G.shortest_path(edges, 1, 8).count() == 0
    assert G.shortest_path(edges, 3, 3).collect()[0].length == 0
    assert {r.node: r.depth for r in G.within_depth(edges, 5, 9).collect()} == {4: 1, 6: 1, 3: 2, 7: 2, 2: 3, 8: 3}
    star = spark.createDataFrame([(0, i) for i in range(1, 80)], "a bigint, b bigint")
    assert G.capped_neighbours(star).where("node = 0").count() == 50


def test_stream_of_revisions(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.union(events).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = first_seen(stream, late="60 days").writeStream.outputMode("append").format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None
    day = changes_per_window(stream).writeStream.outputMode("append").format("memory").queryName("days").trigger(availableNow=True).start()
    day.awaitTermination(60)
    assert day.exception() is None and spark.table("days").columns == ["since", "until", "op", "revisions"]
    batch = changes_per_window(events).agg(F.sum("revisions")).first()[0]
    assert batch == events.count() == spark.table("changes").count()


def test_hash_embedding_is_a_unit_vector_of_words():
    a, b, c, none, blank, same = X.embedded(pd.Series(["retrieval quality", "Retrieval, quality!", "zebra", None, " ! ", "ab ab ab"]))
    assert (a == b).all() and abs((a**2).sum() - 1) < 1e-12 and (a != c).any()
    assert (none == 0).all() and (blank == 0).all() and len(none) == X.DIMENSIONS
    assert abs(same).max() <= 1
