"""The stored index against the scan of the texts."""

import pytest

from corpusloom.operators.search import Index, bm25, write_index

TEXTS = [
    (1, "Café au lait, the café of the cafe"), (2, "a b c a b"), (3, None), (4, ""), (5, "b c a b c the"), (6, "naïve Über-Größe ñandú"), (7, "the the the"), (8, "abc abd abe a b"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    write_index(spark.createDataFrame(TEXTS, "doc_id bigint, text string"), path, buckets=4, slices=2)
    return Index(spark, path, buckets=4)


@pytest.mark.parametrize("mode", ["or", "and"])
@pytest.mark.parametrize("query", ["the", "a b", "a-b c", "b-c-a", "cafe", "CAFÉ lait", "uber-grosse", "nandu", "none", "", "a-b-a", "the the-the"])
@pytest.mark.parametrize("prefix", [False, True])
def test_index_equals_scan(spark, index, query, mode, prefix):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    want = {r.doc_id: round(r.score, 9) for r in bm25(docs, query, mode=mode, prefix=prefix).collect()}
    assert {r.doc_id: round(r.score, 9) for r in index.one(query, mode=mode, prefix=prefix).collect()} == want


def test_batch_is_each_query_by_itself(index):
    queries = ["the", "a b", "none", "cafe"]
    got = [(r.qid, r.key) for r in index.best(queries, 2).orderBy("qid", "rank").collect()]
    want = [(i, r.key) for i, q in enumerate(queries) for r in index.best([q], 2).orderBy("rank").collect()]
    assert got == want and (3, 1) in got


def test_index_of_no_documents(spark, tmp_path):
    write_index(spark.createDataFrame([], "doc_id bigint, text string"), str(tmp_path / "i"))
    assert Index(spark, str(tmp_path / "i")).one("a b").count() == 0
