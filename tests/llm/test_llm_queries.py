"""Queries of the llm subpackage against their oracles or brute force on the smallest tables."""

import html as H
import re
from collections import Counter, defaultdict

import pytest
from compare import connect, same

from corpusloom.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    same(QUERIES[name](spark, FOLDER), con, ORACLES[name])


def test_op1_gives_the_blocks_of_the_article(spark, con):
    for page_id, url, text, n in QUERIES["op1_html_extraction"](spark, FOLDER).select("page_id", "url", "text", "n_chars").collect():
        page = con.sql(f"select html from pages where page_id = {page_id}").fetchall()[0][0]
        inside = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
        blocks = [" ".join(H.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert text == "\n".join(b for b in blocks if b) and n == len(text)


def test_op3_targets_and_takes(spark, con):
    rows = QUERIES["op3_source_mixing"](spark, FOLDER).toPandas()
    docs = con.sql("select doc_id, source, text from documents").df()
    docs["size2"] = docs.text.map(lambda t: len(WORD.findall(t)))
    m = rows.merge(docs, on="doc_id")
    assert len(m) == len(docs) and (m["size"] == m.size2).all() and (m.taken <= 3 * m["size"]).all() and (m.taken >= 0).all()
    size = m.groupby("source")["size"].sum()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size.index))}
    target, free, left = {}, set(size.index), float(size.sum())
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * size[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)
    for s, g in m.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s], rel=1e-9) and (g.source_size == size[s]).all()
        assert abs(g.taken.sum() - target[s]) <= 16
    again = QUERIES["op3_source_mixing"](spark, FOLDER).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, rows.values.tolist()))


def test_op6_round_trip(spark):
    rows = QUERIES["op6_sentencepiece"](spark, FOLDER)
    assert rows.where("not round_trip").count() == 0 and rows.count() == 200


def test_op8_is_balanced_contiguous_and_gapless(spark, con):
    rows = QUERIES["op8_sharding"](spark, FOLDER).toPandas().sort_values("doc_id")
    docs = con.sql("select doc_id, text from documents order by doc_id").df()
    import zlib

    assert (rows["size"].values == docs.text.map(lambda t: len(t.encode()) + 1).values).all()
    assert (rows.text_crc32.values == docs.text.map(lambda t: zlib.crc32(t.encode())).values).all()
    assert rows.shard.is_monotonic_increasing and rows.law.eq("bytes").all() and rows.grown_shard.isna().all()
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
        assert abs(g["size"].sum() - rows["size"].sum() / 16) <= 2 * rows["size"].max()


def brute_links(texts):
    """Components and link counts at a Jaccard of 0.8 on five-word shingles."""
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(t or "")
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    holders, shared = defaultdict(list), Counter()
    for k in sorted(sets):
        for s in sets[k]:
            holders[s].append(k)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                shared[a, b] += 1
    links, parent = Counter(), {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {k: (root(k), links[k]) for k in sets}


def test_op9_equals_brute_force(spark, con):
    want = brute_links(dict(con.sql("select doc_id, text from documents").fetchall()))
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op9_ngram_join"](spark, FOLDER).collect()}
    assert got == want


def test_op2_equals_the_fixed_patterns(spark, con):
    import hashlib

    patterns = (("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
                ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
    texts = dict(con.sql("select doc_id, text from documents").fetchall())
    for r in QUERIES["op2_secret_scan"](spark, FOLDER).collect():
        spans = [(m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(patterns) for m in re.finditer(p, texts[r.doc_id]) if len(m.group(g)) >= n]
        listed = ",".join(f"{k}:{a}:{z}" for a, _, k, z in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k, _ in spans) for x in ("assign", "access", "hex"))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


