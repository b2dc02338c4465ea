"""Ranked lexical search: BM25 over texts, and over a stored inverted index that answers batches of queries."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import fold, let, tokens

#: Fixed values of the ranking function.
K1, B = 1.2, 0.75
#: The weight of a phrase that more than half of the documents hold.
IDF_FLOOR = 1e-6


def query_phrases(text: str) -> list[list[str]]:
    """Each white-space separated term of a query as the tokens that must follow one another."""
    found = []
    for term in text.split():
        phrase = [t for t in re.split(r"[\W_]+", fold(term)) if t]
        if phrase and phrase not in found:
            found.append(phrase)
    return found


def phrase_hits(toks: Column, length: Column, phrase: list[str], prefix: bool = False) -> Column:
    """How often the tokens of `phrase` follow one another; with prefix, the last may go on."""
    last = len(phrase) - 1

    def at(i: Column, k: int) -> Column:
        token = F.element_at(toks, (i + F.lit(k)).cast("int"))
        return token.startswith(phrase[k]) if prefix and k == last else token == F.lit(phrase[k])

    if last == 0:
        return F.size(F.filter(toks, lambda t: t.startswith(phrase[0]) if prefix else t == F.lit(phrase[0])))
    starts = F.when(length > last, F.sequence(F.lit(1), length - F.lit(last))).otherwise(F.array().cast("array<int>"))

    def whole(i: Column) -> Column:
        ok = at(i, 0)
        for k in range(1, last + 1):
            ok = ok & at(i, k)
        return ok

    return F.size(F.filter(starts, whole))


def bm25(docs: DataFrame, query: str, *, key: str = "doc_id", text: str = "text", mode: str = "or", prefix: bool = False) -> DataFrame:
    """Score every document that matches the query: `key`, `score`, higher is better.

    mode "or" needs one phrase, "and" needs all; prefix lets the last token of the last phrase go
    on. One scan yields lengths and phrase counts per document, one row of totals is joined back.
    Empty queries and empty tables give no rows; a null text is empty and matches nothing.
    """
    phrases = query_phrases(query)
    if not phrases:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    names = [f"_tf{i}" for i in range(len(phrases))]
    ends_word = bool(re.search(r"\w$", query))

    def counts(toks: Column) -> Column:
        hits = [phrase_hits(toks, F.size(toks), p, prefix and ends_word and i == len(phrases) - 1).alias(n) for i, (p, n) in enumerate(zip(phrases, names))]
        return F.struct(F.size(toks).alias("_len"), *hits)

    counted = docs.select(key, let(tokens(F.col(text)), counts).alias("_m"))
    totals = counted.agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_m._len").alias("_avg"),
        *[F.sum((F.col(f"_m.{n}") > 0).cast("long")).alias(f"_df{i}") for i, n in enumerate(names)],
    )

    def keep(m: Column) -> Column:
        hit = m[names[0]] > 0
        for n in names[1:]:
            hit = (hit & (m[n] > 0)) if mode == "and" else (hit | (m[n] > 0))
        return hit

    # the generator keeps the filter from being moved below, where it would count anew
    matched = counted.select(key, F.explode(F.filter(F.array("_m"), keep)).alias("_m")).select(key, "_m.*")
    scored = matched.join(F.broadcast(totals))
    score = F.lit(0.0)
    for i, n in enumerate(names):
        idf = F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
        tf = F.col(n).cast("double")
        norm = tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_len") / F.col("_avg"))
        score = score + F.when(F.col(n) > 0, idf * tf * F.lit(K1 + 1) / norm).otherwise(F.lit(0.0))
    return scored.select(key, score.alias("score"))


#: Buckets of terms, and slices of the postings of a bucket, in which an index is stored.
BUCKETS, SLICES = 32, 4


def write_index(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, slices: int = SLICES) -> None:
    """Store an inverted index: path/postings (term, key, tf, len, positions; by bucket of the term, sorted by term) and path/totals.

    A term that most documents hold is dealt to all slices of its bucket. The length of a document stands
    in its postings, so that ranking joins nothing.
    """
    slim = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    slim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("t")), F.lit(0.0)).alias("avg_len")).write.parquet(f"{path}/totals")
    at = slim.select("key", F.size("t").alias("len"), F.posexplode("t").alias("pos", "term"))
    rows = at.groupBy("term", "key", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))
    dealt = rows.repartition("bucket", "slice").sortWithinPartitions("bucket", "term", "key").drop("slice")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    dealt.where(F.lit(False)).write.parquet(f"{path}/schema")  # that of an index without postings, too


@dataclass(frozen=True)
class Index:
    """A stored inverted index."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _postings(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/postings")

    def _asked(self, queries: list[str], prefix: bool) -> tuple[DataFrame, int, bool]:
        """One row per query, phrase and place in it: qid, phrases, phrase, slots, slot, term; the longest phrase; whether any term goes on."""
        rows, go_on = [], []
        for qid, query in enumerate(queries):
            phrases = query_phrases(query)
            for i, p in enumerate(phrases):
                last = prefix and i == len(phrases) - 1 and re.search(r"\w$", query)
                rows += [(qid, len(phrases), i, len(p), j, t) for j, t in enumerate(p) if not (last and j == len(p) - 1)]
                if last:
                    go_on.append((qid, len(phrases), i, len(p), len(p) - 1, p[-1]))
        schema = "qid int, phrases int, phrase int, slots int, slot int, term string"
        asked = self.spark.createDataFrame(rows, schema)
        if go_on:
            terms = self._postings().select(F.col("term").alias("whole")).where(reduce(Column.__or__, [F.col("term").startswith(r[-1]) for r in go_on])).distinct()
            begun = self.spark.createDataFrame(go_on, schema)
            asked = asked.unionByName(terms.join(F.broadcast(begun), F.col("whole").startswith(F.col("term"))).drop("term").withColumnRenamed("whole", "term"))
        return asked, max([r[3] for r in rows + go_on], default=0), bool(go_on)

    def search(self, queries: list[str], *, mode: str = "or", prefix: bool = False) -> DataFrame:
        """All matches of a batch of queries: qid (place in the batch), key, score.

        Only the buckets of the terms asked for are read, once for the whole batch, and of them only the row groups that can hold a term.
        """
        asked, longest, goes_on = self._asked(queries, prefix)
        postings = self._postings()
        if not goes_on:
            bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")
            known = asked.select("term", bucket).distinct().collect()  # the words of the batch
            postings = postings.where(F.col("bucket").isin(sorted({r.b for r in known})) & F.col("term").isin(sorted({r.term for r in known})))
        hits = postings.join(asked if goes_on else F.broadcast(asked), "term")
        by = ("qid", "phrases", "phrase", "slots")
        # a document has as many rows here as a phrase has words (or words that go on)
        held = hits.groupBy(*by, "key").agg(F.first("len").alias("len"), F.collect_list(F.struct("slot", "tf", "positions")).alias("rows"))

        def starts(j: int) -> Column:
            return F.flatten(F.transform(F.filter("rows", lambda r: r["slot"] == j), lambda r: F.transform(r["positions"], lambda x: x - j)))

        together = starts(0)
        for j in range(1, longest):
            together = F.when(F.col("slots") > j, F.array_intersect(together, starts(j))).otherwise(together)
        single = F.aggregate("rows", F.lit(0), lambda a, r: a + r["tf"])
        held = held.select(*by, "key", "len", F.when(F.col("slots") == 1, single).otherwise(F.size(together)).alias("tf")).where("tf > 0")
        df = held.groupBy("qid", "phrase").agg(F.count(F.lit(1)).alias("df"))
        n, average = self.spark.read.parquet(f"{self.path}/totals").first()
        idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf").cast("double")
        weight = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf) * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.lit(average or 1.0)))
        # one row per phrase of the batch
        found = held.join(F.broadcast(df), ["qid", "phrase"]).groupBy("qid", "phrases", "key").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("found"))
        return (found.where("found = phrases") if mode == "and" else found).select("qid", "key", "score")

    def one(self, query: str, *, mode: str = "or", prefix: bool = False, key: str = "doc_id") -> DataFrame:
        """All matches of one query: key, score."""
        return self.search([query], mode=mode, prefix=prefix).select(F.col("key").alias(key), "score")

    def best(self, queries: list[str], k: int, *, mode: str = "or", prefix: bool = False) -> DataFrame:
        """The k best of each query of a batch: qid, rank, key, score; ties to the smaller key."""
        order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "key")
        return self.search(queries, mode=mode, prefix=prefix).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "key", "score")


def span_filter(*, source: str | None = None, exclude: tuple[str, ...] = (), kinds: tuple[str, ...] = (), trust: tuple[str, ...] = (), page: int | None = None, heading: str | None = None) -> Column:
    """The condition that all given filters make over locator, kind, trust_tier, page and heading_path.

    source: part of the locator, in any case; exclude: prefixes of the locator without a leading ./;
    heading: part of the headings joined by " > ", in any case.
    """
    bare = F.regexp_replace("locator", r"^[./]+", "")
    tests = [F.lit(True)]
    if source:
        tests.append(F.contains(F.lower("locator"), F.lit(source.lower())))
    tests += [~bare.startswith(x.lstrip("./")) for x in exclude]
    tests += [F.col(c).isin(*some) for c, some in (("kind", kinds), ("trust_tier", trust)) if some]
    if page is not None:
        tests.append(F.col("page") == page)
    if heading:
        tests.append(F.contains(F.lower(F.array_join("heading_path", " > ")), F.lit(heading.lower())))
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def best_span(scored: DataFrame, spans: DataFrame, *, span: str = "span_id", document: str = "document_id") -> DataFrame:
    """The best span of each document: document, span, score; ties to the smaller span."""
    rows = scored.join(spans.select(span, document), span)
    best = F.max_by(F.struct(F.col(span).alias("s"), F.col("score").alias("v")), F.struct(F.col("score"), -F.col(span)))
    return rows.groupBy(document).agg(best.alias("b")).select(document, F.col("b.s").alias(span), F.col("b.v").alias("score"))


def top_k(scored: DataFrame, k: int, *, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The k highest scores, ties to the smaller key; planned as TakeOrderedAndProject."""
    return scored.orderBy(F.col(score).desc(), F.col(key).asc()).limit(k)


def filtered_search(scored: DataFrame, docs: DataFrame, condition: Column, k: int, *, candidates: int | None = None, key: str = "doc_id") -> DataFrame:
    """The k best of the candidates that fulfil the condition.

    Filters are applied after the cut to max(5 k, 50) candidates, as the searched engine defines it,
    so fewer than k rows may come back; candidates=0 filters before the cut.
    """
    n = max(5 * k, 50) if candidates is None else candidates
    pool = top_k(scored, n, key=key) if n else scored
    return top_k(pool.join(docs.where(condition).select(key), key, "left_semi"), k, key=key)


def title_boost(scored: DataFrame, docs: DataFrame, query: str, boost: float, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores times `boost` where a query term of over two characters occurs in the first line."""
    terms = [t for t in dict.fromkeys(re.split(r"[\W_]+", query.lower())) if len(t) > 2]
    title = F.lower(F.substring_index(F.coalesce(F.col(text), F.lit("")), "\n", 1))
    hit = F.lit(False)
    for t in terms:
        hit = hit | title.contains(t)
    marked = docs.select(key, hit.alias("_hit"))
    return scored.join(marked, key).select(key, F.when(F.col("_hit"), F.col("score") * boost).otherwise(F.col("score")).alias("score"))
