"""Line dedup by content-defined chunks, in Spark expressions only.

Every line has a hash; a rolling hash over two line hashes is taken at each line, and a chunk starts
where that rolling hash is smaller than those of the lines before and after. The place of a boundary
depends on four lines around it alone (two before it, it and the one after), so lines inserted above do not shift the chunks below. A
chunk of two lines or more (with a word in it) that occurs more than once in the corpus stays where
it comes first, in the smallest key and there in the earliest place, and goes everywhere else, but
only if its bytes equal those of the first occurrence.

Chunk hashes are counted with map-side combining; text moves only for chunks whose hash repeats.

These chunks are the law that the SQL of op10 states. A shared passage whose ends lie inside chunks
is lost to them, so dedup_passages compares, besides the chunks, the shortest run of lines of more
than PASSAGE_WORDS words from each line on and up to each line. Two equal passages of more words have
the same such runs, and these cover them from the first to the last line that has a word; each run
is itself a passage of that length, so nothing else goes. The first SIG_BYTES of a SHA-256 over the lines' SHA-256 stand
for the bytes of a run. What repeats is found first by counts of a short hash, so most runs are never moved whole. Runs are compared by key, then hash of the text, then place; null keys come last.
Where a run overlaps its own first occurrence, the lines of that stay.

Defined results: a null text has no lines and stays null; texts without a repeated chunk stay as they
are; rows of one key count as one document, all null keys as one; a document whose lines all went
has the empty text; texts of any length are compared whole; an empty table gives no rows; extra columns pass
through, whatever their names, but for n_lines and n_removed_lines, which are made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import OWN, SPACE_CHARS, lookup, packed, staged, table, words

MIN_LINES = 2
#: Bytes of a run's SHA-256 that stand for it.
SIG_BYTES = 16
#: Columns that are made anew.
COUNTS = ("n_lines", "n_removed_lines")
#: A passage of more words than this goes wherever the boundaries of chunks fall.
PASSAGE_WORDS = 50


def chunk_starts(lines: Column) -> Column:
    """Positions (from 0) at which the chunks of an array of lines start."""

    def hashed(h: Column) -> Column:
        rolled = F.transform(h, lambda x, i: F.md5(F.concat(F.coalesce(F.get(h, i - 1), F.lit("")), x)))
        return F.element_at(F.transform(F.array(rolled), minima), 1)

    def minima(r: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(r) - F.lit(1))
        return F.filter(
            places,
            lambda i: (i == 0)
            | ((i < F.size(r) - F.lit(1)) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) < F.get(r, i + 1))),
        )

    return F.element_at(F.transform(F.array(F.transform(lines, lambda s: F.md5(s))), hashed), 1)


def with_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows as one column, with _k, _text, _th (hash of the text), _lines, _starts; null texts have null arrays."""
    rows = docs.select(packed(docs), F.col(key).alias("_k"), F.col(text).alias("_text"))
    rows = rows.withColumn("_th", F.xxhash64("_text")).withColumn("_lines", F.split("_text", "\n"))
    return rows.withColumn("_starts", chunk_starts(F.col("_lines")))


def _without(joined: DataFrame, docs: DataFrame, text: str, gone: str, left: Column) -> DataFrame:
    """The rows as they came, with the lines that are left in place of a text of which some are gone, and the counts of lines."""
    joined = joined.withColumn("_left", left)
    untouched = F.col(gone).isNull()
    shown = [F.when(untouched, F.col("_text")).otherwise(F.array_join("_left", "\n")).alias(c) if c == text else F.col(OWN + "row").getField(c).alias(c) for c in docs.columns if c not in COUNTS]
    n = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_lines"))
    return joined.select(*shown, n.cast("bigint").alias(COUNTS[0]), F.when(untouched, F.lit(0)).otherwise(F.size("_lines") - F.size("_left")).cast("bigint").alias(COUNTS[1]))


def occurrences(rows: DataFrame) -> DataFrame:
    """One row per chunk that can be removed: _k, _th, idx, chunk (text), h."""

    def chunk(s: Column, j: Column) -> Column:
        n = F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_lines")) - s
        return F.struct(j.alias("idx"), n.alias("n"), F.array_join(F.slice(F.col("_lines"), s + 1, n), "\n").alias("chunk"))

    each = rows.select("_k", "_th", F.explode(F.transform("_starts", chunk)).alias("c"))
    each = each.where((F.col("c.n") >= MIN_LINES) & (F.translate(F.col("c.chunk"), SPACE_CHARS, "") != ""))
    return each.select("_k", "_th", "c.idx", "c.chunk", F.md5(F.col("c.chunk").cast("binary")).alias("h"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with repeated chunks taken out of `text`, and n_lines and n_removed_lines."""
    rows = with_chunks(docs, key, text)
    every = occurrences(rows.select("_k", "_th", "_lines", "_starts"))
    repeated = every.groupBy("h").agg(F.min("_k").alias("_keeper"), F.count(F.lit(1)).alias("_n"))
    repeated = staged(repeated.where("_n > 1").select(F.col("h").alias("_h"), "_keeper"), "repeated")
    hits = staged(lookup(every, repeated, F.col("h"), "_h", how="inner"), "hits")
    own = F.col("_k").eqNullSafe(F.col("_keeper"))
    first = hits.where(own).groupBy(F.col("h").alias("_h")).agg(F.min("idx").alias("_first_idx"), F.min_by("chunk", "idx").alias("_first_chunk"))
    # a passage that much of the corpus shares is a hot key here, which lookup deals to many tasks
    judged = lookup(hits, staged(first, "firsts"), F.col("h"), "_h", how="inner")
    gone = judged.where((F.col("chunk") == F.col("_first_chunk")) & ~(own & (F.col("idx") == F.col("_first_idx"))))
    gone = staged(gone.groupBy(F.struct(F.col("_k"), F.col("_th")).alias("_row")).agg(F.collect_set("idx").alias("_gone")), "gone")
    joined = lookup(rows, gone, F.struct(F.col("_k"), F.col("_th")), "_row")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_starts") - F.lit(1)), F.col("_gone"))

    def lines_of(j: Column) -> Column:
        s = F.get(F.col("_starts"), j)
        return F.slice(F.col("_lines"), s + 1, F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_lines")) - s)

    left = F.when(F.col("_gone").isNotNull(), F.flatten(F.transform(stay, lines_of)))
    return _without(joined, docs, text, "_gone", left)


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _reach(counts: Column) -> Column:
    """For each count: how many from it on add up to more than PASSAGE_WORDS, or 0 where all do not. Counts are 1 at least."""
    one = 1 << 32

    def of(_: Column, i: Column) -> Column:
        more = lambda a, c: F.when(a % one > PASSAGE_WORDS, a).otherwise(a + c + F.lit(one))
        total = F.aggregate(F.slice(counts, i + 1, PASSAGE_WORDS + 1), F.lit(0).cast("bigint"), more)
        return _bound(total, lambda t: F.when(t % one > PASSAGE_WORDS, F.floor(t / one).cast("int")).otherwise(0))

    return F.transform(counts, of)


def _run(start: Column, n: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), n.cast("int").alias("n"))


def passage_runs(lines: Column) -> Column:
    """Start and length of the shortest runs of more than PASSAGE_WORDS words from each line on and up to each line."""

    def runs(counts: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: F.get(counts, i) > 0)
        return _bound(places, lambda p: _bound(F.filter(counts, lambda c: c > 0), lambda c: both(p, c)))

    def both(p: Column, c: Column) -> Column:
        last = F.size(c) - 1
        on = F.transform(_reach(c), lambda k, i: F.when(k > 0, _run(F.get(p, i), F.get(p, i + k - 1) - F.get(p, i) + 1)))
        back = F.transform(_reach(F.reverse(c)), lambda k, i: F.when(k > 0, _run(F.get(p, last - i - k + 1), F.get(p, last - i) - F.get(p, last - i - k + 1) + 1)))
        return F.filter(F.array_union(on, back), lambda r: r.isNotNull())

    return _bound(F.transform(lines, lambda x: F.size(words(x))), runs)


def _signed_runs(rows: DataFrame) -> DataFrame:
    """One row per chunk or run of a passage: _k, _th, s (first line), n (lines), sig."""

    def chunk(s: Column, j: Column) -> Column:
        return _run(s, F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_lines")) - s)

    def worded(r: Column) -> Column:
        return (r["n"] >= MIN_LINES) & F.exists(F.slice(F.col("_lines"), r["s"] + 1, r["n"]), lambda x: F.translate(x, SPACE_CHARS, "") != "")

    def signed(hashes: Column) -> Column:
        sig = lambda r: F.unhex(F.substring(F.sha2(F.array_join(F.slice(hashes, r["s"] + 1, r["n"]), ""), 256), 1, 2 * SIG_BYTES))
        runs = F.array_union(F.filter(F.transform("_starts", chunk), worded), passage_runs(F.col("_lines")))
        return F.transform(runs, lambda r: F.struct(r["s"].alias("s"), r["n"].alias("n"), sig(r).alias("sig")))

    made = _bound(F.transform("_lines", lambda x: F.sha2(x, 256)), signed)
    return rows.select("_k", "_th", F.explode(made).alias("c")).select("_k", "_th", "c.s", "c.n", "c.sig")


def dedup_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without repeated chunks and repeated passages of over PASSAGE_WORDS words in `text`, and n_lines and n_removed_lines."""
    rows = with_chunks(docs, key, text)
    every = staged(_signed_runs(rows.select("_k", "_th", "_lines", "_starts")), "runs")
    place = F.struct(F.col("_k").isNull().alias("last"), F.col("_k").alias("k"), F.col("_th").alias("th"), F.col("s").alias("s"))
    counts = every.groupBy(F.xxhash64("sig").alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    again = staged(lookup(every, staged(counts, "repeated"), F.xxhash64("sig"), "_h", how="inner"), "again")
    firsts = again.groupBy("sig").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = staged(firsts.where("_n > 1").select(F.col("sig").alias("_sig"), "_first"), "firsts")
    hits = lookup(again, firsts, F.col("sig"), "_sig", how="inner").where(place != F.col("_first"))
    # a run that overlaps its own first occurrence leaves the lines of that
    own = F.col("_k").eqNullSafe(F.col("_first.k")) & (F.col("_th") == F.col("_first.th"))
    begin = F.when(own, F.greatest(F.col("s"), F.col("_first.s") + F.col("n"))).otherwise(F.col("s"))
    spans = hits.select("_k", "_th", F.struct(begin.alias("a"), (F.col("s") + F.col("n") - 1).alias("z")).alias("span"))
    gone = spans.groupBy(F.struct(F.col("_k"), F.col("_th")).alias("_row")).agg(F.collect_set("span").alias("_spans"))
    joined = lookup(rows, staged(gone, "gone"), F.struct(F.col("_k"), F.col("_th")), "_row")
    out = F.flatten(F.transform("_spans", lambda x: F.sequence(x["a"], x["z"])))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - F.lit(1)), out)
    left = F.when(F.col("_spans").isNotNull(), F.transform(stay, lambda i: F.get(F.col("_lines"), i)))
    return _without(joined, docs, text, "_spans", left)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the law of chunks takes from each document, as the SQL states it; all cases as the module says."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the pipeline does it: chunks and whole passages."""
    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_line_dedup": op10_line_dedup, "op10_passage_dedup": op10_passage_dedup}
ORACLES = {
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n_lines
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
r AS (SELECT *, md5(coalesce(lag(md5(line)) OVER w, '') || md5(line)) AS r FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, CASE WHEN i = 0 OR (lead(r) OVER w IS NOT NULL AND r < lag(r) OVER w AND r < lead(r) OVER w) THEN 1 ELSE 0 END AS s
      FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM b),
c AS (SELECT doc_id, j, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM k GROUP BY doc_id, j),
f AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, j) AS nth FROM c
      WHERE n >= 2 AND regexp_matches(chunk, '[^\x20\x09-\x0D]')),
o AS (SELECT k.*, coalesce(f.nth, 1) > 1 AS gone FROM k LEFT JOIN f USING (doc_id, j)),
t AS (SELECT doc_id, max(n_lines) AS n_lines, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM o GROUP BY doc_id)
SELECT d.doc_id, t.text, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed_lines
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id"""
}
