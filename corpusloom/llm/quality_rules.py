"""Quality rules as a short-circuit cascade, in Spark expressions only.

Each rule is a predicate on measures of the text that says when a document fails. On a sample of at
most SAMPLE_ROWS rows every rule's rejections are counted and its cost is estimated as the work that its
measure takes on those texts (characters and words read, by fixed unit costs, so that the same
table gives the same order). Rules are then chosen one by one: next comes the one that rejects most per
cost among the sampled rows that those before it let pass. They run in that order as the branches of one CASE, so a
document that fails a rule never pays for those after it. The order changes the cost, never the
verdict. The sample is read from the front of the table, as far as it takes to fill it, so its cost does
not grow with the table; where a table is sorted by quality the order may be worse.

Windows of words are compared by 64-bit hashes of their words within one document.

Defined results: null and empty texts have no words and fail the word count; an unknown label, a
null key or extra columns change nothing (a column of the name asked for is replaced); repeated rows are
judged alike; whole texts of any length are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACES, table, words

#: Fixed values.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
SAMPLE_ROWS = 1000
#: One row in so many, by a hash of its text, is sampled.
SAMPLE_EVERY = 4

Measures = dict[str, Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(toks: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows (of a power of two of words) found twice or more in the text, the first one included."""

    def joined(size: int) -> Callable[[Column], Column]:
        return lambda h: F.zip_with(h, F.slice(h, size + 1, F.size(h)), lambda x, y: F.xxhash64(x, y))

    # a window's hash is made of those of its halves, so each doubling reads every word once
    hashes = F.transform(toks, lambda w: F.xxhash64(w))
    for doubling in range(window.bit_length() - 1):
        hashes = let(hashes, joined(1 << doubling))
    hashes = F.slice(hashes, 1, F.size(toks) - F.lit(window - 1))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(places, j + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def twice(pairs: Column) -> Column:
        found = F.filter(pairs, lambda p, j: F.coalesce(F.get(pairs, j - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, j + 1)["h"] == p["h"], F.lit(False)))
        return let(F.array_sort(F.transform(found, lambda p: p["i"])), covered)

    def counted(hs: Column) -> Column:
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("bigint")).otherwise(let(pairs, twice))

    return F.when(F.size(toks) <= window, F.lit(0).cast("bigint")).otherwise(let(hashes, counted))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{SPACES}]"))


def measures(text: Column, toks: Column, lines: Column) -> Measures:
    """Every measure as an expression over a non-null text, its words and its lines with words."""
    return {
        "n_words": F.size(toks).cast("bigint"),
        "word_chars": F.char_length(F.array_join(toks, "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeat_words(toks),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("bigint"),
        "n_bangs": (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))).cast("bigint"),
    }


@dataclass(frozen=True)
class Rule:
    """A rule by name; fails(measures) is true for a document to reject. Base rules hold by contract.

    Its measure takes per_char units for each character and per_word units for each word.
    """

    name: str
    fails: Callable[[Measures], Column]
    per_char: float
    per_word: float
    base: bool = False


RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20, 0, 0, base=True),
    Rule("repeated_words", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30, 0, 300, base=True),
    Rule("symbols", lambda m: m["n_symbols"] * 10 > m["n_words"], 4, 0),
    Rule("duplicate_lines", lambda m: m["n_dup_lines"] * 2 > m["n_lines"], 3, 0),
    Rule("word_length", lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 14), 1, 10),
    Rule("shouting", lambda m: m["n_upper"] * 2 > m["word_chars"], 5, 0),
    Rule("exclamations", lambda m: m["n_bangs"] * 5 > m["n_words"], 2, 0),
)
#: Units that any rule takes for a document.
PER_ROW = 100.0


def _measured(text: Column, use: Callable[[Measures], Column]) -> Column:
    """use(measures) of a text, null being empty; words and lines are made once, within the one expression.

    So a filter on it that the optimizer moves down does not split the text anew for every window.
    """

    def of(t: Column) -> Column:
        return let(words(t), lambda toks: let(lines_with_words(t), lambda lines: use(measures(t, toks, lines))))

    return let(F.coalesce(text, F.lit("")), of)


def sampled(docs: DataFrame, rules: tuple[Rule, ...], *, text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[float, float, list[bool]]]:
    """For at most `rows` rows: characters, words, and which rules fail. As many partitions are read as it takes."""
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE_EVERY)) == 0)
    facts = _measured(F.col(text), lambda m: F.struct(m["word_chars"].alias("chars"), m["n_words"].alias("words"), F.array(*[r.fails(m) for r in rules]).alias("fails")))
    return [(r.f.chars, r.f.words, r.f.fails) for r in some.select(facts.alias("f")).limit(rows).collect()]


def in_order(rules: tuple[Rule, ...], facts: list[tuple[float, float, list[bool]]]) -> list[Rule]:
    """The rules, each time the one that rejects most per cost of the rows that are left; ties by name."""
    left, out, rest = facts, [], list(enumerate(rules))
    while rest:

        def worth(rule: tuple[int, Rule], left=left) -> tuple[float, float, str]:
            i, r = rule
            cost = sum(PER_ROW + r.per_char * chars + r.per_word * n for chars, n, _ in left) or PER_ROW
            return -sum(f[i] for _, _, f in left) / cost, cost, r.name

        best = min(rest, key=worth)
        rest.remove(best)
        out.append(best[1])
        left = [x for x in left if not x[2][best[0]]]
    return out


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order in which the cascade applies them to this table."""
    return in_order(rules, sampled(docs, rules, text=text, rows=rows))


def verdict(rules: list[Rule], m: Measures) -> Column:
    """The name of the first rule, in order, that a document fails; null if it passes all."""
    found = F
    for rule in rules:
        found = found.when(rule.fails(m), F.lit(rule.name))
    return found.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "failed_rule") -> DataFrame:
    """The rows with the column `into`: what the cascade rejects them for, or null. Later rules cost only those that pass."""
    ordered = order_rules(docs, rules, text=text)
    return docs.withColumn(into, _measured(F.col(text), lambda m: verdict(ordered, m)))


#: What the query returns for every row, whatever the verdict.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document.

    The contract's measures are made once for each row; the cascade reads those, and makes the measures
    of its other rules only for rows that no rule before them rejects.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = order_rules(docs)

    def judged(m: Measures) -> Column:
        return let(F.struct(*[m[n].alias(n) for n in SHOWN]), lambda s: F.struct(s.alias("m"), verdict(ordered, m | {n: s[n] for n in SHOWN}).alias("failed_rule")))

    rows = docs.select("doc_id", _measured(F.col("text"), judged).alias("j")).select("doc_id", "j.m.*", "j.failed_rule")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return rows.select("doc_id", *SHOWN, failed.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


_W = r"[^\x20\x09-\x0D]+"
QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_W}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM d),
m AS (SELECT rid, doc_id, ws, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
             length(t) - length(replace(t, '!', '')) AS n_bangs,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM w),
g AS (SELECT rid, i, ws[i:i+7] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM m WHERE len(ws) > 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
a AS (SELECT m.*, coalesce(c.n, 0) AS n_repeat_words FROM m LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines OR word_chars < n_words * 2
            OR word_chars > n_words * 14 OR n_upper * 2 > word_chars OR n_bangs * 5 > n_words) AS kept
FROM b"""
}
