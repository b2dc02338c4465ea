"""Scores of extraction: cases with expected concepts, pages against a vocabulary, runs against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.corpus import name_shape
from corpusloom.operators.links import normalize


def _keys(names: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(names, lambda n: F.trim(n) != ""), lambda n: normalize(n)))


def _named(names: Column, keep) -> Column:
    """The names whose normalised form `keep` holds for, one for each form (the last given), in order of the alphabet."""
    last = F.filter(names, lambda n, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda m: normalize(m) == normalize(n)) & (F.trim(n) != ""))
    return F.array_sort(F.filter(last, lambda n: keep(normalize(n))))


def score_cases(cases: DataFrame, emitted: DataFrame) -> DataFrame:
    """Found, missed, junk and extra concepts of each case: case_id, found, missed, junk, extra.

    cases: case_id, expected, forbidden; emitted: case_id, concepts. Names are compared in normalised form; a case of which nothing was emitted misses all.
    """
    rows = cases.join(emitted, "case_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    e, x, f = _keys(F.col("concepts")), _keys(F.col("expected")), _keys(F.col("forbidden"))
    inside = lambda keys: lambda k: F.array_contains(keys, k)
    return rows.select(
        "case_id", _named(F.col("expected"), inside(e)).alias("found"), _named(F.col("expected"), lambda k: ~F.array_contains(e, k)).alias("missed"),
        _named(F.col("concepts"), inside(f)).alias("junk"), _named(F.col("concepts"), lambda k: ~F.array_contains(x, k) & ~F.array_contains(f, k)).alias("extra"),
    )


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """Cases, recall (found of expected) and junk rate (junk of emitted); 0 where nothing was expected or emitted."""
    n = lambda c: F.sum(F.size(c))
    share = lambda a, b: F.round(F.coalesce(a / F.when(b > 0, b), F.lit(0.0)), 6)
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), share(n("found"), n("found") + n("missed")).alias("recall"), share(n("junk"), n("found") + n("junk") + n("extra")).alias("junk_rate"))


def score_pages(pages: DataFrame, emitted: DataFrame, vocabulary: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Of each page: whether its own concept was emitted, and how many emitted names are junk, in the vocabulary or neither.

    pages: path, name, targets (names that stand for it); emitted: path, concept; vocabulary and forbidden: name. Junk comes first,
    then the vocabulary. Names are joined by their normalised form, so no list grows with the vocabulary.
    """
    e = emitted.where(F.trim("concept") != "").select("path", normalize(F.col("concept")).alias("norm")).distinct()
    known, junk = (t.select(normalize(F.col("name")).alias("norm")).distinct() for t in (vocabulary, forbidden))
    judged = e.join(junk.withColumn("_j", F.lit(True)), "norm", "left").join(known.withColumn("_v", F.lit(True)), "norm", "left")
    kind = F.when(F.col("_j"), "junk").when(F.col("_v"), "known").otherwise("off")
    counts = judged.withColumn("kind", kind).groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("junk", "known", "off")])
    own = pages.select("path", F.explode("targets").alias("t")).select("path", normalize(F.col("t")).alias("norm")).join(e, ["path", "norm"], "left_semi").select("path", F.lit(True).alias("_own")).distinct()
    out = pages.select("path", "name").join(counts, "path", "left").join(own, "path", "left")
    return out.select("path", "name", F.coalesce("_own", F.lit(False)).alias("recovered"), *[F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in ("junk", "known", "off")])


def recovery_by_shape(scores: DataFrame) -> DataFrame:
    """Pages and recovered ones by the shape of their names; a shape without pages has no row."""
    return scores.groupBy(name_shape(F.col("name")).alias("shape")).agg(F.count_if("recovered").alias("recovered"), F.count(F.lit(1)).alias("pages"))


def compare_cases(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases by what became of them from run to run: change (gained, lost, same, added, removed), cases. Scores as of score_cases."""
    b = before.select("case_id", F.array_join("found", "|").alias("fb"), F.size("found").alias("nb"))
    a = after.select("case_id", F.array_join("found", "|").alias("fa"), F.size("found").alias("na"))
    both = b.join(a, "case_id", "full_outer")
    change = (
        F.when(F.col("nb").isNull(), "added").when(F.col("na").isNull(), "removed").when(F.col("na") > F.col("nb"), "gained")
        .when(F.col("na") < F.col("nb"), "lost").when(F.col("fa") == F.col("fb"), "same").otherwise("changed")
    )
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("cases"))
