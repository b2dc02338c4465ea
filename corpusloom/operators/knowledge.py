"""Knowledge operators: beliefs, gaps, change reports, staleness, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def beliefs(concepts: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """What is held about each concept.

    concepts: concept_id; claims: claim_id, concept_id, status (ACTIVE, DISPUTED, SUPERSEDED, others
    appear in no list); evidence: claim_id, source_id. settled: something is held and nothing disputed.
    Sources are those of active claims only.
    """
    cited = evidence.select("claim_id", "source_id").distinct()
    sources = claims.where("status = 'ACTIVE'").join(cited, "claim_id").groupBy("concept_id").agg(F.countDistinct("source_id").alias("sources"))
    bare = claims.where("status = 'ACTIVE'").join(cited, "claim_id", "left_anti").groupBy("concept_id").agg(F.count(F.lit(1)).alias("unevidenced"))
    counts = claims.groupBy("concept_id").agg(
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("ACTIVE", "held"), ("DISPUTED", "disputed"), ("SUPERSEDED", "superseded"))]
    )
    out = concepts.select("concept_id").join(counts, "concept_id", "left").join(sources, "concept_id", "left").join(bare, "concept_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("held", "disputed", "superseded", "sources", "unevidenced")]
    return out.select("concept_id", *zero).withColumn("settled", (F.col("held") > 0) & (F.col("disputed") == 0))


#: Weights of the gaps.
WEIGHTS = {"no_claims": 0.4, "unevidenced": 0.5, "single_source": 0.25, "disputed": 0.9}
SATURATION_SHARE, SATURATION_LEAST = 0.5, 5


def gap(kind: str, rows: DataFrame, subject: Column, weight: Column | float | None = None) -> DataFrame:
    w = weight if isinstance(weight, Column) else F.lit(WEIGHTS[kind] if weight is None else weight)
    return rows.select(F.lit(kind).alias("kind"), subject.cast("bigint").alias("subject_id"), w.cast("double").alias("weight"))


def single_source(evidence: DataFrame) -> DataFrame:
    """Claims whose evidence comes from one source: claim_id."""
    return evidence.groupBy("claim_id").agg(F.countDistinct("source_id").alias("n")).where("n = 1").select("claim_id")


def saturation(gaps: DataFrame, populations: DataFrame) -> DataFrame:
    """Per kind: count, population, and whether it is collapsed because it holds for at least half of five or more."""
    counted = gaps.groupBy("kind").agg(F.count(F.lit(1)).alias("gaps"))
    share = F.col("gaps") / F.greatest("population", F.lit(1))
    return counted.join(F.broadcast(populations), "kind").select("kind", "gaps", "population", ((F.col("population") >= SATURATION_LEAST) & (share >= SATURATION_SHARE)).alias("collapsed"))


def changes_between(revisions: DataFrame, since: str, until: str) -> DataFrame:
    """Revisions of a closed window: op, revisions, entities, first and last time."""
    inside = revisions.where((F.col("at") >= F.to_timestamp(F.lit(since))) & (F.col("at") <= F.to_timestamp(F.lit(until))))
    return inside.groupBy("op").agg(F.count(F.lit(1)).alias("revisions"), F.countDistinct("entity_id").alias("entities"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def timeline(revisions: DataFrame) -> DataFrame:
    """Revisions of every entity in order: entity_id, seq, op, at, previous_op."""
    order = Window.partitionBy("entity_id").orderBy("at", "revision_id")
    return revisions.select("entity_id", F.row_number().over(order).alias("seq"), "op", "at", F.lag("op").over(order).alias("previous_op"))


def transitions(steps: DataFrame, allowed: DataFrame) -> DataFrame:
    """How often each state follows each other, and whether the state machine allows it. allowed: previous_op, op."""
    counted = steps.where("previous_op is not null").groupBy("previous_op", "op").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(allowed.withColumn("ok", F.lit(True))), ["previous_op", "op"], "left").select("previous_op", "op", "n", F.coalesce("ok", F.lit(False)).alias("allowed"))


def staleness(snapshot: DataFrame, now: DataFrame, fields: tuple[str, ...], *, key: str) -> DataFrame:
    """Rows of a snapshot that are no longer as they were, with the first field that drifted, or missing.

    Fields are compared one by one, so a value that holds a separator is compared rightly.
    """
    current = now.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_now_{f}") for f in fields])
    both = snapshot.join(current, F.col(key) == F.col("_k"), "left")
    reason = F.when(F.col("_k").isNull(), "missing")
    for f in fields:
        reason = reason.when(~F.col(f).eqNullSafe(F.col(f"_now_{f}")), f)
    return both.select(key, reason.alias("reason")).where("reason is not null")


#: Strength of the tiers; nothing derived may be stronger than what it rests on.
TIERS = {"SOURCE_FACT": 4, "EXTRACTED_CLAIM": 3, "USER_ASSERTION": 3, "MODEL_INFERENCE": 2, "SYNTHESIS": 1}


def rank_of(tier: Column) -> Column:
    found = F.when(F.lit(False), 0)
    for name, rank in TIERS.items():
        found = found.when(tier == name, rank)
    return found


def floor_violations(items: DataFrame, inputs: DataFrame) -> DataFrame:
    """Items that claim a stronger tier than their weakest input: item_id, tier. inputs: item_id, tier."""
    weakest = inputs.groupBy("item_id").agg(F.min(rank_of(F.col("tier"))).alias("_floor"))
    return items.join(weakest, "item_id").where(rank_of(F.col("tier")) > F.col("_floor")).select("item_id", "tier")


#: Precedence of impacts, strongest first.
IMPACTS = ("CONFLICT", "REFINES", "SUPPORTS")


def impact(assessments: DataFrame, examined: DataFrame, *, key: str) -> DataFrame:
    """The strongest impact of each subject; without one, new knowledge if no claim was examined, else no change.

    assessments: key, classification; examined: key, claims.
    """
    def worst(c: Column) -> Column:
        found = F.lit(0)
        for i, name in enumerate(IMPACTS):
            found = F.when(c == name, len(IMPACTS) - i).otherwise(found)
        return found

    top = assessments.groupBy(key).agg(F.max(worst(F.col("classification"))).alias("_w"))
    named = F.when(F.col("_w") == 3, IMPACTS[0]).when(F.col("_w") == 2, IMPACTS[1]).when(F.col("_w") == 1, IMPACTS[2])
    return examined.join(top, key, "left").select(key, named.when(F.col("claims") == 0, "NEW_KNOWLEDGE").otherwise("NO_MATERIAL_CHANGE").alias("impact"))
