"""From new evidence to proposals: candidate concepts, their claims, assessments, impact, proposals, review.

The model that assesses is a function passed in; it runs under mapInPandas on (claim, evidence) rows
that are not cached yet. Everything before and after it is a plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import entity_id
from corpusloom.operators import knowledge as K
from corpusloom.operators import lifecycle as Y

#: Proposals that follow from a classification.
PROPOSALS = {"SUPPORTS": "ADD_EVIDENCE", "REFINES": "REFINE_CLAIM", "CONFLICT": "MARK_CONFLICT"}
#: Steps of a run and what may follow each.
NEXT = {"registered": "narrowed", "narrowed": "retrieved", "retrieved": "assessed", "assessed": "classified", "classified": "proposed", "proposed": "awaiting_review", "awaiting_review": "activated", "activated": "recorded", "recorded": "finished"}
MAX_ROUNDS = 25

Assessor = Callable[[pd.DataFrame], pd.DataFrame]
_ASSESSED = "claim_id string, span_id string, quote string, classification string, refined string"


def assess(pairs: DataFrame, cached: DataFrame, assessor: Assessor, *, version: str) -> DataFrame:
    """Assessments of claims against evidence: cached ones as they are, the others by the assessor.

    pairs: claim_id, statement, span_id, evidence; cached: key and the columns of an assessment. The key
    names the evidence, the claim and the version of whatever assesses.
    """
    keyed = pairs.withColumn("key", entity_id("assessment", F.col("claim_id"), F.sha2(F.col("evidence"), 256), F.lit(version)))
    known = keyed.select("key").join(cached, "key").select("key", *[c.split()[0] for c in _ASSESSED.split(", ")])
    missing = keyed.join(cached.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = assessor(b.drop(columns="key"))
                yield out.merge(b[["claim_id", "span_id", "key"]], on=["claim_id", "span_id"], how="left")[["key", "claim_id", "span_id", "quote", "classification", "refined"]]

    return known.unionByName(missing.mapInPandas(run, "key string, " + _ASSESSED))


def validated(assessed: DataFrame, claims: DataFrame, spans: DataFrame) -> DataFrame:
    """Assessments with the reason for which each is rejected, or null."""
    c = claims.select("claim_id", F.lit(True).alias("_claim")).distinct()
    s = spans.select("span_id", F.lit(True).alias("_span")).distinct()
    reason = (
        F.when(F.col("_claim").isNull(), "unknown_claim").when(F.col("_span").isNull(), "unknown_span")
        .when(~F.col("classification").isin(*PROPOSALS, "UNRELATED", "INSUFFICIENT_EVIDENCE"), "unknown_classification")
        .when((F.col("classification") == "REFINES") & (F.trim(F.coalesce("refined", F.lit(""))) == ""), "no_refined_statement")
    )
    return assessed.join(c, "claim_id", "left").join(s, "span_id", "left").withColumn("rejected", reason).drop("_claim", "_span")


def proposals(assessed: DataFrame) -> DataFrame:
    """Proposals that actionable assessments lead to: proposal_id, type, claim_id, evidence (spans of one claim), refined."""
    mapping = F.create_map(*[F.lit(x) for kv in PROPOSALS.items() for x in kv])
    rows = assessed.withColumn("type", mapping[F.col("classification")]).where("type is not null")
    out = rows.groupBy("claim_id", "type").agg(F.array_sort(F.collect_set("span_id")).alias("evidence"), F.min("refined").alias("refined"))
    return out.select(entity_id("proposal", F.col("type"), F.col("claim_id"), F.array_join("evidence", ",")).alias("proposal_id"), "type", "claim_id", "evidence", "refined")


def evolve(concepts: DataFrame, claims: DataFrame, edges: DataFrame, spans: DataFrame, assessor: Assessor, cached: DataFrame, *, version: str = "1") -> dict[str, DataFrame]:
    """The outcome of one piece of evidence: candidates, claims examined, assessments, impact, proposals.

    concepts: concept, aliases; claims: claim_id, concept_id, statement, status; spans: span_id, text, heading.
    """
    found = Y.narrow(concepts, spans, edges)
    order = F.array_position(F.array(*[F.lit(s) for s in Y.SELECTORS]), F.col("selector"))
    places = found.select(F.col("concept").alias("concept_id"), F.dense_rank().over(_by(order)).alias("place"))
    live = claims.where(F.col("status").isin("ACTIVE", "DISPUTED"))
    examined = Y.capped_claims(live.select("claim_id", "concept_id"), places).join(live.select("claim_id", "statement"), "claim_id")
    pairs = examined.select("claim_id", "statement").join(F.broadcast(spans.select("span_id", F.col("text").alias("evidence"))))
    judged = validated(assess(pairs, cached, assessor, version=version), examined, spans)
    sound = judged.where("rejected is null").join(spans.select("span_id", F.col("text").alias("evidence")), "span_id")
    sound = Y.demote_uncorroborated(sound)
    whole = examined.agg(F.count(F.lit(1)).alias("claims")).select(F.lit("run").alias("run"), "claims")
    impact = K.impact(sound.select(F.lit("run").alias("run"), "classification"), whole, key="run")
    return {"candidates": found, "examined": examined, "assessments": judged, "impact": impact.select("impact"), "proposals": proposals(sound)}


def _by(order):
    from pyspark.sql.window import Window

    return Window.orderBy(order, "concept")  # at most the cap of candidates


def advance(state: str, pending: int, rounds: int) -> str:
    """The next state of a run; review holds it until nothing is pending, for a bounded number of rounds."""
    if state == "awaiting_review" and pending:
        return state if rounds < MAX_ROUNDS else "failed"
    return NEXT.get(state, state)


def resolve_identity(asked: DataFrame, aliases: DataFrame, decisions: DataFrame, collisions: DataFrame) -> DataFrame:
    """Concept of each bare name: an alias beats a collision, a decision settles one, else it is ambiguous.

    asked: norm; aliases and decisions: norm, concept; collisions: norm.
    """
    out = asked.join(aliases.withColumnRenamed("concept", "_alias"), "norm", "left").join(decisions.withColumnRenamed("concept", "_decided"), "norm", "left")
    out = out.join(collisions.select("norm", F.lit(True).alias("_collides")), "norm", "left")
    known = F.coalesce("_alias", "_decided")
    return out.select("norm", known.alias("concept"), F.when(F.col("_alias").isNotNull(), "alias").when(F.col("_decided").isNotNull(), "decided").when(F.col("_collides"), "ambiguous").otherwise("unknown").alias("status"))
