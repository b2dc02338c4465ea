"""Typed tables of the knowledge model, and the rules that a batch must keep before it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROVENANCE = "provenance struct<tier:string,derivation:string,agent:string,model_id:string,inputs:array<struct<id:string,tier:string>>>"
#: One schema per entity; a table holds one row per id.
SCHEMAS = {
    "sources": "id string, kind string, locator string, content_hash string, trust_tier string, title string, ingested_at timestamp",
    "documents": "id string, source_id string, version int, content_hash string, parser string",
    "spans": "id string, document_id string, ordinal int, start_line int, end_line int, page int, heading_path array<string>, text string, chunk_strategy string",
    "concepts": f"id string, canonical_name string, kind string, namespace string, vault_path string, aliases array<string>, {_PROVENANCE}",
    "claims": f"id string, statement string, subject_concept_id string, status string, superseded_by string, valid_from timestamp, valid_to timestamp, {_PROVENANCE}",
    "evidence": "id string, claim_id string, span_id string, relation string",
    "links": f"id string, from_id string, to_id string, type string, score double, active boolean, {_PROVENANCE}",
    "revisions": "seq bigint, entity_type string, entity_id string, op string, at timestamp, cause string",
    "proposals": "id string, type string, status string, target_id string, created_at timestamp",
    "questions": "id string, text string, status string, concept_ids array<string>, created_at timestamp",
    "answers": "question_id string, claim_id string",
    "syntheses": "id string, scope string, scope_id string, body string, generated_at timestamp",
    "synthesis_claims": "synthesis_id string, claim_id string, statement string, status string, superseded_by string",
}
#: The states of a claim.
CLAIM_STATES = ("ACTIVE", "DISPUTED", "SUPERSEDED", "RETRACTED")


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """Rule and id of every row that breaks a rule of the model; empty for a sound batch."""
    rank = F.create_map(*[F.lit(x) for kv in {"SOURCE_FACT": 4, "EXTRACTED_CLAIM": 3, "USER_ASSERTION": 3, "MODEL_INFERENCE": 2, "SYNTHESIS": 1}.items() for x in kv])
    p = "provenance"
    floor = F.array_min(F.transform(f"{p}.inputs", lambda i: rank[i["tier"]]))
    bare = t["claims"].where(f"{p}.tier <> 'USER_ASSERTION'").join(t["evidence"].select(F.col("claim_id").alias("id")), "id", "left_anti")
    found = [("claim_without_evidence", bare), ("unknown_claim_state", t["claims"].where(~F.col("status").isin(*CLAIM_STATES))),
             ("superseded_without_successor", t["claims"].where("status = 'SUPERSEDED' and superseded_by is null")),
             ("self_link", t["links"].where("from_id = to_id")), ("span_ends_before_start", t["spans"].where("end_line < start_line"))]
    for name in ("concepts", "claims", "links"):
        found.append((f"{name}_stronger_than_inputs", t[name].where(rank[F.col(f"{p}.tier")] > floor)))
        found.append((f"{name}_model_without_id", t[name].where(f"{p}.derivation = 'MODEL' and {p}.model_id is null")))
    out = None
    for rule, rows in found:
        one = rows.select(F.lit(rule).alias("rule"), "id")
        out = one if out is None else out.unionByName(one)
    return out
