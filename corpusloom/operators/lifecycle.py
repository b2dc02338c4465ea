"""Lifecycle operators: proposals, activation, supersession, evidence review, planning, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.links import normalize
from corpusloom.operators.matching import held_names, quote_presence
from corpusloom.sources.staging import staged

#: The states that may follow each state of a proposal.
MOVES = {"pending": ("approved", "rejected", "superseded"), "approved": ("activated", "superseded"), "activated": ("superseded",), "rejected": ("superseded",), "superseded": ()}
#: Caps of claims that are examined, and ranks of the selectors.
PER_CONCEPT, IN_ALL = 5, 20
SELECTORS = ("exact_name", "alias", "identity", "heading", "lexical", "graph_neighbour")
PRESENT = 0.8


def latest(rows: DataFrame, *, key: str, order: list[str]) -> DataFrame:
    """The last version of each key: an upsert as a fold over appended batches."""
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def fold_states(events: DataFrame, *, key: str, order: str, move: str) -> DataFrame:
    """The state each proposal ends in, and how many of its moves were refused. A proposal has few moves."""

    def step(acc: Column, m: Column) -> Column:
        fine = F.lit(False)
        for state, nexts in MOVES.items():
            if nexts:
                fine = fine | ((acc["state"] == state) & m["move"].isin(*nexts))
        return F.struct(F.when(fine, m["move"]).otherwise(acc["state"]).alias("state"), (acc["refused"] + F.when(fine, 0).otherwise(1)).alias("refused"))

    moves = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(move).alias("move")))).alias("_m"))
    start = F.struct(F.lit("pending").alias("state"), F.lit(0).alias("refused"))
    return moves.select(key, F.aggregate("_m", start, step).alias("_s")).select(key, "_s.state", "_s.refused")


def create_if_absent(stored: DataFrame, proposed: DataFrame, *, key: str) -> DataFrame:
    """Proposals whose identity was never stored, whatever was decided on it since."""
    return proposed.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def supersede(claims: DataFrame, replacements: DataFrame, *, at: str) -> DataFrame:
    """Claims after replacement: old ones stay with status SUPERSEDED, their successor and an end; new ones are added.

    claims: claim_id, statement, status; replacements: claim_id, new_id, statement.
    """
    by = replacements.select("claim_id", F.col("new_id").alias("_new"))
    gone = F.col("_new").isNotNull()
    old = claims.join(by, "claim_id", "left").select(
        "claim_id", "statement", F.when(gone, "SUPERSEDED").otherwise(F.col("status")).alias("status"), F.col("_new").alias("superseded_by"), F.when(gone, F.lit(at)).alias("valid_to")
    )
    live = replacements.join(claims.select("claim_id"), "claim_id", "left_semi")
    new = live.select(F.col("new_id").alias("claim_id"), "statement", F.lit("ACTIVE").alias("status"), F.lit(None).cast(old.schema["superseded_by"].dataType).alias("superseded_by"), F.lit(None).cast("string").alias("valid_to"))
    return old.unionByName(new)


def relationship_gates(edges: DataFrame, concepts: DataFrame, *, least: int = 2) -> DataFrame:
    """Proposed edges with the reason for which each is refused, or null. edges: a, b, shared; concepts: node."""
    ends = concepts.select("node")
    left, right = ends.select(F.col("node").alias("a"), F.lit(True).alias("_ha")), ends.select(F.col("node").alias("b"), F.lit(True).alias("_hb"))
    out = edges.join(left, "a", "left").join(right, "b", "left")
    reason = F.when(F.col("a") == F.col("b"), "self_link").when(F.col("_ha").isNull() | F.col("_hb").isNull(), "missing_concept").when(F.col("shared") < least, "too_few_spans")
    return out.select("a", "b", "shared", reason.alias("refused"))


def capped_claims(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """Claims to examine: at most five of each candidate and twenty in all, in candidate order. candidates: concept_id, place.

    The second cap sees at most five rows for each of the few candidates.
    """
    inner = Window.partitionBy("concept_id").orderBy("claim_id")
    some = claims.join(candidates, "concept_id").withColumn("_n", F.row_number().over(inner)).where(F.col("_n") <= PER_CONCEPT)
    return some.orderBy("place", "claim_id").limit(IN_ALL).select("claim_id", "concept_id", "place")


def narrow(concepts: DataFrame, spans: DataFrame, edges: DataFrame, *, cap: int = 12) -> DataFrame:
    """Concepts that evidence may bear on: concept, selector; the first selector wins, then rank and name, then the cap.

    concepts: concept, aliases; spans: text, heading; edges: a, b over concepts. Names and texts meet as wholes (held_names), texts by their normalised form.
    """
    least = 4

    def holding(names: DataFrame, column: str, selector: str) -> DataFrame:
        texts = spans.select(normalize(F.col(column)).alias("hay")).where(F.length("hay") >= least).distinct().select(F.col("hay").alias("key"), "hay")
        found = held_names(names.select("name"), texts, least=least).select("name").distinct()
        return names.join(found.hint("merge"), "name").select("concept", F.lit(selector).alias("selector"))

    named = concepts.select("concept", normalize(F.col("concept")).alias("name"))
    others = concepts.select("concept", F.explode("aliases").alias("a")).select("concept", normalize(F.col("a")).alias("name"))
    place = F.array_position(F.array(*[F.lit(s) for s in SELECTORS]), F.col("selector"))
    direct = holding(named, "text", "exact_name").unionByName(holding(others, "text", "alias")).unionByName(holding(named, "heading", "heading"))
    direct = staged(direct.groupBy("concept").agg(F.min_by("selector", place).alias("selector")), "selected")
    near = edges.select("a", "b").union(edges.select("b", "a")).join(direct.select(F.col("concept").alias("a")).hint("merge"), "a").select(F.col("b").alias("concept")).distinct()
    near = near.join(direct.hint("merge"), "concept", "left_anti").select("concept", F.lit("graph_neighbour").alias("selector"))
    return direct.unionByName(near).orderBy(place, "concept").limit(cap)


def demote_uncorroborated(assessments: DataFrame) -> DataFrame:
    """Supporting or refining assessments whose quote is not there lose their standing. Columns quote, evidence, classification."""
    weak = F.col("classification").isin("SUPPORTS", "REFINES") & (quote_presence(F.col("quote"), F.col("evidence")) < PRESENT)
    return assessments.withColumn("classification", F.when(weak, "INSUFFICIENT_EVIDENCE").otherwise(F.col("classification")))


def changed_fields(before: DataFrame, after: DataFrame, fields: tuple[str, ...], *, key: str) -> DataFrame:
    """Names of the fields that differ, in order; all of them where one side is missing: key, changed."""
    b = after.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = before.join(b, F.col(key) == F.col("_key"), "full_outer")
    one = F.col(key).isNull() | F.col("_key").isNull()
    names = F.array_compact(F.array(*[F.when(one | ~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fields]))
    return both.select(F.coalesce(key, "_key").alias(key), F.array_join(names, ",").alias("changed")).where("changed <> ''")


def extract_json(text: Column) -> Column:
    """The JSON of a model's reply: all of it, else a fenced block, else from the first brace to the last."""
    t = F.trim(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*\n(.*?)\s*```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(t.rlike(r"^[\{\[]"), t).when(F.trim(fenced) != "", F.trim(fenced)).when(braces != "", braces)


def citations(answers: DataFrame, *, text: str, passages: int) -> DataFrame:
    """Numbers cited as [n] with whether such a passage was given."""
    cited = answers.withColumn("n", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\[(\d+)\]"), F.lit(1)))))
    n = F.col("n").cast("int")
    return cited.withColumn("n", n).withColumn("valid", (F.col("n") >= 1) & (F.col("n") <= passages))


def drift(pinned: DataFrame, heads: DataFrame) -> DataFrame:
    """Status of upstream pins: unreachable, unpinned, current or drifted. pinned: repo, commit; heads: repo, head."""
    both = pinned.join(heads, "repo", "left")
    status = F.when(F.col("head").isNull(), "unreachable").when(F.col("commit").isNull(), "unpinned").when(F.col("commit") == F.col("head"), "current").otherwise("drifted")
    return both.select("repo", status.alias("status"))


def resolve_names(asked: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concept of each request: by id, else by exact name, else by a unique part of a name; null if unknown or ambiguous.

    asked: ask; concepts: id, name. Requests are few and are sent to the concepts.
    """
    a = F.broadcast(asked)
    named = concepts.select(F.col("id").cast("string").alias("id"), "name")
    low = F.lower("name")
    hits = named.join(a, (F.col("id") == F.col("ask")) | F.contains(low, F.lower("ask")))
    rank = F.when(F.col("id") == F.col("ask"), 1).when(low == F.lower("ask"), 2).otherwise(3)
    best = hits.groupBy("ask", rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    first = best.groupBy("ask").agg(F.min_by(F.struct("n", "id"), "rank").alias("h"))
    return asked.join(first, "ask", "left").select("ask", F.when(F.col("h.n") == 1, F.col("h.id")).alias("id"))


def rates(rows: DataFrame, good: Column, measured: Column, *by: str, empty: float = 0.0) -> DataFrame:
    """Share of good rows among the measured ones; `empty` where none was measured (1 for grounding: nothing was said without ground)."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(measured).alias("measured"),
        F.round(F.coalesce(F.count_if(good & measured) / F.when(F.count_if(measured) > 0, F.count_if(measured)), F.lit(empty)), 6).alias("rate"),
    )
