"""The knowledge model as a whole: integrity, gaps, dissent, proposals, and what approved ones activate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import entity_id
from corpusloom.operators.links import normalize

#: Types that relationships may have, tiers that need no evidence, findings that are errors.
LINK_TYPES = ("RELATED_TO", "PART_OF", "DEPENDS_ON", "IMPLEMENTS", "EXPLAINS")
UNEVIDENCED_TIERS = ("USER_ASSERTION",)
ERRORS = ("GR001", "GR002", "GR006", "GR007", "GR009")
#: Weights of gaps and days after which a conflict that awaits review is one.
PAGED, BARE, ISOLATED, SINGLE_MODEL, SINGLE, DISPUTED = 0.6, 0.4, 0.3, 0.5, 0.25, 0.9
ASKED, PER_WEEK, STALE_DAYS, PER_DAY = 0.7, 0.05, 14, 0.005
#: Words that say nothing in a question.
SHORT_WORD = 2


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def integrity(concepts: DataFrame, claims: DataFrame, evidence: DataFrame, spans: DataFrame, links: DataFrame) -> DataFrame:
    """Findings: code, severity, entity_id.

    concepts: id, vault_path, derivation, origin_proposal_id; claims: id, subject_concept_id, tier; evidence: id, claim_id, span_id;
    spans: id; links: id, from_id, to_id, type, agent, active. Only active links are judged; a group of equal ones is one finding, on its least id.
    """
    live = links.where("active")
    known = concepts.select("id").union(claims.select("id")).distinct()
    missing = lambda c: live.join(known.withColumnRenamed("id", c), c, "left_anti").select("id")
    twice = live.groupBy("from_id", "to_id", "type").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    bare = claims.where(~F.col("tier").isin(*UNEVIDENCED_TIERS)).join(evidence.select(F.col("claim_id").alias("id")), "id", "left_anti").select("id")
    dangling = evidence.join(spans.select(F.col("id").alias("span_id")), "span_id", "left_anti").select("id")
    page = F.col("vault_path").isNotNull() & (F.col("derivation") == "DETERMINISTIC")
    orphan = concepts.where(F.col("origin_proposal_id").isNull() & ~page).join(claims.select(F.col("subject_concept_id").alias("id")), "id", "left_anti").select("id")
    found = {
        "GR001": missing("from_id"), "GR002": missing("to_id"), "GR003": twice, "GR004": live.where(~F.col("type").isin(*LINK_TYPES)).select("id"), "GR005": live.where("agent is null or agent = ''").select("id"),
        "GR006": dangling, "GR007": bare, "GR008": orphan, "GR009": live.where("from_id = to_id").select("id"),
    }
    return _union([rows.select(F.lit(code).alias("code"), F.lit("error" if code in ERRORS else "warning").alias("severity"), F.col("id").alias("entity_id")) for code, rows in found.items()])


def days_since(at: Column, now: str) -> Column:
    """Whole days between a time and `now`."""
    return F.floor((F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000))


def gaps(concepts: DataFrame, claims: DataFrame, sources: DataFrame, links: DataFrame, inbound: DataFrame | None, questions: DataFrame, answers: DataFrame, proposals: DataFrame, *, now: str) -> DataFrame:
    """What the model lacks: kind, subject_id, weight.

    concepts: id, vault_path; claims: id, subject_concept_id, status, derivation; sources: claim_id, source_id; links: from_id, to_id;
    inbound: concept_id, inbound, or None where nobody counted, and then the edges of a concept stand for it; a concept that
    was not counted while others were is left out. questions: id, status, created_at; answers: question_id; proposals: id, type, status, target_id, created_at.
    """
    row = lambda df, kind, subject, weight: df.select(F.lit(kind).alias("kind"), subject.alias("subject_id"), F.round(weight, 6).alias("weight"))
    bare = concepts.join(claims.select(F.col("subject_concept_id").alias("id")), "id", "left_anti")
    if inbound is None:
        ends = links.select(F.col("from_id").alias("id")).union(links.select(F.col("to_id").alias("id")))
        alone = concepts.join(ends, "id", "left_anti")
    else:
        alone = concepts.join(inbound.where("inbound = 0").select(F.col("concept_id").alias("id")), "id", "left_semi")
    asked = questions.where("status = 'OPEN'").join(answers.select(F.col("question_id").alias("id")), "id", "left_anti")
    weeks = F.floor(F.greatest(days_since(F.col("created_at"), now), F.lit(0)) / 7)
    single = sources.groupBy(F.col("claim_id").alias("id")).agg(F.countDistinct("source_id").alias("n")).where("n = 1")
    single = claims.where("status = 'ACTIVE'").join(single, "id", "left_semi")
    days = days_since(F.col("created_at"), now)
    waiting = proposals.where("type = 'CLAIM_CONFLICT' and status = 'pending'").where(days >= STALE_DAYS)
    return _union([
        row(bare, "concept_without_claims", F.col("id"), F.when(F.col("vault_path").isNotNull(), PAGED).otherwise(BARE)),
        row(alone, "isolated_concept", F.col("id"), F.lit(ISOLATED)),
        row(asked, "question_without_answers", F.col("id"), F.least(F.lit(1.0), F.lit(ASKED) + F.lit(PER_WEEK) * weeks)),
        row(single, "claim_with_single_source", F.col("id"), F.when(F.col("derivation") == "MODEL", SINGLE_MODEL).otherwise(SINGLE)),
        row(claims.where("status = 'DISPUTED'"), "unresolved_dispute", F.col("id"), F.lit(DISPUTED)),
        row(waiting, "unresolved_dispute", F.coalesce("target_id", "id"), F.least(F.lit(1.0), F.lit(DISPUTED) + F.lit(PER_DAY) * (days - STALE_DAYS))),
    ])


def dissent(concepts: DataFrame, claims: DataFrame, proposals: DataFrame) -> DataFrame:
    """Conflicts that await review, by the concept or a claim on it: concept_id, proposal_id, claim_id (null where the concept itself is meant)."""
    open_ = proposals.where("type = 'CLAIM_CONFLICT' and status = 'pending'").select(F.col("id").alias("proposal_id"), "target_id")
    held = claims.where("subject_concept_id is not null").select(F.col("id").alias("target_id"), F.col("subject_concept_id").alias("concept_id"))
    by_claim = open_.join(held, "target_id").select("concept_id", "proposal_id", F.col("target_id").alias("claim_id"))
    by_concept = open_.join(concepts.select(F.col("id").alias("target_id")), "target_id").select(F.col("target_id").alias("concept_id"), "proposal_id", F.lit(None).cast("string").alias("claim_id"))
    return by_claim.unionByName(by_concept)


def unreferenced(concepts: DataFrame, inbound: DataFrame) -> DataFrame | None:
    """Concepts that no page links to: id. None, and not nothing, where inbound links were never counted."""
    if not inbound.limit(1).count():
        return None
    return inbound.where("inbound = 0").select(F.col("concept_id").alias("id")).join(concepts.select("id"), "id", "left_semi")


def vanished(links: DataFrame, planned: DataFrame, agent: str) -> DataFrame:
    """Links of one agent that its new plan (from_id, to_id, type) no longer has; those of others are never pruned: id."""
    return links.where(F.col("agent") == agent).join(planned.select("from_id", "to_id", "type"), ["from_id", "to_id", "type"], "left_anti").select("id")


def stale_concepts(concepts: DataFrame, planned: DataFrame) -> DataFrame:
    """Concepts made of a page that the plan no longer has: id."""
    return concepts.where("vault_path is not null and derivation = 'DETERMINISTIC'").join(planned.select("vault_path"), "vault_path", "left_anti").select("id")


# -- proposals


def listed(proposals: DataFrame, *, status: str | None = None, type: str | None = None, source: str | None = None, prefix: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Proposals that fulfil all that is given, oldest first, ties by id."""
    for name, value in (("status", status), ("type", type), ("source_id", source)):
        if value is not None:
            proposals = proposals.where(F.col(name) == value)
    if prefix is not None:
        proposals = proposals.where(F.col("id").startswith(prefix))
    ordered = proposals.orderBy("created_at", "id")
    ordered = ordered.offset(offset) if offset else ordered
    return ordered if limit is None else ordered.limit(limit)


def bulk_approvable(proposals: DataFrame, safety: str, *, include_ambiguous: bool = False) -> DataFrame:
    """Pending proposals of one safety class; ambiguous ones are never approved in bulk unless that is asked for."""
    if safety == "AMBIGUOUS" and not include_ambiguous:
        raise ValueError("ambiguous proposals are approved one by one, or with include_ambiguous")
    return proposals.where((F.col("status") == "pending") & (F.col("safety") == safety))


def by_name(concepts: DataFrame, name: str, *, namespace: str | None = None, any_case: bool = False) -> DataFrame:
    """Concepts of a name, in one namespace if given; with any_case ASCII letters are compared in lower case only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fold = (lambda c: F.translate(c, upper, lower)) if any_case else (lambda c: c)
    found = concepts.where(fold(F.col("name")) == fold(F.lit(name)))
    return found if namespace is None else found.where(F.col("namespace") == namespace)


def containing(concepts: DataFrame, part: str) -> DataFrame:
    """Concepts whose name or an alias contains a text, in any case."""
    low = F.lit(part.lower())
    return concepts.where(F.contains(F.lower("name"), low) | F.exists("aliases", lambda a: F.contains(F.lower(a), low)))


# -- activation


def refusal(resolved: Column | None = None) -> Column:
    """Why a proposal (type, status, safety) must not be activated, or null; resolved: whether a user settled what an ambiguous one means."""
    settled = F.lit(False) if resolved is None else F.coalesce(resolved, F.lit(False))
    return (
        F.when(F.col("status") == "activated", None).when(F.col("status") != "approved", F.concat(F.lit("not_approved:"), F.col("status")))
        .when(F.col("type") == "METADATA_REPAIR", "repairs_are_applied").when((F.col("safety") == "AMBIGUOUS") & ~settled, "ambiguous")
    )


def quoted(quote: Column, text: Column) -> Column:
    """QUOTES where the quote stands in the text, white space and case aside, else PARAPHRASES."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when((flat(quote) != "") & F.contains(flat(text), flat(quote)), "QUOTES").otherwise("PARAPHRASES")


def activate_claims(proposals: DataFrame, spans: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """What claim proposals become: outcomes (id, outcome, reason, claim_id), claims and evidence that are new.

    proposals: id, type, status, safety, statement, subject_concept_id, span_ids, quote, created_at; spans: id, text; stored: id.
    A claim is named by its statement and its first span that resolves. Of proposals for one claim the oldest creates it.
    A proposal cites few spans.
    """
    cited = proposals.select("id", F.posexplode("span_ids").alias("place", "span_id")).join(spans.select(F.col("id").alias("span_id"), "text"), "span_id")
    first = cited.groupBy("id").agg(F.min_by("span_id", "place").alias("first_span"))
    rows = proposals.join(first, "id", "left").withColumn("statement", F.trim("statement"))
    rows = rows.withColumn("reason", F.coalesce(refusal(), F.when(F.col("first_span").isNull(), "no_span_resolves")))
    rows = rows.withColumn("claim_id", F.when(F.col("reason").isNull(), entity_id("claim", F.col("statement"), F.col("first_span"))))
    order = Window.partitionBy("claim_id").orderBy("created_at", "id")
    live = rows.where("claim_id is not null").withColumn("nth", F.row_number().over(order))
    live = live.join(stored.select(F.col("id").alias("claim_id"), F.lit(True).alias("there")), "claim_id", "left")
    outcome = F.when(F.col("there") | (F.col("nth") > 1), "already_active").otherwise("created")
    live = live.withColumn("outcome", outcome)
    out = live.select("id", "outcome", F.lit(None).cast("string").alias("reason"), "claim_id")
    refused = rows.where("claim_id is null").select("id", F.lit("refused").alias("outcome"), "reason", "claim_id")
    made = live.where("outcome = 'created'")
    claims = made.select(F.col("claim_id").alias("id"), "statement", "subject_concept_id", F.lit("ACTIVE").alias("status"), F.col("id").alias("origin_proposal_id"))
    evidence = made.select("id", "claim_id", "quote").join(cited, "id").select("claim_id", "span_id", quoted(F.col("quote"), F.col("text")).alias("relation")).distinct()
    return {"outcomes": out.unionByName(refused), "claims": claims, "evidence": evidence}


def activate_matches(proposals: DataFrame, concepts: DataFrame) -> dict[str, DataFrame]:
    """What match proposals become: outcomes (id, outcome, reason) and the concepts with their new aliases.

    proposals: id, type, status, safety, alias, target (a concept's id or name), created_at; concepts: id, name, aliases. An alias that a concept has,
    in any case, is not added again; of proposals for one alias the oldest adds it.
    """
    rows = proposals.withColumn("alias", F.trim("alias")).withColumn("reason", refusal())
    ids = concepts.select(F.col("id").alias("by_id"), F.col("id").alias("concept_id"))
    names = concepts.groupBy(F.col("name").alias("by_name")).agg(F.min("id").alias("named_id"))
    rows = rows.join(ids, F.col("target") == F.col("by_id"), "left").join(names, F.col("target") == F.col("by_name"), "left")
    rows = rows.withColumn("concept_id", F.coalesce("concept_id", "named_id"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("concept_id").isNull(), "target_is_no_concept")))
    order = Window.partitionBy("concept_id", F.lower("alias")).orderBy("created_at", "id")
    fit = rows.where("reason is null").join(concepts.select(F.col("id").alias("concept_id"), "aliases"), "concept_id").withColumn("nth", F.row_number().over(order))
    has = F.exists("aliases", lambda a: F.lower(a) == F.lower("alias"))
    fit = fit.withColumn("outcome", F.when(has | (F.col("nth") > 1), "already_active").otherwise("created"))
    new = fit.where("outcome = 'created'").groupBy(F.col("concept_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "id", "alias"))), lambda x: x["alias"]).alias("new"))
    grown = concepts.join(new, "id", "left").withColumn("aliases", F.concat("aliases", F.coalesce("new", F.array().cast("array<string>")))).drop("new")
    refused = rows.where("reason is not null").select("id", F.lit("refused").alias("outcome"), "reason")
    return {"outcomes": fit.select("id", "outcome", F.lit(None).cast("string").alias("reason")).unionByName(refused), "concepts": grown}


def activate_concepts(proposals: DataFrame, concepts: DataFrame) -> dict[str, DataFrame]:
    """What proposals of new concepts become: outcomes (id, outcome, reason, concept_id) and the new concepts (id, name, origin_proposal_id).

    proposals: id, type, status, safety, name, created_at, resolved (a user settled the name). A concept is named by its normalised name.
    """
    rows = proposals.withColumn("reason", refusal(F.col("resolved"))).withColumn("norm", normalize(F.col("name")))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("norm") == "", "no_name")))
    there = concepts.groupBy(normalize(F.col("name")).alias("norm")).agg(F.min("id").alias("stored"))
    order = Window.partitionBy("norm").orderBy("created_at", "id")
    fit = rows.where("reason is null").join(there, "norm", "left").withColumn("nth", F.row_number().over(order))
    fit = fit.withColumn("outcome", F.when(F.col("stored").isNotNull() | (F.col("nth") > 1), "already_active").otherwise("created"))
    fit = fit.withColumn("concept_id", F.coalesce("stored", entity_id("concept", F.col("norm"))))
    new = fit.where("outcome = 'created'").select(F.col("concept_id").alias("id"), F.trim("name").alias("name"), F.col("id").alias("origin_proposal_id"))
    refused = rows.where("reason is not null").select("id", F.lit("refused").alias("outcome"), "reason", F.lit(None).cast("string").alias("concept_id"))
    return {"outcomes": fit.select("id", "outcome", F.lit(None).cast("string").alias("reason"), "concept_id").unionByName(refused), "concepts": new}


def activate_evolution(claims: DataFrame, evidence: DataFrame, approved: DataFrame, *, at: str) -> dict[str, DataFrame]:
    """Claims and evidence after approved proposals of an evolution, and their revisions.

    claims: id, statement, status, superseded_by; evidence: claim_id, span_id; approved: id, type (ADD_EVIDENCE, REFINE_CLAIM, MARK_CONFLICT),
    claim_id, span_ids, refined. Supporting spans are added where they are new; a refined claim is superseded by a new one that rests
    on the spans cited; a conflict marks a claim disputed and leaves its statement. A claim that is superseded is not disputed too.
    """
    known = approved.join(claims.select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
    refined = known.where("type = 'REFINE_CLAIM'").groupBy("claim_id").agg(F.min_by(F.struct("refined", "span_ids", F.col("id").alias("p")), "id").alias("r"))
    refined = refined.select("claim_id", "r.refined", "r.span_ids", F.col("r.p").alias("cause"), entity_id("claim", F.col("r.refined"), F.col("claim_id")).alias("new_id"))
    conflict = known.where("type = 'MARK_CONFLICT'").groupBy("claim_id").agg(F.min("id").alias("conflict"))
    both = claims.join(refined.select(F.col("claim_id").alias("id"), "new_id"), "id", "left").join(conflict.withColumnRenamed("claim_id", "id"), "id", "left")
    status = F.when(F.col("new_id").isNotNull(), "SUPERSEDED").when(F.col("conflict").isNotNull(), "DISPUTED").otherwise(F.col("status"))
    old = both.select("id", "statement", status.alias("status"), F.coalesce("new_id", "superseded_by").alias("superseded_by"), F.when(F.col("new_id").isNotNull(), F.lit(at)).alias("valid_to"))
    made = refined.select(F.col("new_id").alias("id"), F.col("refined").alias("statement"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("valid_to"))
    cited = known.where("type = 'ADD_EVIDENCE'").select("claim_id", F.explode("span_ids").alias("span_id")).union(refined.select("new_id", F.explode("span_ids"))).distinct()
    new = cited.join(evidence, ["claim_id", "span_id"], "left_anti")
    supported = new.join(claims.select(F.col("id").alias("claim_id")), "claim_id", "left_semi").select("claim_id").distinct()
    revise = lambda df, column, op: df.select(F.col(column).alias("entity_id"), F.lit(op).alias("op"), F.lit(at).alias("at"))
    disputed = conflict.join(refined.select("claim_id"), "claim_id", "left_anti")
    revisions = _union([revise(refined, "new_id", "CREATE"), revise(refined, "claim_id", "SUPERSEDE"), revise(disputed, "claim_id", "CHANGE"), revise(supported, "claim_id", "CHANGE")])
    return {"claims": old.unionByName(made), "evidence": evidence.select("claim_id", "span_id").unionByName(new), "revisions": revisions.distinct()}


# -- selection of text


def extraction_spans(spans: DataFrame, navigation: Column, *, least: int = 40, most: int = 12) -> DataFrame:
    """The spans of each document that are worth a model call: the longest, of `least` characters or more and no lists of links. Columns document_id, ordinal, text."""
    usable = spans.where((F.length(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))) >= least) & ~navigation)
    longest = Window.partitionBy("document_id").orderBy(F.length("text").desc(), "ordinal")
    return usable.withColumn("_n", F.row_number().over(longest)).where(F.col("_n") <= most).drop("_n")


#: Fixed value: a fenced block, up to the next fence or the end.
FENCE = r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)|\z)"


def from_code(quote: Column, text: Column) -> Column:
    """Whether a quote stands in fenced code of the text and not in its prose, white space and case aside."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    code, prose = F.array_join(F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), " "), F.regexp_replace(text, FENCE, " ")
    q = flat(quote)
    return F.coalesce((q != "") & F.contains(flat(code), q) & ~F.contains(flat(prose), q), F.lit(False))


def question_words(text: Column, stopwords: tuple[str, ...]) -> Column:
    """The words of a question that say something, each once, in order of the alphabet."""
    found = F.split(F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) > SHORT_WORD) & ~w.isin(*stopwords))))


def excerpt(text: Column, width: int = 110) -> Column:
    """The start of a text in one line, cut to a width."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)


def lexical_concepts(headings: DataFrame, hits: DataFrame, concepts: DataFrame, *, least: int = 4, most: int = 8) -> DataFrame:
    """Concepts that the first headings of the evidence name, either holding the other, where a search for the heading hits anything: concept, heading, place.

    headings: place, heading (of one piece of evidence); hits: place, n; concepts: concept.
    """
    asked = headings.where(F.length("heading") >= least).orderBy("place").limit(most).join(hits.where("n > 0").select("place"), "place", "left_semi")
    h = asked.select("place", "heading", normalize(F.col("heading")).alias("_h"))
    # the evidence has at most `most` headings
    rows = concepts.select("concept", normalize(F.col("concept")).alias("_c")).where(F.length("_c") >= least)
    near = rows.join(F.broadcast(h), F.contains("_h", F.col("_c")) | F.contains("_c", F.col("_h")))
    return near.groupBy("concept").agg(F.min_by("heading", "place").alias("heading"), F.min("place").alias("place"))
