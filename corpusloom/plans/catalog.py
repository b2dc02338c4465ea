"""The read capabilities over the tables of the knowledge model; each returns a DataFrame.

Lists are pages: at most MAX_PAGE rows from an offset in a total order, with the total before paging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import knowledge as K
from corpusloom.operators import model as D
from corpusloom.operators import relations as R
from corpusloom.operators.search import bm25, top_k
from corpusloom.sources.staging import staged

MAX_PAGE = 200


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    cut = rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, MAX_PAGE)))
    return cut.join(F.broadcast(total))


class Catalog:
    """Reads of one state of the knowledge model. tables: those of sources.schema by name."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.t = tables

    def get_stats(self) -> DataFrame:
        out = None
        for name, df in self.t.items():
            one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
            out = one if out is None else out.unionByName(one)
        return out

    def list_concepts(self, contains: str = "", kind: str | None = None, **at: int) -> DataFrame:
        """Concepts whose name or an alias contains a text, in any case."""
        low = F.lit(contains.lower())
        rows = self.t["concepts"].where(F.contains(F.lower("canonical_name"), low) | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), low)), F.lit(False)))
        return page(rows if kind is None else rows.where(F.col("kind") == kind), [F.lower("canonical_name"), F.col("id")], **at)

    def get_concept(self, id: str) -> DataFrame:
        claims = self.t["claims"].where(F.col("subject_concept_id") == id).agg(F.count(F.lit(1)).alias("claims"))
        links = self._edges().where(F.col("node") == id).agg(F.count(F.lit(1)).alias("links"))
        return self.t["concepts"].where(F.col("id") == id).join(F.broadcast(claims)).join(F.broadcast(links))

    def _edges(self) -> DataFrame:
        live = self.t["links"].where("active")
        return live.select(F.col("from_id").alias("node"), F.col("to_id").alias("neighbour"), "type").union(live.select("to_id", "from_id", "type"))

    def list_concept_neighbors(self, id: str, **at: int) -> DataFrame:
        near = self._edges().where(F.col("node") == id)
        named = near.join(self.t["concepts"].select(F.col("id").alias("neighbour"), "canonical_name"), "neighbour", "left")
        return page(named, [F.col("type"), F.col("neighbour")], **at)

    def list_claims(self, concept_id: str | None = None, status: str | None = None, **at: int) -> DataFrame:
        rows = self.t["claims"]
        rows = rows if concept_id is None else rows.where(F.col("subject_concept_id") == concept_id)
        return page(rows if status is None else rows.where(F.col("status") == status), [F.col("id")], **at)

    def get_claim(self, id: str) -> DataFrame:
        return self.t["claims"].where(F.col("id") == id)

    def _located(self, spans: DataFrame) -> DataFrame:
        docs = self.t["documents"].select(F.col("id").alias("document_id"), "source_id")
        sources = self.t["sources"].select(F.col("id").alias("source_id"), "locator", "trust_tier")
        place = F.concat_ws(" | ", F.when(F.col("page").isNotNull(), F.concat(F.lit("p."), F.col("page"))), F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")))
        return spans.join(docs, "document_id", "left").join(sources, "source_id", "left").withColumn("citation", F.when(place != "", place).otherwise(F.col("locator")))

    def get_claim_evidence(self, id: str) -> DataFrame:
        cited = self.t["evidence"].where(F.col("claim_id") == id).select(F.col("span_id").alias("id"), "relation")
        return self._located(cited.join(self.t["spans"], "id", "left"))

    def get_span(self, id: str) -> DataFrame:
        return self._located(self.t["spans"].where(F.col("id") == id))

    def list_sources(self, contains: str = "", **at: int) -> DataFrame:
        """Sources whose locator or title contains a text, in any case."""
        low = F.lit(contains.lower())
        fit = F.contains(F.lower("locator"), low) | F.coalesce(F.contains(F.lower("title"), low), F.lit(False))
        return page(self.t["sources"].where(fit), [F.col("locator"), F.col("id")], **at)

    def get_source(self, id: str) -> DataFrame:
        versions = self.t["documents"].where(F.col("source_id") == id).agg(F.count(F.lit(1)).alias("versions"), F.max("version").alias("latest"))
        return self.t["sources"].where(F.col("id") == id).join(F.broadcast(versions))

    def list_entity_revisions(self, entity_id: str) -> DataFrame:
        return self.t["revisions"].where(F.col("entity_id") == entity_id).orderBy("seq")

    def list_recent_revisions(self, limit: int = 50) -> DataFrame:
        return self.t["revisions"].orderBy(F.col("seq").desc()).limit(max(1, min(limit, MAX_PAGE)))

    def search_spans(self, text: str, limit: int = 10) -> DataFrame:
        """All terms must occur; ranked by BM25."""
        best = top_k(bm25(self.t["spans"], text, key="id", mode="and"), limit, key="id")
        return self._located(best.join(self.t["spans"], "id")).orderBy(F.col("score").desc(), "id")

    def find_path(self, start: str, goal: str, depth: int = 6) -> DataFrame:
        """One shortest path of ids within the bound, the least in order; each round is one join."""
        step = staged(self._edges().select("node", "neighbour").distinct(), "steps")
        front = self.t["concepts"].where(F.col("id") == start).select(F.col("id").alias("node"), F.array("id").alias("path"))
        found, seen = front.where(F.col("node") == goal), front.select("node")
        for _ in range(max(1, min(depth, 6))):
            grown = front.join(step, "node").select(F.col("neighbour").alias("node"), F.concat("path", F.array("neighbour")).alias("path"))
            front = staged(grown.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")), "frontier")
            found, seen = found.unionByName(front.where(F.col("node") == goal)), seen.union(front.select("node"))
        return found.orderBy(F.size("path"), "path").limit(1).select((F.size("path") - 1).alias("length"), "path")

    def get_belief(self, concept_id: str) -> DataFrame:
        spans = self.t["spans"].select(F.col("id").alias("span_id"), "document_id")
        docs = self.t["documents"].select(F.col("id").alias("document_id"), "source_id")
        evidence = self.t["evidence"].join(spans, "span_id").join(docs, "document_id").select("claim_id", "source_id")
        claims = self.t["claims"].where(F.col("subject_concept_id") == concept_id).select(F.col("id").alias("claim_id"), F.col("subject_concept_id").alias("concept_id"), "status")
        return K.beliefs(self.t["concepts"].where(F.col("id") == concept_id).select(F.col("id").alias("concept_id")), claims, evidence)

    def list_questions(self, open_only: bool = False, **at: int) -> DataFrame:
        rows = self.t["questions"]
        return page(rows.where("status in ('OPEN', 'PARTIALLY_ANSWERED')") if open_only else rows, [F.col("created_at"), F.col("id")], **at)

    def get_question(self, id: str) -> DataFrame:
        answers = self.t["answers"].where(F.col("question_id") == id).agg(F.count(F.lit(1)).alias("answers"))
        return self.t["questions"].where(F.col("id") == id).join(F.broadcast(answers))

    def get_question_evidence(self, id: str, limit: int = 10) -> DataFrame:
        """Spans for the question's words, without those that its answers already cite. One question's text is read first."""
        row = self.t["questions"].where(F.col("id") == id).select("text").first()
        cited = self.t["answers"].where(F.col("question_id") == id).join(self.t["evidence"], "claim_id").select(F.col("span_id").alias("id"))
        return top_k(bm25(self.t["spans"], row.text if row else "", key="id").join(cited, "id", "left_anti"), limit, key="id")

    def list_gaps(self, **at: int) -> DataFrame:
        """Concepts without claims, claims without evidence and disputed claims, heaviest first."""
        kinds = (
            ("no_claims", self.t["concepts"].join(self.t["claims"].select(F.col("subject_concept_id").alias("id")), "id", "left_anti")),
            ("unevidenced", self.t["claims"].join(self.t["evidence"].select(F.col("claim_id").alias("id")), "id", "left_anti")),
            ("disputed", self.t["claims"].where("status = 'DISPUTED'")),
        )
        out = None
        for kind, rows in kinds:
            one = rows.select(F.lit(kind).alias("kind"), F.col("id").alias("subject_id"), F.lit(K.WEIGHTS[kind]).alias("weight"))
            out = one if out is None else out.unionByName(one)
        return page(out, [F.col("weight").desc(), F.col("kind"), F.col("subject_id")], **at)

    def list_proposals(self, status: str | None = None, type: str | None = None, prefix: str | None = None, **at: int) -> DataFrame:
        return page(D.listed(self.t["proposals"], status=status, type=type, prefix=prefix), [F.col("created_at"), F.col("id")], **at)

    def list_typed_neighbors(self, id: str, types: tuple[str, ...] = (), direction: str = "both") -> DataFrame:
        """The first fifty relationships of a concept in order of type and ends."""
        concepts = self.t["concepts"].select("id", F.col("canonical_name").alias("name"))
        near = self.t["links"].where((F.col("from_id") == id) | (F.col("to_id") == id))
        return R.typed_neighbours(near, concepts, types=types, direction=direction).where(F.col("node") == id).orderBy("n")

    def _flat(self) -> dict[str, DataFrame]:
        """Concepts, claims and links with what their provenance says of them."""
        p = "provenance"
        return {
            "concepts": self.t["concepts"].select("id", "vault_path", F.col(f"{p}.derivation").alias("derivation"), F.lit(None).cast("string").alias("origin_proposal_id")),
            "claims": self.t["claims"].select("id", "subject_concept_id", "status", F.col(f"{p}.tier").alias("tier"), F.col(f"{p}.derivation").alias("derivation")),
            "links": self.t["links"].select("id", "from_id", "to_id", "type", F.col(f"{p}.agent").alias("agent"), "active"),
        }

    def get_integrity(self) -> DataFrame:
        flat = self._flat()
        return D.integrity(flat["concepts"], flat["claims"], self.t["evidence"], self.t["spans"], flat["links"]).orderBy("code", "entity_id")

    def list_knowledge_gaps(self, now: str, inbound: DataFrame | None = None, **at: int) -> DataFrame:
        """All five kinds of gaps, heaviest first."""
        flat = self._flat()
        spans = self.t["spans"].select(F.col("id").alias("span_id"), "document_id").join(self.t["documents"].select(F.col("id").alias("document_id"), "source_id"), "document_id")
        sources = self.t["evidence"].join(spans, "span_id").select("claim_id", "source_id")
        found = D.gaps(flat["concepts"], flat["claims"], sources, flat["links"].where("active"), inbound, self.t["questions"], self.t["answers"], self.t["proposals"], now=now)
        return page(found, [F.col("weight").desc(), F.col("kind"), F.col("subject_id")], **at)

    def get_dissent(self, concept_id: str) -> DataFrame:
        """Conflicts on a concept or its claims that await review."""
        return D.dissent(self.t["concepts"], self.t["claims"], self.t["proposals"]).where(F.col("concept_id") == concept_id)

    def get_changes(self, since: str, until: str) -> DataFrame:
        return K.changes_between(self.t["revisions"].select("at", "entity_id", "op"), since, until)

    def list_syntheses(self, **at: int) -> DataFrame:
        return page(self._stale(), [F.col("generated_at").desc(), F.col("id")], **at)

    def get_synthesis(self, id: str) -> DataFrame:
        return self._stale().where(F.col("id") == id)

    def _stale(self) -> DataFrame:
        """Syntheses with the reason for which they are stale, or null: the first claim, in order of id, that drifted."""
        fields = ("status", "statement", "superseded_by")
        seen = self.t["synthesis_claims"].withColumn("_pair", F.struct("synthesis_id", "claim_id"))
        now = self.t["claims"].select(F.col("id").alias("claim_id"), *fields)
        current = seen.select("_pair", "claim_id").join(now, "claim_id").drop("claim_id")
        drifted = K.staleness(seen, current, fields, key="_pair")
        why = drifted.groupBy(F.col("_pair.synthesis_id").alias("id")).agg(F.min_by("reason", "_pair").alias("stale_reason"))
        return self.t["syntheses"].join(why, "id", "left")
