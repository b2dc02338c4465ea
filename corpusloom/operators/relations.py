"""Typed relationships, changes of the model over time, mentions, and the plan that seeds a graph from a vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.graph import MAX_DEPTH, NEIGHBOUR_CAP
from corpusloom.operators.links import STRUCTURAL, normalize, stem
from corpusloom.operators.matching import held_names
from corpusloom.operators.model import LINK_TYPES
from corpusloom.sources.staging import staged

#: Revisions that a change report looks at, and nodes that a search visits.
SCAN, NODE_BUDGET = 20_000, 500
#: Letters of a name that can be mentioned, and spans that two concepts share to be related.
MENTION, SHARED = 6, 2


def relationships(links: DataFrame, *, types: tuple[str, ...] = (), direction: str = "both") -> DataFrame:
    """Active links as seen from each of their ends: node, neighbour, type, from_id, to_id. links: from_id, to_id, type, active."""
    live = links.where("active")
    live = live.where(F.col("type").isin(*types)) if types else live
    out = live.select(F.col("from_id").alias("node"), F.col("to_id").alias("neighbour"), "type", "from_id", "to_id")
    into = live.select(F.col("to_id").alias("node"), F.col("from_id").alias("neighbour"), "type", "from_id", "to_id")
    return {"out": out, "in": into, "both": out.union(into).distinct()}[direction]


def typed_neighbours(links: DataFrame, concepts: DataFrame, *, types: tuple[str, ...] = (), direction: str = "both", cap: int = NEIGHBOUR_CAP) -> DataFrame:
    """The first `cap` relationships of every node in order of type and ends: node, n, neighbour, type, name (null where it is no concept)."""
    order = Window.partitionBy("node").orderBy("type", "to_id", "from_id")
    first = relationships(links, types=types, direction=direction).withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    return first.join(concepts.select(F.col("id").alias("neighbour"), "name"), "neighbour", "left").select("node", "n", "neighbour", "type", "name")


def related_concepts(neighbours: DataFrame, concepts: DataFrame, start: str, depth: int, *, budget: int = NODE_BUDGET) -> DataFrame:
    """Concepts within `depth` steps (clamped to 1..3): id, name, depth; other nodes are passed through and not returned.

    neighbours: node, neighbour (capped, stored). After the round in which the budget of nodes is met the search stops.
    """
    seen = neighbours.sparkSession.createDataFrame([(start, 0)], "node string, depth int")
    front, held = seen, 0
    for d in range(1, max(1, min(depth, MAX_DEPTH)) + 1):
        reached = front.select("node").join(neighbours.select("node", "neighbour"), "node").select(F.col("neighbour").alias("node")).distinct()
        front = staged(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen, held = seen.unionByName(front), held + front.count()
        if held >= budget:
            break
    return seen.where("depth > 0").join(concepts.select(F.col("id").alias("node"), "name"), "node").select(F.col("node").alias("id"), "name", "depth")


def metrics(concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Facts of the graph as rows: metric, value. Ends that are no concepts count for degrees, not for nodes; branching is the mean over nodes with links."""
    live = links.where("active")
    degree = live.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = concepts.select("id", F.lit(1).alias("is")).join(degree, "id", "full_outer").select("is", F.coalesce("d", F.lit(0)).alias("d"))
    one = both.agg(
        F.coalesce(F.sum("is"), F.lit(0)).cast("double").alias("nodes"), F.coalesce(F.max("d"), F.lit(0)).cast("double").alias("max_degree"), F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 4).alias("mean_degree"),
        F.count_if((F.col("d") == 0) & F.col("is").isNotNull()).cast("double").alias("isolated"), F.round(F.coalesce(F.avg(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0)), 4).alias("branching"),
    )
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])).alias("r")).select("r.*")
    by_type = live.groupBy("type").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.concat(F.lit("type:"), "type").alias("metric"), "value")
    return rows.unionByName(by_type).unionByName(live.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("edges").alias("metric"), "value"))


def gated(proposed: DataFrame, known: DataFrame, spans: DataFrame) -> DataFrame:
    """Proposed relationships with their score and why each is refused, or null: id, score, refused.

    proposed: id, from_id, to_id, type, span_ids (those both ends share); known: id; spans: id. A proposal cites few spans.
    """
    cited = proposed.select("id", F.explode("span_ids").alias("s")).join(spans.select(F.col("id").alias("s")), "s").groupBy("id").agg(F.countDistinct("s").alias("n"))
    out = proposed.join(cited, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for end in ("from_id", "to_id"):
        out = out.join(known.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}")).distinct(), end, "left")
    reason = (
        F.when(~F.col("type").isin(*LINK_TYPES), "unsupported_type").when(F.col("from_id") == F.col("to_id"), "self_link").when(F.col("has_from_id").isNull() | F.col("has_to_id").isNull(), "missing_end")
        .when(F.col("n") == 0, "no_span_resolves").when((F.col("type") == "RELATED_TO") & (F.col("n") < SHARED), "too_few_spans")
    )
    return out.select("id", F.round(F.least(F.lit(1.0), F.col("n") / 5), 4).alias("score"), reason.alias("refused"))


def mentions(concepts: DataFrame, spans: DataFrame, *, least: int = MENTION) -> DataFrame:
    """Spans that mention a concept by name, letters and digits alone: concept, span_id.

    Names and texts meet as wholes (held_names). Only names are ever sent to all tasks, and these only where they are few: the texts, small as files where
    they repeat, are large in memory.
    """
    named = concepts.select(F.col("name").alias("concept"), normalize(F.col("name")).alias("name"))
    flat = staged(spans.select(F.col("id").alias("key"), normalize(F.col("text")).alias("hay")).where(F.length("hay") >= least), "normalised")
    return held_names(named, flat, least=least).select("concept", F.col("key").alias("span_id")).distinct()


# -- changes


def changes_since(revisions: DataFrame, since: str, until: str, *, scan: int = SCAN) -> DataFrame:
    """What changed in a closed window: entity_type, op, revisions, entities, ids, causes (sorted), truncated.

    As defined, only the newest `scan` revisions are looked at; truncated says that older ones of the window may be missing.
    revisions: seq, at, entity_type, entity_id, op, cause. The lists hold no more than what was looked at.
    """
    newest = revisions.orderBy(F.col("at").desc(), F.col("seq").desc()).limit(scan)
    inside = newest.where((F.col("at") >= F.to_timestamp(F.lit(since))) & (F.col("at") <= F.to_timestamp(F.lit(until))))
    cut = revisions.limit(scan + 1).count() > scan
    out = inside.groupBy("entity_type", "op").agg(
        F.count(F.lit(1)).alias("revisions"), F.countDistinct("entity_id").alias("entities"),
        F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("at", "seq", "entity_id")))), lambda r: r["entity_id"]).alias("ids"),
        F.array_sort(F.collect_set("cause")).alias("causes"),
    )
    return out.withColumn("truncated", F.lit(cut))


def entered(revisions: DataFrame, state: str) -> DataFrame:
    """Revisions by which an entity came into a state that it was not in before: entity_id, seq. revisions: entity_id, seq, op."""
    order = Window.partitionBy("entity_id").orderBy("seq")
    return revisions.withColumn("_p", F.lag("op").over(order)).where((F.col("op") == state) & ~F.col("_p").eqNullSafe(state)).select("entity_id", "seq")


def trace(revisions: DataFrame, cause: str) -> DataFrame:
    """Everything that one cause did, in order."""
    return revisions.where(F.col("cause") == cause).orderBy("seq")


def dependents_stale(synthesis_claims: DataFrame, superseded: DataFrame) -> DataFrame:
    """Syntheses that rest on a claim that was superseded: synthesis_id, claims. superseded: id."""
    hit = synthesis_claims.join(superseded.select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
    return hit.groupBy("synthesis_id").agg(F.countDistinct("claim_id").alias("claims"))


# -- seeding and reading a vault


def seed_concepts(paths: DataFrame, decided: DataFrame) -> DataFrame:
    """What each page becomes: path, name, outcome (concept, namespaced, undecided_collision, structural).

    paths: path; decided: path, of pages that a user kept apart from others of their name.
    """
    rows = paths.select("path", stem(F.col("path")).alias("name")).withColumn("norm", normalize(F.col("name")))
    groups = rows.groupBy("norm").agg(F.countDistinct("path").alias("n"))
    both = rows.join(groups, "norm").join(decided.select("path", F.lit(True).alias("kept")).distinct(), "path", "left")
    outcome = F.when(F.col("name").rlike(STRUCTURAL) | (F.col("norm") == ""), "structural").when(F.col("n") == 1, "concept").when(F.col("kept"), "namespaced").otherwise("undecided_collision")
    return both.select("path", "name", outcome.alias("outcome"))


def seed_links(resolved: DataFrame, seeded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One RELATED_TO link of score 1 for each pair of pages that became concepts (from_path, to_path), and how many links were left out, by status or outside_the_graph."""
    nodes = seeded.where(F.col("outcome").isin("concept", "namespaced")).select("path")
    source, target = nodes.select(F.col("path").alias("source_path"), F.lit(True).alias("s")), nodes.select(F.col("path").alias("resolved_path"), F.lit(True).alias("t"))
    rows = resolved.join(source, "source_path", "left").join(target, "resolved_path", "left")
    inside = F.col("s").isNotNull() & F.col("t").isNotNull()
    links = rows.where(inside & (F.col("source_path") != F.col("resolved_path"))).select(F.col("source_path").alias("from_path"), F.col("resolved_path").alias("to_path")).distinct()
    why = F.when(F.col("resolved_path").isNull(), F.col("status")).when(~inside, "outside_the_graph").when(F.col("source_path") == F.col("resolved_path"), "self")
    left_out = rows.select(why.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("links"))
    return links.withColumn("type", F.lit("RELATED_TO")).withColumn("score", F.lit(1.0)), left_out


def blocks(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of each text with where they lie: key, line (from 1), char_start, char_end (code points, end exclusive), text. Blank lines are left out."""
    lines = docs.select(key, F.split(F.col(text), "\n").alias("s"))
    ends = F.aggregate("s", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(x) + 1)))
    rows = lines.withColumn("e", ends).select(key, "e", F.posexplode("s").alias("at", "text"))
    start = F.get("e", F.col("at"))
    return rows.where(F.trim("text") != "").select(key, (F.col("at") + 1).alias("line"), start.alias("char_start"), (start + F.char_length("text")).alias("char_end"), "text")


def citation(first_page: Column, last_page: Column, heading_path: Column, locator: Column) -> Column:
    """Where a span stands: p.3 or pp.3-4, then its headings; the locator where neither is known."""
    pages = F.when(first_page.isNull(), None).when(F.coalesce(last_page, first_page) == first_page, F.concat(F.lit("p."), first_page)).otherwise(F.concat(F.lit("pp."), first_page, F.lit("-"), last_page))
    heads = F.when(F.size(heading_path) > 0, F.array_join(heading_path, " > "))
    place = F.concat_ws(" | ", pages, heads)
    return F.when(place != "", place).otherwise(locator)


#: States of a source, the first that fits.
def source_status(found: Column, supported: Column, unchanged: Column, failed: Column, has_text: Column) -> Column:
    return (
        F.when(~found, "not_found").when(~supported, "unsupported").when(unchanged, "unchanged").when(failed, "parse_failed").when(~has_text, "ocr_required").otherwise("ingested")
    )


def to_ingest(now: DataFrame, stored: DataFrame, spans: DataFrame, chunker: str, *, key: str = "path") -> DataFrame:
    """Files whose content is new, or of which no span of this chunker is stored. now, stored: key, content_hash; spans: key, chunk_strategy."""
    cut = spans.where(F.col("chunk_strategy") == chunker).select(key).distinct()
    done = stored.select(key, "content_hash").join(cut, key, "left_semi")
    return now.join(done, [key, "content_hash"], "left_anti")
