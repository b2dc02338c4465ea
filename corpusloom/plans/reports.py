"""A report of the corpus in Markdown or HTML, from short tables alone, and the next steps it suggests."""

from __future__ import annotations

import html

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.links import RESOLVING

TOP = 50
#: Dead links that the page and the Markdown report show, sources shown of each, folders shown.
DEAD_LINKS, SOURCES_SHOWN, FOLDERS_SHOWN = {"page": 100, "markdown": 50}, 3, 20


def dead_links(resolved: DataFrame, most: int) -> DataFrame:
    """Targets that lead nowhere, most often linked first, then by name: target, links, sources, shown (the first few sources)."""
    bad = resolved.where(~F.col("status").isin(*RESOLVING))
    counts = bad.groupBy("target").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("source_path").alias("sources"))
    first = counts.orderBy(F.col("links").desc(), "target").limit(most)
    order = Window.partitionBy("target").orderBy("source_path")
    some = bad.select("target", "source_path").distinct().join(first.select("target"), "target", "left_semi")
    some = some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SOURCES_SHOWN)
    shown = some.groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("source_path")), ", ").alias("shown"))
    return first.join(shown, "target").select("target", "links", "sources", "shown")


def largest_folders(stats: DataFrame, most: int = FOLDERS_SHOWN) -> DataFrame:
    """Folders by their lines, most first, then by name."""
    return stats.orderBy(F.col("lines").desc(), "folder").limit(most)


def state(counts: dict[str, DataFrame]) -> DataFrame:
    """How many rows each table of a state has, as one row per fact: name, value."""
    rows = [df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value") for name, df in counts.items()]
    return reduce(DataFrame.unionByName, rows)


def _cells(df: DataFrame, limit: int) -> list[list[str]]:
    return [["" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]


def markdown(title: str, sections: dict[str, DataFrame], limit: int = TOP) -> str:
    """Sections as tables of at most `limit` rows; order them before."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in row) + " |" for row in _cells(df, limit)]
    return "\n".join(out) + "\n"


def page(title: str, sections: dict[str, DataFrame], limit: int = TOP) -> str:
    """The same as one HTML page."""
    body = []
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in row) + "</tr>" for row in _cells(df, limit))
        body.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{rows}</table>")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{"".join(body)}</body></html>'


def next_steps(counts: dict[str, int]) -> list[str]:
    """What to do next, most urgent first, from the counts of a state."""
    rules = (
        ("unresolved_links", "repair unresolved links"),
        ("pending_proposals", "review pending proposals"),
        ("disputed_claims", "settle disputed claims"),
        ("stale_syntheses", "renew stale syntheses"),
        ("unevidenced_claims", "find evidence for claims that have none"),
        ("open_questions", "answer open questions"),
    )
    return [f"{text} ({counts[name]})" for name, text in rules if counts.get(name)] or ["nothing to do"]
