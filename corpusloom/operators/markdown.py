"""Markdown operators: code masking, headings, heading spans, structural chunks, frontmatter diagnostics."""

from __future__ import annotations

import re

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

#: A fenced block: from a line of three or more of one mark to the next that starts with three of it, or to the end.
FENCED = re.compile(r"^ {0,3}([`~])\1\1.*?(?:\n {0,3}\1{3}[^\n]*|\Z)", re.M | re.S)
#: Fixed value: code within a line.
INLINE_CODE = re.compile(r"`[^`\n]*`")
#: Fixed values of the chunker, in characters.
MAX_CHUNK, MIN_CHUNK = 2400, 80
#: Frontmatter codes and their severities.
SEVERITY = {"FM001": "error", "FM002": "warning", "FM003": "info", "FM004": "error", "FM005": "warning", "FM007": "info", "FM008": "warning"}


def masked(text: str) -> str:
    """Text with code blanked: fenced lines become empty, inline code becomes spaces, line numbers stay."""
    prose = FENCED.sub(lambda block: "\n" * block[0].count("\n"), text)
    return INLINE_CODE.sub(lambda code: " " * len(code[0]), prose)


@F.pandas_udf(StringType())
def mask_code(texts: pd.Series) -> pd.Series:
    return texts.map(masked, na_action="ignore")


def headings(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Headings outside code: key, line (from 1), level, heading."""
    lines = docs.select(key, F.posexplode(F.split(mask_code(F.col(text)), "\n")).alias("at", "s"))
    m = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
    found = lines.where(F.col("s").rlike(r"^#{1,6}\s+\S"))
    return found.select(key, (F.col("at") + 1).alias("line"), F.length(F.regexp_extract("s", m, 1)).alias("level"), F.regexp_extract("s", m, 2).alias("heading"))


def heading_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans from heading to heading, with a preamble before the first: key, ordinal, start_line, end_line, path.

    Spans without a word under their heading are left out and take no ordinal; a text without headings
    is one span. The path holds the headings that are still open: for each level the last one above,
    unless a higher heading has come since.
    """
    heads = headings(docs, key=key, text=text)
    order = Window.partitionBy(key).orderBy("line")
    above = order.rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 7):
        own = F.last(F.when(F.col("level") == k, F.struct("line", "heading")), True).over(above)
        cut = F.max(F.when(F.col("level") < k, F.col("line"))).over(above)
        heads = heads.withColumn(f"_h{k}", F.when(cut.isNull() | (cut < own["line"]), own["heading"]))
    path = F.array_compact(F.array(*[F.when(F.lit(k) <= F.col("level"), F.col(f"_h{k}")) for k in range(1, 7)]))
    heads = heads.select(key, F.col("line").alias("start_line"), F.array_join(path, " > ").alias("path"))
    lines = docs.select(key, F.split(text, "\n").alias("_lines"))
    starts = lines.select(key, F.lit(1).alias("start_line"), F.lit("").alias("path")).join(heads.where("start_line = 1").select(key), key, "left_anti").unionByName(heads)
    end = F.lead("start_line").over(Window.partitionBy(key).orderBy("start_line")) - 1
    spans = starts.withColumn("end_line", end).join(lines, key).withColumn("end_line", F.coalesce("end_line", F.size("_lines")))
    skip = F.when(F.col("path") == "", 0).otherwise(1)
    body = F.array_join(F.slice("_lines", F.col("start_line") + skip, F.greatest(F.col("end_line") - F.col("start_line") + 1 - skip, F.lit(0))), "\n")
    spans = spans.where(F.trim(F.regexp_replace(body, r"\s+", " ")) != "")
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("start_line")) - 1
    return spans.select(key, ordinal.alias("ordinal"), "start_line", "end_line", "path")


def grouped_blocks(blocks: pd.DataFrame) -> list[list[int]]:
    """Row positions of the chunks of one document's blocks (text, is_heading, heading_path, page), in order."""
    size = [len(t) + 1 for t in blocks["text"]]
    head = list(blocks["is_heading"])
    place = list(zip(blocks["heading_path"].map(lambda p: tuple(p) if p is not None else ()), blocks["page"].fillna(-1)))
    groups: list[list[int]] = []
    for i in range(len(blocks)):
        last = groups[-1] if groups else None
        joins = last is not None and (
            (head[i] and head[last[-1]])
            or (not head[i] and place[i] == place[last[-1]] and sum(size[j] for j in last) < MAX_CHUNK)
        )
        groups[-1].append(i) if joins else groups.append([i])
    merged: list[list[int]] = []
    carried: list[int] = []
    for g in groups:
        whole = carried + g
        tiny = len(groups) > 1 and sum(size[j] for j in g) < MIN_CHUNK and all(head[j] for j in g)
        carried = whole if tiny else []
        if not tiny:
            merged.append(whole)
    if carried:
        merged = [*merged[:-1], merged[-1] + carried] if merged else [carried]
    out: list[list[int]] = []
    for g in merged:
        piece: list[int] = []
        for j in g:
            if piece and sum(size[k] for k in piece) + size[j] > MAX_CHUNK:
                out.append(piece)
                piece = []
            piece.append(j)
        out.append(piece)
    return out


def structural_chunks(blocks: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Chunks of located blocks (key, ordinal, text, is_heading, heading_path, page): key, chunk, first, last, chars.

    A fold in order of the blocks of one document, so each document is one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal").reset_index(drop=True)
        rows = []
        for n, g in enumerate(grouped_blocks(pdf)):
            rows.append((pdf[key].iloc[0], n, int(pdf["ordinal"].iloc[g[0]]), int(pdf["ordinal"].iloc[g[-1]]), int(sum(len(pdf["text"].iloc[j]) for j in g))))
        return pd.DataFrame(rows, columns=[key, "chunk", "first", "last", "chars"])

    return blocks.groupBy(key).applyInPandas(run, f"{key} {blocks.schema[key].dataType.simpleString()}, chunk int, first int, last int, chars bigint")


def frontmatter_codes(text: str | None) -> list[str]:
    """Diagnostic codes of the frontmatter of a file."""
    lines = (text or "").split("\n")
    end = next((i for i, s in enumerate(lines[1:], 1) if s.rstrip() in ("---", "...")), None) if lines[0].strip() == "---" else None
    if end is None:
        return ["FM003"]
    block = lines[1:end]
    if not any(s.strip() for s in block):
        return ["FM007"]
    keys = [m[1] for s in block if (m := re.match(r"([A-Za-z_][\w-]*)\s*:", s))]
    codes = {"FM005"} if len(keys) != len(set(keys)) else set()
    if any(re.search(r"\[\[[^\[\]]+\](?!\])\s*$", s) for s in block):
        codes.add("FM008")
    try:
        value = yaml.safe_load("\n".join(block))
    except yaml.YAMLError:
        return sorted(codes | {"FM001"})
    if value is None:
        return ["FM007"]
    if not isinstance(value, dict):
        return sorted(codes | {"FM004"})
    if any(isinstance(v, list) and any(isinstance(x, list) for x in v) for v in value.values()):
        codes.add("FM002")
    return sorted(codes)


@F.pandas_udf(ArrayType(StringType()))
def diagnose(texts: pd.Series) -> pd.Series:
    return texts.map(frontmatter_codes)


def diagnostics(files: DataFrame, *, path: str = "path", text: str = "text") -> DataFrame:
    """One row per finding: path, code, severity."""
    found = files.select(path, F.explode(diagnose(F.col(text))).alias("code"))
    return found.withColumn("severity", F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("code")])


def navigation(text: Column) -> Column:
    """Whether a span is a list of links: four linked lines or more, and at least half of its lines."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    linked = F.size(F.filter(lines, lambda s: s.rlike(r"\[[^\]]*\]\([^)]*\)|\[\[[^\]]+\]\]")))
    return (linked >= 4) & (linked * 2 >= F.size(lines))
