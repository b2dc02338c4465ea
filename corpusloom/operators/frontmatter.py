"""Frontmatter and lines of Markdown files: the block, its wikilinks and tags, repairs and their application."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from corpusloom.functions.text import let
from corpusloom.operators.corpus import tags
from corpusloom.operators.links import WIKILINK, wikilinks
from corpusloom.operators.markdown import headings, mask_code

#: A line of a key and its value, and a wikilink that lost its last bracket.
KEY_VALUE = r"^(\s*)([A-Za-z_][\w-]*)\s*:\s*(.*)$"
TRUNCATED = r"\[\[([^\[\]]+?)\](?!\])\s*$"
#: What may stand between the links of a value that can be repaired.
BETWEEN = " ,[]"


def block_end(lines: Column) -> Column:
    """The number (from 1) of the line that closes the frontmatter, 0 where there is none."""
    closing = F.filter(F.sequence(F.lit(2), F.size(lines)), lambda i: F.rtrim(F.element_at(lines, i)).isin("---", "..."))
    first = F.when(F.size(lines) > 1, F.element_at(F.concat(closing, F.array(F.lit(0))), 1)).otherwise(0)
    return F.when(F.trim(F.element_at(lines, 1)) == "---", first).otherwise(0)


def block_lines(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """The lines within the frontmatter of each file: key, line (from 1 in the file), text."""
    split = files.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("s")).withColumn("end", block_end(F.col("s")))
    inside = split.where("end > 0").select(key, F.posexplode(F.slice("s", 2, F.col("end") - 2)).alias("at", "text"))
    return inside.select(key, (F.col("at") + 2).alias("line"), "text")


def prose_lines(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """The lines of each file after its frontmatter, code blanked: key, line (from 1 in the file), text."""
    split = files.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("s")).withColumn("end", block_end(F.col("s")))
    body = mask_code(F.array_join(F.slice("s", F.col("end") + 1, F.greatest(F.size("s") - F.col("end"), F.lit(0))), "\n"))
    rows = split.select(key, "end", F.posexplode(F.split(body, "\n")).alias("at", "text"))
    return rows.select(key, (F.col("at") + 1 + F.col("end")).alias("line"), "text")


def all_wikilinks(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """Wikilinks of text and frontmatter, none of code: key, line, target, anchor, alias, in_frontmatter."""
    body = wikilinks(prose_lines(files, key=key, text=text)).withColumn("in_frontmatter", F.lit(False))
    front = wikilinks(block_lines(files, key=key, text=text)).withColumn("in_frontmatter", F.lit(True))
    return body.unionByName(front).drop("text")


def names_in(value: Column) -> Column:
    """Wikilink names of a value in order, a last one that lost a bracket included."""
    whole = F.transform(F.regexp_extract_all(value, F.lit(WIKILINK), F.lit(1)), lambda n: F.trim(n))
    cut = F.trim(F.regexp_extract(F.regexp_replace(value, WIKILINK, ""), TRUNCATED, 1))
    return F.filter(F.concat(whole, F.array(cut)), lambda n: n != "")


def field_links(files: DataFrame, field: str, *, key: str = "path", text: str = "text") -> DataFrame:
    """Names in the first line of a field, whether the block is YAML or not: key, names."""
    rows = block_lines(files, key=key, text=text).where(F.regexp_extract("text", KEY_VALUE, 2) == field)
    first = rows.groupBy(key).agg(F.min_by("text", "line").alias("text"))
    return first.select(key, names_in(F.regexp_extract("text", KEY_VALUE, 3)).alias("names"))


def repairs(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """Lines whose value is nothing but wikilinks, with the same links as a list of quoted names: key, line, field, before, after, truncated."""
    part = lambda i: F.regexp_extract("text", KEY_VALUE, i)
    rows = block_lines(files, key=key, text=text).where(F.col("text").rlike(KEY_VALUE) & F.contains(part(3), F.lit("[[")))
    rest = F.regexp_replace(part(3), WIKILINK, "")
    rows = rows.select(key, "line", part(2).alias("field"), F.col("text").alias("before"), part(1).alias("indent"), names_in(part(3)).alias("names"), rest.rlike(TRUNCATED).alias("truncated"), F.regexp_replace(rest, TRUNCATED, "").alias("rest"))
    quoted = F.transform("names", lambda n: F.concat(F.lit('"[['), F.replace(F.replace(n, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit(']]"')))
    after = F.concat("indent", "field", F.lit(": ["), F.array_join(quoted, ", "), F.lit("]"))
    fit = rows.where((F.size("names") > 0) & (F.translate("rest", BETWEEN, "") == ""))
    return fit.select(key, "line", "field", "before", after.alias("after"), "truncated")


def apply_repairs(files: DataFrame, approved: DataFrame, *, key: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Files with the approved lines replaced, and what became of each repair: key, line, refused (null if applied).

    A line is replaced only if the file is there and the line still reads as it did when the repair was proposed. A file has few repairs.
    """
    split = files.select(F.col(key).alias("_file"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_s"))
    judged = approved.join(split, F.col(key) == F.col("_file"), "left")
    reason = F.when(F.col("_file").isNull(), "file_is_gone").when((F.col("line") < 1) | (F.col("line") > F.size("_s")), "line_out_of_range").when(F.get("_s", F.col("line") - 1) != F.col("before"), "line_has_changed")
    judged = judged.select(key, "line", "after", reason.alias("refused"))
    good = judged.where("refused is null").groupBy(F.col(key).alias("_file")).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("line", "after")))).alias("_new"))
    both = files.join(good, F.col(key) == F.col("_file"), "left")
    fixed = let(F.split(F.col(text), "\n"), lambda s: F.array_join(F.transform(s, lambda x, i: F.coalesce(F.element_at(F.col("_new"), i + 1), x)), "\n"))
    out = both.select(*[F.when(F.col("_new").isNull(), F.col(c)).otherwise(fixed).alias(c) if c == text else F.col(c) for c in files.columns])
    return out, judged.select(key, "line", "refused")


def _block(text: str | None) -> object:
    lines = (text or "").split("\n")
    end = next((i for i, s in enumerate(lines[1:], 1) if s.rstrip() in ("---", "...")), None) if lines[0].strip() == "---" else None
    return None if end is None else yaml.safe_load("\n".join(lines[1:end]))


@F.pandas_udf(BooleanType())
def sound(texts: pd.Series) -> pd.Series:
    """Whether the frontmatter of each file is a mapping without lists in lists."""

    def of(text: str | None) -> bool:
        try:
            value = _block(text)
        except yaml.YAMLError:
            return False
        return isinstance(value, dict) and not any(isinstance(v, list) and any(isinstance(x, list) for x in v) for v in value.values())

    return texts.map(of)


def verified(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """Files for which there are repairs, and whether all of them together give sound frontmatter: key, repairs, verified."""
    found = repairs(files, key=key, text=text)
    mended, _ = apply_repairs(files, found, key=key, text=text)
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("repairs")).join(mended.select(key, sound(F.col(text)).alias("verified")), key)


@F.pandas_udf(ArrayType(StringType()))
def block_tags(texts: pd.Series) -> pd.Series:
    """Tags of the frontmatter: a list of texts, or one text split at blanks and commas."""

    def of(text: str | None) -> list[str]:
        try:
            value = _block(text)
        except yaml.YAMLError:
            return []
        given = value.get("tags") if isinstance(value, dict) else None
        found = given.replace(",", " ").split() if isinstance(given, str) else [x for x in given if isinstance(x, str)] if isinstance(given, list) else []
        return [t.strip() for t in found if t.strip()]

    return texts.map(of)


def all_tags(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """Tags of each file, those of the frontmatter first, each once: key, tags."""
    lines = prose_lines(files, key=key, text=text).select(key, "line", tags(F.col("text")).alias("t")).where(F.size("t") > 0)
    inline = lines.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"])).alias("inline"))
    rows = files.select(key, block_tags(F.col(text)).alias("front")).join(inline, key, "left")
    return rows.select(key, F.array_distinct(F.concat("front", F.coalesce("inline", F.array().cast("array<string>")))).alias("tags"))


def titles(files: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """The first heading of level one of each file, null where it has none: key, title."""
    first = headings(files, key=key, text=text).where("level = 1").groupBy(key).agg(F.min_by("heading", "line").alias("title"))
    return files.select(key).join(first, key, "left")
