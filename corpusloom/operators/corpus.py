"""Corpus operators: hashes, duplicates, statistics, snapshot differences, tags, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash


def line_count(text: Column) -> Column:
    """Lines of a text; a text without a line end has one, null has none."""
    return F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1, F.lit(0)).cast("bigint")


def hashed(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, content_hash(F.col(text)).alias("content_hash"))


def duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Members of groups of equal content: key, content_hash, copies, first_id. Groups are never gathered into a list."""
    rows = hashed(docs, key=key, text=text)
    groups = rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id")).where("copies > 1")
    return rows.join(groups, "content_hash").select(key, "content_hash", "copies", "first_id")


def fingerprint(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One hash of the whole corpus that no order of rows changes: a sum of row hashes, combined in every task."""
    row = F.sha2(F.encode(F.concat_ws(":", F.col(key).cast("string"), content_hash(F.col(text))), "UTF-8"), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    total = docs.select(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("p"), F.lit(0).cast("decimal(38,0)")).alias("s"))
    return total.select(F.col("n").alias("documents"), F.sha2(F.encode(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), "UTF-8"), 256).alias("fingerprint"))


def snapshot_diff(before: DataFrame, after: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Status of every key of either snapshot: new, modified, unchanged or deleted. Only hashes are shuffled."""
    a = hashed(before, key=key, text=text).select(F.col(key).alias("_a"), F.col("content_hash").alias("_ha"))
    b = hashed(after, key=key, text=text).select(F.col(key).alias("_b"), F.col("content_hash").alias("_hb"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_ha").eqNullSafe(F.col("_hb")), "unchanged").otherwise("modified")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_b", "_a").alias(key), status.alias("status"))


def stats(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Documents, characters, lines, empty texts and the longest text, over all or by columns."""
    return docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(F.char_length(text)), F.lit(0)).alias("chars"),
        F.coalesce(F.sum(line_count(F.col(text))), F.lit(0)).alias("lines"),
        F.count_if(F.coalesce(F.trim(text), F.lit("")) == "").alias("empty"),
        F.max(F.char_length(text)).cast("bigint").alias("longest"),
    )


def by_folder(files: DataFrame, *, path: str = "path", text: str = "text") -> DataFrame:
    """Files, lines and files with frontmatter of each top folder, files beside the folders under (root): folder, files, lines, with_frontmatter."""
    from corpusloom.operators.frontmatter import block_end

    folder = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("(root)")
    has = block_end(F.split(F.coalesce(F.col(text), F.lit("")), "\n")) > 0
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum(line_count(F.col(text))).alias("lines"), F.count_if(has).alias("with_frontmatter"))


def filename_style(name: Column) -> Column:
    """Naming convention of a file name; the first that fits."""
    return (
        F.when(name.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*\.md$"), "kebab-case")
        .when(name.rlike(r"^[A-Z0-9_]+\.md$"), "SHOUT_CASE")
        .when(name.contains(" "), "Title Case with spaces")
        .otherwise("other")
    )


#: Shapes of page names, the first that fits.
NAME_SHAPES = (
    ("document-type suffix", r"\b(?:Interview Guide|Representative Problems|Cheat Sheet|Template|Schema|Index|Home|Tracker|Roadmap|Glossary|Summary|Plan|Status)$"),
    ("compound pair", r"^.+ - .+$"),
    ("kebab-case slug", r"^[a-z0-9]+(?:-[a-z0-9]+)+$"),
    ("screaming case", r"^[A-Z0-9_]+$"),
)


def name_shape(name: Column) -> Column:
    found = F.when(F.lit(False), "")
    for label, pattern in NAME_SHAPES:
        found = found.when(name.rlike(pattern), label)
    return found.otherwise("plain concept")


def tags(text: Column) -> Column:
    """Inline tags of a line or text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(?<![\w/#])#([A-Za-z][\w/-]*)"), F.lit(1)))


def kind_of_path(pages: DataFrame, prefixes: DataFrame, *, path: str = "path") -> DataFrame:
    """The kind of the longest folder prefix of each path, or concept. prefixes (prefix, kind) is configuration and is sent to all tasks."""
    hit = pages.join(F.broadcast(prefixes), F.col(path).startswith(F.concat("prefix", F.lit("/"))), "left")
    best = hit.groupBy(path).agg(F.max_by("kind", F.length("prefix")).alias("kind"))
    return best.select(path, F.coalesce("kind", F.lit("concept")).alias("kind"))


def conventions(files: DataFrame, scopes: dict[str, Column], name_ok: dict[str, Column]) -> DataFrame:
    """Per system: files in scope, files whose name conforms, and the share in percent."""
    parts = []
    for system, scope in scopes.items():
        inside = files.where(scope)
        parts.append(
            inside.agg(F.count(F.lit(1)).alias("files"), F.count_if(name_ok[system]).alias("conforming")).select(
                F.lit(system).alias("system"), "files", "conforming", F.round(F.lit(100.0) * F.col("conforming") / F.greatest("files", F.lit(1)), 1).alias("percent")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
