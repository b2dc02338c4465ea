"""Link operators: extraction from Markdown lines, the resolution cascade, reports, ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Targets of punctuation and digits alone are no names.
MALFORMED = r"^[\s\d\p{Punct}]*$"
RESOLVING = ("RESOLVED", "CASE_MISMATCH", "PATH_MISMATCH")


def normalize(name: Column) -> Column:
    """Lower case without anything but ASCII letters and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def stem(path: Column) -> Column:
    """File name without folders and .md."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


#: Patterns of links.
WIKILINK = r"\[\[([^\[\]]+?)\]\]"
MARKDOWN_LINK = r'(?<!!)\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'


def wikilinks(lines: DataFrame, *, text: str = "text") -> DataFrame:
    """One row per [[target#anchor|alias]] with a target: the line's columns, target, anchor, alias. Lines come without code (frontmatter.prose_lines)."""
    found = lines.withColumn("_raw", F.explode(F.regexp_extract_all(F.col(text), F.lit(WIKILINK), F.lit(1))))
    head = F.substring_index("_raw", "|", 1)
    alias = F.when(F.instr("_raw", "|") > 0, F.trim(F.expr("substring(_raw, instr(_raw, '|') + 1)")))
    anchor = F.when(F.instr(head, "#") > 0, F.trim(F.regexp_extract(head, r"#(.*)$", 1)))
    out = found.withColumn("target", F.trim(F.substring_index(head, "#", 1))).withColumn("anchor", anchor).withColumn("alias", alias)
    return out.where("target <> ''").drop("_raw")


def markdown_links(lines: DataFrame, *, text: str = "text") -> DataFrame:
    """One row per [text](target "title") that is no image: the line's columns and target."""
    return lines.withColumn("target", F.explode(F.regexp_extract_all(F.col(text), F.lit(MARKDOWN_LINK), F.lit(1))))


def resolve_links(links: DataFrame, paths: DataFrame, decided: DataFrame) -> DataFrame:
    """Status and path of every link by the ordered cascade; the first step that hits decides.

    links: any columns with target; paths: path; decided: norm, path. Each step is an equi-join on a
    key of the paths that holds how many paths share it, so no step multiplies links.
    """

    def index(key: Column, name: str) -> DataFrame:
        named = paths.select(key.alias(f"_{name}_key"), "path")
        return named.groupBy(f"_{name}_key").agg(F.countDistinct("path").alias(f"_{name}_n"), F.min("path").alias(f"_{name}_path"))

    path, no_ext = F.col("path"), F.regexp_replace("path", r"\.md$", "")
    both = paths.select("path", F.explode(F.array_distinct(F.array(path, no_ext))).alias("rel"))
    rel = both.groupBy(F.col("rel").alias("_rel_key")).agg(F.min("path").alias("_rel_path"))
    low_rel = both.groupBy(F.lower("rel").alias("_lrel_key")).agg(F.min("path").alias("_lrel_path"))
    target, base = F.trim("target"), F.substring_index(F.trim("target"), "/", -1)
    out = links.withColumn("_t", target)
    steps = (("stem", index(stem(path), "stem"), target), ("low", index(F.lower(stem(path)), "low"), F.lower(target)),
             ("norm", index(normalize(stem(path)), "norm"), normalize(target)))
    for name, side, key in steps:
        out = out.join(side, key == F.col(f"_{name}_key"), "left")
    base_side = index(stem(path), "base")
    out = out.join(base_side, (F.instr("_t", "/") > 0) & (base == F.col("_base_key")), "left")
    out = out.join(rel, F.col("_t") == F.col("_rel_key"), "left").join(low_rel, F.lower("_t") == F.col("_lrel_key"), "left")
    chosen = decided.select(F.col("norm").alias("_decided_key"), F.col("path").alias("_decided"))
    out = out.join(chosen, normalize(target) == F.col("_decided_key"), "left")
    exact = F.col("_decided").isNotNull() & (stem(F.col("_decided")) == F.col("_t"))
    loose = F.col("_decided").isNotNull() & (F.lower(stem(F.col("_decided"))) == F.lower("_t"))
    cases = (
        (F.col("_t").rlike(MALFORMED), "MALFORMED", None),
        (F.col("_stem_n") == 1, "RESOLVED", "_stem_path"),
        ((F.col("_stem_n") > 1) & exact, "RESOLVED", "_decided"),
        (F.col("_stem_n") > 1, "AMBIGUOUS", None),
        (F.col("_rel_path").isNotNull(), "RESOLVED", "_rel_path"),
        (F.col("_low_n") == 1, "CASE_MISMATCH", "_low_path"),
        ((F.col("_low_n") > 1) & loose, "CASE_MISMATCH", "_decided"),
        (F.col("_low_n") > 1, "AMBIGUOUS", None),
        (F.col("_lrel_path").isNotNull(), "CASE_MISMATCH", "_lrel_path"),
        (F.col("_base_n") == 1, "PATH_MISMATCH", "_base_path"),
        (F.col("_base_n") > 1, "AMBIGUOUS", None),
        ((F.col("_norm_n") == 1) & (normalize(target) != ""), "RENAMED_CANDIDATE", None),
        ((F.col("_norm_n") > 1) & (normalize(target) != ""), "AMBIGUOUS", None),
    )
    status, found = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, name, column in cases:
        status = status.when(test, name)
        found = found.when(test, F.col(column) if column else F.lit(None).cast("string"))
    return out.select(*links.columns, status.otherwise("MISSING").alias("status"), found.alias("resolved_path"))


def link_report(resolved: DataFrame) -> DataFrame:
    """Targets that lead nowhere: count, distinct sources, the status of the first occurrence."""
    bad = resolved.where(~F.col("status").isin(*RESOLVING))
    return bad.groupBy("target").agg(
        F.count(F.lit(1)).alias("links"), F.countDistinct("source_path").alias("sources"), F.min_by("status", F.struct("source_path", "line")).alias("status")
    )


def relative_path(source: Column, target: Column) -> Column:
    """`target` as seen from the folder of `source`: . and .. are collapsed, .. above the root is ignored."""
    clean = F.regexp_replace(F.substring_index(target, "#", 1), r"\+", "%2B")
    decoded = F.coalesce(F.try_url_decode(clean), F.substring_index(target, "#", 1))
    folder = F.when(F.instr(source, "/") > 0, F.regexp_replace(source, "/[^/]*$", "")).otherwise("")
    parts = F.split(F.concat_ws("/", folder, decoded), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(kept, "/")


def resolve_relative(links: DataFrame, files: DataFrame) -> DataFrame:
    """Status of relative links: RESOLVED for a file or a folder that holds one, else MISSING; external ones go."""
    inside = links.where(~F.col("target").rlike("^(https?:|mailto:|#)"))
    at = inside.withColumn("resolved_path", relative_path(F.col("source_path"), F.col("target")))
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("_known")).where("_known <> ''")
    known = files.select(F.col("path").alias("_known")).union(folders).distinct()
    out = at.join(known, F.col("resolved_path") == F.col("_known"), "left")
    hit = F.col("_known").isNotNull()
    return out.select(*links.columns, F.when(hit, "RESOLVED").otherwise("MISSING").alias("status"), F.when(hit, F.col("resolved_path")).alias("resolved_path"))


#: Fixed value: names of pages that hold a vault together and are no concepts.
STRUCTURAL = r"(?i)^(_.*|readme|index|roadmap|\d\d-.*)$"


def ambiguous_stems(paths: DataFrame) -> DataFrame:
    """Normalised stems that name more than one path: norm, paths. Names that hold the vault together are left out."""
    named = paths.where(~stem(F.col("path")).rlike(STRUCTURAL)).select(normalize(stem(F.col("path"))).alias("norm"), "path").where("norm <> ''")
    return named.groupBy("norm").agg(F.countDistinct("path").alias("paths")).where("paths > 1")


def inbound_counts(resolved: DataFrame) -> DataFrame:
    """Distinct pages that link to a page, itself left out, and up to five of them."""
    into = resolved.where(F.col("resolved_path").isNotNull() & (F.col("resolved_path") != F.col("source_path"))).select("resolved_path", "source_path").distinct()
    first = Window.partitionBy("resolved_path").orderBy("source_path")
    some = into.withColumn("_n", F.row_number().over(first))
    return some.groupBy("resolved_path").agg(
        F.count(F.lit(1)).alias("pages"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= 5, F.col("source_path")))), ",").alias("sample")
    )
