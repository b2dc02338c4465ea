"""Queries over a vault of Markdown files, and the SQL that they are checked against.

The files are made of the part table by the same expressions on both sides: one file per part, with
frontmatter (sound, broken, truncated, absent), headings, fenced and inline code, tags and links of
every kind. Spark reads the whole texts; the SQL sees the lines and what was planted in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators import frontmatter as W
from corpusloom.operators import links as L
from corpusloom.operators import markdown as M
from corpusloom.plans import reports
from corpusloom.sources.tables import table

#: Every eleventh file is linked to by others of its number.
LINKED = 149
KINDS = (("DSA", "topic"), ("DSA/01_Patterns", "pattern"), ("Tech", "technology"))

_NAMED = """SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN 'Misc/' || CAST(p_partkey AS STRING) WHEN p_partkey % 4 = 0 THEN 'DSA' WHEN p_partkey % 4 = 1 THEN 'Notes'
       WHEN p_partkey % 4 = 2 THEN 'DSA/01_Patterns' ELSE 'Tech' END AS folder,
       CASE WHEN p_partkey % 10 = 0 THEN p_name WHEN p_partkey % 10 = 1 THEN upper(p_name) || ' ' || CAST(p_partkey AS STRING) ELSE p_name || ' ' || CAST(p_partkey AS STRING) END AS name FROM {part}"""
_LINK = """CASE k % 12 WHEN 0 THEN '[[' || b || ']]' WHEN 1 THEN '[[' || upper(b) || '|alias]]' WHEN 2 THEN '[[' || bf || '/' || b || ']]' WHEN 3 THEN '[[' || bf || '/' || b || '.md#part]]'
 WHEN 4 THEN '[[' || upper(bf) || '/' || b || ']]' WHEN 5 THEN '[[Else/' || b || ']]' WHEN 6 THEN '[[' || replace(b, ' ', '-') || ']]' WHEN 7 THEN '[[Missing ' || b || '#x|y]]' WHEN 8 THEN '[[123]] and [[ ]]'
 WHEN 9 THEN '[[' || b || '#Heading|a]] then [[' || c || ']]' WHEN 10 THEN '`[[' || b || ']]` [[' || c || ']]' ELSE '[[' || lower(c) || ']] [[ ' || b || ' ]]' END"""
_FRONT = [
    "'---'",
    "'title: ' || name",
    "CASE k % 5 WHEN 0 THEN 'tags: alpha, beta/x' WHEN 1 THEN 'tags: [g' || CAST(k % 3 AS STRING) || ', \"two words\", 7]' WHEN 4 THEN 'title: again' ELSE 'kind: note' END",
    "CASE k % 4 WHEN 0 THEN 'related: [[' || b || ']], [[' || c || ']]' WHEN 1 THEN 'related: [\"[[' || b || ']]\"]' WHEN 2 THEN 'related: [[[' || b || ']], [[' || c || ']]]' ELSE 'related: [[' || b || ']], [[' || c || ']' END",
    "'---'",
]
_BODY = [
    "'# ' || name",
    f"'see ' || {_LINK} || ' #tag-' || CAST(k % 5 AS STRING) || ' x#no #Two/three'",
    "CASE WHEN k % 2 = 0 THEN '```py' ELSE '~~~' END",
    "'# hidden [[Hidden]] #hidden [a](b.md) ``` ~~'",
    "CASE WHEN k % 2 = 0 THEN '````' ELSE ' ~~~' END",
    "'## Part ' || CAST(k % 3 AS STRING)",
    "'text `[[Inline]] #inline` [up](../' || replace(bf || '/' || b, ' ', '%20') || '.md#top) [d](../' || bf || '/) [x](https://x.org) ![i](p.png) [gone](./gone.md \"t\")'",
    "'### Deep ##'",
    "'more [[' || c || ']] #tag-' || CAST(k % 5 AS STRING)",
]
_FILES = f"""n AS ({_NAMED}),
f AS (SELECT a.k, a.folder, a.name, a.folder || '/' || a.name || '.md' AS path, coalesce(x.name, 'Nowhere') AS b, coalesce(x.folder, 'None') AS bf, coalesce(y.name, 'Nowhere') AS c
      FROM n a LEFT JOIN n x ON x.k = (a.k * 7 + 3) % {LINKED} LEFT JOIN n y ON y.k = (a.k * 11 + 5) % {LINKED})"""
_TEXT = f"CASE WHEN k % 6 = 5 THEN concat_ws(chr(10), {', '.join(_BODY)}) ELSE concat_ws(chr(10), {', '.join(_FRONT + _BODY)}) END"
_NORM = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
#: Names of several files that were decided on.
_DECIDED = "SELECT norm, min(path) AS path FROM (SELECT {norm} AS norm, folder || '/' || name || '.md' AS path FROM n WHERE k % 10 = 0 AND k % 30 = 0) d GROUP BY norm"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"WITH {_FILES} SELECT k, path, {_TEXT} AS text FROM f", part=table(spark, sf_dir, "part"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("path")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.all_wikilinks(_files(spark, sf_dir)).select(F.col("path").alias("source_path"), "line", "target", "in_frontmatter")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = _NORM.format("name").replace(", 'g')", ")")
    decided = spark.sql(f"WITH n AS ({_NAMED}) {_DECIDED.format(norm=norm)}", part=table(spark, sf_dir, "part"))
    return L.resolve_links(_links(spark, sf_dir), _paths(spark, sf_dir), decided)


def vault_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


def link_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


def link_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.link_report(_resolved(spark, sf_dir))


def link_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("links"))


def inbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.inbound_counts(_resolved(spark, sf_dir))


def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = L.markdown_links(W.prose_lines(_files(spark, sf_dir)).withColumnRenamed("path", "source_path")).select("source_path", "line", "target")
    return L.resolve_relative(links, _paths(spark, sf_dir))


def tags_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.prose_lines(_files(spark, sf_dir)).select(F.col("path").alias("source_path"), "line", F.explode(C.tags(F.col("text"))).alias("tag"))


def tags_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.all_tags(_files(spark, sf_dir)).select("path", F.array_join("tags", "|").alias("tags"))


def md_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.titles(_files(spark, sf_dir))


def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.headings(_files(spark, sf_dir), key="path")


def md_heading_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.heading_spans(_files(spark, sf_dir).withColumnRenamed("path", "file"), key="file")


def frontmatter_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.diagnostics(_files(spark, sf_dir))


def frontmatter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by code and severity, and files with frontmatter by folder: part, name, files, share."""
    files = _files(spark, sf_dir)
    found = M.diagnostics(files)
    some = [found.groupBy(F.lit(p).alias("part"), F.col(p).alias("name")).agg(F.countDistinct("path").alias("files"), F.lit(None).cast("double").alias("percent")) for p in ("code", "severity")]
    has = W.block_end(F.split("text", "\n")) > 0
    folder = F.substring_index("path", "/", 1)
    by = files.groupBy(F.lit("folder").alias("part"), folder.alias("name")).agg(F.count(F.lit(1)).alias("files"), F.round(F.lit(100.0) * F.count_if(has) / F.count(F.lit(1)), 1).alias("percent"))
    return some[0].unionByName(some[1]).unionByName(by)


def wikilink_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.repairs(_files(spark, sf_dir))


def repairs_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.verified(_files(spark, sf_dir))


def repairs_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repair, those of some files after the line or the file changed: path, line, refused, and the line as it reads then."""
    files = _files(spark, sf_dir)
    found = W.repairs(files).join(files.select("path", "k"), "path")
    later = files.where("k % 8 <> 0").withColumn("text", F.when(F.col("k") % 8 == 2, F.regexp_replace("text", "related:", "related :")).otherwise(F.col("text")))
    shifted = found.withColumn("line", F.when(F.col("k") % 16 == 4, 99).otherwise(F.col("line")))
    mended, judged = W.apply_repairs(later, shifted)
    now = mended.select("path", F.get(F.split("text", "\n"), F.lit(3)).alias("reads"))
    return judged.join(now, "path", "left").select("path", "line", "refused", "reads")


def related_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.field_links(_files(spark, sf_dir), "related").select("path", F.array_join("names", "|").alias("names"))


def name_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("path", C.name_shape(L.stem(F.col("path"))).alias("shape"))


def kinds_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kind_of_path(_paths(spark, sf_dir), spark.createDataFrame(list(KINDS), "prefix string, kind string"))


def folder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_folder(_files(spark, sf_dir))


def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.all_tags(_files(spark, sf_dir)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("files"))


def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dead_links(_resolved(spark, sf_dir), reports.DEAD_LINKS["page"])


def largest_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.largest_folders(folder_stats(spark, sf_dir), 3)


def navigation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of some linked lines and some others."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "repeat('- [[' || p_name || ']]\\n', CAST(p_partkey % 7 AS INT)) || repeat('[a](b.md) x\\n \\n', CAST(p_partkey % 3 AS INT)) || repeat('plain\\n', CAST(p_partkey % 5 AS INT)) AS text")
    return rows.select("k", M.navigation(F.col("text")).alias("navigation"))


_LINES = f"""{_FILES.format(part='part')},
g AS (SELECT k, path, name, folder, b, bf, c, k % 6 <> 5 AS has, CASE WHEN k % 6 = 5 THEN list_value({', '.join(_BODY)}) ELSE list_value({', '.join(_FRONT + _BODY)}) END AS ls FROM f),
ln AS (SELECT k, path, has, unnest(ls) AS s, generate_subscripts(ls, 1)::INTEGER AS line FROM g),
o AS (SELECT *, CASE WHEN has THEN 0 ELSE 5 END AS off FROM ln),
pr AS (SELECT k, path, line, regexp_replace(s, '`[^`]*`', ' ', 'g') AS s FROM o WHERE line + off >= 6 AND line + off NOT IN (8, 9, 10)),
fm AS (SELECT k, path, line, s FROM o WHERE has AND line BETWEEN 2 AND 4),
wl AS (SELECT path AS source_path, line, in_frontmatter, trim(string_split(string_split(raw, '|')[1], '#')[1]) AS target FROM (
       SELECT path, line, false AS in_frontmatter, unnest(regexp_extract_all(s, '\\[\\[([^\\[\\]]+?)\\]\\]', 1)) AS raw FROM pr UNION ALL
       SELECT path, line, true, unnest(regexp_extract_all(s, '\\[\\[([^\\[\\]]+?)\\]\\]', 1)) FROM fm)),
w AS (SELECT source_path, line, target, in_frontmatter FROM wl WHERE target <> '')"""
_STEM = r"regexp_replace(string_split(path, '/')[-1], '\.md$', '')"
_CASCADE = rf"""{_LINES},
pt AS (SELECT path, {_STEM} AS st, regexp_replace(path, '\.md$', '') AS ne FROM f),
dc AS ({_DECIDED.format(norm=_NORM.format('name'))}),
s1 AS (SELECT st AS q, count(DISTINCT path) AS n, min(path) AS p FROM pt GROUP BY 1), s3 AS (SELECT lower(st) AS q, count(DISTINCT path) AS n, min(path) AS p FROM pt GROUP BY 1),
s6 AS (SELECT {_NORM.format('st')} AS q, count(DISTINCT path) AS n FROM pt GROUP BY 1),
s2 AS (SELECT q, min(path) AS p FROM (SELECT path AS q, path FROM pt UNION SELECT ne, path FROM pt) GROUP BY 1), s4 AS (SELECT lower(q) AS q, min(path) AS p FROM (SELECT path AS q, path FROM pt UNION SELECT ne, path FROM pt) GROUP BY 1),
c AS (SELECT w.*, coalesce(s1.n, 0) AS n1, s1.p AS p1, dc.path AS d, s2.p AS p2, coalesce(s3.n, 0) AS n3, s3.p AS p3, s4.p AS p4, coalesce(s5.n, 0) AS n5, s5.p AS p5, coalesce(s6.n, 0) AS n6 FROM w
      LEFT JOIN s1 ON s1.q = target LEFT JOIN dc ON dc.norm = {_NORM.format('target')} LEFT JOIN s2 ON s2.q = target LEFT JOIN s3 ON s3.q = lower(target) LEFT JOIN s4 ON s4.q = lower(target)
      LEFT JOIN s1 s5 ON contains(target, '/') AND s5.q = string_split(target, '/')[-1] LEFT JOIN s6 ON s6.q = {_NORM.format('target')}),
e AS (SELECT *, regexp_replace(string_split(d, '/')[-1], '\.md$', '') AS ds FROM c),
r AS (SELECT source_path, line, target, in_frontmatter,
  CASE WHEN regexp_matches(target, '^[\s\d[:punct:]]*$') THEN 'MALFORMED' WHEN n1 = 1 THEN 'RESOLVED' WHEN n1 > 1 THEN CASE WHEN ds = target THEN 'RESOLVED' ELSE 'AMBIGUOUS' END
       WHEN p2 IS NOT NULL THEN 'RESOLVED' WHEN n3 = 1 THEN 'CASE_MISMATCH' WHEN n3 > 1 THEN CASE WHEN lower(ds) = lower(target) THEN 'CASE_MISMATCH' ELSE 'AMBIGUOUS' END
       WHEN p4 IS NOT NULL THEN 'CASE_MISMATCH' WHEN n5 = 1 THEN 'PATH_MISMATCH' WHEN n5 > 1 THEN 'AMBIGUOUS' WHEN n6 = 1 THEN 'RENAMED_CANDIDATE' WHEN n6 > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status,
  CASE WHEN regexp_matches(target, '^[\s\d[:punct:]]*$') THEN NULL WHEN n1 = 1 THEN p1 WHEN n1 > 1 THEN CASE WHEN ds = target THEN d END WHEN p2 IS NOT NULL THEN p2 WHEN n3 = 1 THEN p3
       WHEN n3 > 1 THEN CASE WHEN lower(ds) = lower(target) THEN d END WHEN p4 IS NOT NULL THEN p4 WHEN n5 = 1 THEN p5 END AS resolved_path FROM e)"""
_CODES = f"""{_FILES.format(part='part')}, fc AS (
SELECT path, folder, 'FM003' AS code, 'info' AS severity FROM f WHERE k % 6 = 5 UNION ALL SELECT path, folder, 'FM001', 'error' FROM f WHERE k % 6 <> 5 AND k % 4 IN (0, 3)
UNION ALL SELECT path, folder, 'FM002', 'warning' FROM f WHERE k % 6 <> 5 AND k % 4 = 2 UNION ALL SELECT path, folder, 'FM008', 'warning' FROM f WHERE k % 6 <> 5 AND k % 4 = 3
UNION ALL SELECT path, folder, 'FM005', 'warning' FROM f WHERE k % 6 <> 5 AND k % 5 = 4)"""
_REPAIRS = f"""{_FILES.format(part='part')}, rp AS (SELECT k, path, 4 AS line, 'related' AS field, {_FRONT[3]} AS before, 'related: ["[[' || b || ']]", "[[' || c || ']]"]' AS after, k % 4 = 3 AS truncated FROM f WHERE k % 6 <> 5 AND k % 4 <> 1)"""
_TAGS = r"regexp_extract_all(' ' || s, '(^|[^\pL\pN_/#])#([A-Za-z][\pL\pN_/-]*)', 2)"
_UNION = f"""{_LINES}, it AS (SELECT path, min(line * 1000 + i) AS nth, t FROM (SELECT path, line, unnest({_TAGS}) AS t, generate_subscripts({_TAGS}, 1) AS i FROM pr) GROUP BY path, t),
ft AS (SELECT path, t, i AS nth FROM (SELECT path, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT path, CASE k % 5 WHEN 0 THEN ['alpha', 'beta/x'] WHEN 1 THEN ['g' || (k % 3), 'two words'] END AS ts FROM f WHERE k % 6 <> 5 AND k % 4 IN (1, 2)))),
tu AS (SELECT path, t, min(nth) AS nth FROM (SELECT path, t, nth FROM ft UNION ALL SELECT path, t, nth FROM it) GROUP BY path, t)"""
_SHAPE = "CASE " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{label}'" for label, p in C.NAME_SHAPES) + " ELSE 'plain concept' END"
_FIND = "CASE WHEN path IN (SELECT path FROM f)"

QUERIES = {
    q.__name__: q
    for q in (vault_wikilinks, link_cascade, link_report, link_status_counts, inbound_links, md_links, tags_inline, tags_union, md_titles, md_headings, md_heading_spans, frontmatter_codes, frontmatter_report, wikilink_repairs,
              repairs_verified, repairs_applied, related_fields, name_shapes, kinds_by_folder, folder_stats, tag_histogram, navigation_spans, dead_links, largest_folders)
}
ORACLES = {
    "vault_wikilinks": f"WITH {_LINES} SELECT * FROM w",
    "link_cascade": f"WITH {_CASCADE} SELECT * FROM r",
    "link_report": f"WITH {_CASCADE} SELECT target, count(*) AS links, count(DISTINCT source_path) AS sources, arg_min(status, (source_path, line)) AS status FROM r WHERE status NOT IN ('RESOLVED', 'CASE_MISMATCH', 'PATH_MISMATCH') GROUP BY target",
    "link_status_counts": f"WITH {_CASCADE} SELECT status, count(*) AS links FROM r GROUP BY status",
    "inbound_links": f"WITH {_CASCADE}, i AS (SELECT DISTINCT resolved_path, source_path FROM r WHERE resolved_path IS NOT NULL AND resolved_path <> source_path) SELECT resolved_path, count(*) AS pages, array_to_string(list_sort(list(source_path))[1:5], ',') AS sample FROM i GROUP BY resolved_path",
    "md_links": f"""WITH {_LINES}, fo AS (SELECT DISTINCT folder AS p FROM f UNION SELECT DISTINCT string_split(folder, '/')[1] FROM f UNION SELECT path FROM f),
m AS (SELECT path AS source_path, CASE WHEN has THEN 12 ELSE 7 END AS line, string_split(folder, '/') AS fs, folder, name, b, bf FROM g),
t AS (SELECT source_path, line, '../' || replace(bf || '/' || b, ' ', '%20') || '.md#top' AS target, CASE WHEN len(fs) > 1 THEN fs[1] || '/' ELSE '' END || bf || '/' || b || '.md' AS p FROM m UNION ALL
      SELECT source_path, line, '../' || bf || '/', CASE WHEN len(fs) > 1 THEN fs[1] || '/' ELSE '' END || bf FROM m UNION ALL SELECT source_path, line, './gone.md', folder || '/gone.md' FROM m)
SELECT source_path, line, target, CASE WHEN fo.p IS NULL THEN 'MISSING' ELSE 'RESOLVED' END AS status, fo.p AS resolved_path FROM t LEFT JOIN fo ON t.p = fo.p""",
    "tags_inline": f"WITH {_LINES} SELECT DISTINCT path AS source_path, line, unnest({_TAGS}) AS tag FROM pr",
    "tags_union": f"WITH {_UNION} SELECT f.path, coalesce(string_agg(t, '|' ORDER BY nth), '') AS tags FROM f LEFT JOIN tu ON f.path = tu.path GROUP BY f.path",
    "tag_histogram": f"WITH {_UNION} SELECT t AS tag, count(*) AS files FROM tu GROUP BY t",
    "md_titles": f"WITH {_FILES.format(part='part')} SELECT path, name AS title FROM f",
    "md_headings": f"WITH {_LINES} SELECT path, line, CASE line + off WHEN 6 THEN 1 WHEN 11 THEN 2 ELSE 3 END AS level, CASE line + off WHEN 13 THEN 'Deep' ELSE regexp_replace(s, '^#+ ', '') END AS heading FROM o WHERE line + off IN (6, 11, 13)",
    "md_heading_spans": f"""WITH {_LINES}, x AS (SELECT path, name, 'Part ' || (k % 3) AS part, CASE WHEN has THEN 0 ELSE 5 END AS off, has FROM g)
SELECT path AS file, 0 AS ordinal, 1 AS start_line, 5 AS end_line, '' AS path FROM x WHERE has UNION ALL SELECT path, CASE WHEN has THEN 1 ELSE 0 END, 6 - off, 10 - off, name FROM x
UNION ALL SELECT path, CASE WHEN has THEN 2 ELSE 1 END, 11 - off, 12 - off, name || ' > ' || part FROM x UNION ALL SELECT path, CASE WHEN has THEN 3 ELSE 2 END, 13 - off, 14 - off, name || ' > ' || part || ' > Deep' FROM x""",
    "frontmatter_codes": f"WITH {_CODES} SELECT path, code, severity FROM fc",
    "frontmatter_report": f"""WITH {_CODES} SELECT 'code' AS part, code AS name, count(DISTINCT path) AS files, NULL::DOUBLE AS percent FROM fc GROUP BY code UNION ALL SELECT 'severity', severity, count(DISTINCT path), NULL FROM fc GROUP BY severity
UNION ALL SELECT 'folder', string_split(folder, '/')[1], count(*), round(100.0 * count(*) FILTER (k % 6 <> 5) / count(*), 1) FROM f GROUP BY 2""",
    "wikilink_repairs": f"WITH {_REPAIRS} SELECT path, line, field, before, after, truncated FROM rp",
    "repairs_verified": f"WITH {_REPAIRS} SELECT path, count(*) AS repairs, true AS verified FROM rp GROUP BY path",
    "repairs_applied": f"""WITH {_REPAIRS}, s AS (SELECT *, CASE WHEN k % 8 = 0 THEN 'file_is_gone' WHEN k % 16 = 4 THEN 'line_out_of_range' WHEN k % 8 = 2 THEN 'line_has_changed' END AS refused FROM rp)
SELECT path, CASE WHEN k % 16 = 4 THEN 99 ELSE line END AS line, refused, CASE WHEN refused = 'file_is_gone' THEN NULL WHEN refused = 'line_has_changed' THEN replace(before, 'related:', 'related :') WHEN refused IS NOT NULL THEN before ELSE after END AS reads FROM s""",
    "related_fields": f"WITH {_FILES.format(part='part')} SELECT path, CASE WHEN k % 4 = 1 THEN b ELSE b || '|' || c END AS names FROM f WHERE k % 6 <> 5",
    "name_shapes": f"WITH {_FILES.format(part='part')} SELECT path, {_SHAPE} AS shape FROM (SELECT path, name AS n FROM f)",
    "kinds_by_folder": f"WITH {_FILES.format(part='part')} SELECT path, CASE folder WHEN 'DSA' THEN 'topic' WHEN 'DSA/01_Patterns' THEN 'pattern' WHEN 'Tech' THEN 'technology' ELSE 'concept' END AS kind FROM f",
    "folder_stats": f"WITH {_LINES} SELECT string_split(folder, '/')[1] AS folder, count(*) AS files, sum(len(ls))::BIGINT AS lines, count(*) FILTER (has) AS with_frontmatter FROM g GROUP BY 1",
    "dead_links": f"""WITH {_CASCADE}, d AS (SELECT * FROM r WHERE status NOT IN ('RESOLVED', 'CASE_MISMATCH', 'PATH_MISMATCH'))
SELECT target, count(*) AS links, count(DISTINCT source_path) AS sources, array_to_string(list_sort(list(DISTINCT source_path))[1:3], ', ') AS shown FROM d GROUP BY target ORDER BY links DESC, target LIMIT 100""",
    "largest_folders": f"WITH {_LINES} SELECT string_split(folder, '/')[1] AS folder, count(*) AS files, sum(len(ls))::BIGINT AS lines, count(*) FILTER (has) AS with_frontmatter FROM g GROUP BY 1 ORDER BY lines DESC, folder LIMIT 3",
    "navigation_spans": "SELECT p_partkey AS k, l >= 4 AND 2 * l >= l + p_partkey % 5 AS navigation FROM (SELECT p_partkey, p_partkey % 7 + p_partkey % 3 AS l FROM part)",
}
