"""A folder of files as tables: the scan, incremental work, reports and snapshots of tables.

PDF reading is left to an injected parser: no PDF library is assumed, so PDFs get the status that an
absent parser implies, as unreadable ones do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash

#: Names of folders that are never entered, besides all dotted ones.
EXCLUDED = ("engine", "tests", "scripts", "config", "docker", "node_modules", "__pycache__")


def _base(spark: SparkSession, folder: str) -> str:
    """The folder as Spark writes the paths of the files in it, with its closing slash."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    return whole.replace("file:///", "file:/")


def _listed(spark: SparkSession, folder: str, excluded: tuple[str, ...], pattern: str | None = None) -> DataFrame:
    """Files in no excluded or dotted folder: path (relative), size, content (read only where it is asked for)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (found.option("pathGlobFilter", pattern) if pattern else found).load(folder)
    whole = F.regexp_replace("path", "^file:/+", "file:/")
    files = files.select(F.substring(whole, F.lit(len(_base(spark, folder)) + 1), F.length(whole)).alias("path"), F.col("length").alias("size"), "content")
    parts = F.split("path", "/")
    return files.where(~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*excluded) | p.startswith(".")))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan(spark: SparkSession, folder: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Every file but those under excluded or dotted folders: path (relative), suffix, size. Contents are not read."""
    return _listed(spark, folder, excluded).select("path", suffix(F.col("path")).alias("suffix"), "size")


def link_targets(files: DataFrame) -> DataFrame:
    """What a link may lead to besides Markdown pages: path."""
    return files.where("suffix <> 'md'").select("path")


def read_markdown(spark: SparkSession, folder: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Markdown files, path and text of each from one scan (bad bytes replaced), with content hash and status."""
    rows = _listed(spark, folder, excluded, "*.[mM][dD]").select("path", F.col("content").cast("string").alias("text"))
    return rows.withColumn("content_hash", content_hash(F.col("text"))).withColumn("status", F.lit("ingested"))


def parsed(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes], str]], excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Every file with its text where a parser for its suffix reads it: path, status, text, reason.

    Markdown is read by itself. A parser is called in the workers on the bytes of a file; one that fails, or finds
    no text, is a status and no error, as is a suffix that none supports.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, kind, content in zip(b["path"], b["suffix"], b["content"]):
                parser = parsers.get(kind) or ((lambda raw: raw.decode("utf-8", "replace")) if kind == "md" else None)
                text, reason = None, None
                if parser:
                    try:
                        text = parser(bytes(content))
                    except Exception as e:  # whatever a parser does is a status of its file
                        reason = str(e)
                status = "unsupported" if not parser else "parse_failed" if text is None else "ingested" if text.strip() else "empty"
                out.append((path, status, text, reason))
            yield pd.DataFrame(out, columns=["path", "status", "text", "reason"])

    files = _listed(spark, folder, excluded).withColumn("suffix", suffix(F.col("path")))
    supported = F.col("suffix").isin("md", *parsers)
    read = files.where(supported).select("path", "suffix", "content").mapInPandas(run, "path string, status string, text string, reason string")
    return read.unionByName(files.where(~supported).selectExpr("path", "'unsupported' as status", "cast(null as string) as text", "cast(null as string) as reason"))


def source_report(files: DataFrame, parsers: dict[str, Callable] | None = None) -> DataFrame:
    """Status that the suffix of each file foretells, before `parsed` reads it; a PDF without a parser cannot be read."""
    known = ["md", *(parsers or {})]
    return files.withColumn("status", F.when(F.col("suffix").isin(*known), "ingested").when(F.col("suffix") == "pdf", "parse_failed").otherwise("unsupported"))


def to_ingest(now: DataFrame, stored: DataFrame, *, key: str = "path") -> DataFrame:
    """Rows whose (key, content_hash) is not stored yet."""
    return now.join(stored.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def upsert(stored: DataFrame, batch: DataFrame, *, key: str) -> DataFrame:
    """Stored rows, each replaced by the batch's row of the same key; the batch has one row per key."""
    return stored.join(batch.select(key), key, "left_anti").unionByName(batch)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def backup(tables: dict[str, DataFrame], folder: str) -> dict:
    """Write tables and a manifest of their rows, schemas and fingerprints; returns the manifest."""
    manifest = {}
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.parquet(f"{folder}/{name}")
        manifest[name] = _facts(spark.read.parquet(f"{folder}/{name}"))
    if spark:
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def _facts(df: DataFrame) -> dict:
    row = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s")).first()
    return {"rows": row.n, "fingerprint": str(row.s), "schema": df.schema.simpleString()}


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of a backup; refuses one whose rows no longer are those of the manifest."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    found = {}
    for name, facts in manifest.items():
        df = spark.read.parquet(f"{folder}/{name}")
        if _facts(df) != facts:
            raise ValueError(f"{name} differs from the manifest")
        found[name] = df
    return found
