"""What the operators of this subpackage share: reading, staging in shared storage, joins by size."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: The characters that separate words, as a regular expression class.
SPACES = r"\x20\x09-\x0D"
WORD_BREAK = rf"[{SPACES}]+"
#: The same characters themselves.
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A side of a join with more rows or bytes than these is never broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
#: Pieces that a hot key's rows are dealt into.
SALTS = 16
#: A key is hot if it holds this share of a side or more, so there are at most as many hot keys as one over it.
HOT_SHARE = 1 / 512
#: Share of a side that is read to find its hot keys, and the rows that it must hold there; this moves work, never rows.
HOT_SAMPLE, HOT_ROWS = 0.02, 20
#: Prefix of the names that operators use within; what a table has under such a name is set aside first.
OWN = "__loom_"

_staged: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a local session may do without and gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _hadoop_path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes at release_staged, or when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/corpusloom/{uuid.uuid4().hex}-{name}"
    where, files = _hadoop_path(spark, path)
    files.deleteOnExit(where)
    _staged.append(path)
    return path


def release_staged(spark: SparkSession) -> None:
    """Delete every intermediate result of this process; results that were not written or collected are lost with them."""
    while _staged:
        where, files = _hadoop_path(spark, _staged.pop())
        files.delete(where, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends at replicated files."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text in order: runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def packed(df: DataFrame, row: str = OWN + "row") -> Column:
    """All columns of the table as one, so that names of its own cannot meet those that an operator makes."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias(row)


def unpacked(names: list[str], row: str = OWN + "row") -> list[Column]:
    """The columns again that `packed` put into one."""
    return [F.col(row).getField(c).alias(c) for c in names]


def _bytes(c: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("bigint"), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(0))
        return F.coalesce(F.size(c), F.lit(0)).cast("bigint") * 8 + 16
    if isinstance(kind, StructType):
        return reduce(Column.__add__, [_bytes(c.getField(f.name), f.dataType) for f in kind.fields], F.lit(8).cast("bigint"))
    return F.lit(8).cast("bigint")


def fits(df: DataFrame, rows: int | None = None) -> bool:
    """Whether the table, counted here, is small enough in rows and bytes to be sent to every executor."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes(F.struct(*df.columns), df.schema)), F.lit(0))).first()
    return n <= (BROADCAST_ROWS if rows is None else rows) and size <= BROADCAST_BYTES


def hot_keys(df: DataFrame, key: Column) -> list[int]:
    """Hashes of the keys that hold HOT_SHARE or more of a sample of the rows: at most 1 / HOT_SHARE of them."""
    some = df.sample(HOT_SAMPLE, seed=3).groupBy(F.xxhash64(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    found = staged(some, "key-counts")
    total = found.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in found.where(F.col("n") >= max(HOT_ROWS, math.ceil(total * HOT_SHARE))).select("key").collect()]


def lookup(left: DataFrame, right: DataFrame, left_key: Column, right_key: str, how: str = "left", salts: int | None = None) -> DataFrame:
    """Join `right`, unique by `right_key`, to `left`; the key column of `right` goes. Null keys meet.

    A `right` that fits is broadcast. Otherwise both are shuffled, and the rows of keys that a sample
    of `left` shows to be hot are dealt to `salts` tasks, for which only those keys of `right` are repeated.
    """
    key, salt, deal = OWN + "key", OWN + "salt", OWN + "deal"
    keyed = right.withColumnRenamed(right_key, key)
    if fits(right):
        return left.join(F.broadcast(keyed), left_key.eqNullSafe(F.col(key)), how).drop(key)
    salts = SALTS if salts is None else salts
    hot = hot_keys(left, left_key) if salts > 1 else []
    if not hot:
        return left.join(keyed, left_key.eqNullSafe(F.col(key)), how).drop(key)
    hashed = [F.col(f"`{c}`") for c, t in left.dtypes if "map<" not in t and "variant" not in t]
    dealt = left.withColumn(deal, F.when(F.xxhash64(left_key).isin(hot), F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")).otherwise(0))
    places = F.when(F.xxhash64(F.col(key)).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = keyed.withColumn(salt, F.explode(places))
    return dealt.join(spread, left_key.eqNullSafe(F.col(key)) & (F.col(deal) == F.col(salt)), how).drop(key, salt, deal)
