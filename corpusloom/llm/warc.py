"""WARC archives with a two-level capture index.

Writing: every page becomes one record of a WARC file. Of pages with equal payloads, the one with the
smallest page_id is written as a response and the others as revisits that name it, so a payload is
stored once. Spark's own text writer lays the records down, so any file system that Spark writes to
will do; RECORDS_PER_FILE bounds the files, and pages above LARGE_BYTES go to files of few records.

Index: archives are read record by record to find offsets; the captures are sorted by reversed-host
URL key, cut into compressed blocks of BLOCK_LINES lines (level two), and the first and last key of each
block go into a sparse directory (level one).

Search: for every key asked for, the directory is searched by bisection for the blocks that can hold it, those
blocks are unpacked and searched by bisection, and of the archives only the byte ranges found are read, in order of file and offset.
A directory that fits is sent to all tasks; a longer one is cut into pages of PAGE entries, whose first keys are searched in the same way
before. op5 asks for the keys of all pages. Where Python cannot reach the store of the archives (any other than
a mounted file system), whole archives are loaded by Spark and the ranges cut out of them, so files are kept small.

Defined results: null html is the empty payload; a null url gives a record without target URI and the
empty key; of rows that share the smallest page_id and a payload all are responses; a null page_id
comes after every other, and refers to nothing if no other has the payload; a url comes back as it was; a very long
payload has a file of few records and is read in one range; extra columns are not read, whatever their names; an empty
table gives empty archives and no rows; a key that no capture has gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, fits, lookup, shared_path, staged, table

#: Fixed values of the format.
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID = "urn:capture:"

LARGE_BYTES = 1 << 17
RECORDS_PER_FILE = 1000
LARGE_RECORDS_PER_FILE = 8
BLOCK_LINES = 300
#: Entries of a page of the directory, where it is too long to be sent whole.
PAGE = 10_000
#: Keys of one block that are searched in one task at once.
KEYS_AT_ONCE = 1000
#: Ranges with a gap of no more bytes between them are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 4096, 8 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits (20 bits) make four base32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), HEX32, BASE32)


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: com,example,m)/path?query, lower-case host, without www, port 80/443 and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    tail = f":{port}" if port and port not in (80, 443) else ""
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + tail + ")" + path


def index_key(url: str | None) -> str:
    """The key as blocks hold and sort it, without the spaces and line ends that separate their fields."""
    return surt(url).replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")


def typed(pages: DataFrame, *, key: str, url: str, html: str) -> DataFrame:
    """Rows with digest, record type and what a revisit refers to. Only digests of repeated payloads are joined back."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("_html"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.encode("_html", "UTF-8"))).withColumn("payload_bytes", F.octet_length("_html").cast("bigint"))
    same = rows.groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = staged(same.where("_n > 1").drop("_n"), "repeated-payloads")
    rows = lookup(rows, same, F.col("payload_digest"), "_digest")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_first")


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A whole record without its closing line ends; columns payload_bytes, payload_digest, record_type and refers_to are read."""
    size, revisit = F.col("payload_bytes"), F.col("record_type") == "revisit"
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), size.cast("string"), F.lit(RECORD_END))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), "\x00", "%00")
    block = F.when(revisit, head).otherwise(F.concat(head, html))
    return F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.col("record_type"),
        F.lit(CRLF + f"WARC-Record-ID: <{ID}"), F.md5(F.concat_ws(" ", page_id, "payload_digest", F.monotonically_increasing_id())), F.lit(">" + CRLF + f"WARC-Date: {DATE}" + CRLF),
        F.coalesce(F.concat(F.lit("WARC-Page-ID: "), page_id.cast("string"), F.lit(CRLF)), F.lit("")),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), safe, F.lit(CRLF + "WARC-Page-URL: "), F.url_encode(url), F.lit(CRLF)), F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"), F.lit(CRLF + f"WARC-Profile: {PROFILE}" + CRLF))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF + "WARC-Payload-Length: "), size.cast("string"),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(RECORD_END), block,
    )


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write the pages as WARC files under path/usual and path/large."""
    rows = typed(pages, key=key, url=url, html=html)
    text = rows.select("payload_bytes", record_text(F.col("page_id"), F.col("url"), F.col("_html")).alias("value"))
    for name, some, n in (("usual", F.col("payload_bytes") <= LARGE_BYTES, RECORDS_PER_FILE), ("large", F.col("payload_bytes") > LARGE_BYTES, LARGE_RECORDS_PER_FILE)):
        if name == "large" and not pages.where(F.octet_length(html) > LARGE_BYTES).limit(1).count():
            continue
        text.where(some).select("value").write.option("lineSep", RECORD_END).option("maxRecordsPerFile", n).text(f"{path}/{name}")


def records(content: memoryview) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and header fields of each record of an archive, by its Content-Length."""
    at, n = 0, len(content)
    while at < n:
        size = 4096
        head = bytes(content[at : at + size])
        while (end := head.find(b"\r\n\r\n")) < 0 and at + len(head) < n:
            size *= 2
            head = bytes(content[at : at + size])
        if end < 0 or not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        found = header(head[:end])
        length = end + 4 + int(found["content-length"])
        yield at, length, found
        at += length + 4


def header(head: bytes) -> dict[str, str]:
    """The fields of a header by lower-case name; the last of equal ones counts."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split(CRLF)[1:])}


def page_url(fields: dict[str, str]) -> str | None:
    """The url of the page as it was written."""
    found = fields.get("warc-page-url")
    return None if found is None else unquote_plus(found)


def parse(record: bytes) -> dict:
    """Headers and payload facts of one record; the payload of a response is measured, that of a revisit is as stated."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = header(head)
    number = lambda name: int(fields[name]) if name in fields else None
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    out = {"page_id": number("warc-page-id"), "url": page_url(fields), "record_type": fields["warc-type"], "refers_to": number("warc-refers-to-page-id"), "payload_digest": digest}
    if out["record_type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
        return out | {"payload_bytes": len(payload), "payload": payload}
    return out | {"payload_bytes": int(fields["warc-payload-length"]), "payload": None}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: key, file, offset, length. Archives are walked where they lie; only keys leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column(0)[i].as_py(), memoryview(b.column(1)[i].as_buffer())
                keys, offsets, lengths = [], [], []
                for at, n, fields in records(data):
                    keys.append(index_key(page_url(fields)))
                    offsets.append(at)
                    lengths.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array([name] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    names=["key", "file", "offset", "length"],
                )

    return _files(spark, path).mapInArrow(run, "key string, file string, offset bigint, length bigint")


def build_index(spark: SparkSession, path: str, index: str) -> None:
    """Write index/blocks (compressed runs of sorted captures) and index/directory (first key of each block)."""
    ordered = captures(spark, path).repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, int, int]] = []

        def block() -> pa.RecordBatch:
            lines = "\n".join(f"{k} {o} {n} {f}" for k, f, o, n in held)
            packed = zlib.compress(lines.encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([held[-1][0]]), pa.array([len(held)], pa.int64()), pa.array([packed], pa.binary())], names=["first_key", "last_key", "n", "block"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                held.append(row)
                if len(held) == BLOCK_LINES:
                    yield block()
                    held.clear()
        if held:
            yield block()

    blocks = ordered.mapInArrow(run, "first_key string, last_key string, n bigint, block binary")
    blocks = blocks.withColumn("block_id", F.monotonically_increasing_id())
    blocks.write.parquet(f"{index}/blocks")
    spark.read.parquet(f"{index}/blocks").select("first_key", "last_key", "n", "block_id").write.parquet(f"{index}/directory")


def unpack(block: bytes) -> list[tuple[str, int, int, str]]:
    """Captures of a block: key, offset, length, file."""
    out = []
    for line in zlib.decompress(block).decode().split("\n"):
        key, offset, length, file = line.split(" ", 3)
        out.append((key, int(offset), int(length), file))
    return out


def _in_directory(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """The entries of the directory that can hold each key: key, block_id. Entries have first_key, last_key, block_id and fit."""
    rows = directory.orderBy("first_key", "last_key", "block_id").collect()
    sent = keys.sparkSession.sparkContext.broadcast(([r.first_key for r in rows], [r.last_key for r in rows], [r.block_id for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, ids = sent.value
        for b in batches:
            found, blocks = [], []
            for key in b.column(0).to_pylist():
                # blocks are apart but for a key at their ends, so both lists are in order
                for i in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                    found.append(key)
                    blocks.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(blocks, pa.int64())], names=["key", "block_id"])

    return keys.mapInArrow(run, "key string, block_id bigint")


def find_blocks(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """The blocks that can hold each of the keys (one column, distinct): key, block_id."""
    directory = spark.read.parquet(f"{index}/directory").select("first_key", "last_key", "block_id")
    if fits(directory, BROADCAST_ROWS):
        return _in_directory(keys, directory)
    # the blocks of one part of the index follow each other, so pages of them do
    paged = directory.withColumn("page", F.floor(F.col("block_id") / F.lit(PAGE)))
    pages = paged.groupBy("page").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")).withColumnRenamed("page", "block_id")
    asked = _in_directory(keys, pages).withColumnRenamed("block_id", "page")
    fit = (F.col("first_key") <= F.col("key")) & (F.col("last_key") >= F.col("key"))
    return asked.join(paged, "page").where(fit).select("key", "block_id")


def search(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """The captures of the keys (one column, distinct): key, file, offset, length."""
    found = staged(find_blocks(spark, index, keys), "block-keys")
    often = found.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    dealt = found.join(often, "block_id").withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / KEYS_AT_ONCE)))
    asked = dealt.groupBy("block_id", "part").agg(F.collect_list("key").alias("keys"))  # about KEYS_AT_ONCE keys
    blocks = spark.read.parquet(f"{index}/blocks").select("block_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, packed in zip(b.column(0), b.column(1)):
                rows, out = unpack(packed.as_py()), []
                for key in keys.as_py():
                    at = bisect.bisect_left(rows, key, key=lambda r: r[0])
                    while at < len(rows) and rows[at][0] == key:
                        out.append(rows[at])
                        at += 1
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["key", "offset", "length", "file"])

    return asked.join(blocks, "block_id").select("keys", "block").mapInArrow(run, "key string, offset bigint, length bigint, file string")


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _facts(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Ranges of one file that lie near each other, from rows of file, offset and length in order."""
    held, where = [], None
    for b in batches:
        for file, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
            end = held[-1][0] + held[-1][1] if held else 0
            if held and (file != where or offset - end > GAP_BYTES or offset + length - held[0][0] > READ_BYTES):
                yield where, held
                held = []
            where = file
            held.append((offset, length))
    if held:
        yield where, held


def read_captures(spark: SparkSession, path: str, found: DataFrame, *, mounted: bool | None = None) -> DataFrame:
    """The records at file, offset and length of the archives of a folder: only these ranges are read, near ones at once.

    Python reads them where the files lie in a mounted file system; elsewhere (mounted=False) Spark loads
    whole files, and the ranges are cut out of them.
    """
    found = found.select("file", "offset", "length")
    if mounted is None:
        some = found.limit(1).collect()
        mounted = not some or some[0].file.startswith(("file:", "/"))
    if not mounted:
        return _cut(spark, path, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for name, ranges in _ranges(batches):
            if name != opened:
                file, opened = pafs.LocalFileSystem().open_input_file("/" + name.removeprefix("file:").lstrip("/")), name
            start = ranges[0][0]
            data = memoryview(file.read_at(ranges[-1][0] + ranges[-1][1] - start, start))
            yield _facts([parse(bytes(data[o - start : o - start + n])) for o, n in ranges])

    return found.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def _cut(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """The records at file, offset and length out of whole files."""
    # a file has at most RECORDS_PER_FILE records, so the list of its ranges is bounded
    ranges = found.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))
    files = _files(spark, path).join(ranges, F.col("path") == F.col("file")).select("content", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = memoryview(b.column(0)[i].as_buffer())
                yield _facts([parse(bytes(data[r["offset"] : r["offset"] + r["length"]])) for r in b.column(1)[i].as_py()])

    return files.mapInArrow(run, RECORD)


def keys_of(pages: DataFrame, url: str = "url") -> DataFrame:
    """The distinct index keys of urls: key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([index_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    return pages.select(F.col(url).alias("url")).mapInArrow(run, "key string").distinct()


def read_back(spark: SparkSession, path: str, index: str, pages: DataFrame | None = None, *, url: str = "url", mounted: bool | None = None) -> DataFrame:
    """The records of all urls of `pages`, searched in the index and read by ranges; without pages, those of every capture."""
    keys = captures(spark, path).select("key").distinct() if pages is None else keys_of(pages, url)
    return read_captures(spark, path, staged(search(spark, index, keys), "captures"), mounted=mounted)


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """Bytes [offset, offset + length) of a file of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(file)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(offset)
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()


def lookup_url(spark: SparkSession, index: str, url: str) -> list[dict]:
    """All records of one URL with their payloads, read by the driver."""
    keys = spark.createDataFrame([(index_key(url),)], "key string")
    return [parse(read_range(spark, r.file, r.offset, r.length)) for r in search(spark, index, keys).toLocalIterator()]


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written, indexed, and found again by its url; all cases as the module says."""
    path, index, pages = shared_path(spark, "archives"), shared_path(spark, "index"), table(spark, sf_dir, "pages")
    write_archives(pages, path)
    build_index(spark, path, index)
    return read_back(spark, path, index, pages)


_DIGITS = " || ".join(f"substr('{BASE32}', (1 + (v{i} // {32 ** (3 - j)}) % 32)::BIGINT, 1)" for i in range(8) for j in range(4))
QUERIES = {"op5_warc": op5_warc}
ORACLES = {
    "op5_warc": f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, url, h, {', '.join(f"('0x' || substr(x, {1 + 5 * i}, 5))::BIGINT AS v{i}" for i in range(8))} FROM p),
e AS (SELECT page_id, url, h, {_DIGITS} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM d)
SELECT page_id, url, octet_length(encode(h))::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END::BIGINT AS refers_to FROM e"""
}
