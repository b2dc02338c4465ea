"""Secrets in texts: fixed patterns, and novelty under a dictionary-primed compressor.

Base patterns find assignments, access keys and long hexadecimal runs. Beyond them, each long
token in the line of a word of secrecy, or near it on either side, is compressed by zstandard. Its dictionary
holds the identifiers that occur in most documents (counted over all of them) and words that code
repeats; the frame starts with rarer words of the corpus, spelled backwards, and the text around the token, so that letters
cost what they cost in such text. What the token adds in bytes is its novelty. It is reported as
kind "novel", at every place of the text where its value occurs, if it adds more than a limit for its length:
half way between what nearly all made-up identifiers of that length add and what nearly all random strings add, both
measured by the same compressor when it is made. Case counts only where it is not that of words, so
constants and camel case cost what their words cost. Other occurrences of the candidate do not prime the compressor.

What is a candidate is part of the definition: a token of SHORTEST characters or more, with a letter, that is no
host of a mail address and whose line, or whose REACH characters on either side, hold a word of secrecy.

Defined results: null or empty text has no spans and the digest of the empty string; positions are
code points, the end is exclusive; whole texts of any length are scanned; a null doc_id is passed on; repeated
rows give repeated rows; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "novel")
_RANK = {k: i for i, k in enumerate(KINDS)}
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: AKIA and at least 14 more: the run is as long as it can be, so a shorter one never fits.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE = 12
#: Words near which a token is a candidate: in its line, or with so many characters between on either side.
SENSITIVE = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credential", "bearer", "apikey")
#: What stands before "key", with a space, an underscore, a hyphen or nothing between.
KEYS_OF = ("api", "access", "private", "auth", "signing", "encryption", "decryption", "master", "shared", "account", "storage", "service", "session", "deploy", "ssh", "license")
REACH = 32
CANDIDATE = re.compile(r"[A-Za-z0-9+/_][A-Za-z0-9+/_=.\-]{15,}")
CONTEXT = re.compile("|".join([*SENSITIVE, f"(?:{'|'.join(KEYS_OF)})[ _-]?key"]), re.ASCII | re.IGNORECASE)
#: Characters of the shortest candidate.
SHORTEST = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_=.\-]")
#: What may follow or, read backwards, precede a word of secrecy in an identifier; the whole run of its characters.
REST = re.compile(r"(?:[A-Za-z]{1,15}[0-9]{0,2}(?![A-Za-z0-9]))?(?:[_-]+[A-Za-z]{1,15}[0-9]{0,2}(?![A-Za-z0-9]))*[_-]*")
NAME = re.compile(r"[A-Za-z0-9_-]*")
HOST = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\.?")
#: A value in the case of words: camel case, constants, or lower case.
WORDED = re.compile(r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[^A-Za-z]++)*+")
#: Characters of the text on each side of a candidate that prime the compressor.
AROUND = 512
#: Level at which zstandard looks for matches of three letters.
LEVEL = 19
#: Identifiers of the corpus in the dictionary, and rarer ones that prime frames and make up identifiers.
IN_DICTIONARY, RARER = 3000, 1000
PRIMED = 1000
#: Lengths at which limits are measured, strings measured for each, and the share of them that a limit lies beyond.
LENGTHS = (16, 20, 24, 32, 40, 48, 64, 96, 128)
TRIALS, NEARLY_ALL = 60, 0.95
SEED = 5
#: Placeholders, and words of which identifiers are commonly made.
IDENTIFIERS = (
    "your_api_key_here your_token_here insert_your_key changeme placeholder example abcdefghijklmnopqrstuvwxyz 0123456789 "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx ---------------- 0000000000000000 1234567890"
)
PARTS = (
    "access account action active address admin agent app archive array async auth author backup base batch body branch "
    "buffer build byte cache call category channel class client cloud cluster code color column command comment common "
    "company component config connection console content context control cookie count create current customer data "
    "database date debug default delete deploy detail device digest directory document domain download driver email "
    "enable entity env error event example execute expire export factory feature field file filter final first folder "
    "format function gateway global graph group handler hash header health helper history host html http image import "
    "index info input instance interface internal item iterator job json key label language layout length level library "
    "limit link list load local lock log login main manager map max member memory message metadata method metric min "
    "mode model module monitor name network next node note number object offset option order output owner package page "
    "parameter parent path pattern payload permission pipeline platform plugin point port position prefix private "
    "process product profile project property protocol provider public query queue random range rate read record "
    "region register release remote report request reset resource response result role root"
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Novelty:
    """A compressor primed with identifiers, and the limits beyond which what a value adds is novel.

    words: dictionary text; prime: what every frame starts with; limits: bytes by length (LENGTHS).
    """

    def __init__(self, words: str, prime: str, limits: list[float]) -> None:
        self.words, self.prime, self.limits = words, prime, limits
        held = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, value: str, before: str = "", after: str = "") -> int:
        """Bytes by which a frame of the prime and the surroundings grows with the value."""
        frame = f"{self.prime} {after}\n{before}"
        if WORDED.fullmatch(value):
            value, frame = value.lower(), frame.lower()
        raw = frame.encode("utf-8", "replace")
        return len(self.packer.compress(raw + value.encode())) - len(self.packer.compress(raw))

    def limit(self, length: int) -> float:
        """Bytes that a value of so many characters must add: between two measured lengths in proportion, beyond the last by its share."""
        for low, high, a, z in zip(LENGTHS, LENGTHS[1:], self.limits, self.limits[1:]):
            if length <= high:
                return a + (z - a) * (length - low) / (high - low)
        return self.limits[-1] * length / LENGTHS[-1]

    def plain(self) -> dict:
        """What a worker needs to make the compressor again."""
        return {"words": self.words, "prime": self.prime, "limits": self.limits}


def again(held: dict) -> Novelty:
    """The compressor of these values, made once in a worker and kept beside them."""
    if "novelty" not in held:
        held["novelty"] = Novelty(held["words"], held["prime"], held["limits"])
    return held["novelty"]


def made_up(r: random.Random, pool: list[str], length: int) -> str:
    """An identifier of the words of a pool, in one of the usual spellings."""
    sep, out = r.choice(["_", "_", "-", ".", "/", ""]), ""
    while len(out) < length:
        word = r.choice(pool) if r.random() < 0.9 else str(r.randint(1, 2030))
        out += (sep if out else "") + (word if sep or not out else word.capitalize())
    return out[:length]


def learnt(tokens: list[str]) -> Novelty:
    """The compressor for a corpus whose most frequent identifiers these are, most frequent first."""
    parts = PARTS.split()
    known, rarer = tokens[:IN_DICTIONARY], tokens[IN_DICTIONARY:] or tokens or parts
    r = random.Random(SEED)
    # the end of a dictionary is the nearest to a frame
    words = " ".join([*reversed(known), *parts, IDENTIFIERS])
    # spelled backwards they have the letters of words but no match in the dictionary, so letters are coded by their frequency
    prime = " ".join(r.choice((rarer, parts)[i % 2]).lower()[::-1] for i in range(PRIMED // 3))[:PRIMED]
    found, limits = Novelty(words, prime, []), []
    pool = [w.lower() for w in [*parts, *r.sample(rarer, min(len(rarer), len(parts)))]]
    for n in LENGTHS:
        usual = sorted(found.added(made_up(r, pool, n)) for _ in range(TRIALS))
        letters = ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef")
        strange = sorted(found.added("".join(r.choice(letters[i % 2]) for _ in range(n))) for i in range(TRIALS))
        limits.append((usual[int(NEARLY_ALL * TRIALS)] + strange[int((1 - NEARLY_ALL) * TRIALS)]) / 2)
    return Novelty(words, prime, limits)


def general() -> Novelty:
    """The compressor that knows no corpus; made anew at each call, in about a tenth of a second."""
    return learnt([])


#: Identifiers, or parts of them between separators, that are spelled as words; a random string is none, so secrets never get in.
IDENTIFIER = r"(?<![A-Za-z0-9])((?:[A-Z]?[a-z]{2,31}+){1,4}+|[A-Z]{3,31}+)(?![A-Za-z0-9])"


def frequent_identifiers(docs: DataFrame, text: str = "text") -> list[str]:
    """The IN_DICTIONARY + RARER identifiers that most documents hold, two at least, by count and then by name; every document is counted."""
    each = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(IDENTIFIER), F.lit(1)))
    counts = docs.select(F.explode(each).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return [r.w for r in counts.orderBy(F.col("n").desc(), "w").limit(IN_DICTIONARY + RARER).collect()]


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """The text before and after a candidate, without other occurrences of it."""
    value = text[start:end]
    far, blank = AROUND + len(value), " " * len(value)
    before, after = text[max(0, start - far) : start], text[end : end + far]
    return before.replace(value, blank)[-AROUND:], after.replace(value, blank)[:AROUND]


def identifiers(text: str) -> list[tuple[int, int]]:
    """Words of secrecy with the rest of the identifier around them, where that is made of words; in order, apart."""
    found: list[tuple[int, int]] = []
    last = unfit = 0
    for m in CONTEXT.finditer(text):
        if m.start() < last:
            continue
        start, end = m.start(), m.end()
        if end > unfit:
            rest = REST.match(text, end).end()
            run = NAME.match(text, end).end()
            end, unfit = (rest, unfit) if rest == run else (end, run)
        at = start
        while at > last and (text[at - 1] in "_-" or text[at - 1].isascii() and text[at - 1].isalnum()):
            at -= 1
        if REST.fullmatch(text[at:start][::-1]):
            start = at
        found.append((start, end))
        last = end
    return found


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every token whose line, or whose REACH characters on either side, hold a word of secrecy."""
    names = identifiers(text)
    near: list[list[int]] = []
    for start, end in names:
        if near and end <= near[-1][1] - REACH:
            continue
        line = text.find("\n", end)
        a, z = min(text.rfind("\n", 0, start) + 1, start - REACH), max(len(text) if line < 0 else line, end + REACH)
        if near and a <= near[-1][1]:
            near[-1][1] = max(near[-1][1], z)
        else:
            near.append([max(0, a), z])
    # a token lies between two identifiers and touches what is near
    gaps = [(a, z) for (_, a), (z, _) in zip([(0, 0), *names], [*names, (len(text), 0)])]
    g = 0
    for first, final in near:
        while g < len(gaps) and gaps[g][1] <= first:
            g += 1
        for low, high in gaps[g:]:
            if low >= final:
                break
            at = max(low, first)
            while at > low and TOKEN.match(text, at - 1):
                at -= 1
            for c in CANDIDATE.finditer(text, at, high):
                if c.start() >= final:
                    break
                # the host of a mail address is no secret
                mail = c.start() > low and text[c.start() - 1] == "@" and HOST.fullmatch(c.group())
                if re.search(r"[A-Za-z]", c.group()) and not mail:
                    yield c.span()
            g += high < final


def _trimmed(text: str, start: int, end: int) -> int:
    """The end of a candidate without the stop of a sentence."""
    short = start + len(text[start:end].rstrip(".-"))
    return short if short - start >= SHORTEST else end


def novel_spans(text: str, novelty: Novelty | None = None) -> list[tuple[str, int, int, int]]:
    """Values in sensitive context that the primed compressor can't shorten, wherever they occur: kind, start, end, bytes."""
    novel: dict[str, int] = {}
    for start, end in candidates(text):
        end = _trimmed(text, start, end)
        value = text[start:end]
        if value not in novel:
            novelty = novelty or general()
            added = novelty.added(value, *_around(text, start, end))
            if added >= novelty.limit(len(value)):
                novel[value] = added
    if not novel:
        return []
    begins: dict[str, list[str]] = {}
    for value in sorted(novel, key=len, reverse=True):
        begins.setdefault(value[:SHORTEST], []).append(value)
    found, last = [], 0
    for run in CANDIDATE.finditer(text):
        for i in range(run.start(), run.end() - SHORTEST + 1):
            value = next((v for v in begins.get(text[i : i + SHORTEST], ()) if text.startswith(v, i)), None)
            # an occurrence inside a longer value is part of that
            if value and i + len(value) > last:
                last = i + len(value)
                found.append(("novel", i, last, novel[value]))
    return found


def _listed(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], _RANK[s[0]]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def scan(text: str | None, novelty: Novelty | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, int]]]:
    """Base spans and novel spans of a whole text."""
    if not text:
        return [], []
    return base_spans(text), novel_spans(text, novelty) if CONTEXT.search(text) else []


def find_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every span of every text: key, spans (kind, start, end, value, added bytes or null). One pass counts identifiers, a narrow one scans."""
    sent = docs.sparkSession.sparkContext.broadcast(learnt(frequent_identifiers(docs, text)).plain())
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = again(sent.value)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                base, novel = scan(t, novelty)
                every = [(k, a, e, None) for k, a, e in base] + novel
                every.sort(key=lambda s: (s[1], _RANK[s[0]]))
                out.append([{"kind": k, "start": a, "end": e, "value": t[a:e], "added": n} for k, a, e, n in every])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(span))], names=["_key", "spans"])

    made = rows.mapInArrow(run, f"_key {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string,added:bigint>>")
    return made.withColumnRenamed("_key", key)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and digests that are derived from the operator's spans."""
    found = find_secrets(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("novel"),
        F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES: dict[str, str] = {}
