"""SentencePiece coding: unigram Viterbi over a double-array trie, byte fallback, white-space markers.

A model file gives pieces, scores and types. Pieces go into a double-array trie over UTF-8 bytes, in
which the white-space marker of the pieces stands as a plain space, so a literal marker in a text is
an unknown character and survives the round trip. Encoding puts one space before the text, finds the
segmentation of the highest total log score, and spells characters that no piece covers as bytes.
Decoding joins the pieces, turns markers into spaces, reads bytes as UTF-8 and drops the first space.

A unigram model's scores are log probabilities and are taken as they are. A merge model's scores are
the order of its merges; they become the log probabilities of a Zipf distribution over that order.

No piece of the usual models has a marker after another character, so the best segmentation of a
text is that of its marked words one after another, and words are looked up in a bounded cache; a
model with such pieces is searched over whole texts.

Unused, control and unknown pieces are never emitted. A model that normalises texts is refused.

Defined results: null and empty texts have no ids; a text of any length is coded whole (a word of more than
SHORT characters by itself, at twelve bytes a byte); an empty table gives no rows; other columns are not
read, whatever their names; without byte pieces an uncovered character is the
unknown id and the round trip is false; repeated rows are coded alike; a null key is passed on.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

#: Where the vocabulary lies by default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
MARKER = "▁"
#: Log score by which an uncovered character lies below the least piece.
UNKNOWN_PENALTY = 10.0
#: Rank that is added in Zipf's law.
ZIPF_SHIFT = 2.7
CACHE_WORDS = 400_000
#: Characters of the units that are segmented in step and cached.
SHORT = 48


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value (varints as int, the rest as bytes)."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
            yield tag >> 3, value
            continue
        if kind == 2:
            size, i = varint(i)
        else:
            size = {1: 8, 5: 4}[kind]
        yield tag >> 3, data[i : i + size]
        i += size


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], int, bool]:
    """Pieces (text, score, type), the model type, and whether a space goes before a text.

    Only models that leave texts as they are otherwise are read: a table of character rules, or the
    removal of spaces, would change texts before they are coded, so that no round trip could hold.
    """
    pieces, model_type, prefix = [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece.get(1, b"").decode("utf-8"), score, piece.get(3, NORMAL)))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            rules = dict(_fields(value))
            if rules.get(2) or rules.get(4, 1):
                raise ValueError("the model normalises texts; only models of the identity rule that keep spaces are read")
            prefix = bool(rules.get(3, 1))
    return pieces, model_type, prefix


def log_scores(pieces: list[tuple[str, float, int]], model_type: int) -> list[float]:
    """Log probabilities of the pieces."""
    if model_type == UNIGRAM:
        return [s for _, s, _ in pieces]
    ranks = [-s for _, s, t in pieces if t == NORMAL]
    total = math.log(sum(1 / (r + ZIPF_SHIFT) for r in ranks))
    return [-math.log(-s + ZIPF_SHIFT) - total if t == NORMAL else 0.0 for _, s, t in pieces]


class DoubleArrayTrie:
    """Keys of bytes with values, as two arrays: from node s by byte b to t = base[s] + b + 1 if check[t] == s.

    A key ends at node s if t = base[s] has check[t] == s; its value is -base[t] - 1.
    """

    def __init__(self, base: np.ndarray, check: np.ndarray) -> None:
        self.base_array, self.check_array = base, check
        self.base, self.check = base.tolist(), check.tolist()

    @classmethod
    def of(cls, items: dict[bytes, int]) -> "DoubleArrayTrie":
        """The trie of these keys and values."""
        keys = sorted(items)
        size = 1 << 16
        bases, checks = [0] * size, [-1] * size
        checks[0] = 0  # the root
        free = 1
        todo = [(0, 0, len(keys), 0)]
        while todo:
            node, low, high, depth = todo.pop()
            codes: list[tuple[int, int, int]] = []
            i = low
            while i < high:
                code = keys[i][depth] + 1 if len(keys[i]) > depth else 0
                j = i + 1
                while j < high and (keys[j][depth] + 1 if len(keys[j]) > depth else 0) == code:
                    j += 1
                codes.append((code, i, j))
                i = j
            at = max(1, free - codes[0][0])
            while True:
                if at + 258 > len(bases):
                    bases += [0] * len(bases)
                    checks += [-1] * (len(bases) - len(checks))
                if all(checks[at + c] < 0 for c, _, _ in codes):
                    break
                at += 1
            bases[node] = at
            for c, i, j in codes:
                checks[at + c] = node
                if c == 0:
                    bases[at] = -items[keys[i]] - 1
                else:
                    todo.append((at + c, i, j, depth + 1))
            while checks[free] >= 0:
                free += 1
        pad = 512  # a step from any node stays inside
        return cls(np.array(bases + [0] * pad, dtype=np.int32), np.array(checks + [-1] * pad, dtype=np.int32))


class Codec:
    """Encoder and decoder of one model: its pieces (text, score, type), their log scores, the trie, and what goes before a text."""

    def __init__(self, pieces: list[tuple[str, float, int]], scores: list[float], trie: DoubleArrayTrie | None = None, prefix: bool = True) -> None:
        self.pieces, self.scores = pieces, scores
        self.prefix = " " if prefix else ""
        self.cache: dict[str, bytes] = {}  # ids of words as 32-bit numbers, of a worker, over all its tasks
        coded = {p.replace(MARKER, " ").encode(): i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED) and p}
        self.trie = trie or DoubleArrayTrie.of(coded)
        self.bytes_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), -1)
        plain = [s for s, (_, _, t) in zip(scores, pieces) if t == NORMAL]
        self.unknown_score = (min(plain) if plain else 0.0) - UNKNOWN_PENALTY
        self.spelled = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARKER, " ").encode() for p, _, t in pieces
        ]
        texts = [p for p, _, t in pieces if t in (NORMAL, USER_DEFINED)]
        crossing = any(re.search(f"[^{MARKER}]{MARKER}", p) for p in texts)
        lonely = not any("\n" in p for p in texts)
        self.units = None if crossing else re.compile(" *[^ \n]+| +|\n" if lonely else " *[^ ]+| +")

    def arrays(self) -> dict:
        """What a worker needs to make the codec again: plain lists and arrays, which need no class of this library to be read."""
        return {"pieces": self.pieces, "scores": self.scores, "base": self.trie.base_array, "check": self.trie.check_array, "prefix": bool(self.prefix)}

    @classmethod
    def again(cls, held: dict) -> "Codec":
        """The codec of these arrays, made once in a worker and kept beside them."""
        if "codec" not in held:
            held["codec"] = cls(held["pieces"], held["scores"], DoubleArrayTrie(held["base"], held["check"]), held["prefix"])
        return held["codec"]

    def best(self, text: str) -> list[int]:
        """Ids of the segmentation of the highest total score; of equal ones that whose last piece, then the one before it, is longest."""
        data, base, check, scores = text.encode("utf-8", "surrogatepass"), self.trie.base, self.trie.check, self.scores
        n, size, spelled = len(data), len(self.trie.base), self.spelled
        # twelve bytes for each byte of the text: where a piece ends says where it starts
        total, last = array("d", [-math.inf]) * (n + 1), array("i", [-1]) * (n + 1)
        total[0] = 0.0
        i = 0
        while i < n:
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            so_far, node, j, whole = total[i], 0, i, False
            while j < n:
                t = base[node] + data[j] + 1
                if t >= size or check[t] != node:
                    break
                node, j = t, j + 1
                end = base[node]
                if check[end] == node and base[end] < 0:
                    piece = -base[end] - 1
                    s = so_far + scores[piece]
                    if s > total[j]:
                        total[j], last[j] = s, piece
                    whole = whole or j == i + width
            if not whole:
                s = so_far + self.unknown_score
                if s > total[i + width]:
                    total[i + width], last[i + width] = s, -1
            i += width
        out: list[int] = []
        at = n
        while at:
            piece, start = last[at], at
            if piece >= 0:
                start -= len(spelled[piece])
                out.append(piece)
                at = start
                continue
            start -= 1
            while data[start] & 0xC0 == 0x80:
                start -= 1
            if self.bytes_ids:
                out.extend(self.bytes_ids[b] for b in reversed(data[start:at]))
            else:
                out.append(self.unknown)
            at = start
        out.reverse()
        return out

    def best_many(self, units: list[str]) -> list[list[int]]:
        """best() of many short texts at once."""
        return [np.frombuffer(x, dtype=np.int32).tolist() for x in self.coded_many(units)]

    def coded_many(self, units: list[str]) -> list[bytes]:
        """Ids of many short texts as 32-bit numbers, found in step: one move of the trie is one array operation over all of them."""
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        length = np.array([len(r) for r in raw])
        w, m = len(raw), int(length.max())
        data = np.frombuffer(b"".join(r.ljust(m + 4, b"\0") for r in raw), dtype=np.uint8).reshape(w, m + 4)
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        starts = (data & 0xC0) != 0x80
        base, check, scores = self.trie.base_array, self.trie.check_array, np.array(self.scores)
        total = np.full((w, m + 5), -np.inf)
        total[:, 0] = 0.0
        back, piece_at = np.zeros((w, m + 5), np.int32), np.full((w, m + 5), -1, np.int32)
        for i in range(m):
            rows = np.flatnonzero(starts[:, i] & (length > i))
            cur, node, so_far = rows, np.zeros(len(rows), np.int32), total[rows, i]
            whole = np.zeros(w, dtype=bool)
            for j in range(i, m):
                t = base[node] + data[cur, j] + 1
                ok = (check[t] == node) & (length[cur] > j)
                cur, node, so_far = cur[ok], t[ok], so_far[ok]
                if not len(cur):
                    break
                end = base[node]
                done = np.flatnonzero((check[end] == node) & (base[end] < 0))
                if len(done):
                    r, piece = cur[done], -base[end[done]] - 1
                    s = so_far[done] + scores[piece]
                    better = s > total[r, j + 1]
                    r2 = r[better]
                    total[r2, j + 1], back[r2, j + 1], piece_at[r2, j + 1] = s[better], i, piece[better]
                    whole[r[width[r, i] == j + 1 - i]] = True
            alone = rows[~whole[rows]]
            if len(alone):
                s, to = total[alone, i] + self.unknown_score, i + width[alone, i]
                better = s > total[alone, to]
                r2, to = alone[better], to[better]
                total[r2, to], back[r2, to], piece_at[r2, to] = s[better], i, -1
        # all texts are traced back in step, too; those with characters to spell one by one
        traced, steps, plain = np.empty((w, m), np.int32), np.zeros(w, np.int64), np.ones(w, dtype=bool)
        at, live, column = length.copy(), np.arange(w), m
        while len(live):
            piece = piece_at[live, at[live]]
            plain[live[piece < 0]] = False
            live, piece = live[piece >= 0], piece[piece >= 0]
            column -= 1
            traced[live, column] = piece
            steps[live] += 1
            at[live] = back[live, at[live]]
            live = live[at[live] > 0]
        out = [traced[i, m - n :].tobytes() for i, n in enumerate(steps.tolist())]
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self._spelled_back(raw[i], back[i].tolist(), piece_at[i].tolist())
        return out

    def _spelled_back(self, raw: bytes, back: list[int], pieces: list[int]) -> bytes:
        """Ids of one text from where its pieces start and which they are; characters without a piece are spelled."""
        ids, at = [], len(raw)
        while at:
            start = back[at]
            if pieces[at] >= 0:
                ids.append(pieces[at])
            elif self.bytes_ids:
                ids.extend(self.bytes_ids[x] for x in reversed(raw[start:at]))
            else:
                ids.append(self.unknown)
            at = start
        return array("i", reversed(ids)).tobytes()

    def encode(self, texts: list[str], cache: dict[str, bytes]) -> list[np.ndarray]:
        """Ids of each text; units that the cache lacks are segmented together."""
        if self.units is None:
            return [np.array(self.best(self.prefix + t) if t else [], dtype=np.int32) for t in texts]
        split = [self.units.findall(self.prefix + t) if t else [] for t in texts]
        here = set().union(*split)
        new = here - cache.keys()
        if len(cache) + len(new) > CACHE_WORDS:
            # what these texts use stays, so frequent words are never segmented anew
            kept = {u: cache[u] for u in here & cache.keys()}
            cache.clear()
            cache.update(kept)
        short = sorted((u for u in new if len(u) <= SHORT), key=len)
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            cache.update(zip(part, self.coded_many(part)))
        long = [u for u in new if len(u) > SHORT]
        cache.update((u, array("i", self.best(u)).tobytes()) for u in long)
        out = [np.frombuffer(b"".join(map(cache.__getitem__, units)), dtype=np.int32) for units in split]
        for u in long:
            del cache[u]
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def load(path: str = MODEL) -> Codec:
    """The codec of a model file on the driver."""
    with open(path, "rb") as f:
        pieces, model_type, prefix = read_model(f.read())
    return Codec(pieces, log_scores(pieces, model_type), prefix=prefix)


def _run(docs: DataFrame, codec: Codec, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(codec.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codec.again(sent.value)
        cache = c.cache
        low, high = (min(c.bytes_ids.values()), max(c.bytes_ids.values())) if c.bytes_ids else (0, -1)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                lists = c.encode(texts, cache)
                same = [c.decode(ids) == t for ids, t in zip(lists, texts)]
                counts = np.array([len(x) for x in lists], dtype=np.int64)
                flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
                spelled = np.array([int(((x >= low) & (x <= high)).sum()) for x in lists], dtype=np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(counts), pa.array(spelled), pa.array(same)], names=["_key", "ids", "n_tokens", "n_byte_tokens", "round_trip"])

    out = rows.mapInArrow(run, f"_key {kind}, ids array<int>, n_tokens bigint, n_byte_tokens bigint, round_trip boolean")
    return out.withColumnRenamed("_key", key)


def encode(docs: DataFrame, model: str = MODEL, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text: key, ids, n_tokens, n_byte_tokens, and whether decoding gives the text again. One narrow pass."""
    return _run(docs, load(model), key, text)


def decode(coded: DataFrame, model: str = MODEL, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of id lists: key, text; null ids give the empty text."""
    sent = coded.sparkSession.sparkContext.broadcast(load(model).arrays())
    rows = coded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.again(sent.value)
        for b in batches:
            texts = [codec.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["_key", "text"])

    return rows.mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLES: dict[str, str] = {}
