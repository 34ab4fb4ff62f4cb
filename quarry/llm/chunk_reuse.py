"""BPE encoding that reuses chunks across documents (operator 11).

Texts are cut where a rolling hash of the last 32 bytes says so, so equal
passages give equal chunks wherever they stand. A chunk that occurs more than
once in the corpus is encoded once and its ids are sent to every slice of
documents that holds it; what lies between such chunks is encoded where it is.
Spans encoded by themselves are then joined: the last tokens of the left and the
first of the right one are decoded and encoded again as one window, and the
window replaces them from a place where it agrees with the left span to a place
where it agrees with the right one. Windows grow until both are found; where the
two spans end first, they are encoded again as one span.

Agreement is a token boundary of both encodings at a *stable* place, one where
the pre-tokeniser always splits (``token_counts.stable``), at least one special
string's length away from the join. No merge and no special string crosses such
a place, so the tokens on its far side are those of the whole text. This holds
for byte-level BPE without a normaliser, which is read from the tokenizer's file;
a tokenizer of another kind gets every text whole.

Which chunks occur more than once is told by a bit map of fixed size: two chunks
that share a bit only send both the longer way, which gives the same ids.

Defined cases: a null text is an empty one, without tokens and with the hashes of
empty strings; repeated rows give repeated rows; a null doc_id stays null; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import releasing, single_threaded, sliced, texts_of, tokenizer_path, written
from quarry.llm.pieces import PieceTable
from quarry.llm.token_counts import spliceable, stable

#: Bytes of a chunk: at least, at most, and leading hash bits that are zero at a cut (1024 bytes more on average).
LEAST, MOST, ZEROS = 512, 8192, 10
#: Bytes that are encoded as one span between shared chunks, tokens of a join's first window, bits of the map of repeated chunks.
SPAN, WINDOW, BITS = 1 << 16, 16, 1 << 25
#: Bytes of text of a slice of documents, which gets each shared chunk once.
SLICE = 4 << 20
BLOCK, REACH = 1 << 20, 32


#: Pre-tokens remembered at a time.
KEPT = 250_000

#: The byte-level pre-tokens, with the letters, numbers and white space of Latin-1 spelled out.
_LETTERS, _NUMBERS, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACE}{_LETTERS}{_NUMBERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _gear() -> np.ndarray:
    """A fixed number for each byte: the leading 32 bits of its BLAKE2 hash."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "big") for b in range(256)], np.uint32)


GEAR = _gear()


def cut_places(data: bytes) -> list[int]:
    """The ends of the chunks of UTF-8 bytes; no cut is inside a character."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    found = []
    for at in range(0, n, BLOCK):
        lo, hi = max(0, at - REACH + 1), min(n, at + BLOCK)
        h = GEAR[raw[lo:hi]]
        for k in (1, 2, 4, 8, 16):  # each pass doubles the bytes that a sum reaches back
            more = h.copy()
            more[k:] += h[:-k] << np.uint32(k)
            h = more
        found.append(np.flatnonzero(h[at - lo :] >> np.uint32(32 - ZEROS) == 0) + at + 1)
    ends = np.concatenate(found)
    ends = ends[ends < n]
    ends = ends[raw[ends] & 0xC0 != 0x80]
    out, at = [], 0
    while n - at > LEAST:
        k = int(np.searchsorted(ends, at + LEAST))
        end = int(ends[k]) if k < len(ends) else n
        if end - at > MOST:
            end = at + MOST
            while raw[end] & 0xC0 == 0x80:
                end -= 1
        out.append(end)
        at = end
    return out if out and out[-1] == n else [*out, n]


def key_of(chunk: bytes) -> bytes:
    """128 bits that stand for a chunk."""
    return hashlib.blake2b(chunk, digest_size=16).digest()


def bit_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little") % BITS


class Codec:
    """The library's tokenizer, and the bytes of its tokens."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = max([*self.tok.get_vocab(True).values(), -1]) + 1
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.joins = spliceable(path)
        if not self.joins:
            return
        with open(path, encoding="utf-8") as f:
            added = {t["id"]: t["content"].encode() for t in json.load(f).get("added_tokens", [])}
        # byte-level vocabularies write visible Latin-1 bytes as themselves and the others, in order, from U+0100 on
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        self.bytes = [b""] * self.size
        for token, k in self.tok.get_vocab(False).items():
            self.bytes[k] = added[k] if k in added else bytes(letters[c] for c in token)
        for k, content in added.items():
            self.bytes[k] = content
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.margin = max([len(c) for c in added.values()], default=1)
        self.special = [c.decode() for c in added.values()]
        self.table = PieceTable(self._learn, self.type, KEPT)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.type) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._library(pieces)
        return np.concatenate([*ids, np.zeros(0, self.type)]), np.array([len(i) for i in ids], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text by itself. In Latin-1 texts without special strings each different pre-token is encoded once."""
        if not self.joins:
            return self._library(texts)
        plain = [k for k, t in enumerate(texts) if latin(t) and not any(s in t for s in self.special)]
        others = sorted({*range(len(texts))} - {*plain})
        out = dict(zip(plain, self.table.ids([PIECE.findall(texts[k]) for k in plain]))) | dict(zip(others, self._library([texts[k] for k in others])))
        return [out[k] for k in range(len(texts))]

    def data(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)

    # -- joins

    def _window(self, left: np.ndarray, right: np.ndarray, width: int) -> tuple[int, int, bytes, bytes]:
        """Tokens that stay left and right of a window of about ``width`` tokens a side, and its bytes; it begins and ends between characters."""
        a, b = max(0, len(left) - width), min(len(right), width)
        while a > 0 and self.bytes[left[a]][0] & 0xC0 == 0x80:
            a -= 1
        while b < len(right) and self.bytes[right[b]][0] & 0xC0 == 0x80:
            b += 1
        return a, b, self.data(left[a:]), self.data(right[:b])

    def _splice(self, left: np.ndarray, right: np.ndarray, window: tuple, new: np.ndarray) -> tuple[int, np.ndarray, int] | None:
        """(tokens kept of the left span, ids between, tokens dropped of the right one), if the window agrees with both."""
        a, b, lead, tail = window
        data, join = lead + tail, len(lead)
        text = data.decode()
        plain = len(text) == len(data)
        ends = np.cumsum(self.length[new])
        place = {int(e): k + 1 for k, e in enumerate(ends)}

        def agreed(p: int) -> bool:
            if p not in place or data[p] & 0xC0 == 0x80:
                return False
            return stable(text, p if plain else len(data[:p].decode()))

        before = np.cumsum(self.length[left[a:]]).tolist()
        p = next((k for k in range(len(before) - 1, -1, -1) if before[k] <= join - self.margin and agreed(before[k])), None)
        if p is None:
            return None
        after = (join + np.cumsum(self.length[right[:b]])).tolist()
        q = next((k for k in range(len(after)) if join + self.margin <= after[k] < len(data) and agreed(after[k])), None)
        if q is None:
            return None
        return a + p + 1, new[place[before[p]] : place[after[q]]], q + 1

    def joined(self, spans: list[np.ndarray]) -> np.ndarray:
        """The ids of a text from the ids of its spans, each encoded by itself."""
        spans = [s for s in spans if len(s)]
        if not spans:
            return np.zeros(0, self.type)
        splices: list[tuple[int, np.ndarray, int] | None] = [None] * (len(spans) - 1)
        width = WINDOW
        while todo := [k for k, s in enumerate(splices) if s is None]:
            windows = [self._window(spans[k], spans[k + 1], width) for k in todo]
            for k, window, new in zip(todo, windows, self.encode([(w[2] + w[3]).decode() for w in windows])):
                splices[k] = self._splice(spans[k], spans[k + 1], window, new)
            for k in range(len(splices) - 1, -1, -1):
                s = splices[k]
                spent = s is None and width >= max(len(spans[k]), len(spans[k + 1]))
                crossed = s is not None and k and splices[k - 1] is not None and splices[k - 1][2] > s[0]
                if spent or crossed:  # nothing agrees inside these two spans: they become one
                    spans[k : k + 2] = self.encode([(self.data(spans[k]) + self.data(spans[k + 1])).decode()])
                    del splices[k]
                    for near in (k - 1, k):
                        if 0 <= near < len(splices):
                            splices[near] = None
            width *= 2
        out, at = [], 0
        for span, (end, new, drop) in zip(spans, splices):
            out += [span[at:end], new]
            at = drop
        return np.concatenate([*out, spans[-1][at:]])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def repeated_chunks(docs: DataFrame) -> np.ndarray:
    """A bit map of ``BITS`` bits: set for every chunk that occurs more than once, and for whatever shares its bit."""

    def run(batches):
        for batch in sliced(batches):
            keys = [int.from_bytes(key_of(data[a:b])[:8], "little", signed=True) for data in map(str.encode, texts_of(batch.column(0))) for a, b in _chunks(data)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), "key long").groupBy("key").count().filter("count > 1")
    place = F.pmod(F.col("key"), F.lit(BITS)) + 1
    rows = seen.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)  # at most BITS / 32768 rows of 4 kB
    for row in rows:
        at = (row["bucket"] - 1) * 4096
        out[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return out


def _chunks(data: bytes) -> list[tuple[int, int]]:
    ends = cut_places(data)
    return list(zip([0, *ends], ends))


def _spans(data: bytes, repeated: np.ndarray) -> list[tuple[int, int, bytes | None]]:
    """(start, end, key) of a text's spans: repeated chunks by key, and what lies between them in spans of up to ``SPAN`` bytes."""
    out: list[tuple[int, int, bytes | None]] = []
    for a, b in _chunks(data):
        key = key_of(data[a:b])
        bit = bit_of(key)
        if repeated[bit >> 3] >> (bit & 7) & 1:
            out.append((a, b, key))
        elif out and out[-1][2] is None and b - out[-1][0] <= SPAN:
            out[-1] = (out[-1][0], b, None)
        else:
            out.append((a, b, None))
    return out


def _finished(docs: DataFrame, path: str | None, schema: str, finish: Callable[[Codec, list[np.ndarray]], dict]) -> DataFrame:
    """doc_id and what ``finish`` makes (``schema``) of the ids of every whole text."""
    spark, path = docs.sparkSession, path or tokenizer_path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = spark.sparkContext.broadcast(repeated_chunks(rows)) if codec(path).joins else None
    made = StructType.fromDDL(schema).names
    from pyspark.sql.pandas.types import to_arrow_schema

    first = StructType.fromDDL(f"doc_id long, {schema}, slice long, spans array<struct<key binary, ids binary>>, key binary, text string")
    arrow, last = to_arrow_schema(first), to_arrow_schema(StructType.fromDDL(f"doc_id long, {schema}"))

    def encode(batches):
        """Documents without repeated chunks, done; others with their spans; the repeated chunks of each slice once, with text if the task had not sent it."""
        from pyspark import TaskContext

        own, sent = codec(path), set()
        number, held, keys = TaskContext.get().partitionId() << 32, 0, set()
        for batch in sliced(batches, mb=1):
            texts = texts_of(batch.column(1))
            if not own.joins:
                ids = [own.encode([t])[0] for t in texts]
                yield _batch(arrow, {"doc_id": batch.column(0), **finish(own, ids)}, len(texts))
                continue
            datas = [t.encode() for t in texts]
            spans = [_spans(d, repeated.value) for d in datas]
            plain = [(k, j) for k, s in enumerate(spans) for j, x in enumerate(s) if x[2] is None]
            ids = dict(zip(plain, own.encode([datas[k][spans[k][j][0] : spans[k][j][1]].decode() for k, j in plain])))
            done = [k for k, s in enumerate(spans) if all(x[2] is None for x in s)]
            if done:
                yield _batch(arrow, {"doc_id": batch.column(0).take(pa.array(done, pa.int64())), **finish(own, [own.joined([ids[k, j] for j in range(len(spans[k]))]) for k in done])}, len(done))
            open_ = sorted({*range(len(texts))} - {*done})
            out = {"doc_id": [], "slice": [], "spans": [], "key": [], "text": []}
            for k in open_:
                held += len(datas[k])
                if held > SLICE:
                    number, held, keys = number + 1, len(datas[k]), set()
                for a, b, key in spans[k]:
                    if key is not None and key not in keys:
                        keys.add(key)
                        for name, value in (("doc_id", None), ("slice", number), ("spans", None), ("key", key), ("text", None if key in sent else datas[k][a:b].decode())):
                            out[name].append(value)
                        if len(sent) > 1 << 20:
                            sent.clear()
                        sent.add(key)
                for name, value in (("doc_id", batch.column(0)[k].as_py()), ("slice", number), ("spans", [{"key": x[2], "ids": None if x[2] else ids[k, j].tobytes()} for j, x in enumerate(spans[k])]), ("key", None), ("text", None)):
                    out[name].append(value)
            if open_:
                yield _batch(arrow, out, len(out["slice"]))

    def learn(batches):
        """Each repeated chunk, encoded once."""
        own = codec(path)
        for batch in sliced(batches, mb=1):
            ids = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.tobytes() for i in ids], pa.binary())], names=["key", "ids"])

    def join(batches):
        """Slices: their chunks first, then their documents."""
        own, number, known = codec(path), None, {}
        for batch in sliced(batches, mb=1):
            docs_, parts = [], []
            for slice_, key, ids, doc_id, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if slice_ != number:
                    number, known = slice_, {}
                if key is not None:
                    known[key] = np.frombuffer(ids, own.type)
                else:
                    docs_.append(doc_id)
                    parts.append(own.joined([np.frombuffer(s["ids"], own.type) if s["key"] is None else known[s["key"]] for s in spans]))
            if docs_:
                yield _batch(last, {"doc_id": docs_, **finish(own, parts)}, len(docs_))

    a = written(rows.mapInArrow(releasing(encode), first), "chunked")
    texts = a.filter("text is not null").select("key", "text").dropDuplicates(["key"])
    learned = texts.mapInArrow(releasing(learn), "key binary, ids binary")
    # a chunk that every slice holds is a hot key of this join, which adaptive execution splits
    parts = a.filter("key is not null").select("slice", "key").join(learned, "key").select("slice", "key", "ids", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast(first["spans"].dataType).alias("spans"))
    whole = a.filter("spans is not null").select("slice", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("ids"), "doc_id", "spans")
    dealt = parts.unionByName(whole).repartition("slice").sortWithinPartitions("slice", F.col("key").isNull())
    done = a.filter("slice is null").select("doc_id", *made)
    return done.unionByName(dealt.mapInArrow(releasing(join), f"doc_id long, {schema}"))


def _batch(schema: pa.Schema, columns: dict, n: int) -> pa.RecordBatch:
    """A record batch of this schema; columns that are not given are null."""
    arrays = [columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and n_tokens of every whole text."""
    return _finished(docs, path, "ids array<int>, n_tokens long", lambda own, ids: {"ids": [i.astype(np.int32) for i in ids], "n_tokens": [len(i) for i in ids]})


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, text), special tokens included."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        for batch in sliced(batches, mb=1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec(path).tok.decode(i or [], skip_special_tokens=False) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(releasing(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of every whole text."""

    def finish(own: Codec, ids: list[np.ndarray]) -> dict:
        return {
            "n_tokens": [len(i) for i in ids],
            "ids_sha256": [hashlib.sha256(",".join(map(str, i.tolist())).encode()).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(own.decode(i).encode()).hexdigest() for i in ids],
        }

    return _finished(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish)
