"""Token ids in files of a static range asymmetric numeral system (operator 5).

Texts are encoded with the tokenizers library; an end id is appended to each
document. The documents are dealt to files by ranges of doc_id and sorted, so
files, blocks and documents follow ascending doc_id. All blocks share one table
of frequencies, counted over every id of the corpus and scaled to 2 ** BITS.

A block holds whole documents, about ``BLOCK_IDS`` ids. Its ids are dealt to
interleaved lanes, id t to lane t mod L; a lane is a 64-bit state with 32-bit
words in one common stream, and all lanes take a step at once in numpy. Every
``CHECKPOINT`` steps the block notes all states, the stream's position and the
CRC of the ids up to the next note, so the parts of a block can be decoded
independently and each is verified.

Block layout, little endian: header (magic, version, ids, documents, lanes,
steps per checkpoint, checkpoints, words, CRC of the frequency table), null
flags and doc_ids, ids per document, then per checkpoint its stream position,
CRC and states, then the words. A folder holds two Parquet tables: ``blocks``
(file, block, ids before it in its file, ids, data) and ``table``, the
frequencies, so it can be decoded by itself in any later session, any store that
Spark writes can hold it, and a lost task is simply rerun.

Defined cases: a null text is an empty one and has the end id alone; a null
doc_id comes before all others; rows that repeat a doc_id follow each other and
each is a document; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import per_batch, releasing, scratch, shared_dir, single_threaded, sliced, texts_of, tokenizer_path, written
from quarry.llm.pieces import PieceTable

BITS, LANES, BLOCK_IDS, CHECKPOINT, END_ID = 20, 1024, 1 << 19, 256, 2
#: Bytes of ids before coding that one file holds.
FILE_BYTES = 64 << 20
HEADER = struct.Struct("<4sHIIIIIII")
MAGIC, VERSION = b"rANS", 1
LOW, WORD = np.uint64(1 << 31), np.uint64(32)


# --- tokenising -----------------------------------------------------------------------------------------------


class WordTokenizer:
    """The library's ids of whole texts, remembering those of its pre-tokens.

    Where every character is Latin-1 and no special string can begin, the tokenizer's
    normaliser is lower-casing alone and its pre-tokens follow from one pattern; they are
    numbered, new ones of a batch are encoded by the library together, and a text's ids are
    gathered by number. Any other text goes to the library whole. Both conditions are checked
    for the tokenizer at hand; one that is built otherwise always gets the whole text.
    """

    LETTER, NUMBER, SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\x09-\\x0d\\x20\\x85\\xa0"
    #: Pieces remembered at a time.
    KEPT = 800_000

    def __init__(self, path: str):
        single_threaded()
        import json

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        mark = spec["model"].get("end_of_word_suffix")
        self.parts = bool(mark) and self.same_parts(spec)
        self.ends = np.zeros(self.size, bool)
        if self.parts:
            self.ends[[i for w, i in self.library.get_vocab().items() if w.endswith(mark)]] = True
            # the same model for pieces that are split and lower-cased already
            self.pieces = Tokenizer.from_file(path)
            self.pieces.normalizer = normalizers.Sequence([])
            self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{self.LETTER}]+|[{self.NUMBER}]|[^{self.SPACE}{self.LETTER}{self.NUMBER}]+")
        self.table = PieceTable(self._learn, self.type, self.KEPT)

    @staticmethod
    def same_parts(spec: dict) -> bool:
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        expected = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return normal == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": expected} and all("<|" in t["content"] for t in spec["added_tokens"])

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pieces; a piece ends with a token that bears the word-end mark."""
        ids = np.array(self.pieces.encode_batch_fast([new], is_pretokenized=True, add_special_tokens=False)[0].ids, self.type)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the tokenizer takes a pre-token apart")
        return ids, np.diff(np.concatenate([[0], ends]))

    def _plain(self, text: str) -> bool:
        if not self.parts or "<|" in text:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        plain = [k for k, t in enumerate(texts) if self._plain(t)]
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(plain, self.table.ids([self.pattern.findall(texts[k].lower()) for k in plain])):
            out[k] = ids.tobytes()
        for k in set(range(len(texts))).difference(plain):
            out[k] = np.array(self.library.encode_batch_fast([texts[k]], add_special_tokens=False)[0].ids, self.type).tobytes()
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


# --- the coder ------------------------------------------------------------------------------------------------


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2 ** bits, in proportion to the counts."""
    size, total = len(counts), int(counts.sum())
    if 2 * size > 1 << bits:
        raise ValueError(f"{size} ids need more than {bits} bits")
    room = (1 << bits) - size
    share = np.array([int(c) * room // total for c in counts]) if total else np.zeros(size, np.int64)
    share[int(np.argmax(counts))] += room - share.sum()
    return (share + 1).astype(np.uint64)


class Tables:
    """Frequencies, cumulated frequencies and the symbol of every slot."""

    def __init__(self, frequency: np.ndarray, bits: int = BITS):
        self.bits, self.f = bits, frequency
        self.c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(frequency)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency.astype(np.int64))
        self.crc = zlib.crc32(frequency.astype("<u4").tobytes())


def encode_lanes(ids: np.ndarray, tables: Tables, lanes: int, every: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Words, and (stream position, CRC, states) at every checkpoint, of ids that fill their lanes."""
    rows = ids.reshape(-1, lanes)
    up = np.uint64(63 - tables.bits)
    x = np.full(lanes, LOW, np.uint64)
    words, states = [], {}
    for k in range(len(rows) - 1, -1, -1):
        f, c = tables.f[rows[k]], tables.c[rows[k]]
        full = x >= f << up
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> WORD, x)
        q = x // f
        x = (q << np.uint64(tables.bits)) + (x - q * f) + c
        if k % every == 0:
            states[k] = x.copy()
    words.reverse()
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    notes = [(int(starts[k]), zlib.crc32(rows[k : k + every].astype("<u4").tobytes()), states[k]) for k in sorted(states)]
    return (np.concatenate(words) if words else np.zeros(0, "<u4")), notes


def decode_lanes(words: np.ndarray, note: tuple[int, int, np.ndarray], steps: int, tables: Tables) -> np.ndarray:
    """The ids of ``steps`` steps from a checkpoint on; raises if they miss its CRC."""
    at, crc, x = note[0], note[1], note[2].copy()
    mask, bits = np.uint64((1 << tables.bits) - 1), np.uint64(tables.bits)
    out = np.empty((steps, len(x)), np.uint32)
    for k in range(steps):
        slot = x & mask
        out[k] = s = tables.symbol[slot]
        x = tables.f[s] * (x >> bits) + slot - tables.c[s]
        low = np.flatnonzero(x < LOW)
        if at + len(low) > len(words):
            raise ValueError("a block's part misses its checksum: its words end too early")
        x[low] = (x[low] << WORD) | words[at : at + len(low)]
        at += len(low)
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's part misses its checksum")
    return out.reshape(-1)


def lanes_for(n: int) -> int:
    """Lanes of a block of n ids: a power of two with at least 32 steps, if there are so many ids."""
    lanes = LANES
    while lanes > 1 and n < 32 * lanes:
        lanes //= 2
    return lanes


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, tables: Tables) -> bytes:
    lanes = lanes_for(len(ids))
    pad = -len(ids) % lanes
    common = int(np.argmax(tables.f))
    words, notes = encode_lanes(np.concatenate([ids, np.full(pad, common, ids.dtype)]), tables, lanes, CHECKPOINT)
    head = HEADER.pack(MAGIC, VERSION, len(ids), len(doc_ids), lanes, CHECKPOINT, len(notes), len(words), tables.crc)
    body = [head, bytes(d is None for d in doc_ids), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes()]
    for at, crc, x in notes:
        body += [struct.pack("<II", at, crc), x.astype("<u8").tobytes()]
    return b"".join([*body, words.tobytes()])


def unpack_block(block: bytes, tables: Tables, part: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a block; with ``part``, only the ids from that checkpoint to the next."""
    magic, version, n, docs, lanes, every, count, size, crc = HEADER.unpack_from(block)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a block of this format")
    if crc != tables.crc:
        raise ValueError("the block was written with another frequency table")
    at = HEADER.size
    null = block[at : at + docs]
    doc_ids = [None if z else d for z, d in zip(null, np.frombuffer(block, "<i8", docs, at + docs).tolist())]
    at += 9 * docs
    lengths = np.frombuffer(block, "<u4", docs, at)
    at += 4 * docs
    notes = []
    for _ in range(count):
        pos, check = struct.unpack_from("<II", block, at)
        notes.append((pos, check, np.frombuffer(block, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    words = np.frombuffer(block, "<u4", size, at).astype(np.uint64)
    steps = -(-n // lanes)
    parts = range(count) if part is None else [part]
    ids = [decode_lanes(words, notes[k], min(every, steps - k * every), tables) for k in parts]
    end = n if part is None else min(n, (part + 1) * every * lanes) - part * every * lanes
    return doc_ids, lengths, (np.concatenate(ids) if ids else np.zeros(0, np.uint32))[:end]


# --- the tables -----------------------------------------------------------------------------------------------


def tokenized(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, ids): little-endian ids of 2 or 4 bytes, by the size of the vocabulary."""

    def run(batch: pa.RecordBatch) -> dict:
        own = word_tokenizer(path)
        end = b"" if end_id is None else np.array([end_id], own.type).tobytes()
        return {"doc_id": batch.column(0), "ids": [ids + end for ids in own.encode_batch(texts_of(batch.column(1)))]}

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(per_batch(run, s := "doc_id long, ids binary"), s)


def counts(ids: DataFrame, kind: str, size: int) -> np.ndarray:
    """How often each id occurs; summed per task first, so at most one row per id reaches the driver."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(releasing(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def encoded(ids: DataFrame, frequency: np.ndarray, kind: str, total: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(file, block, before, ids, data) of rows (doc_id, tie, ids), by ranges of (doc_id, tie) in ascending order.

    There are as many files as ``total`` bytes of ids need, so none grows with the corpus; the tie lets a
    range end between rows of one doc_id, or of none. A file is one range, numbered by its place.
    """
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("ids", pa.int64()), ("data", pa.binary())])
    width = np.dtype(kind).itemsize

    def run(batches):
        from pyspark import TaskContext

        tables, file = Tables(frequency), TaskContext.get().partitionId()
        block, before, held = 0, 0, 0
        names, lengths, parts = [], [], []

        def flush():
            nonlocal block, before, held
            data = pack_block(names, lengths, np.frombuffer(b"".join(parts), kind), tables)
            row = pa.RecordBatch.from_pylist([{"file": file, "block": block, "before": before, "ids": held, "data": data}], schema=schema)
            block, before, held = block + 1, before + held, 0
            names.clear(), lengths.clear(), parts.clear()
            return row

        for batch in sliced(batches, 4096, 8):
            for d, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held >= BLOCK_IDS:
                    yield flush()
                names.append(d), lengths.append(len(own) // width), parts.append(own)
                held += lengths[-1]
        if names:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = ids.repartitionByRange(max(n, total // file_bytes), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return ordered.mapInArrow(releasing(run), "file int, block int, before long, ids long, data binary")


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from a folder that ``filed`` has written and nothing else."""
    frequency = read_frequency(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks")
    per_file = blocks.groupBy("file").agg(F.sum("ids").alias("n"))
    base = per_file.select("file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches):
        tables = Tables(frequency)
        for batch in sliced(batches, 4, 8):
            for data, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids, lengths, ids = unpack_block(data, tables)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                begins = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row per file; written, so that Spark knows its size and broadcasts it only if it is small
    placed = blocks.join(written(base, "rans-starts"), "file").select("data", (F.col("base") + F.col("before")).alias("start"))
    return placed.mapInArrow(releasing(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_frequency(spark: SparkSession, folder: str) -> np.ndarray:
    """The frequency table that stands beside the blocks."""
    row = spark.read.parquet(f"{folder}/table").first()
    if row["version"] != VERSION or row["bits"] != BITS:
        raise ValueError(f"{folder}: a table of another format")
    return np.frombuffer(bytes(row["frequency"]), "<u4").astype(np.uint64)


def filed(docs: DataFrame, path: str | None = None, end_id: int | None = END_ID, folder: str | None = None) -> str:
    """Writes a corpus's blocks and their frequency table below a folder and returns it."""
    spark = docs.sparkSession
    path, folder = path or tokenizer_path("word_bpe_49k.json"), folder or f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    own = word_tokenizer(path)
    with scratch(spark):
        ids = written(tokenized(docs, path, end_id).withColumn("tie", F.monotonically_increasing_id()), "rans-ids", "snappy")
        seen = counts(ids, own.type.str, own.size)
        frequency = scaled(seen)
        spark.createDataFrame([(VERSION, BITS, bytearray(frequency.astype("<u4").tobytes()))], "version int, bits int, frequency binary").coalesce(1).write.parquet(f"{folder}/table")
        encoded(ids, frequency, own.type.str, int(seen.sum()) * own.type.itemsize).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The corpus written in this format and read back: doc_id, start, n_tokens, ids_crc32."""
    return decoded(docs.sparkSession, filed(docs, path))
