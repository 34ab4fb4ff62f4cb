"""Byte-level BPE encoding and decoding through a sentencepiece model (operator 2).

The rank file is turned into a serialised sentencepiece BPE model without any
training: every token becomes a piece whose bytes are mapped to 256 code points
of their own, its score is its negative rank, and the normaliser is the
identity. sentencepiece then merges the adjacent pair of the highest score,
leftmost first, which is the merge of the lowest rank. Pre-tokens are encoded
one by one, so no merge crosses a pre-token; ids are decoded by the inverse
mapping of ids to bytes.

Defined cases: a null text is an empty text; an empty text has no tokens, the
hash of the empty string and an empty decoded text; repeated rows give repeated
rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import per_batch, texts_of, tokenizer_path, tokenizer_pattern
from quarry.llm.pieces import PieceTable

#: First of the 256 code points that stand for bytes inside the model.
BYTE_BASE = 0x100
#: Pre-tokens remembered at a time.
KEPT = 250_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in tokens] != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks are not 0 to {len(tokens) - 1}")
    return [token for _, token in tokens]


def mapped(data: bytes) -> str:
    """Bytes as the model's code points."""
    return data.decode("latin-1").translate(_SHIFT)


_SHIFT = {b: BYTE_BASE + b for b in range(256)}


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of these tokens; ids are ranks, and one unknown piece follows."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=mapped(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.unk_id, model.trainer_spec.bos_id = len(tokens), -1
    model.trainer_spec.eos_id, model.trainer_spec.pad_id = -1, -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


def splitters(pattern: str) -> tuple[re.Pattern | None, object]:
    """The pre-token pattern for ASCII texts (if it can be stated without Unicode classes) and for all texts.

    White space is the Unicode property: the information separators 0x1C to 0x1F are none.
    """
    import regex

    ascii_form = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    full = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return None if r"\p" in ascii_form else re.compile(ascii_form, re.ASCII), regex.compile(full)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {mapped(t): i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.tokens))
        self.ascii, self.full = splitters(pattern)
        self.names = [str(i) for i in range(len(self.tokens))]
        self.table = PieceTable(self._learn, "<i4", KEPT)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces: one that is itself a token is that token; the model merges the others."""
        symbols = [mapped(p.encode("utf-8", "surrogatepass")) for p in new]
        found = [self.whole.get(s) for s in symbols]
        rest = iter(self.model.encode([s for s, f in zip(symbols, found) if f is None], num_threads=1))
        ids = [next(rest) if f is None else [f] for f in found]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(i) for i in ids], np.int64)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return self.table.ids([(self.ascii if self.ascii is not None and t.isascii() else self.full).findall(t) for t in texts])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens of every whole text, and whether the ids decode to the text's bytes."""
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or tokenizer_pattern()

    def run(batch: pa.RecordBatch) -> dict:
        own, texts = codec(path, pattern), texts_of(batch.column(1))
        ids = own.encode_batch(texts)
        return {"doc_id": batch.column(0), "ids": ids, "n_tokens": [len(i) for i in ids], "round_trip": [own.decode(i.tolist()) == t.encode() for i, t in zip(ids, texts)]}

    schema = "doc_id long, ids array<int>, n_tokens long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(per_batch(run, schema, mb=1), schema)


def decoded(ids: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, data): the bytes that the ids stand for."""
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or tokenizer_pattern()

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "data": [codec(path, pattern).decode(i or []) for i in batch.column(1).to_pylist()]}

    return ids.select("doc_id", "ids").mapInArrow(per_batch(run, s := "doc_id long, data binary", mb=1), s)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, decoded again, both hashed."""
    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or tokenizer_pattern()

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        n, ids_hash, data_hash = [], [], []
        for ids in own.encode_batch(texts_of(batch.column(1))):
            ids = ids.tolist()
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(" ".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
            data_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": data_hash}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(per_batch(run, schema, mb=1), schema)
