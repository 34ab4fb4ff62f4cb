"""Token counts with bounded memory for huge documents (operator 8).

Every text is cut into chunks of ``chunk`` characters that overlap their left
neighbour by ``overlap``; a text of one chunk is simply encoded. Chunks are
encoded with offsets, and two neighbours are spliced at a character position
inside their overlap that both encodings have as a token boundary and that is
*stable*: the pre-tokeniser splits there whatever stands further away. Stable
are the places

* after a letter, before a character that is no letter,
* after a digit, before a character that is no digit,
* after a character that is not white space, before white space,

because no alternative of the byte-level pattern spans them (``'s`` and its
like begin with the apostrophe) and its look-ahead only concerns white-space
runs, which end before them. Only characters whose class has never changed since
Unicode 3.2 count, as libraries follow different versions. A special string that
holds such a place is one token in at least one of the two encodings, as overlaps
are longer than any special string, so the place is no common boundary. Without a
common stable boundary the later chunk starts earlier, with twice the overlap,
until one is found or it begins where its neighbour does and takes its place: the
whole text at worst.

The proof holds for a byte-level BPE without a normaliser, whose special strings
are shorter than ``overlap``; that is read from the tokenizer's file. A tokenizer
of another kind (a normaliser, another pattern, a sentencepiece model) gets every
text whole.

Defined cases: a null text has no bytes and no tokens; an empty text likewise;
repeated rows give repeated rows; a null doc_id stays null; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import per_batch, single_threaded, texts_of, tokenizer_path

CHUNK_CHARS, OVERLAP_CHARS, MARGIN, LIMIT = 4096, 128, 32, 1024
#: Chunks encoded together.
TOGETHER = 64


@lru_cache(maxsize=2)
def tokenizer(path: str):
    single_threaded()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def spliceable(path: str, overlap: int = OVERLAP_CHARS) -> bool:
    """Whether the stable places are proven for this tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and spec["model"].get("type") == "BPE" and spec["model"].get("dropout") is None
    level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    short = all(len(t["content"]) < MARGIN and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens", []))
    return bool(plain and level and short and overlap > 2 * MARGIN)


@lru_cache(maxsize=2)
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _kind(c: str) -> str:
    """The class of a character, '' if it has changed since Unicode 3.2."""
    import unicodedata

    now = unicodedata.category(c)[0]
    return now if unicodedata.ucd_3_2_0.category(c)[0] == now else ""


def stable(text: str, p: int) -> bool:
    """Whether the pre-tokeniser always splits ``text`` at ``p``, 0 < p < len(text)."""
    a, b = text[p - 1], text[p]
    left, right = _kind(a), _kind(b)
    if not left or not right:
        return False
    if left in "LN" and left != right:
        return True
    return b in " \t\n\r\x0b\x0c" and not (a.isspace() or "\x1c" <= a <= "\x1f")


def boundary(encoding, at: int) -> int | None:
    """The number of tokens before character ``at`` of a chunk, if no token spans the place."""
    k = encoding.char_to_token(at)
    return k if k is not None and encoding.token_to_chars(k)[0] == at else None


def common(text: str, left: tuple, right: tuple) -> tuple[int, int] | None:
    """Tokens of either chunk (start, end, encoding) before a stable boundary that both have; from the middle of the overlap on."""
    lo, hi = max(right[0] + MARGIN, 1), left[1] - MARGIN
    if right[0] == left[0] or lo >= hi:
        return None
    middle = (lo + hi) // 2
    for p in chain(range(middle, hi), range(middle - 1, lo - 1, -1)):
        if stable(text, p):
            a, b = boundary(left[2], p - left[0]), boundary(right[2], p - right[0])
            if a is not None and b is not None:
                return a, b
    return None


def cuts(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """The chunks of a text of n characters."""
    step = chunk - overlap
    return [(at, min(n, at + chunk)) for at in range(0, max(1, n - overlap), step)]


def count_tokens(encode: Callable[[list[str]], list], text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of ``text``, by overlapping chunks of which a few are in memory at a time."""
    places = cuts(len(text), chunk, overlap)
    now, total, base = None, 0, 0  # base: tokens of the current chunk that lie before its splice
    for at in range(0, len(places), TOGETHER):
        some = places[at : at + TOGETHER]
        for (start, end), encoding in zip(some, encode([text[a:b] for a, b in some])):
            new = (start, end, encoding)
            if now is None:
                now = new
                continue
            width = overlap
            while (found := common(text, now, new)) is None and new[0] > now[0]:
                width *= 2
                start = max(now[0], now[1] - width)
                new = (start, end, encode([text[start:end]])[0])
            if found is not None:
                total, base = total + found[0] - base, found[1]
            now = new  # without a splice the wider chunk takes its neighbour's place, from the same start
    return total + len(now[2]) - base


def _counter(path: str, chunk: int, overlap: int) -> Callable[[list[str]], list[int]]:
    """Token counts of a list of texts."""
    if path.endswith(".model"):
        model = _sentencepiece(path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    tok = tokenizer(path)
    encode = lambda texts: tok.encode_batch(texts, add_special_tokens=False)
    if not spliceable(path, overlap):
        return lambda texts: [len(e) for t in texts for e in encode([t])]

    def counts(texts: list[str]) -> list[int]:
        single = [k for k, t in enumerate(texts) if len(t) <= chunk]
        out = [0] * len(texts)
        for at in range(0, len(single), TOGETHER):
            some = single[at : at + TOGETHER]
            for k, e in zip(some, tok.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)):
                out[k] = len(e)
        for k, t in enumerate(texts):
            if len(t) > chunk:
                out[k] = count_tokens(encode, t, chunk, overlap)
        return out

    return counts


def counted(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every whole text."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch.column(1))
        counts = _counter(path, chunk, overlap)(texts)
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [c > limit for c in counts]}

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(per_batch(run, schema), schema)
