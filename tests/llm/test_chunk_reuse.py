"""BPE by reused chunks: exact against the library, at joins that are hard, with odd rows."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import chunk_reuse
from quarry.llm.common import tokenizer_path
from tests.llm.test_text_ops import ODD, frame


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_whole_texts_and_odd_rows(spark, library):
    passage = "A passage that many documents share, don't they? " * 60
    texts = [*ODD, *(f"{k} own words {passage}{k * 7} the end <|endoftext|>" for k in range(6)), passage, passage, "y" * 30_000 + passage, "<|endoftext|>" * 900]
    rows = chunk_reuse.digests(frame(spark, texts)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digest(library, texts[4 if r.doc_id is None else r.doc_id])
    assert chunk_reuse.digests(frame(spark, texts).filter("false")).count() == 0


def test_ids_and_their_texts(spark, library):
    ids = chunk_reuse.encoded(frame(spark, ODD))
    got = {r.doc_id: (r.ids, r.n_tokens) for r in ids.collect()}
    assert all(got[k] == (e := library.encode(t or "", add_special_tokens=False).ids, len(e)) for k, t in enumerate(ODD) if k != 4)
    assert {r.doc_id: r.text for r in chunk_reuse.decoded(ids).collect()}[5] == ODD[5]


@pytest.mark.parametrize("seed", range(4))
def test_spans_cut_anywhere_join_to_the_text(library, seed):
    own, rnd = chunk_reuse.Codec(tokenizer_path("byte_bpe_50k.json")), random.Random(seed)
    bits = ["<|endoftext|>", "<|endof", "text|>", " the", "  ", "\n", "'s", "don't", "é", "日本", "😀", "123", "xyz" * 9, "!", "\x1c", " " * 30, "a"]
    for _ in range(60):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 120)))
        cuts = sorted(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 6)))
        spans = own.encode([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])])
        assert own.joined(spans).tolist() == library.encode(text, add_special_tokens=False).ids


def test_all_of_latin_1_in_every_place(library):
    own, rnd = chunk_reuse.Codec(tokenizer_path("byte_bpe_50k.json")), random.Random(9)
    texts = ["".join(chr(rnd.choice([rnd.randrange(256), 32, 39, 10, 115])) for _ in range(60)) for _ in range(800)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_follow_the_content():
    rnd = random.Random(3)
    shared = "".join(rnd.choice("abcdefgh éß日") for _ in range(60_000)).encode()
    ends = chunk_reuse.cut_places(shared)
    assert ends[-1] == len(shared) and all(chunk_reuse.LEAST <= b - a <= chunk_reuse.MOST for a, b in zip([0, *ends], ends[:-1]))
    assert all(shared[:e].decode() for e in ends)
    chunks = lambda data: {data[a:b] for a, b in chunk_reuse._chunks(data)}
    assert len(chunks(shared) & chunks(b"something else " + shared)) >= len(ends) - 4
    assert chunk_reuse.cut_places(b"") == [] and chunk_reuse.cut_places(b"ab") == [2]


def test_repeated_chunks_are_found(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdef gh") for _ in range(40_000))
    df = spark.createDataFrame([(k, f"{k} {text}") for k in range(5)] + [(9, text[::-1])], "doc_id long, text string")
    repeated = chunk_reuse.repeated_chunks(df)
    spans = [chunk_reuse._spans(f"{k} {text}".encode(), repeated) for k in range(5)]
    keys = [{s[2] for s in x if s[2]} for x in spans]
    assert all(len(k) >= 3 for k in keys) and len(set.union(*keys)) <= len(keys[0]) + 2
    assert all(s[2] is None for s in chunk_reuse._spans(text[::-1].encode(), repeated))
    assert int(np.unpackbits(repeated).sum()) <= 40


def test_other_tokenizers_get_whole_texts(spark):
    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = chunk_reuse.encoded(frame(spark, ODD), path).collect()
    assert all(r.ids == tok.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids for r in rows if r.doc_id is not None)
