"""Phrase mining against a plain version, with odd rows, wide keys, split ranges and the join of a large dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import phrases


def plain(docs, least=30, share=80, top=2000):
    """The contract, word by word."""
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(ws[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, name, -a, left, right, totals[lang], -score) for rank, (score, a, _, name, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def texts(seed, n=400):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "City", "é", "Été", "日本", "a\x00b", "x", "rare%d"]
    out = []
    for k in range(n):
        parts = [rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ", " ", " "]) for _ in range(rnd.randint(0, 40))]
        text = "".join(parts).replace("%d", str(rnd.randint(0, 10**6)))
        out.append((rnd.choice(["en", "en", "de", None, "und"]), "new york city hall! " * 3 + text if k % 3 == 0 else text))
    return [*out, ("fr", None), ("fr", ""), (None, "rare words only")]


def rows_of(df):
    assert df.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    return sorted(tuple(r) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame([(k, *d, "x", 1) for k, d in enumerate(docs)], "doc_id long, lang string, text string, word string, key int")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_version(spark, seed):
    docs = texts(seed)
    assert rows_of(phrases.mined(frame(spark, docs))) == plain(docs)


def test_other_limits(spark):
    docs = texts(3)
    assert rows_of(phrases.mined(frame(spark, docs), least=5, share=50, top=7)) == plain(docs, 5, 50, 7)


def test_a_dictionary_too_large_to_send_is_joined(spark, monkeypatch):
    docs = texts(4)
    monkeypatch.setattr(phrases, "WORDS", 0)
    monkeypatch.setattr(phrases, "RUN", 16)
    assert rows_of(phrases.mined(frame(spark, docs))) == plain(docs)


def test_many_ranges_and_flushes(spark, monkeypatch):
    docs = texts(5)
    monkeypatch.setattr(phrases, "RANGE", 500)
    monkeypatch.setattr(phrases, "HELD", 300)
    assert rows_of(phrases.mined(frame(spark, docs))) == plain(docs)


def test_empty_table(spark):
    assert phrases.mined(frame(spark, texts(1)).filter("false")).count() == 0
    assert phrases.mined(frame(spark, [("en", None), (None, "few words")])).count() == 0


def test_wide_keys_and_their_counts():
    rnd = np.random.default_rng(1)
    ids = rnd.choice([0, 1, 2, 70_000, 4_000_000_000], 5000).astype(np.uint32)
    digits, counts = phrases.run_lengths(d := phrases.packed(ids, True), np.ones(len(d), np.int64))
    assert sorted(map(tuple, digits.tolist())) == list(map(tuple, digits.tolist()))
    expected = Counter(tuple(ids[i : i + m]) for m in (2, 3, 4) for i in range(len(ids) - m + 1) if ids[i : i + m].all())
    got = {tuple(int(hi) << 16 | int(lo) for hi, lo in zip(row[::2], row[1::2]) if hi or lo): n for row, n in zip(digits.tolist(), counts.tolist())}
    assert got == expected
    back = phrases.unpack(phrases.pack(digits, counts))
    assert (back[0] == digits).all() and (back[1] == counts).all()


def test_ranges_split_a_frequent_first_word():
    f = np.full(200, 10, np.int64)
    f[5] = 1000
    splits = phrases.splitters(np.arange(1, 201), f, 20)
    assert 15 <= len(splits) <= 30 and (np.diff(splits.astype(np.int64)) > 0).all()
    assert sum(int(s) >> 32 == 6 and int(s) & 0xFFFFFFFF > 0 for s in splits) >= 3
    assert len(phrases.splitters(np.zeros(3, np.int64), np.zeros(3, np.int64), 5)) == 0
