"""Ranked lexical search against a plain version, with odd rows; the bisection's halves; exact stopping."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lexical


def plain(docs, items, top=20):
    """The contract over lists of (doc_id, text) and (item_id, text)."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    counted = [(d, Counter(ts), len(ts)) for d, t in docs if (ts := terms(t))]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counted:
            m = 100 - 25 + 25 * n * big_n // big_l
            s = sum(r * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0, r[3]))


def corpus(seed, n=300):
    rnd = random.Random(seed)
    topics = [[f"{a}{k}" for k in range(40)] for a in ("red", "Blue", "été", "日本")]
    docs = []
    for k in range(n):
        own = rnd.choice(topics)
        docs.append((k, " ".join(rnd.choice(own if rnd.random() < 0.8 else rnd.choice(topics)) + rnd.choice(["", "", ",", "_", "\n"]) for _ in range(rnd.randint(1, 60)))))
    docs += [(n + k, docs[5][1]) for k in range(30)]  # ties
    docs += [(None, docs[5][1]), (None, docs[6][1]), (7, docs[8][1]), (n + 40, None), (n + 41, ""), (n + 42, "...")]
    items = [(k, f"{docs[k][1][:80]} {docs[k * 2][1][:40]} Nowhere") for k in range(9)] + [(20, None), (21, "nothing here"), (3, "blue1"), (None, "red2")]
    return docs, items


def rows_of(df):
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0, r[3]))


def frames(spark, docs, items):
    more = lambda rows: [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(more(docs), "doc_id long, text string, term string, shard int"), spark.createDataFrame(more(items), "item_id long, text string, item string, score int")


def sized(monkeypatch, postings=400, docs=40, leaf=8, sample=128):
    for name, value in (("POSTINGS", postings), ("SHARD_DOCS", docs), ("LEAF", leaf), ("TOGETHER", 4)):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical.fitted, "__defaults__", (sample, 3))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_version(spark, seed, monkeypatch):
    sized(monkeypatch)
    docs, items = corpus(seed)
    assert rows_of(lexical.ranked(*frames(spark, docs, items))) == plain(docs, items)


def test_as_registered_and_fewer_hits(spark):
    docs, items = corpus(3)
    folder = lexical.build(frames(spark, docs, items)[0])
    for top in (20, 3):
        assert rows_of(lexical.search(spark, folder, frames(spark, docs, items)[1], top)) == plain(docs, items, top)


def test_empty_tables(spark):
    docs, items = frames(spark, *corpus(1))
    assert lexical.ranked(docs.filter("false"), items).count() == 0
    assert lexical.ranked(docs, items.filter("false")).count() == 0
    assert lexical.ranked(docs.filter("text is null"), items).count() == 0


def test_shards_that_cannot_matter_are_not_visited(spark, monkeypatch):
    sized(monkeypatch)
    docs, _ = corpus(4)
    docs, items = [*docs, *((1000 + k, "needle haystack") for k in range(25))], [(0, "needle"), (1, "needle haystack")]
    seen, scored = [], lexical._scored
    monkeypatch.setattr(lexical, "_scored", lambda visits, *a: seen.extend(r["shard"] for r in visits.collect()) or scored(visits, *a))
    d, i = frames(spark, docs, items)
    folder = lexical.build(d)
    assert rows_of(lexical.search(spark, folder, i, 5)) == plain(docs, items, 5)
    shards = spark.read.parquet(f"{folder}/terms").select("shard").distinct().count()
    assert len(set(seen)) < shards


def test_bisection_puts_topics_apart():
    rnd = random.Random(1)
    topic = [k % 4 for k in range(256)]
    docs = [np.unique([t * 30 + rnd.randrange(30) for _ in range(12)]) for t in topic]
    made = lexical.Bisection(docs, 120, 2)
    together = [Counter(topic[k] for k in np.flatnonzero(made.leaf == leaf)) for leaf in range(4)]
    assert all(max(c.values()) >= 0.9 * sum(c.values()) for c in together)
    clusters = lexical.Clusters([str(k).encode() for k in range(120)], made.weights, made.depth)
    again = [clusters.leaf([str(t).encode() for t in d]) for d in docs]
    assert np.mean(np.array(again) == made.leaf) > 0.95
