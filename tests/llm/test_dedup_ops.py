"""MinHash, suffix-array dedup, tiled embeddings, mixing and sharding against brute force, and the pipeline."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import components, exact_substrings, minhash, mixing, queries, sharding, shingles, suffixes, tiles

WORDS = [f"w{k}" for k in range(400)]


def copies(seed, n=60):
    """Texts with exact copies, near copies, shared passages, periodic text and odd rows."""
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 120))) for _ in range(n)]
    passage = " ".join(rnd.choice(WORDS) for _ in range(60))
    for k in range(0, n, 3):
        base = texts[rnd.randrange(n)]
        kind = rnd.randrange(5)
        if kind == 0:
            texts[k] = base
        elif kind == 1:
            w = base.split()
            for _ in range(max(1, len(w) // 40)):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            texts[k] = "\n".join(w) + "  "
        elif kind == 2:
            texts[k] = base.upper()
        elif kind == 3:
            texts[k] = base[: rnd.randrange(1, len(base) + 1)] + passage + base[:30]
        else:
            texts[k] = "again and " * rnd.randint(1, 60)
    return [*texts, None, "", "   ", "one", "one", "one two three", "ONE\ttwo three", "é" * 120, "é" * 130, "\x0bmix\x0c of ws"]


def frame(spark, texts, first=0):
    df = spark.createDataFrame([(first + i, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return df.unionByName(df.filter(F.col("doc_id") == first + 5)).unionByName(df.filter(F.col("doc_id") == first + 6).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("kept", F.lit(0)).withColumn("bucket", F.lit("x")).withColumn("size", F.lit(1))


def brute_sets(texts, words):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    return out


def brute_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_equals_brute_force(spark, seed):
    texts = copies(seed)
    sets = brute_sets(texts, 4)
    want = brute_components(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    rows = minhash.deduplicated(frame(spark, texts), 4, 80).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        k = 6 if r.doc_id is None else r.doc_id  # the row without an id has the text of document 6, and links others as this does
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[k]), want[k], want[k] == r.doc_id)


def test_minhash_links_by_way_of_rows_without_an_id(spark):
    rnd = random.Random(3)
    base = [rnd.choice(WORDS) for _ in range(200)]
    near = [*base[:-18], *(f"n{k}" for k in range(18))]
    far = [*(f"f{k}" for k in range(12)), *near[12:]]
    other = " ".join(rnd.choice(WORDS) for _ in range(50))
    # 4 and 9 are linked only by way of a row without an id; 7 has two texts, one of them a copy of 4's
    rows = [(9, " ".join(far)), (None, " ".join(near)), (4, " ".join(base)), (None, other), (None, other), (7, " ".join(base)), (7, "quite another text"), (12, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("id", F.lit(2)).withColumn("named", F.lit(3))
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.deduplicated(df).collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    want = [(9, 4, False), (None, 4, False), (4, 4, True), (None, None, True), (None, None, False), (7, 4, False), (7, 7, True), (12, 12, True), (None, None, True)]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_a_link_between_members_that_are_not_the_representative():
    """Two members of a cell lie in other components than the rest and are linked with each other."""
    rnd = np.random.default_rng(1)
    text = lambda w: " ".join(w).encode()
    base = [f"a{k}" for k in rnd.integers(0, 10**9, 300)]
    near, other = [*base[:-5], "x", "y"], [f"b{k}" for k in rnd.integers(0, 10**9, 300)]
    import pyarrow as pa

    rows = []
    for side, doc, words in ((1, 1, other), (0, 2, base), (0, 3, near)):
        (s,) = shingles.shingle_sets(pa.array([text(words)], pa.binary()), 5)
        sig = shingles.mix(minhash.minima(s).astype(np.uint64)).astype(np.uint8).tobytes()
        rows.append((side, doc, doc, len(s), sig, text(words)))
    assert minhash.joined_in_cell([r for r in rows if r[0] == 0], 5, 80) == [(2, 3)] or minhash.joined_in_cell([r for r in rows if r[0] == 0], 5, 80) == [(3, 2)]
    assert minhash.joined_in_cell(rows, 5, 80) == []


def test_large_buckets_are_compared_in_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rnd = random.Random(7)
    base = [rnd.choice(WORDS) for _ in range(200)]
    texts = []
    for k in range(40):
        w = list(base)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = f"n{k}"
        texts.append(" ".join(w))
    sets = brute_sets(texts, 5)
    want = brute_components(40, [(a, b) for a in range(40) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.deduplicated(df).collect()} == dict(enumerate(want))


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(55)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 200 + k) for k in range(30)]
    want = brute_components(300, edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_kept(texts, length=100):
    first, out = set(), {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in first:
                gone[p : p + length] = b"\1" * length
            first.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_suffix_dedup_equals_brute_force(spark, seed, monkeypatch):
    if seed == 4:  # buckets of three segments count as hot, and pieces are small
        monkeypatch.setattr(exact_substrings, "HOT", 3)
        monkeypatch.setattr(exact_substrings, "SORTED", 3000)
    texts = copies(seed) + ["ab" * 400, "x" + "ab" * 300, "".join(random.Random(1).choice("abc") for _ in range(500)) * 2]
    want = brute_kept(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pos", F.lit(1))
    rows = exact_substrings.deduplicated(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert sum(v[1] for v in want.values()) > 1000


def test_suffix_dedup_of_odd_rows(spark):
    long = " ".join(WORDS[:60])
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, None), (3, "x")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in exact_substrings.deduplicated(df).collect())
    assert got == [(False, 1, len(long)), (False, 1, len(long)), (False, 2, 0), (False, 3, 0), (True, 0, 0)]
    assert exact_substrings.deduplicated(df.filter("false")).count() == 0
    cleaned = exact_substrings.cleaned(df.withColumn("n_chars", F.lit(9).cast("long")).withColumn("data", F.lit(1)))
    assert {(r.doc_id, r.text, r.n_chars) for r in cleaned.collect()} == {(None, long, len(long)), (1, "", 0), (2, None, None), (3, "x", 1)}


def test_rows_without_a_doc_id_and_texts_of_a_repeated_one_are_documents_of_their_own(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    a, b, c, d, e, f = (word() for _ in range(6))
    # a stands in two rows without an id at the same place, c + d in one of them and later in document 9
    rows = [(None, a + b), (None, a + c), (None, d), (None, d), (7, e + a), (7, e + f), (7, e + f), (8, f), (9, c + word()), (-5, word())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted({(i is not None, i or 0, hashlib.sha256(t.encode()).hexdigest(), k if i is None else 0): t for k, (i, t) in enumerate(rows)}.items())
    want = brute_kept([t for _, t in order])
    by_key = {key: want[k] for k, (key, _) in enumerate(order)}
    expected = sorted((i is not None, i or 0, *by_key[(i is not None, i or 0, hashlib.sha256(t.encode()).hexdigest(), k if i is None else 0)]) for k, (i, t) in enumerate(rows))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exact_substrings.deduplicated(df.repartition(3)).collect())
    assert got == expected
    kept = sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in exact_substrings.cleaned(df).collect())
    assert kept == sorted(x[-1] for x in expected)


def shuffled(spark):
    """Bytes of each shuffle whose files are there."""
    out = {}
    for top in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        for at, _, names in os.walk(top.getPath()):
            for name in names:
                if m := re.match(r"shuffle_(\d+)_\d+_\d+\.data$", name):
                    out[int(m[1])] = out.get(int(m[1]), 0) + os.path.getsize(f"{at}/{name}")
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_passages_are_cut_with_one_shuffle_of_the_texts_and_none_of_segments_left(spark, tmp_path, odd):
    rnd = random.Random(17)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passages = [word(200) for _ in range(20)]
    texts = [word(3000) + (rnd.choice(passages) if k % 3 else "") + word(3000) for k in range(200)]
    rows = [(k, t, len(t), "s") for k, t in enumerate(texts)] + [(3, texts[3], len(texts[3]), "s")] * odd
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string").write.parquet(f"{tmp_path}/in")
    size = sum(map(len, texts))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = spark.read.parquet(f"{tmp_path}/in")
        numbering = set(shuffled(spark))
        out = exact_substrings.cleaned(docs)
        time.sleep(1)  # files go in the background
        # the numbering of odd rows deals whole texts once; segments are larger than texts
        assert sum(n for k, n in shuffled(spark).items() if k not in numbering) < (0.1 + 1.2 * odd) * size
        before = set(shuffled(spark))
        out.write.parquet(f"{tmp_path}/out")
        assert sum(n for k, n in shuffled(spark).items() if k not in before) < 1.5 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = brute_kept(texts)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.doc_id, r.source): (hashlib.sha256(r.text.encode()).hexdigest(), r.n_chars) for r in got} == {(k, "s"): (v[3], v[0] - v[1]) for k, v in want.items()}
    assert len(got) == len(rows) and sum(v[2] for v in want.values()) > 50


def test_difference_cover_and_blockwise_order():
    assert {(a - b) % suffixes.V for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.V))
    rng = np.random.default_rng(0)
    for trial in range(12):
        text = rng.integers(97, 97 + 1 + trial % 3, int(rng.integers(150, 1500))).astype(np.uint8)
        part = rng.integers(97, 123, 300).astype(np.uint8)
        text = np.concatenate([text, part, text[:40], part, part[:130]])
        starts, raw = np.arange(len(text) - 99), text.tobytes()
        keys = [raw[s : s + 100] for s in np.concatenate(list(suffixes.sorted_blocks(text, starts, 100, bucket=64)))]
        assert keys == sorted(keys)
        rank = rng.permutation(len(starts))
        best = {}
        for s, r in zip(starts, rank):
            best[raw[s : s + 100]] = min(best.get(raw[s : s + 100], 10**9), r)
        assert (suffixes.repeats(text, starts, 100, rank, bucket=64) == [r > best[raw[s : s + 100]] for s, r in zip(starts, rank)]).all()


def brute_tiles(rows, threshold):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = set()
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links.add((a[0], b[0]))
    return links


def test_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(150):
        v = rng.normal(size=24) if i % 3 or not rows else np.array(rows[rng.integers(len(rows))][1]) * rng.uniform(0.5, 2) + rng.normal(size=24) * 0.12
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(200 + k, rows[3][1], rows[3][2]) for k in range(5)]
    odd = [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, [float("inf")] + [1.0] * 23, 1), (304, rows[0][1], None), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [None, 1.0], 1)]
    rows += odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("strip", F.lit(0))
    links = brute_tiles(rows, 0.93)
    ids = [r[0] for r in rows]
    comp = brute_components(400, links)
    for r in tiles.linked(df, tile=16).collect():
        assert (r.n_links, r.component_id, r.kept) == (sum(r.vec_id in e for e in links), comp[r.vec_id], comp[r.vec_id] == r.vec_id)
    assert len(links) > 40 and len(ids) == tiles.linked(df).count()
    assert tiles.linked(df.filter("false")).count() == 0


def test_tiles_of_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=12)
    near = lambda v: [float(np.float32(x)) for x in v + rng.normal(size=12) * 0.01]
    far = [float(np.float32(x)) for x in -a]
    rows = [(1, near(a), 1), (1, near(a), 1), (1, far, 1), (2, near(a), 1), (3, near(-a), 1), (4, near(a), 2), (None, near(a), 1), (5, None, 1), (6, near(a), None)]
    rows += [rows[3], rows[3]]  # the same vector again
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("k1", F.lit(0)).withColumn("tile", F.lit(0))
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in tiles.linked(df).collect())
    want = [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 3, 1), (2, 3, 1), (2, 3, 1), (3, 1, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6)]
    assert got == [(False, i, n, c, i == c) for i, n, c in want] + [(True, 0, 3, 1, False)]
    alone = tiles.linked(spark.createDataFrame([(None, near(a), 1), (None, near(a), 1), (None, far, 1), (9, far, 2)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in alone) == [(0, 0, 0, True), (0, 1, 0, False), (0, 1, 0, True), (9, 0, 9, True)]
    lone = tiles.linked(spark.createDataFrame([(1, near(a), 1), (1, near(a), 1)], "vec_id long, embedding array<float>, label int"))
    assert [r.n_links for r in lone.collect()] == [0, 0]


def test_tiles_far_apart_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16)) * 3
    rows = [(i, [float(np.float32(x)) for x in centers[i % 12] + rng.normal(size=16) * 0.2], 0) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    seen = []
    real = tiles._compared
    monkeypatch.setattr(tiles, "_compared", lambda cells, *a: seen.append(cells.count()) or real(cells, *a))
    links = brute_tiles(rows, 0.93)
    got = {r.vec_id: r.n_links for r in tiles.linked(df, tile=60).collect()}
    assert got == {i: sum(i in e for e in links) for i in range(600)} and sum(got.values()) > 1000
    assert seen[0] < 600 * 4  # of about ten tiles a vector goes to few


def test_mixing(spark):
    rnd = random.Random(4)
    texts = [" ".join(["w"] * min(2000, int(rnd.paretovariate(1.1) * 20))) for _ in range(3000)] + [None, "", "a\tb\x0bc"]
    df = spark.createDataFrame([(i, t, ["a", "b", "c", "d", None][0 if i % 3 == 0 else i % 5]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = mixing.report(df).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert all(r["size"] == sizes[r.doc_id] and r.taken <= 2 * r["size"] for r in rows)
    by, weight = {}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    for i, (_, _, s) in enumerate(df.collect()):
        by[s] = by.get(s, 0) + sizes[i]
    want, left, open_ = {}, 1.5 * sum(by.values()), set(by)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * by[s]}
        if not over:
            want |= share
            break
        want |= {s: 2 * by[s] for s in over}
        left -= sum(2 * by[s] for s in over)
        open_ -= over
    source = {r.doc_id: r.source for r in df.collect()}
    taken = {}
    for r in rows:
        assert r.source_size == by[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) < 0.03 * want[s] + 100 for s in want)
    # a document's last copy is a draw of its own number against one threshold of its source
    from quarry.llm.mixing import _number, draw  # noqa: F401

    u = {r.doc_id: r.u for r in df.select("doc_id", draw(F.col("doc_id"), F.col("text"), "mix").alias("u")).collect()}
    for s in want:
        extra = [(u[r.doc_id], r.taken // r["size"] - int(want[s] // by[s])) for r in rows if source[r.doc_id] == s and r["size"]]
        assert max([x for x, e in extra if e], default=0) <= min([x for x, e in extra if not e], default=1)
        share = sum(e for _, e in extra) / len(extra)
        assert abs(share - want[s] / by[s] % 1) < 0.2
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.report(df.repartition(7)).collect()))
    clash = df.withColumn("__mix", F.lit(1)).withColumn("size", F.lit(2))
    mixed = mixing.mixed(clash)
    assert mixed.columns == clash.columns
    copies_ = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(copies_.get(r.doc_id, 0) * r["size"] == r.taken for r in rows)
    assert mixing.report(df.filter("false")).count() == 0 and mixing.mixed(df.filter("false")).count() == 0


def test_mixing_of_odd_rows(spark):
    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (None, "d e", "x"), (1, "f g", None), (1, "h", None), (1, "h", None), (2, None, "empty"), (3, "", "empty"), (4, "w " * 50_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("base", F.lit(1)).withColumn("threshold", F.lit(2)).withColumn("by", F.lit(3)).withColumn("copies", F.lit(4))
    got = mixing.report(df).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in got)
    assert all((r.source_size, r.target, r.taken) == (0, 0.0, 0) for r in got if r.doc_id in (2, 3))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and {r.source for r in mixed.collect()} <= {"x", None, "y"}
    pairs = {}
    for r in got:
        pairs.setdefault((r.doc_id, r["size"]), set()).add(r.taken)
    assert all(len(v) == 1 for v in pairs.values())  # repeated rows share their draw


def test_best_fit_decreasing():
    rnd = random.Random(6)
    for _ in range(60):
        sizes = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 90))]
        capacity = rnd.randint(max(sizes), 150)
        bins, out = [], [0] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fit = min(((left, b) for b, left in enumerate(bins) if left >= sizes[k]), default=None)
            if fit is None:
                bins.append(capacity)
                fit = (capacity, len(bins) - 1)
            bins[fit[1]] -= sizes[k]
            out[k] = fit[1]
        assert sharding.pack(sizes, capacity) == out
        assert sharding.pack(sizes, capacity, len(bins) - 1 or None) is None or len(bins) == 1
    assert sharding.pack([5], 4) is None and sharding.pack_into([], 3) == []
    assert max(sharding.pack_into([9, 1, 1, 1], 2)) <= 1


def test_balanced_tree():
    rnd, tree, keys = random.Random(8), sharding.BalancedTree(), set()
    for _ in range(3000):
        k = (rnd.randrange(60), rnd.randrange(60))
        if k in keys and rnd.random() < 0.7:
            tree.remove(k)
            keys.discard(k)
        elif k not in keys:
            tree.insert(k)
            keys.add(k)
        q = (rnd.randrange(60), -1)
        assert tree.ceiling(q) == min((x for x in keys if x >= q), default=None)


def test_sharding(spark):
    texts = ["hot text"] * 700 + [f"text {k} " * (k % 40) for k in range(1300)] + [None, None, "", "é"]
    df = spark.createDataFrame([(None if k % 5 == 0 else k // 2, k, t) for k, t in enumerate(texts)], "doc_id long, k long, text string").withColumn("shard", F.lit(1)).withColumn("group", F.lit(1))
    rows = sharding.sharded(df).collect()
    shard, total = {}, [0] * 16
    for r in rows:
        assert (r.law, r.grown_shard) == ("bytes", None)
        shard.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
        total[r.shard] += r["size"]
    want = sorted((None if k % 5 == 0 else k // 2, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in enumerate(texts) if k % 5)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows if r.doc_id is not None) == want and len(rows) == len(texts)
    # the null and the empty text are two groups of one size and sum; every other text is in one shard
    assert all(len(s) == 1 for key, s in shard.items() if key != (0, 1)) and max(total) - min(total) < 0.05 * sum(total) / 16
    for k in range(16):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert sharding.sharded(df.filter("false")).count() == 0


def test_two_levels_of_packing_come_near_to_one(spark):
    """Groups packed by cells into items and these into shards, against best fit decreasing of all groups at once."""
    rnd = random.Random(3)
    texts = ["x" * min(60_000, int(rnd.paretovariate(0.9) * 30)) + f" {k}" for k in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = [len(t.encode()) + 1 for t in texts]
    for cells in (20_000, 200):  # one cell, and fifteen
        sharding.PER_CELL = cells
        try:
            total = {r.shard: r.b for r in sharding.sharded(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
            few = {r.shard: r.b for r in sharding.sharded(df, capacity=100_000).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
        finally:
            sharding.PER_CELL = 20_000
        pure = [0] * 16
        for s, b in zip(sizes, sharding.pack_into(sizes, 16)):
            pure[b] += s
        assert sum(total.values()) == sum(sizes) and max(total.values()) <= 1.01 * max(pure)
        best = max(sharding.pack(sizes, 100_000)) + 1
        assert max(few.values()) <= 100_000 and len(few) <= best + max(1, best // 50)
    with pytest.raises(ValueError, match="more than a shard"):
        sharding.sharded(df, capacity=1000)


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixing", "byte_bpe"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit("kept as it is"))
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, sf).cache()
        if name != "byte_bpe":
            assert out.columns == docs.columns, name
        if name == "language":
            assert out.count() == docs.count()  # all prose is of a learned language
        if name == "near_duplicates":
            texts = {r.doc_id: r.text for r in out.collect()}
            sets = brute_sets(list(texts.values()), 5)
            assert not [1 for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        if name == "repeated_passages":
            again = brute_kept([r.text for r in seen.orderBy("doc_id").collect()])
            assert sum(v[0] - v[1] for v in again.values()) - sum(len(r.text.encode()) for r in out.collect()) < 4 * len(again)
        seen = out
    assert seen.filter("not round_trip").count() == 0 and seen.count() > 100
    assert corpus_pipeline.run(spark, sf).count() == seen.count()


def odd_documents(spark):
    rnd = random.Random(12)
    prose = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    one, two, three = prose(80), prose(80), prose(80)
    passage = prose(60)
    rows = [(None, one, "en"), (None, one, "en"), (None, two, "en"), (7, three, "en"), (7, prose(90), "en"), (7, three + " end", "en"), (8, None, "en"), (9, "", "en"), (10, "1234 !!", "en"), (11, prose(60) + passage + prose(50), None), (12, prose(50) + passage, "en"), (13, prose(200_000), "en")]
    rows += [(100 + k, prose(100), "en" if k % 2 else "xx") for k in range(40)]
    df = spark.createDataFrame([(i, t, lang, ["a", None, "c"][k % 3], len(t or "")) for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("gone", "doc", "data", "row", "kept", "bucket", "copies", "__letters", "pos", "size"):
        df = df.withColumn(name, F.lit(name))
    return df


def test_pipeline_stages_with_odd_rows(spark):
    docs = odd_documents(spark)
    texts = lambda df: [r.text for r in df.collect()]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "").cache()
        counts.append(out.count())
        assert stage(spark, docs.filter("false"), "").count() == 0, name
        if name != "byte_bpe":
            assert out.columns == docs.columns and out.filter("gone <> 'gone' OR size <> 'size'").count() == 0, name
        if name == "language":  # rows without letters go, all prose stays
            assert counts[-1] == docs.count() - 3
        if name == "near_duplicates":  # one row of each group; copies without an id go, other texts of an id stay
            sets = brute_sets(texts(out), 5)
            assert not [1 for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert counts[-1] == counts[-2] - 2 and out.filter("doc_id is null").count() == 2 and out.filter("doc_id = 7").count() == 2
        if name == "repeated_passages":
            assert counts[-1] == counts[-2]
            before, after = sorted(len(t) for t in texts(docs)), sorted(len(t) for t in texts(out))
            assert 100 < sum(before) - sum(after) < 1000 and all(r.n_chars == len(r.text) for r in out.collect())
        docs = out
    assert docs.filter("not round_trip").count() == 0


INNER = ("__no_text", "absent", "row", "kept", "doc", "data", "id", "hash", "tie", "pos", "n", "n_bytes", "gone", "draw", "size", "component_id", "named", "lang_pred", "noise", "each", "copies", "taken", "key", "bucket")


@pytest.mark.parametrize("odd", [False, True])
def test_pipeline_stages_with_columns_named_as_their_own(spark, odd):
    rnd = random.Random(2)
    rows = [(None if odd and k < 2 else k, " ".join(rnd.choice(WORDS) for _ in range(80)), "en", "s", 5) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(c) for c in INNER})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.filter(F.col("__no_text") != "__no_text").count() == 0 and out.count() > 0, name


def test_queries_and_their_sql(spark):
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{k}" for k in range(1, 14))
    assert set(queries.ORACLE_SQL) == {"op1_suffix_dedup", "op3_mixing", "op6_tiles", "op9_minhash", "op12_lexical", "op13_phrases"}
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, text in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        cols = sorted(df.columns)
        got = sorted(tuple(r[c] for c in cols) for r in df.collect())
        res = con.execute(text)
        at = [[d[0] for d in res.description].index(c) for c in cols]
        assert got == sorted(tuple(row[k] for k in at) for row in res.fetchall()), name
