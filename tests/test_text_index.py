"""The segmented text index: random changes answer as a fresh build, few segments, small writes."""

import random

import pytest

from quarry.operators import search
from quarry.plans.text_index import TextIndex, built

WORDS = ("booking", "payment", "Gateway", "cancelOrder", "hotel", "guest")


def text(spark, rows):
    return spark.createDataFrame(rows, "entity_type string, sub_type string, entity_id long, owner long, name string, description string")


def row(rnd, k):
    return ("module", rnd.choice(["schema", "context"]), k, k % 3, f"{rnd.choice(WORDS)} {rnd.choice(WORDS)}", rnd.choice([None, " ".join(rnd.choice(WORDS) for _ in range(5))]))


def answers(index):
    docs, found = index.docs(), index.searchable()
    key = ("entity_type", "sub_type", "entity_id")
    out = [sorted(tuple(r) for r in docs.select(*key, "name_tokens", "desc_tokens", "dl").collect().__iter__())]
    for q in ("booking payment", "hotel", "gate zzz", "cancelOrder guest"):
        out.append([tuple(r) for r in search.relaxed(found, q).orderBy("score", *key).collect()])
    out.append(sorted(tuple(r) for r in search.phrase(found, "booking payment").collect()))
    return [str(x) for x in out]


def test_random_changes_answer_as_a_fresh_build(spark, tmp_path):
    rnd, index, now = random.Random(7), TextIndex(spark, str(tmp_path / "i")), {}
    for step in range(8):
        new = {k: row(rnd, k) for k in rnd.sample(range(40), rnd.randint(0, 9))}
        gone = rnd.sample(sorted(now), min(len(now), rnd.randint(0, 4)))
        gone = [k for k in gone if k not in new]
        index = index.changed(text(spark, list(new.values())) if new else None, spark.createDataFrame([("module", k) for k in gone], "entity_type string, entity_id long") if gone else None)
        now = {k: v for k, v in (now | new).items() if k not in gone}
        if step % 2:
            index = index.merged()
    fresh = built(spark, str(tmp_path / "fresh"), text(spark, list(now.values())))
    assert (index.n_docs, index.total_len) == (fresh.n_docs, fresh.total_len) == (len(now), fresh.docs().agg({"dl": "sum"}).first()[0])
    assert answers(index) == answers(fresh) == answers(index.merged(every=True))
    assert len(index.merged(every=True).segments) == 1 and len(index.merged().segments) <= 4


def test_a_changed_text_writes_its_own_postings_only(spark, tmp_path):
    rnd = random.Random(1)
    rows = {k: row(rnd, k) for k in range(30)}
    index = built(spark, str(tmp_path / "i"), text(spark, list(rows.values())))
    rows[4] = ("module", "schema", 4, 1, "entirely new", None)
    del rows[7]
    owners = spark.createDataFrame([(1,)], "owner long")
    new, gone = index.differences(text(spark, [r for r in rows.values() if r[3] == 1]), owners)
    assert [r.entity_id for r in new.collect()] == [4] and [r.entity_id for r in gone.collect()] == [7]
    later = index.changed(new, gone)
    last = later.segments[-1]
    assert (last.docs, last.removed) == (1, 2)
    written = spark.read.parquet(f"{tmp_path}/i/postings/seg={last.seg}")
    assert sorted((r.term, r.entity_id) for r in written.collect()) == [("entirely", 4), ("new", 4)]
    assert later.n_docs == 29 and index.docs().count() == 30  # the former index still reads what it had


def test_equal_texts_change_nothing(spark, tmp_path):
    rows = [row(random.Random(2), k) for k in range(5)]
    index = built(spark, str(tmp_path / "i"), text(spark, rows))
    new, gone = index.differences(text(spark, rows), spark.createDataFrame([(0,), (1,), (2,)], "owner long"))
    assert index.changed(new, gone) is index and index.merged() is index


def test_unused_files_are_deleted(spark, tmp_path):
    index = built(spark, str(tmp_path / "i"), text(spark, [row(random.Random(3), k) for k in range(4)]))
    later = index.changed(text(spark, [("module", "schema", 9, 0, "more", None)])).merged(every=True)
    later.discard_unused([later])
    assert later.docs().count() == 5 and later.searchable().postings.filter("term = 'more'").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        index.docs().count()


def test_zones_that_cannot_matter_are_not_read(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    filler = [f"f{k}" for k in range(50)]
    rows = [("file", "a", k, k % 5, None, " ".join((["needle"] * rnd.randint(1, 2) if k % 3 == 0 else []) + (["Hay"] if k % 2 else []) + [rnd.choice(filler) for _ in range(int(rnd.paretovariate(0.7)) + 1)][:3000])) for k in range(900)]
    index = built(spark, str(tmp_path / "i"), text(spark, rows))
    index = index.changed(text(spark, [("file", "a", 3, 3, "needle", "Hay")]), spark.createDataFrame([("file", 5), ("file", 6)], "entity_type string, entity_id long"))
    full = search.Index(index.postings(), index.stats())
    read = []
    real = search._near
    for merged in (index, index.merged(every=True)):
        found = merged.searchable()
        for q, limit, kind in (("needle", 20, None), ("needle hay", 5, None), ("Hay needle needle", 7, "file"), ("needle nowhere", 5, None), ("needle", 3, "repo"), ("needle", 1000, None)):
            read.clear()
            watched = found._replace(postings=Watched(found.postings, read))
            got = [tuple(r) for r in search.ranked(watched, q, limit, kind).orderBy("score", "entity_type", "entity_id").collect()]
            want = [tuple(r) for r in search.ranked(full, q, limit, kind).orderBy("score", "entity_type", "entity_id").collect()]
            assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6), q
            if (q, limit) in (("needle", 20), ("needle hay", 5)):
                every = found.postings.filter(real(search.Query((tuple(q.split()),), True))).count()
                assert 0 < sum(read) < every / 2, (q, read, every)


class Watched:
    """Postings that count the rows of each filter."""

    def __init__(self, df, read):
        self.df, self.read, self.sparkSession = df, read, df.sparkSession

    def filter(self, condition):
        rows = self.df.filter(condition)
        self.read.append(rows.count())
        return rows


def test_phrases_stay_inside_a_list_and_repeat_words(spark):
    rows = text(spark, [("a", "a", 1, None, "x y", "z w"), ("a", "a", 2, None, "q", "x x y x"), ("a", "a", 3, None, "y z", None), ("a", "a", 4, None, None, "X-Y")])
    index = search.Index.over(search.fts_docs(rows))
    found = lambda q: sorted(r.entity_id for r in search.phrase(index, q).collect())
    assert found("x y") == [1, 2, 4] and found("y z") == [3] and found("x x y") == [2] and found("x y x") == [2] and found("z") == [1, 3] and found("y x x") == []


def test_postings_of_repeated_keys_and_far_places(spark, tmp_path):
    """Counts and places are made where the document is; rows of one key still are one document of the index."""
    from pyspark.sql import functions as F

    rows = [("file", "en", 1, None, "hotel guest", "guest of the hotel, guest"), ("file", "en", 1, None, "hotel guest", "guest of a hotel: guest"), ("file", "en", 2, None, None, None), ("file", "en", 3, None, "booking", " ".join(f"w{k % 7}" for k in range(5000)))]
    docs = search.fts_docs(text(spark, rows))
    both = F.concat("name_tokens", F.array(F.lit(None).cast("string")), "desc_tokens")
    key = ("term", "entity_type", "sub_type", "entity_id", "dl")
    want = docs.select(*key[1:], F.posexplode(both).alias("place", "term")).filter("term is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("place")).alias("places"))
    order = lambda df: sorted(map(str, df.select(*key, "tf", "places").collect()))
    assert order(built(spark, str(tmp_path / "i"), text(spark, rows)).postings()) == order(search.positional(docs)) == order(want)


def test_making_postings_shuffles_no_tokens(spark):
    docs = search.fts_docs(text(spark, [row(random.Random(1), k) for k in range(5)]))
    assert "Exchange" not in search.placed(docs)._jdf.queryExecution().executedPlan().toString()


def test_a_small_segment_has_one_file_for_each_prefix(spark, tmp_path):
    index = built(spark, str(tmp_path / "i"), text(spark, [("file", "en", k, None, "x", " ".join(f"ab{j}" for j in range(50))) for k in range(20)]))
    files = [f for f in index.postings().inputFiles() if "p2=ab" in f]
    assert len(files) == 1


def test_segments_are_written_small(spark, tmp_path):
    index = built(spark, str(tmp_path / "i"), text(spark, [row(random.Random(1), k) for k in range(5)]))
    for kind in ("docs", "postings", "terms"):
        files = list((tmp_path / "i" / kind).rglob("*.parquet"))
        assert files and all(f.name.endswith(".zstd.parquet") for f in files)
    assert index.searchable().postings.count() > 0


def test_a_large_segment_is_written_in_runs_and_answers_alike(spark, tmp_path, monkeypatch):
    """No posting of a large segment is shuffled; random changes, repeated keys and merges answer as dealt segments do."""
    from quarry.plans import text_index

    rnd = random.Random(11)
    rows = {k: row(rnd, k) for k in range(60)}
    twice = [row(rnd, 7)[:2] + (70, 1, "hotel guest", f"the hotel {w}") for w in ("a", "b")]
    want = built(spark, str(tmp_path / "dealt"), text(spark, [*rows.values(), *twice]))
    monkeypatch.setattr(text_index, "DEALT_TOKENS", 20)
    some = built(spark, str(tmp_path / "runs"), text(spark, [*rows.values(), *twice]))
    assert some.segments[0].runs and not want.segments[0].runs and not (tmp_path / "runs" / "postings").exists()
    assert "Exchange" not in search.runs(some.docs())._jdf.queryExecution().executedPlan().toString()
    order = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert order(some.postings()) == order(want.postings()) and order(some.terms()) == order(want.terms()) and answers(some) == answers(want)
    later, gone = [row(rnd, k) for k in range(5, 30)] + [row(rnd, 99)], spark.createDataFrame([("module", 40), ("module", 70)], "entity_type string, entity_id long")
    some, few = some.changed(text(spark, later), gone), some.changed(text(spark, later[:1]))
    assert [s.runs for s in some.segments] == [True, True] and [s.runs for s in few.segments] == [True, False]
    assert text_index.TextIndex.of(spark, some.root, some.state()) == some
    now = {**rows, **{r[2]: r for r in later}}
    now.pop(40)
    monkeypatch.setattr(text_index, "DEALT_TOKENS", 1_000_000)
    fresh = built(spark, str(tmp_path / "fresh"), text(spark, list(now.values())))
    assert answers(some) == answers(fresh) == answers(some.merged(every=True))
    few_now = {**rows, later[0][2]: later[0]}
    assert answers(few) == answers(built(spark, str(tmp_path / "few"), text(spark, [*few_now.values(), *twice])))


def test_a_run_holds_each_term_together(spark):
    docs = search.fts_docs(text(spark, [("file", "en", k, None, f"t{k % 9} t{k % 5}", " ".join(f"w{j % 11}" for j in range(k % 40))) for k in range(300)])).repartition(1)
    rows = [(r.term, r.zone) for r in search.runs(docs).collect()]
    assert rows == sorted(rows) and len(rows) > 300
