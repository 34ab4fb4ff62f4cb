"""Mining of phrases of two to four words (operator 13).

Every word of a phrase that is frequent enough is itself frequent enough, so the
frequent words of each language get numbers and pieces are broken at all others.
The numbers of a run's words are packed into keys of fixed width: four numbers,
zeros after the last. A task sorts its keys by radix, least word first, counts
runs of equal ones, and sends them in ranges of keys, so what is shuffled are few
rows of many sorted keys. A range's task sorts and counts them again and keeps
the frequent ones. Ranges follow from how often words occur: a range of words
that is more frequent than a range should be is split by the second word.

What then remains (frequent phrases) is joined as ordinary tables: both parts of
every cut, the longer phrases that hold a phrase, and the words of the numbers.

The dictionary is sent to all tasks while it has at most ``WORDS`` words and
``WORD_BYTES`` bytes. Beyond that, words and dictionary are joined by a shuffle in
blocks of ``RUN`` words, which gives the same keys.

Defined cases: a null text is an empty one; a null language is ``und``, together
with a language of that name; a language without frequent phrases has no rows; an
empty table gives an empty table; repeated rows count each; other columns are not
read. All arithmetic is of 64-bit counts, products are decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import releasing, sliced, written

LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
#: What is broadcast at most: words of the dictionary, and their bytes.
WORDS, WORD_BYTES = 1_000_000, 16 << 20
#: Groups of words that are numbered together, keys of a range, keys that a task holds, words of a block.
GROUPS, RANGE, HELD, RUN = 4096, 4_000_000, 3_000_000, 4096
#: Distinct words that a task counts before it sends them.
COUNTED = 400_000

#: Bytes that end a piece, and bytes between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_LOWER = {b: b + 32 for b in range(ord("A"), ord("Z") + 1)}
_PLAIN = bytes(0x20 if b in BREAKS + BLANKS else _LOWER.get(b, b) for b in range(256))
_BROKEN = bytes(0x2E if b in BREAKS else 0x20 if b in BLANKS else _LOWER.get(b, b) for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """All words, lower-cased."""
    return data.translate(_PLAIN).split(b" ")


def broken(data: bytes) -> list[bytes]:
    """All words, lower-cased, with ``.`` between pieces; empty strings mean nothing."""
    return data.translate(_BROKEN).replace(b".", b" . ").split(b" ")


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts) of slices, one string of bytes for all texts of a language; pieces never cross texts."""
    for batch in sliced(batches, rows=2048):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            yield lang, b".".join(some)


def word_counts(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, f) of words that occur ``least`` times, and one row per language, without a word, of all its words."""

    def run(batches):
        counts: dict[str, Counter] = {}

        def sent():
            for lang, counter in counts.items():
                counter.pop(b"", None)
                names, n = list(counter), np.fromiter(counter.values(), np.int64, len(counter))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(names) + 1)), pa.array([*names, None], pa.binary()).cast(pa.string()), pa.array(np.append(n, n.sum()))], names=["lang", "word", "f"])
            counts.clear()

        for lang, data in _by_lang(batches):
            counts.setdefault(lang, Counter()).update(words_of(data))
            if sum(map(len, counts.values())) > COUNTED:
                yield from sent()
        yield from sent()

    found = rows.mapInArrow(releasing(run), "lang string, word string, f long")
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f")).filter(F.col("word").isNull() | (F.col("f") >= least))


def dictionary(counts: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(lang, word, f, id) with ids from 1 without gaps; the last id and the frequency of each group of ids.

    Words are dealt to ``GROUPS`` groups by a hash and numbered within them, so no task numbers all.
    """
    words = written(counts.filter("word is not null").withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(GROUPS))), "words")
    size = {r["part"]: (r["n"], r["f"]) for r in words.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f")).collect()}
    n, f = (np.array([size.get(k, (0, 0))[j] for k in range(GROUPS)], np.int64) for j in (0, 1))
    ends = np.cumsum(n)
    if len(ends) and ends[-1] >= 1 << 32:
        raise ValueError("more than 2^32 frequent words")
    first = F.element_at(F.lit((ends - n).tolist()), F.col("part").cast("int") + 1)
    place = F.row_number().over(W.partitionBy("part").orderBy("lang", "word"))
    return words.select("lang", "word", "f", (first + place).alias("id")), ends, f


def splitters(ends: np.ndarray, f: np.ndarray, ranges: int) -> np.ndarray:
    """Least keys (first id << 32 | second id) of all ranges but the first, from the frequencies of groups of ids."""
    total = int(f.sum())
    if total == 0 or ranges < 2:
        return np.zeros(0, np.uint64)
    share, upto = total / ranges, np.cumsum(f)
    out, held = [], 0.0
    for k in np.flatnonzero(f):
        start = 0 if k == 0 else int(ends[k - 1])
        if held + f[k] > share and held:
            out.append((start + 1) << 32)
            held = 0.0
        pieces = int(f[k] // share)
        if pieces >= 2:  # a frequent first word: its keys are split by the second
            places = np.searchsorted(upto, [total * j / pieces for j in range(1, pieces)])
            for first in range(start + 1, int(ends[k]) + 1):
                out += [(first << 32) + int(ends[p]) + 1 for p in places]
        held += float(f[k])
    return np.unique(np.array(out, np.uint64))


def radix_order(digits: np.ndarray) -> np.ndarray:
    """The order of rows of 16-bit digits, the most significant first; one stable pass a digit, from the last on."""
    order = np.arange(len(digits))
    for column in digits.T[::-1]:
        if len(column) and (column[0] != column).any():
            order = order[np.argsort(column[order], kind="stable")]  # a radix sort for 16 bits
    return order


def run_lengths(digits: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sum of the weights of each."""
    if not len(digits):
        return digits, weights
    order = radix_order(digits)
    digits, weights = digits[order], weights[order]
    first = np.append(True, (digits[1:] != digits[:-1]).any(axis=1))
    return digits[first], np.add.reduceat(weights, np.flatnonzero(first))


def packed(ids: np.ndarray, wide: bool, starts: int | None = None) -> np.ndarray:
    """Keys of all phrases of two to four words that begin within ``starts`` places; 0 in ``ids`` breaks them.

    A key is four numbers of one 16-bit digit, of two if ``wide``; shorter phrases end in zeros.
    """
    n = len(ids) if starts is None else min(starts, len(ids))
    padded = np.concatenate([ids, np.zeros(LONGEST, ids.dtype)])
    columns = [padded[k : k + n] for k in range(LONGEST)]
    out, there = [], columns[0] > 0
    for size in range(2, LONGEST + 1):
        there = there & (columns[size - 1] > 0)
        at = np.flatnonzero(there)
        key = np.zeros((len(at), LONGEST), np.uint32)
        for k in range(size):
            key[:, k] = columns[k][at]
        out.append(key)
    key = np.concatenate(out)
    if not wide:
        return key.astype(np.uint16)
    return np.stack([key >> 16, key & 0xFFFF], axis=2).reshape(len(key), 2 * LONGEST).astype(np.uint16)


def _leading(digits: np.ndarray, wide: bool) -> np.ndarray:
    """The first two numbers of keys, as splitters state them."""
    d = digits.astype(np.uint64)
    s = np.uint64
    return (d[:, 0] << s(48)) | (d[:, 1] << s(32)) | (d[:, 2] << s(16)) | d[:, 3] if wide else (d[:, 0] << s(32)) | d[:, 1]


class Keys:
    """Keys of a task: held, then sorted, counted and sent in ranges."""

    def __init__(self, splits: np.ndarray, wide: bool):
        self.splits, self.wide, self.held, self.n = splits, wide, [], 0

    def add(self, digits: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(digits)
        self.n += len(digits)
        if self.n > HELD:
            yield from self.sent()

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        digits, self.held, self.n = np.concatenate(self.held), [], 0
        digits, counts = run_lengths(digits, np.ones(len(digits), np.int64))
        bounds = np.searchsorted(_leading(digits, self.wide), self.splits)
        for part, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(digits)])):
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pack(digits[a:b], counts[a:b])], pa.binary())], names=["part", "keys"])


def pack(digits: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts: digit by digit, so that equal leading digits shrink."""
    head = np.array([len(digits), digits.shape[1]], "<u4").tobytes()
    raw = np.ascontiguousarray(digits.T).astype("<u2").tobytes() + counts.astype("<i8").tobytes()
    return head + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = np.frombuffer(data, "<u4", 2).tolist()
    raw = pa.Codec("zstd").decompress(data[8:], decompressed_size=n * (2 * width + 8), asbytes=True)
    return np.frombuffer(raw, "<u2", n * width).reshape(width, n).T, np.frombuffer(raw, "<i8", n, 2 * n * width)


def _frequent(least: int, wide: bool):
    """Ranges of keys to (key, f) of those that occur ``least`` times; a key here has four bytes a word and no padding."""

    def made(digits: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        keep = counts >= least
        digits, counts = digits[keep], counts[keep]
        ids = (digits.astype(np.uint32) if not wide else (digits[:, ::2].astype(np.uint32) << 16) | digits[:, 1::2]).reshape(len(digits), LONGEST)
        raw, sizes = ids.astype(">u4").tobytes(), 4 * (ids > 0).sum(axis=1)
        keys = [raw[16 * k : 16 * k + n] for k, n in enumerate(sizes.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["key", "f"])

    def run(batches):
        part, held, n = None, [], 0
        merged = lambda: run_lengths(np.concatenate([d for d, _ in held]), np.concatenate([c for _, c in held]))
        for batch in batches:
            for number, keys in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != part:
                    if held:
                        yield made(*merged())
                    part, held, n = number, [], 0
                held.append(unpack(keys.as_py()))
                n += len(held[-1][1])
                if n > 2 * RANGE:  # equal keys of many tasks
                    held = [merged()]
                    n = len(held[0][1]) - RANGE if len(held[0][1]) > RANGE else 0
        if held:
            yield made(*merged())

    return releasing(run)


def _sent_words(words: DataFrame) -> dict[str, tuple[bytes, np.ndarray]] | None:
    """{lang: (words, ids)} of a dictionary that is small enough to be sent to all tasks, else None."""
    n, size = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if n > WORDS or size > WORD_BYTES:
        return None
    rows = words.select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow()
    out = {}
    for lang in rows["lang"].unique().to_pylist():
        own = rows.filter(pc.equal(rows["lang"], lang))
        out[lang] = b" ".join(own["word"].to_pylist()), own["id"].to_numpy().astype(np.uint32)
    return out


def _keys_by_broadcast(rows: DataFrame, sent: dict, splits: np.ndarray, wide: bool) -> DataFrame:
    value = rows.sparkSession.sparkContext.broadcast((sent, splits))

    def run(batches):
        known, splits_ = value.value
        ids_of = {lang: dict(zip(words.split(b" "), ids.tolist())) for lang, (words, ids) in known.items()}
        keys = Keys(splits_, wide)
        for lang, data in _by_lang(batches):
            ids = ids_of.get(lang)
            if not ids:
                continue
            found = [ids.get(w, 0) for w in broken(data) if w]
            yield from keys.add(packed(np.array(found, np.uint32), wide))
        yield from keys.sent()

    return rows.mapInArrow(releasing(run), "part long, keys binary")


def _keys_by_join(rows: DataFrame, words: DataFrame, splits: np.ndarray, wide: bool) -> DataFrame:
    """The same by a join: words in blocks of ``RUN`` places with the next three, back in blocks with their numbers.

    A place without a row is a break: an end of a piece, or a word that is not frequent.
    """

    def placed(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 40
        for lang, data in _by_lang(batches):
            tokens = [w for w in broken(data) if w]
            for at in range(0, len(tokens), RUN):
                some = [(k, w) for k, w in enumerate(tokens[at : at + RUN + LONGEST - 1]) if w != b"."]
                places, names = [k for k, _ in some], [w for _, w in some]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(places, pa.int32()), pa.array([lang] * len(some), pa.string()), pa.array(names, pa.binary()).cast(pa.string())], names=["block", "place", "lang", "word"])
                block += 1

    def run(batches):
        keys, now, ids = Keys(splits, wide), None, np.zeros(RUN + LONGEST - 1, np.uint32)
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            bounds = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
            for a, b in zip(bounds, [*bounds[1:], batch.num_rows]):
                if columns[0][a] != now:
                    yield from keys.add(packed(ids, wide, RUN))
                    now = columns[0][a]
                    ids = np.zeros_like(ids)
                ids[columns[1][a:b]] = columns[2][a:b]
        yield from keys.add(packed(ids, wide, RUN))
        yield from keys.sent()

    tokens = rows.mapInArrow(releasing(placed), "block long, place int, lang string, word string")
    numbered = tokens.join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "place", "id")
    return numbered.repartition("block").sortWithinPartitions("block").mapInArrow(releasing(run), "part long, keys binary")


def _key_of(word_id) -> F.Column:
    """An id as four bytes."""
    return F.unhex(F.lpad(F.hex(word_id), 8, "0"))


def _sub(key, start, words) -> F.Column:
    """``words`` words of a key from word ``start`` (0 first) on."""
    return F.substring(key, start * 4 + 1, words * 4)


def mined(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases.

    ``a``, ``l`` and ``r`` count the phrase and both parts of its lowest-scoring cut, ``n`` all words.
    A phrase inside a longer one that occurs at least ``share`` percent as often is left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    counts = written(word_counts(rows, least), "word-counts")
    numbered, ends, f = dictionary(counts)
    words = written(numbered, "dictionary")
    wide = bool(ends[-1] >= 1 << 16)
    splits = splitters(ends, f, max(1, -(-3 * int(f.sum()) // RANGE)))
    sent = _sent_words(words)
    keys = _keys_by_join(rows, words, splits, wide) if sent is None else _keys_by_broadcast(rows, sent, splits, wide)
    # a range's task reads its keys once, so a range is a partition and not a group of rows in memory
    dealt = keys.repartition(len(splits) + 1, "part").sortWithinPartitions("part")
    found = written(dealt.mapInArrow(_frequent(least, wide), "key binary, f long"), "phrases")

    grams = found.unionByName(words.select(_key_of(F.col("id")).alias("key"), "f"))
    size = (F.length("key") / 4).cast("int")
    candidates = found.select("key", F.col("f").alias("a"), size.alias("size"))
    cuts = candidates.select("key", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", _sub(F.col("key"), F.lit(0), F.col("k")).alias("first"), _sub(F.col("key"), F.col("k"), F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(grams.select(F.col("key").alias("first"), F.col("f").alias("l")), "first").join(grams.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (CAST(l AS DECIMAL(20, 0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.filter("size > 2").select("key", F.col("a").alias("f"), "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    longer = longer.select("f", "key", "m", F.explode(F.expr("sequence(0, size - m)")).alias("i"))
    inside = longer.groupBy(_sub(F.col("key"), F.col("i"), F.col("m")).alias("key")).agg(F.max("f").alias("longer"))
    wide_of = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored.join(inside, "key", "left").filter(F.col("longer").isNull() | (wide_of("longer") * 100 < wide_of("a") * share))

    places = kept.select("key", F.explode(F.expr("sequence(0, CAST(length(key) / 4 AS INT) - 1)")).alias("i"))
    places = places.select("key", "i", F.conv(F.hex(_sub(F.col("key"), F.col("i"), F.lit(1))), 16, 10).cast("long").alias("id"))
    named = places.join(words.select("id", "lang", "word"), "id").groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows_ = kept.join(named, "key").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    # the best of each share of a language first, so no task holds all phrases of one
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    shares = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    some = rows_.withColumn("share", shares).withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("word is null").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """The same in DuckDB."""
    capitals = "".join(map(chr, range(65, 91)))
    return rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
grams AS MATERIALIZED (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*)::BIGINT AS f FROM starts, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM grams WHERE m > 1 AND f >= {least}),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 : m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, g.f AS l, h.f AS r, ((2000000::HUGEINT * c.a) // (g.f::HUGEINT + h.f))::BIGINT AS score
  FROM cuts c JOIN grams g ON g.lang = c.lang AND g.phrase = c.head JOIN grams h ON h.lang = c.lang AND h.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.lang = b.lang AND len(c.ws) > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100::HUGEINT * c.a >= {share}::HUGEINT * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= {top}"""
