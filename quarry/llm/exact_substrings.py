"""Suffix-array deduplication of repeated byte strings (operator 1).

Every byte that a string of ``length`` bytes covers is removed if that string
also starts earlier: in a document of smaller doc_id, or earlier in the same
document. Strings are judged on the input.

All starts of a corpus would be far too many to sort in one place, so they are
dealt to suffix buckets, and one bucket is sorted at a time:

1. The bucket of a start is the least hash of the ``GRAM``-byte strings inside
   its ``length`` bytes. Equal strings have equal buckets. Consecutive starts of
   one bucket form a segment, about ``(length - GRAM) / 2`` starts long, so a
   segment is one small row without text.
2. Rows meet by bucket, sorted by content, doc_id and position. Of segments with
   equal content, by 95 bits of two independent hashes, all but the first are
   removed whole, a collapse of long ties that needs no text; a task drops those
   that it sees itself before the shuffle. Two of n different segments agree on all
   bits with a probability of at most n^2 / 2^96, which is 1e-4 for the 3e12 segments
   of 100 TB and 1e-12 for those of 10 GB. What remains are buckets of two or more different
   contents, mostly the edges of repeated passages, and segments of periodic
   text, which may repeat a string within themselves.
3. The bytes of these segments are fetched, each bucket's are laid end to end,
   and their suffixes are sorted by ``suffixes``: blockwise, with a difference
   cover whose sample ranks resolve ties beyond its period. Neighbours that
   agree on ``length`` bytes are repeats; all but the first start go.
4. Per document the removed ranges are united and the rest is hashed.

Step 2 streams, whatever a bucket's size is. In step 3 a bucket of more than
``HOT`` segments is dealt anew, start by start, by a hash of the string itself,
and a bucket or part is sorted in pieces that hand only each string's first start
on, so memory holds the distinct strings of one bucket or part, of at most ``HOT``
segments, even of a passage that stands in a third of all documents.

Defined cases: a null text is an empty one; texts shorter than ``length`` bytes
are kept whole; a null doc_id is smaller than all others, and each row without
one is a document of its own; so is each text of a repeated doc_id, while rows
that repeat both count as one document. A start is earlier only if it is strictly
smaller in (document, position); documents of one doc_id are in the order of
their texts' hashes. An empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import byte_view, known, numbered, odd_ids, releasing, sliced, written
from quarry.llm.shingles import _BACK, _BASE, _BYTE, _power, mix
from quarry.llm.suffixes import repeats
from quarry.session import swept

LENGTH, GRAM, RUN, HOT = 100, 32, 256, 20_000
#: Bytes hashed at a time, and bytes of segments sorted together.
PIECE, SORTED = 1 << 18, 1 << 20
#: Marks of a segment's length; STEP is above both, and packs a position and a length into one number.
INNER, STEP = 1 << 20, 1 << 22
#: Rows that a task combines before they are shuffled, and the mark of those that need not meet others.
HELD, LOCAL = 1_000_000, -1


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, content, check, position, starts) of the segments of one text of at least ``length`` bytes.

    ``content`` and ``check`` are two independent hashes of a segment's bytes, one modulo 2 ** 64, one
    modulo a prime, so that no regular text makes both collide. INNER is added to the starts of a segment that holds its bucket's gram twice: only such a
    segment can repeat a string within itself.
    """
    n, w = len(data), length - gram + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CASED[data] * _power(_BASE, n)[:n])])
    back = _power(_BACK, n)
    grams = mix((total[gram:] - total[:-gram]) * back[: n - gram + 1])
    # sliding minimum of w grams: from the right of one block of w and the left of the next
    m = len(grams)
    blocks = np.concatenate([grams, np.full(-m % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: m - w + 1], left[w - 1 : m])
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    start = np.concatenate([[0], change])
    size = np.diff(np.concatenate([start, [len(least)]]))
    # grams that are the least of some window, and pairs of equal neighbours among them
    picked = np.flatnonzero(_sliding_max(least, w, m) == grams)
    twice = np.concatenate([[0], np.cumsum(grams[picked[1:]] == grams[picked[:-1]])])
    if size.max() > RUN:  # long runs of one bucket, as in periodic text, are cut
        parts = -(-size // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = np.repeat(start, parts) + nth * RUN, np.minimum(np.repeat(size, parts) - nth * RUN, RUN)
    first, last = np.searchsorted(picked, start), np.searchsorted(picked, start + size + w - 1) - 1
    inner = twice[np.maximum(last, first)] > twice[first]
    content = mix((total[start + size - 1 + length] - total[start]) * back[start] + size.astype(np.uint64))
    # the same bytes as a polynomial modulo a prime, brought to exponent zero by the inverse power
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_PRIME_BYTE[data] * _prime_power(_PRIME_BASE, n)[:n] % _PRIME)])
    span = (sums[start + size - 1 + length] - sums[start]) % _PRIME
    check = span * _prime_power(_PRIME_BACK, n)[start] % _PRIME
    return least[start].view(np.int64), content.view(np.int64), check.view(np.int64), start, size + INNER * inner


_PRIME = np.uint64((1 << 31) - 1)
_prime_rng = np.random.default_rng(20250611)
_PRIME_BYTE = _prime_rng.integers(1, int(_PRIME), 256, dtype=np.uint64)
_PRIME_BASE = int(_prime_rng.integers(1 << 20, int(_PRIME)))
_PRIME_BACK = pow(_PRIME_BASE, -1, int(_PRIME))
_prime_powers: dict[int, np.ndarray] = {}


def _prime_power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo the prime, by doubling; kept, as no text is hashed in greater pieces."""
    kept = _prime_powers.get(base)
    if kept is None or len(kept) <= n:
        kept = np.ones(1, np.uint64)
        while len(kept) <= n:
            kept = np.concatenate([kept, kept * np.uint64(pow(base, len(kept), int(_PRIME))) % _PRIME])
        _prime_powers[base] = kept
    return kept


def _sliding_max(least: np.ndarray, w: int, m: int) -> np.ndarray:
    """For each of m grams, the greatest of the minima of the windows that hold it."""
    wide = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    blocks = np.concatenate([wide, np.zeros(-len(wide) % w, np.uint64)]).reshape(-1, w)
    left = np.maximum.accumulate(blocks, axis=1).ravel()
    right = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(right[:m], left[w - 1 : w - 1 + m])


#: Bytes as they are, unlike the words' table.
_BYTE_CASED = _BYTE.copy()
_BYTE_CASED[65:91] = mix(_BYTE[97:123])


def all_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(bucket, content, check, doc, at) of all documents (doc, data); ``at`` is the position times STEP plus the starts.

    Of rows that a task holds with equal bucket and content only the first goes to its bucket. The
    others are repeats for certain, whatever other tasks hold; they are dealt evenly, marked by
    ``check`` LOCAL, so a passage that stands in a third of all documents fills no bucket.
    """

    def run(batches):
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        held = 0
        for batch in batches:
            docs_, (data, offsets) = batch.column(0).to_numpy(), byte_view(batch.column(1))
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                # a long text is hashed piece by piece; each start is in one piece
                for at in range(a, b - length + 1, PIECE):
                    bucket, content, check, pos, n = segments(data[at : min(b, at + PIECE + length - 1)], length, gram)
                    for col, new in zip(out, (bucket, content, check, np.full(len(pos), docs_[k]), (pos + (at - a)) * STEP + n)):
                        col.append(new)
                    held += len(pos)
                    if held > HELD:
                        yield _combined(out)
                        out, held = [[], [], [], [], []], 0
        if held:
            yield _combined(out)

    return docs.mapInArrow(releasing(run), "bucket long, content long, check long, doc long, at long")


def _combined(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    bucket, content, check, doc, at = (np.concatenate(c).astype(np.int64, copy=False) for c in columns)
    key = mix(bucket.view(np.uint64) + mix(content.view(np.uint64)))
    order = np.lexsort((at, doc, key))
    bucket, content, check, doc, at = (c[order] for c in (bucket, content, check, doc, at))
    again = np.concatenate([[False], (bucket[1:] == bucket[:-1]) & (content[1:] == content[:-1]) & (check[1:] == check[:-1]) & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))])
    # a row that is one document's for the second time is no repeat of itself
    own = np.concatenate([[False], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])
    again &= ~own
    # a document's repeats stay together, a stretch of it at a time, and so are small when compressed
    spread = mix(doc.view(np.uint64) + mix((at // (STEP << 20)).view(np.uint64))).view(np.int64)
    bucket, content, check = np.where(again, spread, bucket), np.where(again, 0, content), np.where(again, LOCAL, check)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (bucket, content, check, doc, at)], names=["bucket", "content", "check", "doc", "at"])


def collapsed(rows: DataFrame) -> DataFrame:
    """Of rows sorted by bucket, content, check, doc, at: the repeats of equal content, and the firsts of contested buckets.

    Returns (contested, bucket, doc, pos, n). The state that passes from batch to batch is one row.
    """

    def run(batches):
        last = None  # bucket, content, check and the first (doc, at) of the last row
        waiting, contested = None, False  # the only first of the last bucket so far
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(5)]
            local = columns[2] == LOCAL
            if local.any():
                yield _found(False, *(columns[k][local] for k in (0, 3, 4)))
                columns = [c[~local] for c in columns]
            bucket, content, check, doc, at = columns
            if not len(bucket):
                continue
            k = np.arange(len(bucket))
            new_b = np.concatenate([[last is None or bucket[0] != last[0]], bucket[1:] != bucket[:-1]])
            other = np.concatenate([[last is None or content[0] != last[1] or check[0] != last[2]], (content[1:] != content[:-1]) | (check[1:] != check[:-1])])
            new_c = new_b | other
            first = np.maximum.accumulate(np.where(new_c, k, -1))
            first_doc, first_at = doc[first], at[first]
            old = first < 0
            if old.any():
                first_doc[old], first_at[old] = last[3], last[4]
            repeat = ~new_c & ((doc != first_doc) | (at != first_at))
            if repeat.any():
                yield _found(False, bucket[repeat], doc[repeat], at[repeat])
            # firsts of buckets: the bucket that goes on from the batch before comes first
            f = np.flatnonzero(new_c)
            goes_on = not new_b[0]
            owner = np.cumsum(new_b)[f]  # 0: the bucket that goes on
            per = np.bincount(owner, minlength=int(new_b.sum()) + 1)
            many = (per > 1) | (np.bincount(owner, at[f] % STEP >= INNER, minlength=len(per)) > 0)
            if goes_on:
                many[0] |= contested or (waiting is not None and per[0] > 0)
                if many[0] and not contested and waiting is not None:
                    yield _found(True, *waiting)
                    waiting = None
            elif waiting is not None:
                waiting = None
            emit = many[owner]
            if emit.any():
                e = f[emit]
                yield _found(True, bucket[e], doc[e], at[e])
            if new_b.any():  # the last bucket began in this batch
                contested = bool(many[-1])
                e = f[owner == len(per) - 1]
                waiting = None if contested else (bucket[e], doc[e], at[e])
            else:
                contested = bool(many[0])
            last = (bucket[-1], content[-1], check[-1], first_doc[-1], first_at[-1])

    return rows.mapInArrow(releasing(run), "contested boolean, bucket long, doc long, pos long, n long")


def _found(contested: bool, bucket, doc, at) -> pa.RecordBatch:
    columns = (bucket, doc, at // STEP, at % STEP % INNER)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), contested)), *(pa.array(np.ascontiguousarray(x)) for x in columns)], names=["contested", "bucket", "doc", "pos", "n"])


def fetched(contested: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(bucket, doc, pos, n, data): the bytes of the segments, cut from their documents.

    Other columns of ``docs`` come along unread: a shuffle of all its columns is the one that later joins use again.
    """
    wanted = contested.groupBy("doc").agg(F.collect_list(F.struct("bucket", "pos", "n")).alias("parts"))

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc, data, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = memoryview(data.as_buffer())
                bucket, pos, n = (parts.values.field(k).to_pylist() for k in range(3))
                for b, p, m in zip(bucket, pos, n):
                    rows.append((b, doc, p, m, bytes(data[p : p + m + length - 1])))
                    size += m + length
                if size > 1 << 21:
                    yield _cut(rows)
                    rows, size = [], 0
            if rows:
                yield _cut(rows)

    return docs.join(wanted, "doc").select("doc", "data", "parts", *[c for c in docs.columns if c not in ("doc", "data")]).mapInArrow(releasing(run), "bucket long, doc long, pos long, n long, data binary")


def _cut(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.binary()))], names=["bucket", "doc", "pos", "n", "data"])


def resolved(rows: DataFrame, length: int) -> DataFrame:
    """(doc, pos, n): the starts of segments (sorted by bucket, doc, pos) whose string starts earlier in the same bucket."""

    def work(doc, pos, n, data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per start: its document, its position, and whether it is a repeat."""
        text = np.frombuffer(b"".join(data), np.uint8)
        begin = np.cumsum(np.array([len(d) for d in data])) - np.array([len(d) for d in data])
        owner = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        d, p = doc[owner], pos[owner] + nth
        order = np.lexsort((p, d))
        rank = np.empty(len(order), np.int64)
        fresh = np.concatenate([[True], (d[order][1:] != d[order][:-1]) | (p[order][1:] != p[order][:-1])])
        rank[order] = np.cumsum(fresh)
        return d, p, repeats(text, begin[owner] + nth, length, rank)

    def spans(d, p, gone) -> pa.RecordBatch:
        d, p = d[gone], p[gone]
        edge = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)]) if len(d) else np.zeros(0, bool)
        at = np.flatnonzero(edge)
        return pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(p[at]), pa.array(np.diff(np.concatenate([at, [len(d)]])))], names=["doc", "pos", "n"])

    def run(batches):
        held: list[tuple] = []  # (bucket, doc, pos, n, data)
        size = 0

        def piece(rows):
            b, doc, pos, n, data = zip(*rows)
            return work(np.array(doc), np.array(pos), np.array(n), data)

        bound = SORTED  # of the current bucket: twice what its firsts hold, so the work stays in proportion
        for batch in sliced(batches, 10_000, 8):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SORTED and row[0] != held[-1][0]:  # whole buckets only: nothing is handed on
                    yield spans(*piece(held))
                    held, size, bound = [], 0, SORTED
                elif size > 2 * bound and row[0] == held[-1][0]:  # one bucket fills the memory: the firsts of its strings stay
                    d, p, gone = piece(held)
                    yield spans(d, p, gone)
                    held = _firsts(held, gone, length, row[0])
                    size = sum(len(r[4]) for r in held)
                    bound = max(SORTED, size)
                held.append(row)
                size += len(row[4])
        if held:
            yield spans(*piece(held))

    return rows.mapInArrow(releasing(run), "doc long, pos long, n long")


def _firsts(held: list[tuple], gone: np.ndarray, length: int, bucket: int) -> list[tuple]:
    """The parts of the last bucket's segments whose starts are no repeats."""
    out, at = [], 0
    for b, doc, pos, n, data in held:
        own = gone[at : at + n]
        at += n
        if b != bucket:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]]).astype(np.int8)))
        out += [(b, doc, pos + int(x), int(y - x), data[x : y + length - 1]) for x, y in zip(edge[::2], edge[1::2])]
    return out


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, pos, n) of documents (doc, data): every run of n starts from pos on whose string starts earlier."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = all_segments(docs, length, gram).repartition(n, "bucket").sortWithinPartitions("bucket", "content", "check", "doc", "at")
    with swept(spark):  # all segments are shuffled here, more than the texts' size: gone before the texts are
        found = written(collapsed(met), "suffix-collapsed")
    contested = found.filter("contested")
    hot = contested.groupBy("bucket").count().filter(F.col("count") > HOT).select("bucket", F.ceil(F.col("count") / 1000).cast("int").alias("parts"))
    cut = fetched(contested.select("bucket", "doc", "pos", "n"), docs, length).withColumn("bucket", known(F.col("bucket"))).join(hot, "bucket", "left")
    even = cut.filter("parts is null").select("bucket", "doc", "pos", "n", "data")
    nth = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    each = cut.filter("parts is not null").withColumn("nth", nth).select(
        "bucket", "doc", (F.col("pos") + F.col("nth")).alias("pos"), F.lit(1).cast("long").alias("n"), F.substring("data", F.col("nth") + 1, F.lit(length)).alias("data"), "parts"
    )
    parted = each.select(F.xxhash64("bucket", F.pmod(F.xxhash64("data"), F.col("parts"))).alias("bucket"), "doc", "pos", "n", "data")
    ordered = even.unionByName(parted).repartition(n, "bucket").sortWithinPartitions("bucket", "doc", "pos")
    return found.filter("not contested").select("doc", "pos", "n").unionByName(resolved(ordered, length))


def kept_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: bool = False) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256, and with ``text`` what is kept as text) of documents (doc, data)."""
    docs = docs.withColumn("doc", known(F.col("doc")))
    runs = removed(docs, length, gram).groupBy("doc").agg(F.collect_list("pos").alias("pos"), F.collect_list("n").alias("n"))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for data, pos, n in zip(batch.column(1), batch.column(2), batch.column(3)):
                data = np.frombuffer(data.as_buffer(), np.uint8)
                if pos.is_valid:
                    delta = np.zeros(len(data) + 1, np.int32)
                    p, m = pos.values.to_numpy(), n.values.to_numpy()
                    np.add.at(delta, p, 1)
                    np.add.at(delta, p + m + length - 1, -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    rest = data[~gone].tobytes()
                    spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
                else:
                    rest, spans = data.tobytes(), 0
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(rest))
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                out["kept"].append(rest.decode("utf-8", "ignore") if text else None)
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * text, *rest_names]
            columns = [batch.column(0), *(pa.array(out[k], pa.string() if k in ("kept", "kept_sha256") else pa.int64()) for k in names[1 : 5 + text]), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rest_names = [c for c in docs.columns if c not in ("doc", "data")]
    joined = docs.join(runs, "doc", "left").select("doc", "data", "pos", "n", *rest_names)
    schema = f"doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept string' * text}"
    full = StructType([*StructType.fromDDL(schema).fields, *(docs.schema[c] for c in rest_names)])
    return joined.mapInArrow(releasing(run), full)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    # distinct ids are the documents' numbers: texts go without another column, and one shuffle of them serves both joins
    odd = odd_ids(rows)
    keyed = numbered(rows.withColumn("id", F.col("doc_id"))) if odd else rows.select(known(F.col("doc_id")).alias("doc"), "data")
    return kept_bytes(keyed, length).select(F.col("id" if odd else "doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their repeated strings removed from the text; ``n_chars``, if there is one, counts anew.

    Where a removed range begins or ends inside a character, what is left of the character goes
    too. A null text stays null, and a document of which nothing is left has an empty text.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").isNull().alias("absent"),
    )

    back = kept_bytes(numbered(rows), length, text=True)
    text = F.when(~F.col("absent"), F.col("kept"))
    stated = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in others else {})
    return back.select(*[stated.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def sql(length: int = LENGTH) -> str:
    """The same in DuckDB's SQL, over hexadecimal texts: blocks of a text first, then one row per start of a string."""
    block = 256
    return f"""
WITH hexed AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS MATERIALIZED (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM hexed),
blocks AS MATERIALIZED (SELECT doc_id, q, least({block}, n - {length - 1} - q) AS m, substr(h, 1 + 2 * q::INT, {2 * (block + length - 1)}) AS b FROM (SELECT *, unnest(range(0, n - {length - 1}, {block})) AS q FROM sized WHERE n >= {length})),
starts AS MATERIALIZED (SELECT doc_id, q + i AS p, hash(substr(b, 1 + 2 * i::INT, {2 * length})) AS s FROM (SELECT *, unnest(range(0, m)) AS i FROM blocks)),
firsts AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM starts),
gone AS MATERIALIZED (SELECT doc_id, p FROM firsts WHERE k > 1),
edges AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > {length}, true) AS new FROM gone),
numbered AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM edges),
spans AS MATERIALIZED (SELECT doc_id, g, min(p) AS a, max(p) + {length} AS b FROM numbered GROUP BY doc_id, g),
parts AS (
  SELECT s.doc_id, s.b AS a, coalesce(lead(s.a) OVER (PARTITION BY s.doc_id ORDER BY s.a), t.n) AS b FROM spans s JOIN sized t ON s.doc_id = t.doc_id
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (
  SELECT p.doc_id, string_agg(substr(t.h, 1 + 2 * p.a::INT, 2 * (p.b - p.a)::INT), '' ORDER BY p.a) AS h FROM parts p JOIN sized t ON p.doc_id = t.doc_id GROUP BY p.doc_id),
removed AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM sized t LEFT JOIN removed r ON t.doc_id = r.doc_id LEFT JOIN kept k ON t.doc_id = k.doc_id"""
