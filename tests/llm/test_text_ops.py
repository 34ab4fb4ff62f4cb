"""BPE, token counts, language ID, audio and token files: exact against the libraries, round trips, odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import audio, bpe, language, queries, rans, token_counts
from quarry.llm.common import tokenizer_path, tokenizer_pattern

ODD = ["", None, "a", "  two  blanks\n\n\tend ", "don't we'll 's", "日本語 テキスト 👩‍👩‍👧", "x" * 5000 + " " + " " * 3000 + "y", "\x1c\x1d a\x85b\xa0c", "<|endoftext|> in <|startoftext|>", "ª²½ ÀÉÎ Straße ΣΑΣ İ", "é combining", "tab\tand\x0bvt"]


def frame(spark, texts, **more):
    rows = [(i, t, *[v for v in more.values()]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))
    # repeated rows, a null id, and columns whose names an operator might use itself
    df = df.unionByName(df.filter("doc_id = 3")).unionByName(df.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    return df.withColumn("ids", F.lit(1)).withColumn("size", F.lit("z")).withColumn("score", F.lit(0.5))


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken")))}, special_tokens={})


def test_bpe_equals_tiktoken(spark, tiktoken_encoding):
    rows = bpe.digests(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = ODD[4 if r.doc_id is None else r.doc_id] or ""
        ids = tiktoken_encoding.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_on_random_texts(tiktoken_encoding):
    own = bpe.Codec(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())
    rnd = random.Random(1)
    texts = ["".join(rnd.choice([" ", "\n", "'", "s", "t", "é", "中", "😀", "́", "1", "٣", ".", "a", "the"]) for _ in range(rnd.randint(0, 150))) for _ in range(200)]
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text)
        assert own.decode(ids.tolist()) == text.encode()


def test_every_token_encodes_to_itself():
    own = bpe.Codec(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())
    assert all(ids == [k] for k, ids in enumerate(own.model.encode([bpe.mapped(t) for t in own.tokens])))


def test_encoded_and_decoded_tables(spark):
    ids = bpe.encoded(frame(spark, ODD))
    assert ids.filter("not round_trip").count() == 0
    got = {r.doc_id: bytes(r.data) for r in bpe.decoded(ids).collect()}
    assert got[5] == ODD[5].encode() and got[0] == b"" and got[1] == b""


def test_empty_tables(spark):
    none = frame(spark, []).filter("false")
    for made in (bpe.digests(none), token_counts.counted(none), audio.digests(none), rans.digests(none), language.identified(none.withColumn("lang", F.lit("en")))):
        assert made.count() == 0


def test_counts_equal_the_library(spark):
    tok = token_counts.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    long = ["word's and " * 4000 + "x" * 3000 + "<|endoftext|>" * 50, "日本。" * 6000, " " * 9000 + "!" * 9000]
    texts = [*ODD, *long]
    for r in token_counts.counted(frame(spark, texts), chunk=1500, overlap=96).collect():
        text = texts[4 if r.doc_id is None else r.doc_id] or ""
        n = len(tok.encode(text, add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_overlaps_widen_where_nothing_aligns():
    tok = token_counts.tokenizer(tokenizer_path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    for _ in range(60):
        text = "".join(rnd.choice(["a" * 40, "'s", "!", "<|endoftext|>", " ", "é", "9", "\n"]) for _ in range(rnd.randint(1, 120)))
        for chunk, overlap in ((64, 16), (160, 80), (300, 100)):
            assert token_counts.count_tokens(lambda ts: tok.encode_batch(ts, add_special_tokens=False), text, chunk, overlap) == len(tok.encode(text, add_special_tokens=False))


def test_whole_tables_of_token_operators_equal_the_libraries(spark, tiktoken_encoding):
    """op2, op5 and op8 over all of sf0.01; half of its characters stand in texts that op8 splices."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert sum(len(t) for t in texts.values() if len(t) > token_counts.CHUNK_CHARS) > 0.3 * sum(map(len, texts.values()))
    tok, words = (Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for r in queries.op8_token_counts(spark, sf).collect():
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    for r in queries.op2_byte_bpe(spark, sf).collect():
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_rans(spark, sf).collect()}
    at = 0
    for i in sorted(texts):
        ids = [*words.encode(texts[i], add_special_tokens=False).ids, 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_other_tokenizers_get_whole_texts(spark, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    text = "Überall word's and 日本語 " * 900
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert token_counts.counted(df, tokenizer_path("piece_bpe_32k.model")).first().n_tokens == len(model.encode(text))
    assert token_counts.counted(df, tokenizer_path("word_bpe_49k.json")).first().n_tokens == len(words.encode(text, add_special_tokens=False).ids)
    assert token_counts.spliceable(tokenizer_path("byte_bpe_50k.json")) and not token_counts.spliceable(tokenizer_path("word_bpe_49k.json"))


def test_language_of_held_out_texts(spark):
    rnd = random.Random(2)
    stock = {"en": "the and of to in that is was he for it with as his on be at by".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht".split(), "fr": "le de un à être et en avoir que pour dans ce il qui ne sur se pas".split()}
    rows = [(i, " ".join(rnd.choice(stock[lang]) for _ in range(rnd.randint(20, 200))), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    df = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "123 !!", "en"), (1002, "the and of it was", None), (None, "der die und das", "de")], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x"))
    got = {r.doc_id: r for r in language.identified(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(180)) and got[None].held_out
    held = [(lang, got[i].lang_pred) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001))
    assert got[1002].lang_pred == "en" and 0 <= got[1002].score <= 1
    noise = ["".join(rnd.choice("qxzjkvwpbgy") for _ in range(300)), "".join(chr(rnd.randrange(0xA1, 0x2FF)) for _ in range(400)), "".join(rnd.choice("qxzjkvwpbgy ") for _ in range(3000))]
    more = spark.createDataFrame([(2000 + k, t, None, "x") for k, t in enumerate(noise)], df.schema).unionByName(spark.createDataFrame([(3000, "the and of it was he for it with as his on be", None, "x")], df.schema))
    odd = df.unionByName(more).withColumn("noise", F.lit("n")).withColumn("__bytes", F.lit(1)).withColumn("row", F.lit(2))
    kept = language.spoken(odd, most=0.9)  # a network of so few documents is less sure
    ids = {r.doc_id: r.lang for r in kept.collect()}
    assert kept.columns == odd.columns and {1000, 1001, 2000, 2001, 2002}.isdisjoint(ids) and {i for i, _, _ in rows} <= set(ids) and ids[3000] == "en"


def test_the_bound_as_shipped_rejects_noise_and_keeps_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(8)
    noise = [
        *("".join(rnd.choice("qxzjkvwpbgy") for _ in range(n)) for n in (300, 3000)),
        *("".join(chr(rnd.randrange(0xA1, 0x2FF)) for _ in range(n)) for n in (400, 4000)),
        *("".join(chr(rnd.randrange(0x21, 0x7F)) for _ in range(n)) for n in (300, 2000)),
    ]
    first = 10_000_000
    more = spark.createDataFrame([(first + k, t) for k, t in enumerate(noise)], "doc_id long, text string")
    kept = language.spoken(docs.unionByName(more, allowMissingColumns=True)).select("doc_id").collect()
    ids = {r.doc_id for r in kept}
    assert not [k for k in range(len(noise)) if first + k in ids]
    assert len(ids) == docs.filter(F.col("text").rlike(r"\p{L}")).count()


def test_a_very_long_text_has_the_language_of_its_windows(spark):
    rnd = random.Random(3)
    stock = {"en": "the and of to in that is was he for it with".split(), "de": "der die und in den von zu das mit sich des auf".split()}
    rows = [(i, " ".join(rnd.choice(stock[lang]) for _ in range(120)), lang) for i, lang in enumerate(["en", "de"] * 40)]
    long = " ".join(rnd.choice(stock["de"]) for _ in range(400_000))
    df = spark.createDataFrame([*rows, (500, long, None)], "doc_id long, text string, lang string")
    net = language.trained(df)
    got = language.predicted(df.filter("doc_id = 500"), net).first()
    data = np.frombuffer(long.encode(), np.uint8)
    total = np.zeros(3)
    for at in range(0, len(data), language.WINDOW):  # one window after another
        own = data[at : at + language.WINDOW + net.reach - 1]
        wide = np.zeros((1, language.WINDOW + net.reach - 1), np.uint8)
        wide[0, : len(own)] = own
        total += net.probabilities(wide)[0] * min(language.WINDOW, len(data) - at)
    assert got.lang_pred == net.langs[int(total[:-1].argmax())] == "de" and got.score == pytest.approx(total[:-1].max() / total[:-1].sum(), abs=1e-3)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identified(df).first().lang_pred == "und"
    assert language.spoken(df.unionByName(df.withColumn("text", F.lit("12 !")))).count() == 1


def test_network_gradients_are_right():
    net = language.ByteCNN(["a", "b"], seed=3)
    rng = np.random.default_rng(0)
    windows, target = rng.integers(0, 256, (5, language.WINDOW + net.reach - 1)).astype(np.uint8), np.array([0, 1, 0, 1, 1])
    grads = net.gradients(windows, target)
    loss = lambda: -np.log(net.probabilities(windows).astype(np.float64)[np.arange(5), target]).mean()
    for name in ("v", "c", "b"):
        p = net.p[name].reshape(-1)
        k = int(np.argmax(np.abs(grads[name].reshape(-1))))
        was = p[k]
        p[k] = was + 1e-2
        up = loss()
        p[k] = was - 1e-2
        down = loss()
        p[k] = was
        assert (up - down) / 2e-2 == pytest.approx(grads[name].reshape(-1)[k], rel=0.1, abs=1e-3)


def test_audio_round_trip_and_determinism(spark):
    rows = audio.digests(frame(spark, [*ODD, ODD[6], "q" * 100_000])).collect()
    texts = [*ODD, ODD[6], "q" * 100_000]
    for r in rows:
        payload = audio.padded((texts[4 if r.doc_id is None else r.doc_id] or "").encode())
        assert len(payload) % 576 == 0 and r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(audio.to_wav(payload)), hashlib.sha256(audio.to_wav(payload)).hexdigest())
    by = {r.doc_id: r.feature for r in rows}
    assert by[6] == by[len(ODD)] and len({f for f in by.values()}) > 6
    assert audio.from_wav(audio.to_wav(b"abc")) == (audio.RATE, b"abc")
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFFxxxxJUNK")


def plain_log_mel(payload):
    """The frames' log-mel energies by the definitions: zero-stuffing and a full convolution, then one transform per frame."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    taps = audio.UP * audio.TAPS
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / max(audio.UP, audio.DOWN)) * np.hamming(taps)
    h *= audio.UP / h.sum()
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    full = np.convolve(stuffed, h)
    # output k is the filtered signal at k * DOWN, delayed by half the filter
    at = np.arange(len(x) * audio.UP // audio.DOWN) * audio.DOWN + taps // 2 - audio.UP
    y = full[at]
    y = np.concatenate([y, np.zeros(max(0, audio.FRAME - len(y)))])
    out = []
    for s in range(0, len(y) - audio.FRAME + 1, audio.HOP):
        power = np.abs(np.fft.rfft(y[s : s + audio.FRAME] * np.hanning(audio.FRAME))) ** 2
        row = []
        top = 2595 * np.log10(1 + audio.RATE * audio.UP / audio.DOWN / 2 / 700)
        edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, top, audio.MELS + 2)]
        f = np.fft.rfftfreq(audio.FRAME, audio.DOWN / audio.UP / audio.RATE)
        for a, b, c in zip(edges, edges[1:], edges[2:]):
            row.append(np.log1p(sum(p * max(0.0, min((g - a) / (b - a), (c - g) / (c - b))) for p, g in zip(power, f))))
        out.append(row)
    return np.array(out)


def test_audio_features_equal_a_plain_version():
    rnd = random.Random(4)
    for n in (576, 5 * 576, 40 * 576):
        payload = bytes(rnd.randrange(256) for _ in range(n))
        want, got = plain_log_mel(payload), audio.features(payload)
        assert got["n_frames"] == len(want)
        frames = got["tensors"].reshape(-1, audio.MELS)
        assert np.allclose(frames[: len(want)], want, atol=2e-3) and not frames[len(want) :].any()
        ms = 1000 * audio.DOWN / audio.UP / audio.RATE
        assert [a for a, _ in got["spans"]] == [round(k * audio.HOP * ms, 3) for k in range(0, len(want), audio.TENSOR[0])]
        assert got["spans"][-1][1] == round(((len(want) - 1) * audio.HOP + audio.FRAME) * ms, 3)


def test_stored_tensors_are_arrow_tensors(spark):
    texts = ["short", "longer " * 3000, None]
    media = audio.stored(frame(spark, texts))
    for row in audio.featured(media).collect():
        sounds, cut = audio.from_ipc(bytes(row.sounds)), audio.from_ipc(bytes(row.tensors))
        assert cut.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), audio.TENSOR)
        per = np.bincount(cut["sound"].to_numpy(), minlength=sounds.num_rows)
        for k, (doc, frames) in enumerate(zip(sounds["doc_id"].to_pylist(), sounds["n_frames"].to_pylist())):
            payload = audio.padded((texts[doc] or "").encode()) if doc is not None else None
            assert per[k] == -(-frames // audio.TENSOR[0])
            if payload is not None:
                mine = cut.filter(pa.array(cut["sound"].to_numpy() == k)).combine_chunks()
                assert np.array_equal(mine["tensor"].combine_chunks().to_numpy_ndarray(), audio.features(payload)["tensors"])
    found = {r.doc_id: r for r in audio.described(audio.featured(media)).collect()}
    assert found[1].n_tensors > 3 and found[0].n_tensors == 1


def test_audio_finds_a_loud_part():
    rnd = random.Random(1)
    quiet, loud = bytes([128]) * 8000, bytes(rnd.randrange(256) for _ in range(8000))
    found = audio.features(quiet + loud + quiet)["segments"]
    assert 900 < found[0][0] < 1100 and 1900 < found[-1][1] < 2100 and sum(b - a for a, b in found) > 500
    assert audio.segments(np.array([0, 9, 5, 5, 3, 5, 10.0])) == [(1, 4), (6, 7)]
    assert audio.segments(np.ones(4)) == []


def test_polyphase_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000).astype(np.float32)
    y = audio.resampled(x)
    assert len(y) == 6000 and abs(np.argmax(np.abs(np.fft.rfft(y))) - 440) <= 1


def test_token_files_read_back(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [*ODD, "THE same Words again and again " * 300]
    df = frame(spark, texts)
    rows = rans.digests(df).collect()
    order = sorted(((-1 if r.doc_id is None else r.doc_id) for r in df.collect()))
    want, at = [], 0
    for i in order:
        ids = [*tok.encode(texts[4 if i < 0 else i] or "", add_special_tokens=False).ids, 2]
        want.append((None if i < 0 else i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_token_files_are_read_by_another_process(spark, tmp_path):
    import subprocess
    import sys

    texts = [*ODD, "null ids and repeated ones " * 40]
    df = frame(spark, texts).unionByName(frame(spark, texts).limit(6).withColumn("doc_id", F.lit(None).cast("long")))
    folder = rans.filed(df, folder=str(tmp_path / "files"))
    want = sorted((r.start, r.n_tokens, r.ids_crc32, -1 if r.doc_id is None else r.doc_id) for r in rans.decoded(spark, folder).collect())
    assert [w[3] for w in want] == sorted(w[3] for w in want) and [w[0] for w in want] == [sum(x[1] for x in want[:k]) for k in range(len(want))]
    code = f"from quarry.session import local_session; from quarry.llm import rans; print(sorted((r.start, r.n_tokens, r.ids_crc32, -1 if r.doc_id is None else r.doc_id) for r in rans.decoded(local_session('2'), {folder!r}).collect()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, check=True).stdout
    assert out.strip().splitlines()[-1] == str(want)


def test_many_files_of_few_bytes(spark):
    ids = spark.createDataFrame([(None if k % 3 == 0 else k // 2, k, bytearray(np.array([k % 50, 2], "<u2").tobytes())) for k in range(400)], "doc_id long, tie long, ids binary")
    frequency = rans.scaled(rans.counts(ids, "<u2", 64))
    blocks = rans.encoded(ids, frequency, "<u2", total=1600, file_bytes=40)
    files = [r.file for r in blocks.select("file").distinct().collect()]
    assert len(files) > 20  # rows without a doc_id are a third of all and lie in several files
    tables = rans.Tables(frequency)
    got = [d for r in blocks.orderBy("file", "block").collect() for d in rans.unpack_block(bytes(r.data), tables)[0]]
    assert len(got) == 400 and [-1 if d is None else d for d in got] == sorted(-1 if d is None else d for d in got)


def test_rans_blocks_and_their_parts():
    rng = np.random.default_rng(3)
    for n, size in ((0, 50), (1, 50), (5000, 50), (700_000, 1000)):
        ids = (rng.zipf(1.3, n) % size).astype("<u2")
        tables = rans.Tables(rans.scaled(np.bincount(ids, minlength=size)))
        lengths = [n // 2, n - n // 2]
        block = rans.pack_block([7, None], lengths, ids, tables)
        names, got, back = rans.unpack_block(block, tables)
        assert names == [7, None] and got.tolist() == lengths and (back == ids).all()
        parts = rans.HEADER.unpack_from(block)[6]
        if parts:
            assert (np.concatenate([rans.unpack_block(block, tables, k)[2] for k in range(parts)]) == ids).all()
    assert parts > 1 and len(block) < 0.75 * 2 * n
    with pytest.raises(ValueError, match="checksum"):
        rans.unpack_block(block[:-4000] + bytes(4000), tables)
    with pytest.raises(ValueError, match="frequency table"):
        rans.unpack_block(block, rans.Tables(rans.scaled(np.ones(1000, np.int64))))


def test_scaled_frequencies():
    f = rans.scaled(np.array([0, 10, 1, 0]), 8)
    assert f.sum() == 256 and f.min() >= 1 and f.argmax() == 1
    assert rans.scaled(np.zeros(4, np.int64), 8).sum() == 256
    with pytest.raises(ValueError):
        rans.scaled(np.ones(300, np.int64), 8)
