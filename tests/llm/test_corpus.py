"""The corpus operators against brute force on small tables, and their stated edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import wave
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tabsmith.llm import decontam, langid, license, linedup, media, mixing, near, passages, registry, shards, warc
from tabsmith.llm.components import components
from tabsmith.llm.numtext import column_bytes, shingles, words

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall((text or "").lower())


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and clashing extra columns."""
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\n ", None, None, None), (4, "one two", "en", "a", 7), (4, "one two", "en", "a", 7),
        (5, "one two", "fr", "b", 7), (None, "the null one has some words in it", "en", "b", 3), (6, long, "en", "a", len(long)), (7, long + " x", "en", None, len(long)),
        (8, "!!! ???", "en", "a", 3), (9, "汉字 文本", "en", "a", 3), (10, "A\nB\nC\nA\nB\nC", "de", "a", 3), (10, "other words of one id", "de", "a", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("size", "cls", "score", "shard", "slot", "taken", "lang_pred", "pos", "root", "n", "key", "i", "w", "words", "_v", "_k", "url", "ver", "no", "_n", "_turn", "_copy", "_x", "starts", "hits", "sha", "u")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())


# --- words


def test_words_and_shingles_are_those_of_the_pattern():
    texts = ["Hello, world! one two three", "", "straße ÉTÉ x", "a", "a b c d e f", "a b c d e f g"]
    data, off = column_bytes(pa.array([t.lower() for t in texts]))
    w = words(data, off)
    got = [[data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in itertools.pairwise(w.first)]
    assert got == [split(t) for t in texts]
    flat = [h for h in w.hash]
    names = [x for t in texts for x in split(t)]
    assert len(set(zip(names, flat, strict=True))) == len(set(names)) == len(set(flat))
    value, at = shingles(w, 5)
    assert np.diff(at).tolist() == [1, 0, 1, 1, 2, 3]
    assert set(value[at[4] : at[5]]) < set(value[at[5] : at[6]])


def test_components(spark):
    rng = random.Random(3)
    edges = [(a, a + 1) for a in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 560)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    edges += [(1000 + k, 1000) for k in range(1, 700)] + [(1699, 1700)]  # a hub, whose edges are joined by broadcast
    for a, b in edges[-700:]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {u: find(u) for u in parent if find(u) != u}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 2 media


def test_media_round_trip(spark, odd, none):
    stored = media.store_wav(odd)
    texts = collections.Counter((r["doc_id"], r["text"]) for r in odd.collect())
    for r in stored.collect():
        payload = media.from_wav(bytes(r["wav"]))
        raw = payload[: r["n_bytes"]].decode()
        assert set(payload[r["n_bytes"] :]) <= {32} and len(payload) % 192 == 0 and len(payload) >= 192
        assert (r["doc_id"], raw) in texts or not raw and (r["doc_id"], None) in texts
    out = media.fingerprints(stored).collect()
    same = [(r["payload_sha256"], tuple(r["codes"])) for r in out if r["doc_id"] in (4, 5)]
    assert len(out) == 13 and len(set(same)) == 1
    assert media.fingerprints(media.store_wav(none)).count() == 0


def test_media_digests(spark):
    df = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    payload = b"hello" + b" " * 187
    r = media.fingerprints(media.store_wav(df)).first()
    assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (192, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert r["media_bytes"] == len(media.to_wav(payload)) and wave.open


def test_fingerprint_of_a_text_by_hand(spark):
    text = "Ein Text, dessen Bytes zu Tönen werden. " * 12
    r = media.fingerprints(media.store_wav(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    raw = text.encode()
    x = np.frombuffer(raw + b" " * (-len(raw) % 192), np.uint8).astype(float) - 128
    n, window = 192, [0.5 - 0.5 * math.cos(2 * math.pi * k / 191) for k in range(192)]
    bins = []
    for lo in range(0, len(x) - n + 1, 96):
        part = [abs(sum(x[lo + k] * window[k] * complex(math.cos(2 * math.pi * f * k / n), -math.sin(2 * math.pi * f * k / n)) for k in range(n))) for f in range(1, 97)]
        bins.append(1 + part.index(max(part)))
    want = [(k, bins[k] << 9 | bins[k + d] << 2 | d) for k in range(len(bins)) for d in (1, 2, 3) if k + d < len(bins)]
    assert list(zip(r["frames"], r["codes"], strict=True)) == want


def test_peaks_find_a_tone():
    t = np.arange(1920)
    tone = (128 + 100 * np.sin(2 * np.pi * 24 * t / media.FRAME)).astype(np.uint8)
    assert set(media.peaks(tone)) == {24}
    frame, code = media.pairs(np.array([3, 4, 5]))
    assert list(zip(frame.tolist(), code.tolist(), strict=True)) == [(0, 3 << 9 | 4 << 2 | 1), (0, 3 << 9 | 5 << 2 | 2), (1, 4 << 9 | 5 << 2 | 1)]
    assert set(media.peaks(np.full(192, 128, np.uint8))) == {0}


# --- 3 mixing


def test_targets_by_water_filling(spark):
    rng = random.Random(5)
    for _ in range(3):
        sizes = [rng.randrange(0, 1000) for _ in range(7)]
        w = [[5, 2, 1][k % 3] for k in range(7)]
        cap, want, open_ = [2.0 * s for s in sizes], [0.0] * 7, set(range(7))
        left = 1.5 * sum(sizes)
        while open_:  # give by weight, cap, and share the excess anew
            unit = left / sum(w[k] for k in open_)
            over = {k for k in open_ if w[k] * unit >= cap[k]}
            if not over:
                for k in open_:
                    want[k] = w[k] * unit
                break
            for k in over:
                want[k] = cap[k]
                left -= cap[k]
            open_ -= over
        df = spark.createDataFrame([(f"s{k}", s, k) for k, s in enumerate(sizes)], "source string, source_size long, rank int")
        got = {r["rank"]: r["target"] for r in mixing.targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        assert [got[k] for k in range(7)] == pytest.approx(want)


def test_sainte_lague_is_highest_quotients(spark):
    rng = random.Random(2)
    rows = [(g, k, rng.choice([0, 1, 5, 30, 400]) * rng.random(), rng.randrange(0, 60)) for g in range(12) for k in range(6)]
    seats = {g: rng.randrange(0, 90) for g in range(12)}
    df = spark.createDataFrame([(g, k, w, seats[g]) for g, k, w, _ in rows], "g int, k int, w double, seats int")
    got = {(r["g"], r["k"]): r["out"] for r in mixing.sainte_lague(df, ["g"], ["k"], "w", "seats", "out").collect()}
    for g in range(12):
        own = {k: w for h, k, w, _ in rows if h == g}
        have = dict.fromkeys(own, 0)
        if sum(own.values()) > 0:
            for _ in range(seats[g]):
                k = min(own, key=lambda k: (-own[k] / (2 * have[k] + 1), k))
                have[k] += 1
        assert {k: got[g, k] for k in own} == have


def test_mix_meets_its_targets(documents):
    out = mixing.mix(documents, shard_words=4000).collect()
    assert len(out) == documents.count()
    by = collections.defaultdict(list)
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 64 + 64
    again = mixing.mix(documents.repartition(7), shard_words=4000).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mix_by_hand(spark):
    """Shards, their quotas and the seeded blocks of one run, made again row by row."""
    rng = random.Random(11)
    rows = [(k, f"s{k % 3}" if k % 7 else None, " ".join(["w"] * rng.choice([0, 0, 1, 7, 90, 400]))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(df, shard_words=1500, shard_rows=40).collect()}
    ver = mixing.text_key(F.col("text"))
    hashed = df.select("doc_id", "source", *[F.xxhash64(F.lit(n), F.col("doc_id"), ver).alias(f"h{n}") for n in (7, 8)]).collect()
    pick = {(b, s): h for b, s, h in spark.range(200).crossJoin(spark.range(40).withColumnRenamed("id", "s")).select("id", "s", F.xxhash64(F.lit(9), F.col("id"), F.col("s"))).collect()}
    size = {k: len(t.split()) for k, _, t in rows}
    names = ["s0", "s1", "s2", None]
    total = {n: sum(size[r["doc_id"]] for r in hashed if r["source"] == n) for n in names}
    target = {r["source"]: r["target"] for r in mixing.mix(df).select("source", "target").distinct().collect()}

    def divide(weights, seats):
        have = [0] * len(weights)
        for _ in range(seats if sum(weights) else 0):
            k = min(range(len(weights)), key=lambda k: (-weights[k] / (2 * have[k] + 1), k))
            have[k] += 1
        return have

    blocks = dict(zip(names, divide([target[n] for n in names], math.floor(sum(target.values()) / 64 + 0.5)), strict=True))
    for n in names:
        own = [r for r in hashed if r["source"] == n]
        shards = max(1, math.ceil(total[n] / 1500), math.ceil(len(own) / 40))
        parts = [sorted((r["h8"], r["doc_id"]) for r in own if r["h7"] % shards == k) for k in range(shards)]
        words = [sum(size[i] for _, i in p) for p in parts]
        filled = [k for k in range(shards) if parts[k]]
        quota = dict(zip(filled, divide([words[k] for k in filled], blocks[n]), strict=True))
        for k in filled:
            line = [i for _, i in parts[k] for _ in range(size[i])]
            want = collections.Counter({i: 0 for _, i in parts[k]})
            left = min(quota[k] * 64, 2 * len(line))
            while line and left >= len(line):
                want.update(line)
                left -= len(line)
            for b in sorted(range(-(-len(line) // 64)), key=lambda b: pick[b, k]):
                some = line[64 * b : 64 * b + 64][:left]
                want.update(some)
                left -= len(some)
            assert {i: got[i] for i in want} == dict(want)


def test_many_empty_texts_have_many_shards(spark, monkeypatch):
    df = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("").alias("text")).union(spark.createDataFrame([(-1, "a", "one two")], "doc_id long, source string, text string"))
    monkeypatch.setattr(mixing, "DISTRICT", 4)
    out = mixing.mix(df, shard_rows=2000)
    assert out.count() == 50_001 and out.agg(F.sum("taken")).first()[0] <= 4 and out.where("taken > 0").count() <= 1


def test_mix_edges(odd, none):
    out = mixing.mix(odd)
    assert ids(out) == ids(odd) and mixing.mix(none).count() == 0
    rows = out.collect()
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3)) and {r["source"] for r in rows} == {"a", "b", None}
    assert {r["doc_id"]: r["size"] for r in rows}[6] == 30_000


# --- 4 language


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n, k, penalty in ((1, 2, 1.0), (9, 3, 0.7), (300, 3, 2.0)):
        score = rng.normal(size=(n, k)).astype(np.float32)
        starts = np.array([0, n // 2])
        d, back = score[0].astype(float), []
        for t in range(1, n):
            cost = 0 if t in starts else penalty
            b = np.where(d >= d.max() - cost, np.arange(k), d.argmax())
            back.append(b)
            d = d[b] - np.where(b == np.arange(k), 0, cost) + score[t]
        path = langid.viterbi(score, starts, penalty)
        value = sum(score[t, path[t]] - (penalty if t and path[t] != path[t - 1] and t not in starts else 0) for t in range(n))
        assert value == pytest.approx(d.max(), abs=1e-2)


def test_many_languages_and_long_documents():
    rng = np.random.default_rng(2)
    for k in (3, 16, 130, 200):
        score = rng.normal(size=(500, k)).astype(np.float32)
        score[:, k - 1] += 1.0
        starts = np.array([0, 40, 41, 300])
        slow = langid.by_documents(score, starts, 2.0)
        if k <= 16:
            fast = langid.by_segments(score, starts, 2.0)
            cost = [sum(score[t, p[t]] - (2.0 if t and t not in starts and p[t] != p[t - 1] else 0) for t in range(500)) for p in (slow, fast)]
            assert cost[0] == pytest.approx(cost[1], abs=1e-2)
        assert slow.min() >= 0 and np.bincount(slow).argmax() == k - 1
        assert (langid.viterbi(score, starts, 2.0) == (fast if k <= 16 else slow)).all()


def test_scripts_by_code_point():
    texts = ["việt ẽ", "ἀρχή", "word 123", "слово", "ქართ", "漢字", "ひらがな", "漢字かな", "한국", "שלום", "سلام", "բարեւ", "สวัสดี", "नमस्ते", "ﬀ", "№", "😀", "Ａｂ", "ｶﾅ", "𠀀"]
    w = words(*column_bytes(pa.array(texts)))
    got = [langid.NAMES[k] for k in langid.scripts(w).tolist()]
    assert got == "Latin Latin Greek Latin none Cyrillic Georgian Han kana kana Hangul Hebrew Arabic Armenian Thai Devanagari none none none Latin kana Han".split()
    assert len({n for n, _, _ in langid.RANGES}) + 1 == langid.SCRIPTS and (np.diff(langid._EDGES) >= 0).all()


@pytest.mark.parametrize("pair", [("שלום עולם טוב", "مرحبا بالعالم الجميل"), ("բարեւ աշխարհ", "שלום עולם"), ("สวัสดี ชาวโลก", "नमस्ते दुनिया"), ("これは ひらがな です", "这是 一个 汉字 句子"), ("привет мир", "γεια σου κόσμε")])
def test_scripts_tell_languages_apart(spark, pair):
    """Each language was learned from other letters of its script than those it is asked for."""
    letters = [sorted({c for c in t if c != " "}) for t in pair]
    rng, rows = random.Random(16), []
    for k in range(40):
        for lang, own in zip("ab", letters, strict=True):
            half = own[: max(2, len(own) // 2)]
            rows.append((len(rows), " ".join("".join(rng.choice(half) for _ in range(4)) for _ in range(30)), lang))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(n, " ".join("".join(own[len(own) // 2 :]) for _ in range(3))) for n, own in enumerate(letters)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.label(asked, model).collect()} == {0: "a", 1: "b"}


def test_held_out_accuracy(documents):
    model = langid.train(documents.where(~langid.held_out(F.col("doc_id"))))
    out = langid.label(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("lang").alias("n")).first()
    assert r["a"] >= 0.97 and r["n"] > 20


def test_spans_of_mixed_text(spark, documents):
    model = langid.train(documents)
    one = {r["lang"]: " ".join(split(r["text"])[:40]) for r in documents.where("length(text) > 1000").collect()}
    df = spark.createDataFrame([(1, f"{one['en']} {one['de']} {one['fr']}")], "doc_id long, text string")
    spans = langid.label(df, model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de", "fr"] and [abs(s["end_word"] - e) <= 3 for s, e in zip(spans, (40, 80, 120), strict=True)] == [True] * 3


def test_language_edges(documents, odd, none):
    model = langid.train(documents)
    out = {(r["doc_id"], r["lang_pred"] == "und", r["score"] > 0) for r in langid.label(odd, model).collect()}
    assert {(1, True, False), (2, True, False), (3, True, False), (8, True, False), (9, False, False), (4, False, True)} <= out
    assert langid.label(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.label(odd, langid.train(none)).collect()} == {"und"}


# --- 5 lines


def test_lines_by_hand(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "p\nq"), (4, "p\nq"), (5, "r\nr\nr\nr\nr")]
    got = {r["doc_id"]: (r["removed"], r["kept_text"]) for r in linedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ([], "a\nb\nc\nd"), 2: ([1, 2, 3, 4], "x\ny"), 3: ([], "p\nq"), 4: ([0, 1], ""), 5: ([1, 2, 3, 4], "r")}


def test_a_window_that_all_documents_have(spark):
    """And a text of many lines."""
    long = "\n".join(f"line {k}" for k in range(20_000))
    rows = [(k, f"own {k}\nfoot a\nfoot b\nfoot c") for k in range(3000)] + [(5000, long), (5001, long + "\nmore")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in linedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (4, 0, rows[0][1]) and all(got[k] == (4, 3, f"own {k}") for k in range(1, 3000))
    assert got[5000][1] == 0 and got[5001] == (20_001, 20_000, "more")


def test_lines_edges(odd, none):
    out = linedup.drop_repeated_lines(odd)
    assert ids(out) == ids(odd) and linedup.drop_repeated_lines(none).count() == 0
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[1]["kept_text"] is None and by[2]["kept_text"] == "" and by[5]["n_removed"] == 1


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    mine = registry.queries()[name](spark, DATA)
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in mine.select(*names).collect()))) == sorted(map(str, got.fetchall()))


# --- 6 WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://a/{i}", f"<p>page {i % 7}</p>" * (1 + i % 3)) for i in range(60)] + [(60, None, None), (61, "u r l\n", ""), (5, "http://again", "<p>page 5</p>" * 3), (None, "http://n", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"shard": F.lit(1), "bin": F.lit(2), "sha": F.lit("")})
    files = warc.write_warc(df, f"file://{tmp_path}/w", shard_bytes=500, roll_bytes=900)
    assert files.agg(F.sum("records")).first()[0] == len(pages) and files.count() > 3
    assert not (tmp_path / "w" / "_temporary").exists()
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect())
    least = {}
    for i, _, html in pages:
        if i is not None:
            least[html or ""] = min(least.get(html or "", i), i)
    want = collections.Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        later = i is not None and i > least[html or ""]
        want[i, len(raw), warc.base32_sha1(raw), "revisit" if later else "response", least[html or ""] if later else None] += 1
    assert got == want
    warc.write_warc(df.repartition(5), f"file://{tmp_path}/v", shard_bytes=500, roll_bytes=900)
    digests = [sorted((r["name"], r["sha256"]) for r in spark.read.parquet(f"{tmp_path}/{x}/_manifest").collect()) for x in "wv"]
    assert digests[0] == digests[1]
    empty = warc.write_warc(df.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0 and warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_outlying_ids_leave_shards_even(spark, tmp_path):
    """An id of 2^60, one 2^63 below it, and an id that many rows share."""
    df = spark.range(3000).select(F.when(F.col("id") == 1, F.lit(1 << 60)).when(F.col("id") == 2, F.lit(-(1 << 62) * 2 + 1)).when(F.col("id") < 1000, F.lit(5)).otherwise(F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id")).alias("html"))
    files = warc.write_warc(df, f"file://{tmp_path}/w", shard_bytes=2000).groupBy("shard").agg(F.sum("records").alias("n")).orderBy("shard").collect()
    n = [r["n"] for r in files]
    assert sum(n) == 3000 and len(n) > 10 and max(n) <= 1.5 * min(n[:-1])
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 3000


# --- 7 near duplicates


def brute_near(texts):
    sets = {}
    for i, t in texts.items():
        w = split(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    links, parent = collections.Counter(), {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return links, {i: find(i) for i in texts}


def test_near_duplicates_by_brute_force(spark, documents, texts, monkeypatch):
    links, cls = brute_near(texts)
    for block in (1024, 3):
        monkeypatch.setattr(near, "BLOCK", block)
        got = {r["doc_id"]: r for r in near.near_duplicates(documents).collect()}
        assert {i: r["class_id"] for i, r in got.items()} == cls
        assert {i: r["links"] for i, r in got.items() if r["links"]} == dict(links)
    assert links


def test_a_group_of_near_copies_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    texts = {}
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        texts[i] = " ".join(w)
    links, cls = brute_near(texts)
    monkeypatch.setattr(near, "BLOCK", 16)
    got = {r["doc_id"]: r for r in near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r["links"] for i, r in got.items()} == dict(links) and {i: r["class_id"] for i, r in got.items()} == cls


def test_a_large_group_loses_no_link_to_its_leaders(spark):
    """Copies of one text with edits of their own, at all distances up to 0.35 of each other: classes by brute force."""
    rng = random.Random(14)
    base = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    texts = {}
    for i in range(700):
        w = list(base)
        for j in rng.sample(range(100), rng.choice((0, 1, 1, 2, 3, 4))):
            w[j] = f"x{i}y{j}"
        texts[i] = " ".join(w)
    links, cls = brute_near(texts)
    got = {r["doc_id"]: r for r in near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert sum(got[i]["links"] for i in texts) >= 0.99 * sum(links.values())
    assert sum(got[i]["class_id"] == cls[i] for i in texts) >= 0.99 * len(texts)


def test_keys_of_one_class_are_held_against_no_frequent_bucket(spark, monkeypatch):
    handled, joined = [], near.join_counted

    def spy(rows, *rest, **more):
        handled.append(rows.count())
        return joined(rows, *rest, **more)

    monkeypatch.setattr(near, "join_counted", spy)
    rows = [(i, [i], [1000 + 8 * i + k for k in range(7)] + [5 if i < 300 else 1007 + 8 * i]) for i in range(600)]
    classes = near.materialize(spark.createDataFrame(rows, "no long, bits array<long>, bands array<long>"), "test-classes")
    links = near.candidate_links(classes, "bits", lambda a, b: F.lit(1.0), link=0.4, done=0.8)
    assert sorted((r["u"], r["v"]) for r in links.collect()) == [(i, 0) for i in range(1, 300)]
    assert max(handled) <= 300


def test_near_edges(odd, none):
    out = near.near_duplicates(odd)
    assert ids(out) == ids(odd) and near.near_duplicates(none).count() == 0
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[5]["class_id"] == 4 and by[5]["links"] == 2 and by[7]["class_id"] == 6 and by[1]["links"] == by[3]["links"] == 0


# --- 8 licenses


def test_licenses_by_brute_force(documents, texts):
    wanted = {n: split(t) for n, t in license.TEMPLATES.items()}

    def sh(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for i, t in texts.items():
        w = split(t)
        for n, x in wanted.items():
            s = sh(x, min(5, len(x)))
            if len(s & sh(w, min(5, len(x)))) >= 0.8 * len(s) - 1e-9:
                want.add((i, n))
    assert {(r["doc_id"], r["license"]) for r in license.scan(documents).collect()} == want and want


def test_license_edges(spark, odd, none):
    lines = [(1, "Text before. RELEASED   under the\nMIT license!"), (2, "Released under the BSD License."), (3, "x All rights, reserved y"), (None, "Released under the MIT License. " * 3)]
    got = {(r["doc_id"], r["license"]) for r in license.scan(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (3, "All-rights-reserved"), (None, "MIT")}
    assert license.scan(odd).count() == 0 and license.scan(none).count() == 0 and license.scan(odd, {}).count() == 0


def test_license_texts_and_long_texts(spark):
    other = [f"w{k % 5000}" for k in range(100_000)]
    mit = license.TEMPLATES["MIT-text"].split()
    long = " ".join([*other, *mit[:60], "an", "edit", *mit[61:], *other])
    rows = [(1, long), (2, " ".join(license.TEMPLATES["BSD-3-Clause-text"].split()[40:90])), (3, "Licensed under CC BY-NC 4.0")]
    began = time.time()
    got = {(r["doc_id"], r["license"]): r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k in got if k[0] == 1} == {(1, "MIT-text"), (1, "MIT-grant")} and got[1, "MIT-text"]["first_word"] == 100_000
    assert {k for k in got if k[0] > 1} == {(3, "CC-BY-NC")} and time.time() - began < 60


# --- 9 passages


def test_sorted_rows_in_batches_of_any_size():
    """Keys that another row has, and the keys of each number, whatever the cuts between batches."""
    rng = random.Random(15)

    def batches(rows):
        i = 0
        while i < len(rows):
            j = i + rng.randrange(0, 7)
            yield pa.RecordBatch.from_pydict({"no": pa.array([r[0] for r in rows[i:j]], pa.int64()), "key": pa.array([r[1] for r in rows[i:j]], pa.int64())})
            i = j

    for _ in range(100):
        rows = sorted(((rng.randrange(9), rng.randrange(30)) for _ in range(rng.randrange(60))), key=lambda r: r[1])
        keys = collections.Counter(k for _, k in rows)
        got = [(r["no"], r["key"]) for b in passages._beside(batches(rows)) for r in b.to_pylist()]
        assert got == [r for r in rows if keys[r[1]] > 1]
        rows.sort()
        got = [(r["no"], k) for b in passages._listed(batches(rows)) for r in b.to_pylist() for k in r["keys"]]
        assert got == rows


def test_planted_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    planted = [[word() for _ in range(55)] for _ in range(12)]
    rows, want = [], set()
    for i in range(120):
        w = [word() for _ in range(150)]
        if i < 60:
            w[70:70] = planted[i % 12]
            want.add(i)
        rows.append((i, " ".join(w)))
    out = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in out}
    assert found <= want and len(found) >= 0.9 * len(want)
    assert {r["doc_id"] for r in out if r["removed_words"] == 0} == {i for i in found if i < 12}
    assert all(r["kept_doc"] % 12 == r["doc_id"] % 12 and r["kept_doc"] <= r["doc_id"] for r in out)
    assert all(65 <= r["first_word"] and r["end_word"] <= 130 for r in out)


def test_near_paragraphs(spark):
    base = [f"w{k}" for k in range(40)]
    cut = passages.cuts
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, "nothing of the kind stands here at all")]
    got = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1, 2} and cut


def wrapped(w, width):
    return "\n".join(" ".join(w[k : k + width]) for k in range(0, len(w), width))


def test_cuts_do_not_depend_on_lines():
    w = [f"w{k * 7919 % 1000}" for k in range(300)]
    cut = [passages.cuts(words(*column_bytes(pa.array([wrapped(w, n), wrapped(w, n)])))) for n in (300, 12, 4, 1)]
    assert all((c == cut[0]).all() for c in cut) and cut[0][0] and cut[0][300]
    assert np.diff(np.flatnonzero(cut[0][:300]))[1:-1].min() > passages.REACH


def test_passages_in_short_and_rewrapped_lines(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, n = [], 40
    for i in range(n):
        p = [word() for _ in range(100)]
        for k, width in enumerate((3, 4, 8, 100)):  # both copies' lines are short, or they differ
            if k == i % 3 or k == 3 and i % 2:
                rows.append((2 * i + k // 3, wrapped([word() for _ in range(80)], 9) + "\n" + wrapped(p, width) + "\n" + wrapped([word() for _ in range(80)], 7)))
        if not i % 2:
            rows.append((2 * i + 1, " ".join(word() for _ in range(50)) + "\n" + wrapped(p, (3, 4, 8)[i % 3])))
    found = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows) == 2 * n and len(found) >= 0.95 * len(rows)


def test_grow_is_the_best_banded_alignment():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (40, 20)).astype(np.int32)
    y = np.where(rng.random((40, 20)) < 0.8, x, rng.integers(0, 5, (40, 20))).astype(np.int32)
    y[::2, 7:] = y[::2, 6:-1]
    a, b, equal = passages.grow(x, y)
    for r in range(40):
        s = {(0, 0): 0}
        for i, j in itertools.product(range(21), range(21)):
            if (i or j) and abs(i - j) <= passages.DRIFT:
                ways = [s.get((i - 1, j), -999) - passages.COST, s.get((i, j - 1), -999) - passages.COST]
                if i and j:
                    ways.append(s[i - 1, j - 1] + (1 if x[r, i - 1] == y[r, j - 1] else -passages.COST))
                s[i, j] = max(ways)
        assert s[a[r], b[r]] == max(s.values()) and equal[r] <= min(a[r], b[r])


def test_passages_with_an_inner_edit(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, sizes = [], {}
    for i in range(120):
        n, edits = ((51, [25]), (51, []), (60, [30]), (100, [33, 66]))[i % 4]
        p = [word() for _ in range(n)]
        q = list(p)
        for e in edits:
            q[e : e + 1] = [[word()], [], [word(), q[e]]][i % 3]
        for k, w in enumerate((p, q)):
            rows.append((2 * i + k, " ".join([word() for _ in range(70)] + w + [word() for _ in range(70)])))
            sizes[2 * i + k] = n, len(w)
    got = {r["doc_id"]: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in range(4):
        own = [i for i in sizes if i // 2 % 4 == kind]
        assert sum(i in got for i in own) >= 0.85 * len(own), kind
    for i, r in got.items():
        assert 65 <= r["first_word"] and r["end_word"] <= 75 + sizes[i][1] and r["kept_doc"] == i - i % 2
        assert r["words"] <= r["end_word"] - r["first_word"] and r["removed_words"] == (r["words"] if i % 2 else 0)


@pytest.mark.parametrize("n", [51, 60])
def test_passages_with_an_edit_beside_pieces_in_other_documents(spark, n):
    """The first and last documents by id hold pieces of all passages, so a seed's first and last occurrence are not its passage's other copy."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    around = lambda k: [word() for _ in range(k)]
    passages_, rows = [[word() for _ in range(n)] for _ in range(60)], []
    for i, p in enumerate(passages_):
        q = p[: n // 2] + [word()] + p[n // 2 + 1 :]
        rows += [(1000 + 2 * i + k, " ".join([*around(70), *w, *around(70)])) for k, w in enumerate((p, q))]
    for doc in (1, 9999):  # pieces of twenty words, apart
        rows.append((doc, " ".join(x for p in passages_ for piece in (p[2:22], p[-22:-2]) for x in [*around(60), *piece])))
    found = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = sum(1000 + 2 * i in found and 1001 + 2 * i in found for i in range(60))
    assert pairs >= 48, pairs


def shared_runs(texts, size):
    """Documents that have ``size`` equal words in a row with another."""
    where = collections.defaultdict(set)
    for i, t in texts.items():
        w = split(t)
        for k in range(len(w) - size + 1):
            where[hash(tuple(w[k : k + size]))].add(i)
    return {i for s in where.values() if len(s) > 1 for i in s}


def near_somewhere(a, b, size=20, share=0.7):
    """Whether some stretch of ``size`` words of ``a`` shares most of its words with a stretch of ``b``."""
    at = collections.defaultdict(list)
    for k in range(len(b)):
        at[b[k]].append(k)
    for k in range(0, max(len(a) - size + 1, 1)):
        near = collections.Counter(p // size for w in set(a[k : k + size]) for p in set(at.get(w, ())))
        if near and max(near[p] + near[p + 1] for p in near) >= share * len(set(a[k : k + size])):
            return True
    return False


def test_passages_by_brute_force(spark):
    """Recall of documents with equal runs, and every reported passage is one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if os.path.isdir("/root/testdata/sf0.01") else spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    out = passages.repeated_passages(docs, across=True).collect()
    found = {r["doc_id"] for r in out}
    for size, least in ((51, 0.98), (24, 0.9)):
        want = shared_runs(texts, size)
        assert want and len(want & found) >= least * len(want), (size, len(want & found), len(want))
    assert found <= {r["doc_id"] for r in passages.repeated_passages(docs).collect()}
    for r in out:
        if r["removed_words"]:
            own = split(texts[r["doc_id"]])[r["first_word"] : r["end_word"]]
            assert near_somewhere(own, split(texts[r["kept_doc"]])), r


def test_passages_within_one_document(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    p = [word() for _ in range(60)]
    df = spark.createDataFrame([(1, " ".join([*p, *[word() for _ in range(50)], *p])), (2, " ".join(word() for _ in range(90)))], "doc_id long, text string")
    assert {r["doc_id"] for r in passages.repeated_passages(df).collect()} == {1}
    assert passages.repeated_passages(df, across=True).count() == 0


def test_versions_of_one_id(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    p = [word() for _ in range(60)]
    rows = [(None, " ".join([word() for _ in range(9)] + p)), (None, " ".join(p + [word() for _ in range(9)])), (None, " ".join(p + ["x"])), (None, " ".join(p + ["x"]))]
    out = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["ver"] for r in out}) == 3 and sum(r["removed_words"] == 0 for r in out) == 1


def test_passage_edges(odd, none):
    got = {r["doc_id"] for r in passages.repeated_passages(odd).collect()}
    assert got == {6, 7} and passages.repeated_passages(none).count() == 0


# --- 10 shards


def test_shards(odd, none, documents):
    out = shards.assign_shards(documents).collect()
    for s in range(16):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in out) and any(r["grown_shard"] == 16 for r in out)
    assert len({r["shard"] for r in out}) == 16
    o = shards.assign_shards(odd)
    assert ids(o) == ids(odd) and shards.assign_shards(none).count() == 0
    by = {r["doc_id"]: r for r in o.collect()}
    assert (by[1]["size"], by[1]["text_crc32"], by[4]["size"], by[4]["text_crc32"]) == (1, 0, 8, zlib.crc32(b"one two"))


def test_winning_scores_by_hand(spark):
    def xx(value, width, seed):
        return xxhash.xxh64((value & (1 << 8 * width) - 1).to_bytes(width, "little"), seed).intdigest()

    keys = [0, 1, -5, 2**40, 77]
    got = [tuple(r) for r in spark.createDataFrame([(k,) for k in keys], "k long").select(shards.rendezvous(F.col("k"), [1.0] * 16), shards.rendezvous(F.col("k"), [1.0, 2.5, 0.5])).collect()]
    for key, mine in zip(keys, got, strict=True):
        for weights, shard in zip(([1.0] * 16, [1.0, 2.5, 0.5]), mine, strict=True):
            u = [((xx(key, 8, xx(j, 4, xx(11, 4, 42))) >> 11) + 0.5) / 2**53 for j in range(len(weights))]
            assert shard == max(range(len(weights)), key=lambda j: -weights[j] / math.log(u[j]))


def test_weighted_shards(spark):
    df = spark.range(40_000).select(shards.rendezvous(F.col("id"), [1.0, 3.0]).alias("s"))
    n = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    assert abs(n[1] / 40_000 - 0.75) < 0.02


# --- 1 benchmark


def test_lcs():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(np.array(a, np.uint64), np.array(b, np.uint64)) == t[-1][-1]


def test_leaks_and_paraphrases(spark, documents):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    want = {(i, k) for i, t in docs.items() for k, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(documents, bench).collect()}
    assert want and len(want - got) <= 0.1 * len(want)
    for i, k in got - want:
        a, b = split(items[k]), split(docs[i])
        assert len(set(a) & set(b)) >= 0.6 * len(set(a))
    rng, rows = random.Random(1), []
    some = sorted(docs)[:20]
    for n, k in enumerate(sorted(items)[:20]):  # every tenth word goes; the last five stay
        w = items[k].split()
        w = [x for j, x in enumerate(w) if j % 10 != 4 or j >= len(w) - 5]
        rows.append((10_000 + n, docs[some[n]][:300] + " " + " ".join(w) + " " + docs[some[-n]][:200]))
    found = decontam.find_leaks(documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")), bench)
    hit = {(r["doc_id"] - 10_000, r["item_id"]) for r in found.where("doc_id >= 10000").collect()}
    assert len(hit & set(enumerate(sorted(items)[:20]))) >= 18 and rng


def brute_leaks(texts, items, copied=0.8, paraphrased=0.6, answer_words=5):
    """All pairs, the rule itself: the LCS of the item with any stretch of the document of one and a half times its length."""
    out = set()
    have = {i: np.array([hash(x) & (1 << 62) - 1 for x in split(t)], np.uint64) for i, t in texts.items()}
    for k, x in items.items():
        w = np.array([hash(y) & (1 << 62) - 1 for y in split(x)], np.uint64)
        some = set(w.tolist())
        for i, h in have.items():
            if not len(w) or len(some & set(h.tolist())) < paraphrased * len(some) * 0.9:
                continue
            step = max(len(w) // 4, 1)
            for lo in range(0, max(len(h) - len(w) // 2, 1), step):
                near = h[lo : lo + len(w) + 2 * step]
                score = decontam.lcs(w, near) / len(w)
                if score >= copied or score >= paraphrased and decontam.lcs(w[-answer_words:], near) >= 0.8 * len(w[-answer_words:]):
                    out.add((i, k))
                    break
    return out


def test_leaks_by_brute_force_on_all_pairs(spark, documents, texts):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    rng = random.Random(3)
    planted = dict(texts)
    for n, k in enumerate(sorted(items)):  # part of the words replaced, by words of other texts or rare ones, or left out; the answer stays
        w = items[k].split()
        fill = split(texts[sorted(texts)[n % len(texts)]]) or ["x"]
        for j in rng.sample(range(max(len(w) - 5, 0)), int(0.33 * max(len(w) - 5, 0))):
            w[j] = ("", f"rare{n}x{j}", rng.choice(fill))[n % 3]
        planted[10_000 + n] = " ".join([*fill[:60], *w, *fill[60:120]])
    df = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    want = brute_leaks(planted, items)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect()}
    short = {(i, k) for i, k in want if len(split(items[k])) < 25}
    assert len(want) >= len(items) and len(want & got) >= 0.9 * len(want), (len(want), len(want & got))
    assert not short or len(short & got) >= 0.9 * len(short), (len(short), len(short & got))
    assert len(got - want) <= 0.02 * len(got)


def test_items_of_any_length_and_in_parts(spark, documents):
    rng = random.Random(7)
    vocabulary = sorted({x for t in ("alpha beta gamma delta epsilon zeta eta theta", ) for x in t.split()} | {f"word{k}" for k in range(3000)})
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate((6, 12, 20, 40, 61, 150, 300, 600, 1500, 5000))]
    rows = [(100_000 + k, " ".join(rng.choice(vocabulary) for _ in range(200)) + " " + t + " " + " ".join(rng.choice(vocabulary) for _ in range(130 + k))) for k, t in items]
    df = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part in (25_000, 4):
        got = {(r["doc_id"] - 100_000, r["item_id"]) for r in decontam.find_leaks(df, bench, part_items=part).where("doc_id >= 100000").collect()}
        assert got == {(k, k) for k, _ in items}


def test_answers_only_if_named(spark, documents):
    words_ = " ".join(f"q{k}" for k in range(8))
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(100_000, words_ + " and then the reply is forty two")], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, words_ + " x y z", "forty two")], "item_id long, text string, answer string")
    assert decontam.find_leaks(docs, bench).count() == 0
    assert decontam.find_leaks(docs, bench, answer="answer").count() == 1


def test_leak_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(odd, bench).collect()}
    assert got == {(4, 3), (5, 3)}
    assert decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(odd, bench.limit(0)).count() == 0


# --- pipeline


def test_pipeline(spark, documents, odd, none):
    docs, counts = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).persist()
        assert docs.columns == documents.columns
        counts.append(docs.count())
    assert documents.count() >= counts[0] > counts[1] >= counts[2]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0
        out = stage(spark, odd, DATA)
        assert out.count() > 0 and (stage is corpus_pipeline.sharded or out.columns == odd.columns)
    assert corpus_pipeline.run(spark, DATA).count() == counts[3]


def test_pipeline_row_by_row(spark, documents):
    """The first two stages against plain decisions on each row; rows without an id among them."""
    base = [tuple(r) for r in documents.collect()]
    rows = base + [(None, f"{t[1][:400]} and so on {k}" if t[1] else None, *t[2:]) for k, t in enumerate(base[:50])] + [(None, "!!!", "en", "a", 3), (None, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = corpus_pipeline.known_language(spark, docs, DATA).collect()
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert collections.Counter(map(tuple, known)) == collections.Counter(t for t in rows if letters(t[1]))

    some = [t for t in rows if t[1]]
    bags = []
    for t in some:
        w = split(t[1])
        bags.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(some)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a, b in itertools.combinations(range(len(some)), 2):
        if bags[a] and bags[b] and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b]):
            group[find(b)] = find(a)
    kept = [some.index(tuple(r)) for r in corpus_pipeline.one_of_each(spark, spark.createDataFrame(some, SCHEMA), DATA).collect()]
    assert collections.Counter(find(k) for k in kept if bags[k]) == collections.Counter({find(k): 1 for k in range(len(some)) if bags[k]})
    least = {}
    for k, t in enumerate(some):
        if t[0] is not None and bags[k]:
            least[find(k)] = min(least.get(find(k), t[0]), t[0])
    assert all(some[k][0] == least[find(k)] for k in kept if bags[k] and some[k][0] is not None)


def test_registry_has_the_thirteen():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 14)) and math.e
