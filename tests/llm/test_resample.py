"""Importance resampling against a plain computation with zlib, and its stated edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import resample

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, seed=7):
    def feats(text):
        w = WORD.findall((text or "").translate(LOW))
        return w, [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    have = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for *_, f in have for b in f), Counter(b for x in target for b in feats(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, w, f in have:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    drawn = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[5]))
    for k, r in enumerate(drawn[: 25 * len(drawn) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (r[:5] for r in rows)))


def got(df):
    return sorted(repr([r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")]) for r in df.collect())


def test_crc_of_spans_of_any_length():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(6000), np.uint8)
    start = np.array([rng.randrange(0, 5000) for _ in range(400)] + [0, 0, 9])
    end = np.minimum(start + np.array([rng.choice([0, 1, 3, 9, 511, 512, 513, 1024, 1025, 5000]) for _ in start]), 6000)
    for depth in (4, 16, 512):
        parts = resample.position_table(depth)
        out = resample.span_crcs(data, start, end, parts, resample.length_constants(parts))
        assert out.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


def test_documents_against_zlib(spark):
    out = resample.op11_resample(spark, DATA)
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").collect()
    assert got(out) == plain([(r["doc_id"], r["text"]) for r in read("documents")], [r["text"] for r in read("benchmark")])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert sorted(repr(list(r[:5])) for r in con.execute(resample.OP11_SQL).fetchall()) == got(out)
    assert dict(out.dtypes) | {"n_words": ""} == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint") | {"n_words": ""}


def test_edge_cases(spark):
    rng = random.Random(2)
    many = " ".join(rng.choice(["Alpha", "béta", "GAMMA", "x", "É"]) for _ in range(30_000))
    huge = "q" * 300_000 + " " + "Z9" * 40_000 + " end"
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(1, None), (2, ""), (3, "!!! --"), (4, text), (4, text), (4, text + " more"), (None, text), (None, None), (5, many), (6, huge), (7, "one"), (8, text.upper()), (9, "a\x00b\tc")]
    rows += [(10 + k, f"{text} {k} {rng.random()}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("bucket", "n", "weight", "score", "rank", "_part", "_small", "_place", "n_words")})
    target = ["Alpha béta " + text, None, "x x x"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample.resample(docs, bench)) == plain(rows, target)
    assert got(resample.resample(docs, bench.limit(0))) == plain(rows, [])
    assert resample.resample(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("longest", [1, 3])
def test_longer_features(spark, longest):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e")], "doc_id long, text string")
    have = {r["bucket"]: r["n"] for r in resample.bucket_counts(docs, longest=longest).collect()}
    words = ["a b c d".split(), ["e"]]
    want = Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for w in words for n in range(1, longest + 1) for k in range(len(w) - n + 1))
    assert have == want
