"""Suffix dedup against a plain count of all strings, the external sort against Python's, and the stated edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import tempfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import induced, suffixes

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(docs, least=200):
    texts = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(t[k : k + least] for _, t in texts for k in range(len(t) - least + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - least + 1):
            if count[t[k : k + least]] > 1:
                gone[k : k + least] = b"\x01" * least
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append(repr([i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()]))
    return sorted(out)


def got(df):
    return sorted(repr([r["doc_id"], r["n_bytes"], sum(s["to"] - s["from"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()]) for r in df.collect())


def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.mark.parametrize("memory,width", [(1 << 20, 1 << 18), (200, 64), (50, 7), (5, 1000)])
def test_suffix_order_and_shared_starts(memory, width, monkeypatch):
    monkeypatch.setattr(induced, "SLICE", width)
    rng = random.Random(memory)
    for _ in range(60):
        n, letters, least = rng.choice([1, 2, 3, 5, 10, 50, 300, 1500]), rng.choice([1, 2, 3, 26]), rng.choice([1, 2, 3, 5, 20])
        b = bytes(rng.randrange(letters) for _ in range(n))
        b = b + b[: n // 2] + b"\x00" + b if rng.random() < 0.5 else b
        count = Counter(b[k : k + least] for k in range(len(b) - least + 1))
        with tempfile.TemporaryDirectory() as folder:
            flag = induced.shared_starts(np.frombuffer(b + bytes(8), np.uint8), least, folder, memory)
            assert flag.tolist() == [k + least <= len(b) and count[b[k : k + least]] > 1 for k in range(len(b))]
            order = induced.suffix_order(np.frombuffer(b, np.uint8), folder, memory)
            assert order.array().tolist() == sorted(range(len(b)), key=lambda k: b[k:])


def test_documents_against_all_strings(spark):
    out = suffixes.op12_suffixes(spark, DATA)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    rows = sorted(repr(list(r)) for r in out.collect())
    assert rows == plain(texts(spark))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(repr(list(r)) for r in con.execute(suffixes.OP12_SQL).fetchall()) == rows


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 4000, "memory": 100}, {"wide_bytes": 1000}])
def test_edge_cases(spark, options):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgéλ漢") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = text(60), text(9000)
    rows = [(1, None), (2, ""), (3, "x" * 199), (3, "y" * 199), (4, "x" * 5000), (5, "ab" * 300), (6, passage), (6, passage), (None, text(50)), (None, None), (7, long), (8, text(20) + long[5000:30000])]
    rows += [(9, "\x00" * 300), (10, "漢" * 67), (10, "other of one id " + passage[:201]), (11, long + "!")]
    rows += [(100 + k, f"{text(30)} {passage} {text(30)}") for k in range(60)] + [(200 + k, text(80)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("a", "c", "n", "ver", "start", "spans", "key", "_n", "copies", "parts", "starts", "ends")})
    assert got(suffixes.cut_repeated(docs, **options)) == plain(rows)
    assert suffixes.cut_repeated(docs.limit(0), **options).count() == 0


def test_other_lengths(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.choice([10, 60, 200])))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixes.cut_repeated(docs, least=40)) == plain(rows, 40)


def test_what_has_copies_only_is_not_sorted(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    written, write = {}, suffixes.materialize

    def spy(df, label):
        out = write(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(suffixes, "materialize", spy)
    long = text(400)
    rows = [(k, long) for k in range(3)] + [(10 + k, t) for t in (text(100), text(90)) for k in range(2)] + [(20 + k, text(100)) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixes.cut_repeated(docs)) == plain(rows)
    assert written["suffix-classes"] > 0 and written["suffix-fragments"] == 0
    # where a copied passage also stands in one other text, its edges are sorted, and what lies inside is not
    rows += [(30, f"{text(40)} {long[500:1500]} {text(40)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixes.cut_repeated(docs)) == plain(rows)
    assert 0 < written["suffix-fragments"] < written["suffix-classes"]
