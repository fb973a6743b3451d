"""Ranked search against plain scoring of all documents, its bounds, and its stated edge cases."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tabsmith.llm import ranked

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOW))


def plain(docs, items, k=20):
    """Rows (item, rank, doc, score) of each item by scoring every document."""
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    N, L, df = len(bags), sum(n for *_, n in bags), Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        q = Counter(split(text))
        rows = []
        for i, c, n in bags:
            m = 75 + 25 * n * N // L
            score = sum(x * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, x in q.items() if c[t])
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:k])]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


def test_documents_against_all_scores(spark):
    read = lambda t, c: [(r[c], r["text"]) for r in spark.read.parquet(f"{DATA}/{t}.parquet").collect()]
    out = ranked.op13_ranked(spark, DATA)
    want = plain(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert got(out) == want and out.columns == ["item_id", "rank", "doc_id", "score"]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert sorted(map(repr, con.execute(ranked.OP13_SQL).fetchall())) == want


def test_edge_cases(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["éa", "Ω"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "?! ."), (4, "w1 w2 w3"), (4, "w1 w2 w3"), (None, "w1 w2 w3"), (5, "W1 w2-W3"), (6, text(40_000)), (7, "x" * 200_000 + " w1"), (8, "unknown only")]
    rows += [(100 + k, text(rng.choice([3, 8, 30, 200]))) for k in range(300)]
    items = [(1, "w1 w2 w2 éa"), (1, "w1 w2 w2 éa"), (2, None), (3, ""), (4, "nowhere"), (None, "w5 Ω w1"), (5, text(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("query", "item_id", "rank", "score", "term", "n", "_part")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain(rows, items)
    assert got(ranked.ranked(docs, bench)) == want
    assert got(ranked.ranked(docs, bench, part_items=2)) == want
    assert got(ranked.ranked(docs, bench, k=3)) == plain(rows, items, 3)
    assert ranked.ranked(docs.limit(0), bench).count() == ranked.ranked(docs, bench.limit(0)).count() == 0


def test_buckets_are_pruned_and_nothing_is_lost():
    """Many short vectors and a few long ones that hold an item: most buckets stay closed, most documents of the others unscored."""
    rng = np.random.default_rng(5)
    terms, n = 400, 60_000
    weight = rng.integers(1, 9000, terms)
    rows = [type("R", (), {"__getitem__": lambda s, c, v=v: v[c]})() for v in ({"item_id": k, "terms": sorted(rng.choice(terms, 12, False).tolist()), "times": [1] * 12} for k in range(8))]
    q = ranked.Queries.of(rows, 0)
    weight = weight[q.vocabulary.astype(np.int64)]
    size = rng.integers(1, 12, n)
    size[::3000] = 40
    off = np.concatenate([[0], np.cumsum(size)])
    term = np.concatenate([np.sort(rng.choice(len(weight), min(s, len(weight)), False)) for s in size])
    impact = rng.integers(1000, 400_000, len(term))
    search = ranked.Search(q, weight, 20)
    search.add(np.arange(n), np.zeros(n, np.int64), off, term, impact)
    for k in range(8):
        dense = np.zeros(len(weight), np.int64)
        dense[q.term[q.off[k] : q.off[k + 1]]] = weight[q.term[q.off[k] : q.off[k + 1]]]
        score = np.add.reduceat(dense[term] * impact, off[:-1])
        order = np.lexsort((np.arange(n), -score))[:20]
        s, _, d = search.best[k]
        assert d.tolist() == order.tolist() and s.tolist() == score[order].tolist()
    assert search.opened < 0.7 * search.seen and search.scored < 0.2 * 8 * n
