"""Rules that SQL over the test tables does not show: refusals, nulls, published numbers."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import struct
import tracemalloc
from collections import Counter
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsmith import storage
from tabsmith.errors import WorkbenchError
from tabsmith.functions import distributions as dist
from tabsmith.operators import catalog, dataset, features, inputs, prep, recon, results, runs, scorer
from tabsmith.operators.order import Ordered, global_index, index_within
from tabsmith.plans.readonly import check_readonly, preview, query
from tabsmith.queries import core
from tabsmith.queries import storage as storage_queries
from tabsmith.sources import readers, writers
from tabsmith.sources import arrow_ipc, csv_records, json_records
from tabsmith.streaming import runs as streaming_runs
from tabsmith.streaming import upsert
from tabsmith.sources.arrow_ipc import read_arrow_ipc, write_arrow_ipc


def code(f, *a, **k):
    with pytest.raises(WorkbenchError) as e:
        f(*a, **k)
    return e.value.code


@pytest.fixture(scope="module")
def hourly(spark):
    return readers.synthetic_hourly(spark.range(256), "id").cache()


def text(path, content):
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_hourly_ids_keep_all_digits(spark):
    rows = readers.synthetic_hourly(spark.createDataFrame([(7,), (1234,), (12345,), (123456,)], "id long"), "id").collect()
    assert [r["source_row_id"] for r in rows] == ["row-0007", "row-1234", "row-12345", "row-123456"]


# --- SQL


@pytest.mark.parametrize("sql", ["INSERT INTO t VALUES (1)", "DROP TABLE t", "CREATE TABLE t (a int)", "SET a = 1", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT * FROM read_files('x')", "EXPLAIN SELECT 1", ""])
def test_refused(spark, sql):
    assert code(check_readonly, spark, sql) == "INVALID_QUERY"


def test_a_path_is_no_table(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    assert code(query, spark, f"SELECT * FROM parquet.`{tmp_path}/x`") == "INVALID_QUERY"


@pytest.mark.parametrize("sql", ["SELECT 1", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "VALUES (1), (2)", "(SELECT 1)", "-- note\nSELECT 'DROP TABLE x; ?'"])
def test_allowed(spark, sql):
    assert query(spark, sql).count() >= 1


def test_parameters(spark):
    assert query(spark, "SELECT ? + ? AS x", [1, 2.5]).first()["x"] == 3.5
    assert code(query, spark, "SELECT ? AS x", [1, 2]) == "INVALID_QUERY"
    assert code(query, spark, "SELECT ? AS x", [math.inf]) == "INVALID_QUERY"
    assert query(spark, "SELECT :a AS x", {"a": "b"}).first()["x"] == "b"


def test_preview(spark):
    n, top = preview(spark.range(300), 5)
    assert (n, top.count()) == (300, 5)
    assert code(preview, spark.range(3), 201) == "INVALID_QUERY"


def test_global_index_is_gapless(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 11).alias("k"), "id")
    got = global_index(df, ["k", "id"]).orderBy("row_ordinal").collect()
    assert [r["row_ordinal"] for r in got] == list(range(1000))
    assert [(r["k"], r["id"]) for r in got] == sorted((i * 37 % 11, i) for i in range(1000))
    assert global_index(df.limit(0), ["k", "id"]).count() == 0


# --- import and export


def test_csv_nulls_quotes_and_bom(spark, tmp_path):
    p = text(tmp_path / "a.csv", '﻿id,empty,value\r\n1,"",\\N\r\n2,,"a,""b"""\r\n\r\n3,x,1.5\r\n')
    rows = readers.read_csv(spark, p).orderBy("id").collect()
    assert [(r["id"], r["empty"], r["value"]) for r in rows] == [(1.0, "", None), (2.0, None, 'a,"b"'), (3.0, "x", "1.5")]


@pytest.mark.parametrize(("content", "want"), [("a,a\n1,2\n", "SCHEMA_MISMATCH"), ("a,\n1,2\n", "SCHEMA_MISMATCH"), ("a,b\n1\n", "INVALID_FORMAT"), ("a,b\n1,2,3\n", "INVALID_FORMAT"), ("", "EMPTY_INPUT")])
def test_csv_refusals(spark, tmp_path, content, want):
    assert code(readers.read_csv, spark, text(tmp_path / "b.csv", content)) == want


def test_unsafe_integers_stay_text(spark, tmp_path):
    p = text(tmp_path / "c.csv", "id\n9007199254740993\n")
    assert readers.read_csv(spark, p).first()["id"] == "9007199254740993"
    assert code(readers.read_csv, spark, p, types={"id": "number"}) == "TYPE_LOSS"


def test_types(spark):
    df = spark.createDataFrame([("1", "true", "2025-01-01T00:00:00Z", "x", None), (None, "false", None, "1", None)], "n string, b string, t string, s string, z string")
    assert {r["column_name"]: r["type"] for r in readers.inference(df).collect()} == {"n": "number", "b": "boolean", "t": "timestamp", "s": "string", "z": "null"}
    assert code(readers.cast_declared, df, {"s": "number"}) == "TYPE_LOSS"


def test_json_paths(spark, tmp_path):
    p = text(tmp_path / "d.json", '{"data": {"rows": [{"x": 1, "y": 2}, {"y": 3}]}}')
    assert [tuple(r) for r in readers.read_json_rows(spark, p, "$.data.rows").collect()] == [(1, 2), (None, 3)]
    assert code(readers.read_json_rows, spark, p, "$.data.none") == "INVALID_FORMAT"
    assert code(readers.read_json_rows, spark, p) == "INVALID_FORMAT"


def test_a_failed_import_keeps_the_old_table(spark):
    readers.import_source(spark, spark.range(3), "kept")
    assert code(readers.import_source, spark, spark.range(0), "kept", replacing=True) == "EMPTY_INPUT"
    assert spark.table("kept").count() == 3
    assert code(readers.import_source, spark, spark.range(3), "KEPT") == "NAME_CONFLICT"
    assert code(readers.import_source, spark, spark.range(3), "__x") == "NAME_CONFLICT"


def test_arrow_round_trip(spark, tmp_path, hourly):
    write_arrow_ipc(hourly.repartition(3), str(tmp_path / "x"))
    assert recon.diff_tables(read_arrow_ipc(spark, str(tmp_path / "x")), hourly, on="source_row_id").count() == 0


def test_lossless(spark):
    assert code(readers.check_lossless, spark.createDataFrame([(math.nan,)], "x double")) == "TYPE_LOSS"
    assert code(readers.check_lossless, spark.createDataFrame([(2**53,)], "x long")) == "TYPE_LOSS"
    assert code(readers.reject_nested, spark.createDataFrame([([1],)], "x array<int>")) == "TYPE_LOSS"


def test_no_columns(spark, tmp_path):
    assert code(writers.write_csv, spark.range(1).select(), str(tmp_path / "n")) == "EXPORT_FAILED"


def test_published_statistics(hourly):
    """The stated statistics of the hourly rows."""
    row = {r["column_name"]: r for r in catalog.table_stats(hourly).collect()}
    assert row["temperature_c"]["mean"] == pytest.approx(16.54140625, abs=1e-9)
    assert (row["wind_speed_ms"]["min"], row["wind_speed_ms"]["max"]) == (0.0, 9.0)
    assert row["solar_wm2"]["mean"] == pytest.approx(229.294938730469, abs=1e-6)
    assert row["demand_mwh"]["mean"] == pytest.approx(28.734980578125, abs=1e-6)
    mean, scale = prep.target_statistics(hourly, "demand_mwh")
    assert (mean, scale) == (pytest.approx(28.734981536865234, abs=2e-6), pytest.approx(2.9033761024475098, abs=2e-6))


# --- datasets and features


def test_dataset_refusals(spark):
    assert code(dataset.build_dataset, spark, "SELECT 1 AS a, 2 AS A") == "SCHEMA_MISMATCH"
    assert code(dataset.build_dataset, spark, "SELECT 1 AS __row_id") == "SCHEMA_MISMATCH"
    assert code(dataset.build_dataset, spark, "SELECT 1 AS a WHERE false") == "EMPTY_INPUT"


def test_ratio_split_of_the_hourly_rows(spark, hourly):
    hourly.createOrReplaceTempView("hourly")
    df = dataset.build_dataset(spark, "SELECT * FROM hourly", ["timestamp_utc", "source_row_id"])
    train, test = dataset.ratio_split(df, "timestamp_utc")
    assert (train.count(), test.count()) == (204, 52)
    assert dataset.split_overlap(train, test).first().asDict() == {"verifiable": True, "overlap": 0}
    assert not dataset.split_overlap(train.drop("__row_id"), test).first()["verifiable"]
    roles = dataset.column_roles(train, test, "demand_mwh")
    assert roles == {"features": ["temperature_c", "wind_speed_ms", "solar_wm2", "hour_utc"], "target": "demand_mwh", "time": "timestamp_utc"}


def test_cutoffs(spark):
    df = spark.createDataFrame([(1, None), (2, "2025-01-01"), (3, "2025-01-02")], "i int, t string")
    a, b = dataset.time_split(df, "t", "2025-01-02T00:00:00Z")
    assert ([r["i"] for r in a.collect()], [r["i"] for r in b.collect()]) == ([2], [3])
    assert code(dataset.time_split, df, "t", "soon") == "INVALID_DATA"


def test_matrix_refusals(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", 1e300, math.inf), (None, 3.0, "b", 1.0, 1.0)], "x double, y double, s string, big double, inf double")
    p = features.prepare_prediction_input
    assert code(p, df, df, "y", ["s"]) == "FEATURE_MISMATCH"
    assert code(p, df, df, "y", ["y"]) == "INVALID_TARGET"
    assert code(p, df, df, "y", ["x", "x"]) == "FEATURE_MISMATCH"
    assert code(p, df, df, "y", ["big"]) == "NUMERIC_OVERFLOW"
    assert code(p, df, df, "y", ["inf"]) == "INF_DISABLED"
    assert code(p, df, df, "x", ["y"]) == "NONFINITE_TARGET"
    got = p(df, df.withColumn("y", F.when(F.col("x") == 1, F.col("y"))), "y", ["x"]).predict.collect()
    assert [r["truth"] for r in got] == [2.0, None] and math.isnan(got[1]["x"])


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (1.0, None, None)], "a double, b double, c double")
    assert prep.select_non_constant(df, ["a", "b", "c"]) == ["b"]
    assert code(prep.select_non_constant, df, ["a", "c"]) == "INVALID_DATA"


def test_repeated_rows_have_fingerprints_of_their_own(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, math.nan)], "i int, x double")
    plain = {r["i"]: r["__fingerprint"] for r in prep.row_fingerprint(df, ["x"], 6).collect()}
    own = {r["i"]: r["__fingerprint"] for r in prep.row_fingerprint_distinct(df, ["x"], 6, "i").collect()}
    assert plain[1] == plain[2] == own[1] != own[2] and all(0 <= v <= 1 for v in own.values())


def test_fit_and_predict(hourly):
    x = ["temperature_c", "wind_speed_ms", "solar_wm2", "hour_utc"]
    state = prep.fit_preprocessing(hourly, x, "demand_mwh", "source_row_id", order=[3, 2, 0, 1, 4])
    assert state.used == ["hour_utc", "solar_wm2", "temperature_c", "wind_speed_ms", prep.FINGERPRINT] and state.salt == 256 * 4
    m = prep.transform_features(hourly, state, row_id="source_row_id")
    stats = m.agg(*[F.avg(c).alias(c) for c in m.columns]).first()
    assert all(abs(v) < 1e-4 for v in stats)
    assert code(prep.transform_features, hourly.drop("hour_utc"), state) == "SCHEMA_MISMATCH"
    assert prep.permutation("abcd", shift=1) == ["d", "a", "b", "c"]
    assert code(prep.permutation, "ab", order=[0, 0]) == "INVALID_DATA"


# --- distributions


def test_softmax_edges(spark):
    df = spark.createDataFrame([([0.0, -math.inf, 0.0],), ([math.nan, 1.0],), ([-math.inf, -math.inf],), ([1000.0, 0.0],)], "x array<double>")
    got = [r["p"] for r in df.select(dist.softmax(F.col("x")).alias("p")).collect()]
    assert got == [[0.5, 0.0, 0.5], None, None, [1.0, 0.0]]


@pytest.mark.parametrize(("bin_", "mean", "scale", "want"), [(2000, 10.0, 2.0, (4010.5, 4011.5)), (0, 0.0, 1.0, (0.25, 0.75)), (4999, 0.0, 1.0, (4999.25, 4999.75))])
def test_quantiles_of_one_bucket(spark, bin_, mean, scale, want):
    p = [0.0] * 5000
    p[bin_] = 1.0
    df = spark.createDataFrame([(p,)], "p array<double>")
    assert tuple(df.select(dist.decode_quantiles(F.col("p"), list(range(5001)), mean=mean, scale=scale).alias("q")).first()["q"]) == want


def test_borders():
    assert code(dist.check_borders, [0, 1, 1], 2) == "RESULT_INVALID"
    assert code(dist.check_borders, [0, 1], 2) == "RESULT_INVALID"
    b = dist.default_borders(4, [(0.0, -2.0), (0.5, 0.0)])
    assert b.tolist() == [-2, -1, 0, 1, 2]
    assert dist.rebin_of(np.array([[0.5, 0.5]]), np.array([0.0, 1, 2]), np.array([0.0, 0.5, 2])).tolist() == [[0.25, 0.75]]


# --- results and runs


def make_results(spark, rows):
    return spark.createDataFrame(rows, "row_ordinal long, mean double, q25 double, q75 double")


@pytest.mark.parametrize("rows", [[(0, 1.0, None, None)], [(0, 1.0, None, None), (0, 1.0, None, None)], [(0, 1.0, None, None), (2, 1.0, None, None)], [(0, 1.0, None, None), (1, math.nan, None, None)], [(0, 1.0, 1.0, None), (1, 1.0, None, None)], [(0, 1.0, 2.0, 1.0), (1, 1.0, None, None)]])
def test_nothing_bad_is_published(spark, rows):
    assert code(results.validate_results, make_results(spark, rows), 2) == "RESULT_INVALID"


def test_good_results(spark):
    results.validate_results(make_results(spark, [(1, 1.0, 0.0, 2.0), (0, 1.0, None, None)]), 2)


def test_names(spark):
    assert results.unique_name(["a"], "mean") == "mean"
    assert results.unique_name(["Mean"], "mean") == "prediction_mean"
    assert results.unique_name(["mean", "prediction_mean"], "mean") == "prediction_mean_2"
    test = spark.createDataFrame([(0, 5.0)], "row_ordinal long, mean double")
    assert results.enrich_test_rows(test, make_results(spark, [(0, 1.0, 0.5, 1.5)])).columns == ["row_ordinal", "mean", "prediction_mean", "q25", "q75"]


def events(spark, rows):
    return spark.createDataFrame([(f"r{r}", "s", g, q, k, b, e) for r, g, q, k, b, e in rows], "request_id string, stream_id string, generation long, seq long, kind string, baseline boolean, experiment boolean")


def replay(spark, rows):
    changes = runs.replayed(events(spark, rows)).cache()
    states, heads = runs.run_states(changes), runs.stream_heads(changes)
    return {r["request_id"]: r["status"] for r in states.collect()}, results.current_runs(states, heads).first(), heads.first()


def test_twenty_scenarios(spark):
    """A baseline and twenty edits in a row: the twentieth is current, the others are superseded."""
    rows = [(0, 0, 0, "reserve", True, False), (0, 0, 1, "publish", True, False)]
    rows += [(k, k + 1, 1 + k, "reserve", False, False) for k in range(1, 21)] + [(k, k + 1, 50 + k, "publish", False, False) for k in (3, 20)]
    by, current, heads = replay(spark, rows)
    assert sum(v == "superseded" for v in by.values()) == 19 and by["r20"] == by["r0"] == "published"
    assert current["request_id"] == "r20" and heads["baseline"] == "r0" and heads["head"] == 21


def test_current_while_pending_and_cancelled(spark):
    rows = [(1, 1, 0, "reserve", False, False), (1, 1, 1, "publish", False, False), (2, 2, 2, "reserve", False, False)]
    assert replay(spark, rows)[1] is None
    rows.append((2, 2, 3, "cancel", False, False))
    assert replay(spark, rows)[1] is None
    rows[-1] = (2, 2, 3, "fail", False, False)
    assert replay(spark, rows)[1]["request_id"] == "r1"


def test_baselines_and_experiments_are_never_stale(spark):
    rows = [(1, 5, 0, "reserve", False, False), (2, 9, 1, "reserve", False, True), (3, 0, 2, "reserve", True, False), (4, 7, 3, "reserve", True, False), (1, 5, 4, "publish", False, False), (5, 6, 5, "reserve", False, False), (6, 4, 6, "reserve", False, False), (7, 3, 7, "reserve", False, True)]
    by, current, heads = replay(spark, rows)
    assert by == {"r1": "published", "r2": "pending", "r3": "pending", "r4": "pending", "r5": "pending", "r6": "refused", "r7": "pending"}
    assert current is None and heads["head"] == 6
    rows += [(5, 6, 8, "fail", False, False), (6, 4, 9, "reserve", False, False)]
    by, current, heads = replay(spark, rows)
    assert current["request_id"] == "r1" and by["r6"] == "refused" and heads["head"] == 5


def test_baseline_goes_back_when_rolled_back(spark):
    rows = [(1, 0, 0, "reserve", True, False), (1, 0, 1, "publish", True, False), (2, 0, 2, "reserve", True, False), (2, 0, 3, "publish", True, False)]
    assert replay(spark, rows)[2]["baseline"] == "r2"
    rows.append((2, 0, 4, "rollback", True, False))
    by, _, heads = replay(spark, rows)
    assert by["r2"] == "failed" and heads["baseline"] == "r1"
    rows.append((1, 0, 5, "delete", True, False))
    by, _, heads = replay(spark, rows)
    assert by["r1"] == "deleted" and heads["baseline"] is None


def test_known_requests_and_deletion(spark):
    rows = [(1, 1, 0, "reserve", False, False), (1, 1, 1, "cancel", False, False), (1, 9, 2, "reserve", False, False)]
    by, _, heads = replay(spark, rows)
    assert by == {"r1": "refused"} or by == {"r1": "cancelled"} and heads["head"] == 1
    got = runs.run_states(runs.replayed(events(spark, rows))).collect()
    assert {(r["seq"], r["status"]) for r in got} == {(0, "cancelled"), (2, "refused")}
    rows += [(1, 1, 3, "delete", False, False), (1, 9, 4, "reserve", False, False), (2, 10, 5, "reserve", False, False), (1, 9, 6, "delete", False, False)]
    changes = runs.replayed(events(spark, rows)).cache()
    assert {(r["seq"], r["status"]) for r in runs.run_states(changes).collect()} == {(0, "deleted"), (2, "refused"), (4, "deleted"), (5, "pending")}
    assert [r["request_id"] for r in results.run_history(runs.run_states(changes), "s").collect()] == ["r2"]


def random_events(rng, n):
    out, kinds = [], ["reserve", "reserve", "publish", "publish", "cancel", "fail", "rollback", "delete"]
    for k in range(n):
        r = rng.randrange(max(1, n // 4))
        out.append((r, rng.choice([0, 1, k, k + 1, k + 5]), k, rng.choice(kinds), r % 5 == 0, r % 7 == 3))
    return out


def test_states_from_any_cut_are_those_from_the_beginning(spark):
    """Stream k has the same events k later, so that one cut comes after another event in each."""
    rng, n = random.Random(8), 60
    rows = [(f"r{r}", f"s{k}", g, q + k, kind, b, x) for k in range(n + 1) for r, g, q, kind, b, x in random_events(random.Random(1000 + k % 7), n)]
    ev = spark.createDataFrame(rows, "request_id string, stream_id string, generation long, seq long, kind string, baseline boolean, experiment boolean")
    whole = runs.replayed(ev).cache()
    key = lambda df: sorted(map(repr, (tuple(r[c] for c in runs.NAMES) for r in df.collect())))
    changes, state = runs.replayed_in_steps(ev, [n, n + rng.randrange(5, 20)])
    assert key(changes) == key(whole.where("status <> 'head'"))
    assert key(state) == key(runs.settled(whole))
    plain = {}
    for k in range(7):
        stream = runs.Stream()
        plain[f"s{k}"] = [c for e in random_events(random.Random(1000 + k), n) for c in stream.step(f"r{e[0]}", e[1], e[2] + k, *e[3:])]
    assert sum(map(len, plain.values())) == whole.where("status <> 'head' and stream_id in ('s0','s1','s2','s3','s4','s5','s6')").count()


def test_events_are_made_once_for_all_steps(spark):
    """However many steps there are, and whatever the seq; events that have none come first, as in one pass."""
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    rows = [(f"r{r}", "s", g, q, k, b, x) for r, g, q, k, b, x in random_events(random.Random(12), 200)]
    ev = spark.createDataFrame([*rows, ("first", "s", 0, None, "reserve", True, False)], "request_id string, stream_id string, generation long, seq long, kind string, baseline boolean, experiment boolean")
    changes, state = runs.replayed_in_steps(ev.mapInPandas(count, ev.schema), [40, 40, 90, 500])
    got, whole = sorted(map(repr, changes.collect())), runs.replayed(ev).cache()
    assert made.value == 201
    assert got == sorted(map(repr, whole.where("status <> 'head'").select(*changes.columns).collect()))
    assert sorted(map(repr, state.select(*runs.NAMES).collect())) == sorted(map(repr, runs.settled(whole).select(*runs.NAMES).collect()))
    assert [p.count() for p in runs.in_steps(ev.limit(0), [1])] == [0, 0] and [p.count() for p in runs.in_steps(ev, [])] == [201]


def test_heap():
    rng, heap, have = random.Random(9), runs.Heap(), []
    for _ in range(3000):
        if have and rng.random() < 0.45:
            assert heap.top() == min(have)
            have.remove(heap.top())
            heap.pop()
        else:
            have.append((rng.randrange(50), rng.randrange(1000), "x"))
            heap.push(have[-1])
    assert heap.size == len(have)


class StandInState:
    """A state variable by stream, which counts its calls."""

    def __init__(self, handle):
        self.handle, self.rows = handle, {}

    def _call(self, key=()):
        self.handle.calls += 1
        return self.handle.stream, key

    def get(self):
        return self.rows.get(self._call())

    def update(self, row):
        self.rows[self._call()] = row

    def getValue(self, key):
        return self.rows.get(self._call(key))

    def containsKey(self, key):
        return self._call(key) in self.rows

    def updateValue(self, key, row):
        self.rows[self._call(key)] = row

    def removeKey(self, key):
        del self.rows[self._call(key)]


class StandInHandle:
    calls, stream = 0, None

    def getValueState(self, *_):
        return StandInState(self)

    def getMapState(self, *_):
        return StandInState(self)


def test_stream_states_are_asked_for_by_pages():
    """Batches of all sizes give the changes of one pass; the store is asked by pages, not by runs and cells."""
    rng, handle, states = random.Random(10), StandInHandle(), streaming_runs.RunStates()
    states.init(handle)
    streams = {name: [(f"r{r}", *rest) for r, *rest in random_events(rng, 9000)] for name in ("a", "b")}
    got, low = {"a": [], "b": []}, 0
    for size in (1, 0, 2, 3000, 7, 4000, 1, 1989):
        for name, rows in streams.items():
            handle.stream, part = name, rows[low : low + size]
            if part:
                rng.shuffle(part)
                frames = [pd.DataFrame(part[k : k + 1000], columns=["request_id", "generation", "seq", "kind", "baseline", "experiment"]) for k in range(0, size, 1000)]
                got[name] += [tuple(None if pd.isna(v) else v for v in r) for f in states.handleInputRows((name,), iter(frames), None) for r in f.itertuples(index=False, name=None)]
        low += size
    for name, rows in streams.items():
        stream = runs.Stream()
        assert got[name] == [(name, r.request, r.generation, r.baseline, r.experiment, r.seq, r.status, r.before, e[2]) for e in rows for r in stream.step(*e)]
    assert handle.calls < 0.05 * 18000


def test_pages_stay_small_and_are_read_once():
    rng, store, plain, n, entries = random.Random(11), {}, {}, 0, 0
    for size in (0, 1, 5000, 30, 400, 3000, 1):
        read = []
        pages = runs.HashedPages(lambda k, read=read: read.append(k) or dict(store[k]), tuple, n, entries)
        for _ in range(size):
            key, value = rng.choice([None, "", "\ud800", *(f"r{k}" for k in range(60))]) if rng.random() < 0.1 else f"r{rng.randrange(9000)}", rng.choice([None, (1,), (2,)])
            assert pages.get(key) == plain.get(key)
            pages.put(key, value)
            plain[key] = value
        store.update((k, dict(page)) for k, page in pages.written().items() if k < pages.n)
        n, entries = pages.n, pages.entries
        assert {k: v for page in store.values() for k, v in page.items()} == {k: v for k, v in plain.items() if v is not None}
        assert len(read) == len(set(read)) and set(store) == set(range(n)) and entries == sum(map(len, store.values()))
    assert n > 10 and max(map(len, store.values())) < 4 * runs.Pages.SIZE


def test_axis_and_scope(spark):
    df = spark.createDataFrame([(0, "3"), (1, "1"), (2, None), (3, "20")], "row_ordinal long, a string")
    got = results.axis_order(df, "a").orderBy("position").collect()
    assert [r["row_ordinal"] for r in got] == [1, 0, 3, 2]
    assert [r["row_ordinal"] for r in results.scope_window(results.axis_order(df, "a"), 9, 1.6).orderBy("position").collect()] == [3, 2]


def test_scenarios(spark):
    base = spark.createDataFrame([(0, 1.0), (1, 2.0)], "row_ordinal long, x double")
    out = results.derive_scenario(base, [{"column": "x", "kind": "factor", "value": 3.0, "start": 1}])
    assert [r["x"] for r in out.orderBy("row_ordinal").collect()] == [1.0, 6.0]
    assert code(results.derive_scenario, base, [{"column": "x", "kind": "grow", "value": 1}]) == "INVALID_DATA"


# --- catalog


def test_digest_follows_rows_and_order(spark, hourly):
    d = catalog.logical_digest(hourly, ["source_row_id"], block=10, fan=4)
    assert d == catalog.logical_digest(hourly.repartition(7), ["source_row_id"], block=10, fan=4)
    assert d != catalog.logical_digest(hourly, [F.col("source_row_id").desc()], block=10, fan=4)
    assert d != catalog.logical_digest(hourly.where("hour_utc < 23"), ["source_row_id"], block=10, fan=4)


def test_snapshots_are_immutable(spark, tmp_path):
    root = str(tmp_path / "s")
    sid = catalog.save_snapshot(spark.range(5), root, "a", "csv", ["id"], snapshot="one")
    assert catalog.save_snapshot(spark.range(5), root, "a", "csv", ["id"], snapshot="one") == sid
    assert code(catalog.save_snapshot, spark.range(6), root, "a", "csv", ["id"], snapshot="one") == "SNAPSHOT_CORRUPT"
    assert catalog.snapshots(spark, root).count() == 1
    assert catalog.read_snapshot(spark, root, "one", verify=True).count() == 5


def test_experiments(spark):
    known = spark.createDataFrame([("a", 1, "x")], "id string, revision long, body string")
    assert catalog.save_experiments(known, known).count() == 0
    assert code(catalog.save_experiments, known, known.withColumn("body", F.lit("y"))) == "SNAPSHOT_CORRUPT"


def test_restore(spark):
    e = spark.createDataFrame([("a", ["1", "2"]), ("b", ["3"]), ("c", []), ("d", ["1"])], "id string, snapshots array<string>")
    reg = spark.createDataFrame([("1",), ("2",)], "snapshot_id string")
    bad = spark.createDataFrame([("2",)], "snapshot_id string")
    got = {r["id"]: (r["status"], r["missing"]) for r in catalog.restore_check(e, reg, bad).collect()}
    assert got == {"a": ("needs-data", ["2"]), "b": ("needs-data", ["3"]), "c": ("corrupt", []), "d": ("restored", [])}
    wanted = spark.createDataFrame([("d",), ("z",)], "id string")
    assert {r["id"]: r["status"] for r in catalog.restore_check(e, reg, bad, wanted).collect()} == {"d": "restored", "z": "missing"}


def test_tables_that_differ(spark):
    a = spark.createDataFrame([(0, 1.0, "x"), (1, 2.0, None)], "row_ordinal long, v double, s string")
    b = spark.createDataFrame([(0, 1.0 + 1e-9, "x"), (1, 2.1, None), (2, 0.0, "z")], "row_ordinal long, v double, s string")
    assert {(r["row_ordinal"], r["column"]) for r in recon.diff_tables(a, b).collect()} == {(1, "v"), (2, "<row>")}
    assert code(recon.diff_tables, a, b.drop("s")) == "SCHEMA_MISMATCH"


# --- what large values, zones, names and paths must not change


def test_integers_beyond_doubles_differ(spark):
    a, b = (spark.createDataFrame([(0, 2**53 + k, Decimal(2**53 + k))], "row_ordinal long, v long, m decimal(38,3)") for k in (0, 1))
    assert catalog.logical_digest(a, ["row_ordinal"]) != catalog.logical_digest(b, ["row_ordinal"])
    assert {r["column"] for r in recon.diff_tables(a, b).collect()} == {"v", "m"}
    kinds = ("v long", "v double", "v decimal(20,4)", "v int", "v float")
    same = [catalog.logical_digest(spark.createDataFrame([(Decimal(7) if "dec" in k else float(7) if "do" in k or "fl" in k else 7,)], k), ["v"]) for k in kinds]
    assert len(set(same)) == 1


def test_digests_do_not_depend_on_the_zone(spark):
    df = spark.sql("SELECT 1 AS k, timestamp_micros(1700000000123456) AS t, timestamp_ntz'2024-03-10 02:30:00' AS n")
    found, cells = set(), set()
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        found.add(catalog.logical_digest(df, ["k"]))
        cells.add(tuple(recon.normalize_cells(df).first()))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert len(found) == 1 and cells == {(1, "2023-11-14T22:13:20.123Z", "2024-03-10T02:30:00.000Z")}


def test_cutoffs_with_an_offset(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-09 23:00:00' AS t UNION ALL SELECT timestamp_ntz'2024-01-09 21:00:00'")
    train, test = dataset.time_split(df, "t", "2024-01-10T00:00:00+02:00")
    assert (train.count(), test.count()) == (1, 1)


def test_roles_by_pattern(spark):
    df = spark.createDataFrame([(1, 1, 1, 1.0, 2.0, "2024")], "user_id long, slot_ordinal long, idx long, load double, y double, reading_timestamp string")
    assert dataset.column_roles(df, df, "y") == {"features": ["idx", "load"], "target": "y", "time": "reading_timestamp"}


def test_request_ids_are_text(spark, tmp_path):
    root = str(tmp_path / "r")
    for k, request in enumerate(("7", "007", "a-b", "2024-01-01")):
        rows = make_results(spark, [(0, float(k), 0.0, 9.0)]).withColumns({c: F.lit("x") for c in ("input_snapshot_id", "business_key", "scenario_id", "context_id")})
        writers.register_results(rows, root, request, 1)
    got = {r["request_id"]: r["mean"] for r in writers.all_results(spark, root).collect()}
    assert got == {"7": 0.0, "007": 1.0, "a-b": 2.0, "2024-01-01": 3.0}
    assert spark.table("predictions_a_b").first()["mean"] == 2.0


def test_csv_files_of_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    assert code(readers.read_csv, spark, str(tmp_path)) == "SCHEMA_MISMATCH"
    (tmp_path / "b.csv").write_text("x,y\n3,4\n")
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path)).collect()) == [(1.0, 2.0), (3.0, 4.0)]


def test_synthetic_ids_keep_their_digits(spark):
    got = [r[0] for r in readers.synthetic_hourly(spark.range(99_999, 100_002), "id").select("source_row_id").collect()]
    assert got == ["row-99999", "row-100000", "row-100001"]


def test_functions_that_run_code(spark):
    for sql in ("SELECT reflect('java.lang.System', 'getProperty', 'x')", "SELECT 1 WHERE java_method('java.lang.Math', 'abs', 1) = 1", "WITH a AS (SELECT try_reflect('a', 'b') AS x) SELECT * FROM a", "SELECT (SELECT reflect('a', 'b'))"):
        assert code(check_readonly, spark, sql) == "INVALID_QUERY"
    check_readonly(spark, "SELECT upper('a'), count(*) OVER () FROM range(3)")


def test_files_in_pieces(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc" * 1000)
    whole, parts = (catalog.raw_digest(spark, f"{tmp_path}/*.bin", whole=w).first() for w in (1 << 20, 10))
    assert whole == parts and whole["sha256"] == hashlib.sha256(b"abc" * 1000).hexdigest()


def test_secrets_in_nested_parameters(spark):
    df = spark.createDataFrame([({"a": {"token": "1", "b": "2"}, "Secret": {}},)], "p map<string,map<string,string>>")
    assert df.select(catalog.strip_credentials(F.col("p"), df.schema["p"].dataType).alias("p")).first()["p"] == {"a": {"b": "2"}}


def test_index_within_a_large_group(spark):
    df = spark.range(1000).select((F.col("id") % 7 == 0).cast("int").alias("g"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(1).alias("h"), "id")
    got = index_within(df, ["g", "h"], ["id"], "k", parts=5).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["id"]):
        assert r["k"] == seen.get((r["g"], r["h"]), 0)
        seen[r["g"], r["h"]] = r["k"] + 1
    assert len(got) == 1000


def test_fit_with_the_fingerprint_by_hand(spark):
    rows = [(k, float(k % 5), float(k * k % 11), 3.0 * (k % 5) + k % 3) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    state = prep.fit_preprocessing(df, ["a", "b"], "y", "id", shift=1)
    fp = prep.row_fingerprint_distinct(df, ["a", "b"], 400, "id").orderBy("id").collect()
    x = np.array([[r[2], r[1], f[prep.FINGERPRINT]] for r, f in zip([(r[0], r[1], r[2]) for r in rows], fp, strict=True)])
    y = np.array([r[3] for r in rows])
    t = (y - state.target[0]) / state.target[1]
    by = dict(zip(("b", "a", prep.FINGERPRINT), x.T, strict=True))
    assert set(state.used) == set(by) and state.salt == 400
    for c, v in by.items():
        z = (v - v.mean()) / v.std()
        assert state.scales[c] == pytest.approx((v.mean(), v.std())) and state.weights[c] == pytest.approx((z * t).sum() / (z * z).sum(), abs=1e-6)


def test_distributions_without_mass_are_refused(spark):
    rows = [([0.0, 1.0],), ([float("-inf"), 0.0],)]
    assert dist.require_distribution(spark.createDataFrame(rows, "e array<double>"), "e", 2).count() == 2
    for bad in ([float("-inf")] * 2, [float("nan"), 0.0], [1.0], None):
        assert code(dist.require_distribution, spark.createDataFrame([*rows, (bad,)], "e array<double>"), "e", 2) == "RESULT_INVALID"


def plain_csv(text):
    """Records as a reader of one character at a time sees them: a quote toggles, a break outside ends a record."""
    out, record, cell, quoted, ever = [], [], "", False, False

    def close():
        nonlocal record, cell, ever
        record.append((None if cell == "\\N" or cell == "" and not ever else cell, ever, cell))
        cell, ever = "", False

    i = 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            else:
                quoted, ever = not quoted, True
        elif c == "," and not quoted:
            close()
        elif c in "\r\n" and not quoted:
            close()
            out.append(record)
            record = []
        else:
            cell += c
        i += 1
    if cell or record or ever:
        close()
        out.append(record)
    return [[x[0] for x in r] for r in out if any(x[2] or x[1] for x in r)]


def test_csv_line_breaks_in_cells_over_many_ranges(spark, tmp_path):
    rng = random.Random(6)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for trial, size in enumerate((80, 5000)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            folder, want = tmp_path / f"t{trial}", []
            folder.mkdir()
            for f in range(2):
                rows = [[str(k), "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", "\r", " "]) for _ in range(rng.choice([0, 1, 5, 150]))), rng.choice(["", "x", "\\N"])] for k in range(15)]
                end = rng.choice(["\n", "\r\n"])
                cells = lambda r: ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if k == 1 or c == "" and rng.random() < 0.5 else c for k, c in enumerate(r))
                lines = ['id,"no\nte",tag', *[cells(r) for r in rows]]
                lines.insert(7, rng.choice(["", ",,"]))
                text = end.join(lines) + rng.choice(["", end])
                (folder / f"{f}.csv").write_bytes((rng.choice(["", "\ufeff"]) + text).encode())
                want += [r for r in plain_csv(text)[1:]]
            got = readers.read_csv(spark, str(folder), infer=False)
            assert got.columns == ["id", "no\nte", "tag"]
            assert sorted(map(repr, ([*r] for r in got.collect()))) == sorted(map(repr, want))
            if size < 5000:
                assert got.rdd.getNumPartitions() > 3
        (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
        assert code(readers.read_csv, spark, str(tmp_path / "open.csv")) == "INVALID_FORMAT"
        (tmp_path / "ragged.csv").write_text('a,b\n1,"x\n"\n2\n')
        assert code(readers.read_csv, spark, str(tmp_path / "ragged.csv")) == "INVALID_FORMAT"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_digest_trees_name_the_blocks_that_differ(spark):
    rows = spark.range(1000).select(F.col("id").alias("__ordinal"), (F.col("id") * 7).alias("v"))
    tree = catalog.digest_tree(rows, ordinal="__ordinal", block=10, fan=3)
    assert {r["level"]: r["count"] for r in tree.groupBy("level").count().collect()} == {0: 100, 1: 34, 2: 12, 3: 4, 4: 2}
    assert catalog.root_digest(tree, ["v"]) == catalog.logical_digest(rows, ordinal="__ordinal", block=10, fan=3)
    for odd, last, want in (([55, 56, 731], 1000, {5: "changed", 73: "changed"}), ([], 1000, {}), ([3], 985, {0: "changed", 98: "changed", 99: "missing"}), ([], 1004, {100: "extra"})):
        longer = spark.range(last).select(F.col("id").alias("__ordinal"), F.when(F.col("id").isin(odd or [-1]), 0).otherwise(F.col("id") * 7).alias("v"))
        found = catalog.changed_blocks(catalog.digest_tree(longer, ordinal="__ordinal", block=10, fan=3), tree, fan=3)
        assert {r["block"]: r["fault"] for r in found.collect()} == want


def test_only_differing_segments_are_read(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    df = spark.range(4000).select("id", (F.col("id") * 3).alias("v"))
    a = catalog.save_snapshot(df, root, "t", "parquet", ["id"], block=20, segment=100)
    b = catalog.save_snapshot(df.withColumn("v", F.when(F.col("id").isin(1777, 3001), -1).otherwise(F.col("v"))), root, "t", "parquet", ["id"], block=20, segment=100)
    assert sorted((r["__ordinal"], r["column"]) for r in catalog.diff_snapshots(spark, root, a, b).collect()) == [(1777, "v"), (3001, "v")]
    blocks = catalog.changed_blocks(*(catalog.snapshot_tree(spark, root, s) for s in (a, b))).select("block")
    assert sorted(r["block"] for r in blocks.collect()) == [88, 150]
    part = catalog.snapshot_blocks(spark, root, a, storage.stored(blocks, "blocks"))
    assert part.count() == 40
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*IN \((17,30|30,17)\)", plan)


def test_versions_are_claimed_once(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert storage.claim(spark, f"{root}/claims/a/1") and not storage.claim(spark, f"{root}/claims/a/1")
    catalog.save_snapshot(spark.range(3), root, "a", "csv", ["id"])  # another writer has claimed version 1
    assert [r["version"] for r in catalog.snapshots(spark, root).collect()] == [2]


def test_sign_of_zero_counts_in_digests(spark):
    of = lambda v: catalog.logical_digest(spark.createDataFrame([(v,)], "v float"), ["v"])
    assert of(-0.0) != of(0.0) == catalog.logical_digest(spark.createDataFrame([(0,)], "v int"), ["v"])


def test_cells_of_other_kinds_differ(spark):
    make = lambda v, kind: spark.createDataFrame([(0, v), (1, None)], f"row_ordinal long, v {kind}")
    diff = lambda a, b: [r["row_ordinal"] for r in recon.diff_tables(a, b).collect()]
    assert diff(make("1", "string"), make(1, "long")) == [0] == diff(make(True, "boolean"), make("true", "string"))
    assert diff(make(1.0, "double"), make(1, "long")) == []
    twice = make(1, "long").union(make(2, "long"))
    assert code(recon.diff_tables, twice, make(1, "long")) == code(recon.diff_tables, make(1, "long"), twice) == "INVALID_DATA"


RUNS_CODE = ("reflect('java.lang.Math', 'abs', -1)", "java_method('java.lang.Math', 'abs', -1)", "try_reflect('java.lang.Math', 'abs', -1)", "IDENTIFIER('reflect')('java.lang.Math', 'abs', -1)", "IDENTIFIER('re' || 'flect')('java.lang.Math', 'abs', -1)", "mine(1)", "IDENTIFIER('mine')(1)")
PLACES = (
    "SELECT {}", "VALUES ({})", "SELECT id FROM v WHERE {} IS NOT NULL", "SELECT (SELECT {})", "SELECT id FROM v WHERE EXISTS (SELECT {})", "SELECT id FROM v WHERE id IN (SELECT {})", "WITH c AS (SELECT {} AS x) SELECT * FROM c",
    "SELECT count({}) FROM v", "SELECT id FROM v ORDER BY {}", "SELECT count(*) FROM v GROUP BY {}", "SELECT id FROM v GROUP BY id HAVING max({}) IS NOT NULL", "SELECT max(id) OVER (PARTITION BY {}) FROM v", "SELECT transform(array(1), x -> {})", "SELECT * FROM v JOIN v AS w ON v.id = w.id AND {} IS NOT NULL",
    "SELECT id FROM v UNION ALL SELECT {}", "SELECT * FROM v, LATERAL (SELECT {})", "SELECT explode(array({})) FROM v", "SELECT coalesce(NULL, CASE WHEN true THEN {} END)", "SELECT id FROM v LIMIT length(CAST({} AS string))", "SELECT named_struct('a', array({}))", "SELECT /* x */ ({})",
)


@pytest.mark.parametrize("place", PLACES)
def test_code_is_refused_in_every_place(spark, place):
    spark.range(3).createOrReplaceTempView("v")
    spark.udf.register("mine", lambda x: x, "int")
    for call in RUNS_CODE:
        for inner in (call, f"abs({call})", f"(SELECT max(x) FROM (SELECT {call} AS x))"):
            assert code(query, spark, place.format(inner)) == "INVALID_QUERY"


@pytest.mark.parametrize("sql", [
    "SELECT * FROM IDENTIFIER('v')", "SELECT * FROM IDENTIFIER('range')(3)", "SELECT * FROM stored_table", "SELECT * FROM spark_catalog.default.stored_table", "SELECT * FROM read_files('/tmp')", "SELECT TRANSFORM(id) USING 'cat' FROM v", "SELECT * FROM stored_view",
])
def test_only_registered_views_are_read(spark, sql):
    spark.range(3).createOrReplaceTempView("v")
    spark.sql("CREATE TABLE IF NOT EXISTS stored_table USING parquet AS SELECT 1 AS id")
    spark.sql("CREATE OR REPLACE VIEW stored_view AS SELECT id FROM stored_table")
    assert code(query, spark, sql) == "INVALID_QUERY"


@pytest.mark.parametrize("sql", [
    "SELECT k, count(*) AS n, avg(id), sum(DISTINCT id) FILTER (WHERE id > 2) FROM v GROUP BY k HAVING count(*) > 1 ORDER BY n DESC LIMIT 2",
    "WITH c AS (SELECT * FROM v) SELECT transform(a, x -> x + 1), aggregate(a, 0L, (p, x) -> p + x), s.x, a[0] FROM c WHERE EXISTS (SELECT 1 FROM v WHERE v.id = c.id) AND id IN (SELECT id FROM v) AND id NOT IN (1, 2) AND t LIKE '1%'",
    "SELECT row_number() OVER (PARTITION BY k ORDER BY id), sum(id) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), lag(id) OVER (ORDER BY id), (SELECT max(id) FROM v) FROM v", "VALUES (1, 'a'), (2, 'b')", "TABLE v", "SELECT * FROM v JOIN v AS w USING (id) CROSS JOIN range(3)",
    "SELECT CASE WHEN id > 1 THEN 1 ELSE 2 END, CAST(t AS int), try_cast(t AS int), nvl(t, 'x'), date_trunc('day', ts), extract(year FROM ts), ts + interval 1 day, ts - ts, id || t, map('a', 1)['a'], id BETWEEN 1 AND 2, -id, id / 2, id % 2 FROM v",
    "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY id), listagg(t, ',') WITHIN GROUP (ORDER BY t), max_by(t, id), count_if(id > 1) FROM v", "SELECT explode(a) FROM v", "SELECT * FROM v LATERAL VIEW explode(a) AS e", "SELECT * FROM v, LATERAL (SELECT v.id + 1 AS z)", "SELECT k, grouping(k), count(*) FROM v GROUP BY ROLLUP (k)",
    "SELECT * FROM (SELECT k, id FROM v) PIVOT (sum(id) FOR k IN (1, 2))", "SELECT id FROM v UNION ALL SELECT id FROM v EXCEPT SELECT 3 INTERSECT SELECT 4", "SELECT * EXCEPT (id) FROM v", "SELECT DISTINCT k FROM v", "SELECT to_json(s), date_format(ts, 'y'), split(t, ','), regexp_replace(t, 'a', 'b'), array_sort(a), to_date('2024-01-01') + 1 FROM v",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT n FROM r",
])
def test_reading_statements_are_not_refused(spark, sql):
    spark.range(10).selectExpr("id", "id % 3 AS k", "array(id, 2) AS a", "named_struct('x', id) AS s", "cast(id AS string) AS t", "timestamp'2024-01-01' AS ts").createOrReplaceTempView("v")
    query(spark, sql).collect()


def test_running_values_over_many_partitions(spark):
    rng = random.Random(11)
    rows = [(k, rng.choice([None, rng.randrange(100)]), rng.random() < 0.5) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, v long, b boolean").repartition(5)
    x = Ordered(df, ["k"], parts=13).index("i").running("s", F.col("v")).running("lo", F.col("v"), "min").running("hi", F.col("v"), "max").running("known", F.col("v"), "last").previous("was", F.col("b"))
    seen, want = [], []
    for k, v, b in rows:
        seen += [] if v is None else [v]
        want.append((k, k, sum(seen) if seen else None, min(seen, default=None), max(seen, default=None), seen[-1] if seen else None, rows[k - 1][2] if k else None))
    assert [tuple(r[c] for c in ("k", "i", "s", "lo", "hi", "known", "was")) for r in x.rows().orderBy("k").collect()] == want
    assert Ordered(df.limit(0), ["k"]).running("s", F.col("v")).rows().count() == 0


def test_axis_blanks_and_scope_halves(spark):
    df = spark.createDataFrame([(0, "10"), (1, "9"), (2, ""), (3, None), (4, "Infinity"), (5, " 8 ")], "row_ordinal long, a string")
    got = results.axis_order(df, "a").orderBy("position")
    assert [r["row_ordinal"] for r in got.collect()] == [5, 1, 0, 2, 3, 4]
    floats = spark.createDataFrame([(0, float("nan")), (1, 2.0), (2, float("inf")), (3, 1.0)], "row_ordinal long, a double")
    assert [r["row_ordinal"] for r in results.axis_order(floats, "a").orderBy("position").collect()] == [3, 1, 0, 2]
    of = lambda *a: [r["position"] for r in results.scope_window(got, *a).orderBy("position").collect()]
    assert of(0.5, 2.5) == [1, 2, 3] and of(-0.5, 0.49) == [0] and of(None, float("nan")) == [0, 1, 2, 3, 4, 5] and of(99, 4) == [4, 5]


def test_models_are_fitted_by_merged_states(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    y = x @ [1.0, -2.0, 0.5] + 4 + rng.normal(size=500) * 0.01
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)] + [(0.0, 0.0, 0.0, None)], "a double, b double, c double, t double")
    model = scorer.Ridge(0.5)
    whole = model.finish(model.add(model.start(3), x, y))
    z = x - x.mean(0)
    assert np.allclose(whole["slope"], np.linalg.solve(z.T @ z + 0.5 * np.eye(3), z.T @ (y - y.mean())))
    for parts in (1, 7, 40):
        got = scorer.fit_model(model, df.repartition(parts), ["a", "b", "c"], "t", fan=3)
        assert np.allclose(got["slope"], whole["slope"]) and np.isclose(got["bias"], whole["bias"])
    assert code(scorer.fit_model, model, df.limit(0), ["a", "b", "c"], "t") == "EMPTY_INPUT"


def test_contexts_are_kept_by_id(spark, tmp_path):
    df, path = spark.createDataFrame([(float(k), 2.0 * k) for k in range(10)], "a double, t double"), f"file://{tmp_path}/c"
    first, reused = scorer.fit_context(spark, path, "one", "ridge", scorer.Ridge(), df, ["a"], "t")
    again, reused_then = scorer.fit_context(spark, path, "one", "ridge", scorer.Ridge(), df.limit(0), ["a"], "t")
    assert (reused, reused_then) == (False, True) and np.array_equal(first["slope"], again["slope"])
    assert scorer.import_context(spark, path, "two", "ridge", ["a"]) is None
    assert code(scorer.import_context, spark, path, "one", "forest", ["a"]) == code(scorer.import_context, spark, path, "one", "ridge", ["b"]) == "CONTEXT_INCOMPATIBLE"


def test_odd_distributions_give_null(spark):
    inf = math.inf
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [1.0]), (4, []), (5, [-inf, -inf]), (6, [1.0, math.nan]), (7, [inf, 0.0]), (8, [0.0, -inf]), (9, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "k long, x array<double>").coalesce(1)
    good = {r["k"] for r in df.where(dist.softmax(F.col("x")).isNotNull()).collect()}
    assert good == {0, 3, 8, 9}  # of any length
    for f in (dist.decode_mean(F.col("x"), [0.0, 1.0], logits=True), dist.decode_quantiles(F.col("x"), [0.0, 1.0, 2.0], logits=True), dist.rebin(F.col("x"), [0.0, 1.0, 2.0], [0.0, 2.0], logits=True)):
        got = {r["k"]: r["v"] for r in df.select("k", f.alias("v")).collect()}
        assert {k for k, v in got.items() if v is not None} == {0, 8, 9}
    mean = {r["k"]: r["v"] for r in df.select("k", dist.decode_mean(F.col("x"), [0.0, 1.0], 10.0, 2.0, logits=True, temperature=2.0).alias("v")).collect()}
    assert math.isclose(mean[0], 10 + 2 / (1 + math.exp(-0.5))) and mean[8] == 10
    plain = {r["k"]: r["v"] for r in df.select("k", dist.decode_mean(F.col("x"), [1.0, 3.0]).alias("v")).collect()}
    assert {k for k, v in plain.items() if v is not None} == {0, 9} and plain[0] == 7.0
    assert df.limit(0).select(dist.decode_mean(F.col("x"), [0.0, 1.0])).collect() == []


def test_default_borders():
    b = dist.default_borders(5000)
    assert (b[0], b[5], b[2500], b[4980], b[5000]) == (-128, -16.9, 0, 13, 128) and np.allclose(b, -b[::-1]) and (np.diff(b) > 0).all()


def test_arrow_batches_columns_and_bounds(spark, tmp_path):
    path = str(tmp_path / "x")
    df = spark.range(5000).select("id", (F.col("id") * 0.5).alias("half"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"), F.when(F.col("id") < 4000, None).otherwise(1).alias("late"))
    write_arrow_ipc(df.coalesce(1), path, rows=100)
    file = arrow_ipc._infos(path)[0].path
    x = read_arrow_ipc(spark, path)
    assert x.rdd.getNumPartitions() == 7 and x.count() == 5000
    assert read_arrow_ipc(spark, path, columns=["name"]).columns == ["name"]
    of = lambda *f: [k for p in arrow_ipc._partitions(path, [file], f) for k in p.numbers]
    assert of(("id", "=", 250)) == [2] and of(("half", ">", 2449.5)) == [49] and of(("half", ">", 2499.5)) == []
    assert of(("name", "in", ("n00001", "n04999", "zz"))) == [0, 49] and of(("late", "known", None)) == list(range(40, 50))
    assert of(("id", "<", 100), ("half", "<=", 10)) == [0] and of(("id", "=", "x")) == list(range(50)) and of(("id", "=", None)) == []
    y = read_arrow_ipc(spark, path, where=[("id", ">", 4750), ("name", "<", "n04753")])
    assert [r["id"] for r in y.collect()] == [4751, 4752] and y.rdd.getNumPartitions() == 1
    assert read_arrow_ipc(spark, path, where=[("id", "<", 0)]).count() == 0
    assert y.union(x.where("id < 3")).count() == 5
    assert code(read_arrow_ipc, spark, path, where=[("id", "~", 1)]) == "INVALID_QUERY"
    odd = spark.createDataFrame([(float("nan"), "x" * 100), (1.0, None)], "v double, t string")
    write_arrow_ipc(odd.coalesce(1), str(tmp_path / "odd"))
    assert read_arrow_ipc(spark, str(tmp_path / "odd"), where=[("v", ">", 5)]).count() == 1  # NaN is greater


def packed(values, salt):
    """The fingerprint as its definition reads: little-endian floats and salt, SHA-256, the last eight bytes as a share of 2^64 - 1."""
    rounded = [math.nan if math.isinf(v) or math.isnan(v) else np.float32(np.round(np.float64(np.float32(v)) / 1e-12) * 1e-12) for v in values]
    body = b"".join(b"\x00\x00\xc0\x7f" if math.isnan(v) else struct.pack("<f", v) for v in rounded) + struct.pack("<q", salt)
    return np.float32(int.from_bytes(hashlib.sha256(body).digest()[-8:], "big") / (2**64 - 1))


def test_fingerprints_of_a_table_by_their_definition(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 7).cast("double").alias("k"))
    odd = spark.createDataFrame([(-1, float("nan"), 1.0), (-2, float("inf"), None), (-3, -0.0, 1e-30)], o.schema)
    x = o.union(odd)
    got = {r["o_orderkey"]: (r["o_totalprice"], r["k"], r["fp"]) for r in prep.row_fingerprint(x, ["o_totalprice", "k"], 30, "fp").collect()}
    assert len(got) == x.count()
    for price, k, fp in got.values():
        assert np.float32(fp) == packed([price, math.nan if k is None else k], 30)
    rows = prep.row_fingerprint_distinct(x, ["k"], 30, "o_orderkey", "fp").orderBy("o_orderkey").collect()
    seen = Counter()
    for r in rows:
        key = "nan" if r["k"] is None else np.float32(r["k"])
        assert np.float32(r["fp"]) == packed([math.nan if r["k"] is None else r["k"]], 30 + seen[key])
        seen[key] += 1
    assert max(seen.values()) > 100


def test_frozen_inputs(spark, tmp_path):
    root = f"file://{tmp_path}/f"
    spark.range(5).createOrReplaceTempView("five")
    freeze = lambda sql="SELECT id FROM five", **k: inputs.freeze_query(spark, root, sql, order=["id"], **({"source_snapshot": "s", "revision": 0} | k))
    one = freeze()
    assert freeze() == one == freeze("SELECT id FROM five WHERE id >= 0") and inputs.provenance(spark, root).count() == 2
    assert [r["row_ordinal"] for r in inputs.input_rows(spark, root, one).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    assert code(freeze, source_snapshot=" ") == code(freeze, revision=-1) == code(freeze, revision=True) == code(freeze, "DROP TABLE x") == "INVALID_QUERY"
    assert code(inputs.input_rows, spark, root, "none") == "SNAPSHOT_CORRUPT"
    made = inputs.materialize_input(spark, root, "SELECT id, id * 2 AS x FROM five WHERE id > ?", [1], ["x"], None, ["id"], ["id"])
    assert inputs.input_rows(spark, root, made).columns == ["id", "x", "row_ordinal"]
    assert inputs.provenance(spark, root).where(F.col("snapshot_id") == made).first()["kind"] == "prediction"


def test_upserts_are_fenced_by_batch(spark, tmp_path):
    root, rng, want = f"file://{tmp_path}/u", random.Random(12), {}
    batches = [[(f"k{rng.randrange(30)}", rng.randrange(1000), b * 100 + n) for n in range(20)] for b in range(4)]
    make = lambda rows: spark.createDataFrame(rows, "k string, g long, v long")
    assert upsert.upserted(spark, root) is None
    for b, rows in enumerate(batches):
        upsert.upsert_batch(make(rows), b, root, ["k"], ["g", "v"], buckets=5)
        if b == 2:  # a run that broke off before the commit: the batch comes again
            (tmp_path / "u" / "commits" / "2").unlink()
            assert {r["k"]: r["v"] for r in upsert.upserted(spark, root).collect()} == want
            upsert.upsert_batch(make(rows), b, root, ["k"], ["g", "v"], buckets=5)
        upsert.upsert_batch(make([("k1", 10**6, -1)]), b, root, ["k"], ["g", "v"], buckets=5)  # committed: left out
        best = {}
        for k, g, v in [r for part in batches[: b + 1] for r in part]:
            best[k] = max(best.get(k, (-1, -1)), (g, v))
        want = {k: v for k, (_, v) in best.items()}
        assert {r["k"]: r["v"] for r in upsert.upserted(spark, root).collect()} == want


def test_json_documents_over_many_ranges(spark, tmp_path):
    rng = random.Random(14)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        for trial, size in enumerate((120, 100_000)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            folder, want = tmp_path / f"t{trial}", []
            folder.mkdir()
            for f in range(2):
                word = lambda: "".join(rng.choice(["a", "é", '"', "\\", "}", "{", "]", "[", ":", ",", "\n", " "]) for _ in range(rng.choice([0, 2, 9, 60])))
                rows = [{"id": k + 100 * f, "t": word(), 'k"{': word()} for k in range(12)]
                doc = {"rows": [{"id": -1}], "meta": {"data": {"rows": [{"id": -2, "x": [{}]}]}, "t": word()}, "data": {"a": [{"rows": []}], "rows": rows, "z": {"rows": [{}]}}, "end": [word(), {"data": 1}]}
                (folder / f"{f}.json").write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"]), encoding="utf-8")
                want += rows
            got = readers.read_json_rows(spark, str(folder), "$.data.rows")
            assert sorted((r["id"], r["t"], r['k"{']) for r in got.collect()) == sorted((r["id"], r["t"], r['k"{']) for r in want)
            if size < 1000:
                assert json_records.chunks(spark, str(folder)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("doc,where,want", [
    ('[{"a": 1}, {"a": 2}]', "$", None), ('[{"a": 1}, 2]', "$", "INVALID_FORMAT"), ('[{"a": 1}, [2]]', "$", "INVALID_FORMAT"), ('[{"a": 1}, "x"]', "$", "INVALID_FORMAT"), ('{"a": 1}', "$", "INVALID_FORMAT"), ('{"a": [{"b": 1}]}', "$.b", "INVALID_FORMAT"),
    ('[{"a": 1}', "$", "INVALID_FORMAT"), ('[{"a": "x}]', "$", "INVALID_FORMAT"), ("[]", "$", "EMPTY_INPUT"), ('[{"a": {"b": 1}}]', "$", "TYPE_LOSS"), ('{"a": {"b": [{"c": 1}]}}', "$.a.b", None), ('{"a": [{"b": [{"c": 1}]}]}', "$.a.b", "INVALID_FORMAT"),
])
def test_json_arrays_and_refusals(spark, tmp_path, doc, where, want):
    p = text(tmp_path / "d.json", doc)
    if want:
        assert code(readers.read_json_rows, spark, p, where) == want
    else:
        assert readers.read_json_rows(spark, p, where).count() == doc.count(": 1") - doc.count('": 1,') + doc.count(": 2")


def test_csv_text_is_cut_in_pieces(monkeypatch):
    """A batch of long lines takes little memory beside its own, and its records are the same however small the pieces."""
    lines = [f'{k},"{"x" * 4000}""{"y" * 4000}"' + ("," if k % 3 else ',"a') for k in range(2000)]
    batch = pa.RecordBatch.from_pydict({"value": lines, "file": ["f"] * 2000, "start": pa.array([0] * 2000, pa.int64()), "id": pa.array([1] * 2000, pa.int64())})
    cut = lambda: [b.column("value").to_pylist() for b in csv_records._cutter(np.zeros(0, np.int64))(iter([batch]))]
    tracemalloc.start()
    want = hashlib.sha256()
    for b in csv_records._cutter(np.zeros(0, np.int64))(iter([batch])):
        want.update("\n".join(b.column("value").to_pylist()).encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * batch.nbytes
    batch = batch.slice(0, 40)
    whole = sum(cut(), [])
    for size in (1, 7, 8000, 8011):
        monkeypatch.setattr(csv_records, "PIECE", size)
        assert sum(cut(), []) == whole
    ends = np.array([0, 0, 3, 3, 7, 10])
    for size in (1, 3, 4, 10, 11):
        monkeypatch.setattr(csv_records, "PIECE", size)
        assert b"".join(x.tobytes() for x in csv_records._parts(np.frombuffer(b"abcdefghij", np.uint8), ends)) == b"\n\nabc\n\ndefg\nhij\n"


def _parallel(spark):
    """Shuffles are not put together, however small they are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    return lambda: spark.conf.set(name, before)


def test_no_task_sorts_all_rows_for_arrow_files(spark, monkeypatch):
    found, back = [], _parallel(spark)
    monkeypatch.setattr(storage_queries, "write_arrow_ipc", lambda df, path, **k: (found.append(df.rdd.getNumPartitions()), write_arrow_ipc(df, path, **k)))
    try:
        core.QUERIES["a04_arrow_by_batch"](spark, "/root/testdata/sf0.001")
    finally:
        back()
    assert found[0] > 1


def test_no_task_sorts_a_json_document(spark, monkeypatch):
    found, back, join = [], _parallel(spark), writers.join_files
    monkeypatch.setattr(writers, "join_files", lambda s, folders: (found.extend(sum(n.startswith("part-") for n in storage.file_names(s, f)) for f in folders), join(s, folders)), raising=False)
    try:
        assert core.QUERIES["a02_json_documents"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        back()
    assert len(found) == 2 and min(found) > 1


def test_files_are_joined_in_the_order_of_their_names(spark, tmp_path):
    for f, n in (("a", 12), ("b", 1)):
        (tmp_path / f).mkdir()
        for k in range(n):
            (tmp_path / f / f"part-{k:05d}.txt").write_text(f"{f}{k}\n" * (k + 1))
        (tmp_path / f / "_SUCCESS").write_text("x")
    writers.join_files(spark, {f"file://{tmp_path}/{f}": f"file://{tmp_path}/out/{f}.txt" for f in "ab"})
    for f, n in (("a", 12), ("b", 1)):
        assert (tmp_path / "out" / f"{f}.txt").read_text() == "".join(f"{f}{k}\n" * (k + 1) for k in range(n))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.txt", "b.txt"]


def test_positions_take_no_second_shuffle_of_the_rows(spark):
    x = global_index(spark.range(1000).select(F.hash("id").alias("k"), "id"), ["k", "id"], parts=7)
    assert "row_number" not in x._jdf.queryExecution().executedPlan().toString()
    rows = x.orderBy("row_ordinal").collect()
    assert [r["row_ordinal"] for r in rows] == list(range(1000)) and x.columns == ["k", "id", "row_ordinal"]
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


def test_snapshots_have_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "FOLDERS", 7)
    root, df = f"file://{tmp_path}/s", spark.range(4000).select("id", (F.col("id") * 3).alias("v"))
    a = catalog.save_snapshot(df, root, "t", "parquet", ["id"], block=20, segment=100)
    assert len([n for n in storage.file_names(spark, f"{root}/data/snapshot_id={a}") if n.startswith(catalog.SEGMENT)]) == 7
    more = spark.range(5003).select("id", F.when(F.col("id").isin(17, 3999), -1).otherwise(F.col("id") * 3).alias("v"))
    b = catalog.save_snapshot(more, root, "t", "parquet", ["id"], block=20, segment=100)
    got = sorted((r["__ordinal"], r["column"]) for r in catalog.diff_snapshots(spark, root, b, a).collect())
    assert got == [(17, "v"), (3999, "v"), *((k, "<row>") for k in range(4000, 5003))]
    assert [r["rows"] for r in catalog.snapshots(spark, root).orderBy("version").collect()] == [4000, 5003]
