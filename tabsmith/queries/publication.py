"""Queries of results, runs, scenarios, chart series, reconciliation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import recon, results, runs
from tabsmith.operators.order import global_index
from tabsmith.queries.core import register, table
from tabsmith.queries.matrices import KEY, LINEAR, fitted
from tabsmith.sources.writers import query_results, register_results
from tabsmith.storage import fresh_path, stored
from tabsmith.streaming.runs import PROVIDER, run_state, score_stream
from tabsmith.streaming.upsert import upserted, upserter

PREDICTED = "SELECT o_orderkey AS business_key, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_ordinal, o_totalprice * 1.5 AS mean, o_totalprice AS q25, o_totalprice * 2 AS q75, o_totalprice + o_custkey AS truth, o_orderdate FROM orders"


def predicted(spark, d):
    """Predictions made from orders, a row for each."""
    o = global_index(table(spark, d, "orders"), ["o_orderkey"])
    p = F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("business_key"), "row_ordinal", (p * 1.5).alias("mean"), p.alias("q25"), (p * 2).alias("q75"), (p + F.col("o_custkey")).alias("truth"), "o_orderdate")


def as_results(spark, d):
    return predicted(spark, d).select(F.lit("snap").alias("input_snapshot_id"), "row_ordinal", F.col("business_key").cast("string").alias("business_key"), F.lit("base").alias("scenario_id"), F.lit("ctx").alias("context_id"), "mean", "q25", "q75")


@register("i01_result_faults", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS row_difference, count(*) FILTER (WHERE business_key % 50 = 0 AND row_ordinal > 0) AS repeated, CAST(0 AS BIGINT) AS outside, count(*) FILTER (WHERE business_key % 7 = 0) AS bad_mean, count(*) FILTER (WHERE business_key % 5 = 0) AS half_interval, count(*) FILTER (WHERE business_key % 3 = 0 AND business_key % 5 <> 0 AND q75 > 0) AS bad_interval FROM (" + PREDICTED + ")")
def i01(spark, d):
    k = F.col("business_key")
    x = predicted(spark, d).select(
        "business_key",
        F.when(k % 50 == 0, F.lit(0)).otherwise(F.col("row_ordinal")).alias("row_ordinal"),
        F.when(k % 7 == 0, float("nan")).otherwise(F.col("mean")).alias("mean"),
        F.when(k % 5 != 0, F.col("q25")).alias("q25"),
        F.when((k % 3 == 0) & (k % 5 != 0), -F.col("q75")).otherwise(F.col("q75")).alias("q75"),
    )
    return results.result_faults(x, x.count())


@register("i02_join_by_ordinal", "SELECT row_ordinal, mean, o_custkey FROM (" + PREDICTED + ") JOIN orders ON o_orderkey = business_key")
def i02(spark, d):
    inputs = global_index(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"]).withColumn("input_snapshot_id", F.lit("snap")).drop("o_orderkey")
    return results.join_rows_by_ordinal(as_results(spark, d), inputs).select("row_ordinal", "mean", "o_custkey")


@register("i03_enrich_test_rows", "SELECT row_ordinal, mean, prediction_mean, prediction_q25, q75 FROM (SELECT row_ordinal, truth AS mean, mean AS prediction_mean, q25 AS prediction_q25, q75 FROM (" + PREDICTED + "))")
def i03(spark, d):
    p = stored(predicted(spark, d), "predicted")
    test = p.select("row_ordinal", F.col("truth").alias("mean"), F.lit(1).alias("q25"))
    return results.enrich_test_rows(test, p.select("row_ordinal", "mean", "q25", "q75")).drop("q25")


@register("i04_truth_and_ordinal", "SELECT business_key, truth AS prediction_truth, row_number() OVER (ORDER BY business_key) - 1 AS row_ordinal, 7 AS truth FROM (" + PREDICTED + ")")
def i04(spark, d):
    p = stored(predicted(spark, d), "predicted")
    return results.with_truth_and_ordinal(p.select("business_key", F.lit(7).alias("truth")), p.select("business_key", "truth"), "business_key")


#: The rules of publication as a recursive query: a step is each stream's next event, a row its head, baseline and all its runs. A request is known until
#: it is deleted, and known ones are not reserved again.
STATES = """WITH RECURSIVE raw AS (SELECT event_id AS i, 'r' || event_id AS r, 's' || (user_id % 400) AS stream_id, CASE WHEN event_id % 70 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 1 ELSE event_id + 1 END AS g, event_id % 10 = 0 AS b, event_id % 11 = 0 AS x FROM events),
ev AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM (
  SELECT stream_id, r, g, b, x, i * 10 AS seq, 'reserve' AS kind FROM raw
  UNION ALL SELECT stream_id, r, g, b, x, i * 10 + 1 + (i % 3) * 4000, CASE WHEN (i // 3) % 4 = 2 THEN 'cancel' WHEN (i // 3) % 4 = 3 THEN 'fail' ELSE 'publish' END FROM raw WHERE i % 7 <> 0
  UNION ALL SELECT stream_id, r, g, b, x, i * 10 + 9002, CASE WHEN i % 60 < 20 THEN 'rollback' ELSE 'delete' END FROM raw WHERE i % 20 < 2 AND i % 60 < 40
  UNION ALL SELECT stream_id, r, g, b, x, i * 10 + 9003, 'delete' FROM raw WHERE i % 17 = 5
  UNION ALL SELECT stream_id, r, g + 1200, b, x, i * 10 + 9004, 'reserve' FROM raw WHERE i % 9 = 4)),
st AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS head, CAST(NULL AS VARCHAR) AS base, CAST([] AS STRUCT(r VARCHAR, g BIGINT, b BOOLEAN, x BOOLEAN, s BIGINT, status VARCHAR, p VARCHAR)[]) AS runs FROM ev
UNION ALL SELECT stream_id, n,
  CASE WHEN kind = 'reserve' AND moves THEN g WHEN kind IN ('fail', 'rollback') AND hit THEN list_max([q.g FOR q IN runs IF q.status = 'published' AND NOT q.x AND q.r <> r]) ELSE head END,
  CASE WHEN kind = 'publish' AND hit AND NOT old AND (me.b OR me.g = 0) THEN r
       WHEN kind = 'delete' AND base = r THEN NULL
       WHEN kind = 'rollback' AND hit AND base = r THEN CASE WHEN len([q FOR q IN runs IF q.r = me.p AND q.status = 'published']) > 0 THEN me.p END ELSE base END,
  CASE WHEN kind = 'reserve' THEN list_append(list_transform(runs, lambda q: CASE WHEN moves AND q.status = 'pending' AND q.g < g AND NOT q.b THEN struct_pack(r := q.r, g := q.g, b := q.b, x := q.x, s := q.s, status := 'superseded', p := q.p) ELSE q END),
         struct_pack(r := r, g := g, b := b, x := x, s := seq, status := CASE WHEN refused THEN 'refused' ELSE 'pending' END, p := CAST(NULL AS VARCHAR)))
       WHEN hit THEN list_transform(runs, lambda q: CASE WHEN q.s = me.s THEN struct_pack(r := q.r, g := q.g, b := q.b, x := q.x, s := q.s,
         status := CASE kind WHEN 'publish' THEN CASE WHEN old THEN 'superseded' ELSE 'published' END WHEN 'cancel' THEN 'cancelled' WHEN 'delete' THEN 'deleted' ELSE 'failed' END,
         p := CASE WHEN kind = 'publish' THEN base ELSE q.p END) ELSE q END)
       ELSE runs END
FROM (SELECT *, NOT refused AND NOT x AND (NOT (b OR g = 0) OR head IS NULL) AS moves, me IS NOT NULL AND (kind = 'delete' OR kind = 'rollback' AND me.status = 'published' OR kind IN ('publish', 'cancel', 'fail') AND me.status = 'pending') AS hit,
        NOT me.x AND NOT (me.b OR me.g = 0) AND head IS NOT NULL AND head <> me.g AS old
  FROM (SELECT *, me IS NOT NULL OR NOT x AND NOT (b OR g = 0) AND head IS NOT NULL AND g <= head AS refused
  FROM (SELECT st.stream_id, st.head, st.base, st.runs, ev.n, ev.r, ev.g, ev.b, ev.x, ev.seq, ev.kind,
          list_filter(st.runs, lambda q: q.r = ev.r AND q.status NOT IN ('deleted', 'refused'))[1] AS me
        FROM st JOIN ev ON ev.stream_id = st.stream_id AND ev.n = st.n + 1)))),
last AS (SELECT * FROM st JOIN (SELECT stream_id, max(n) AS n FROM ev GROUP BY 1) USING (stream_id, n)),
states AS (SELECT stream_id, q.r AS request_id, q.g AS generation, q.b AS baseline, q.x AS experiment, q.s AS seq, q.status AS status FROM (SELECT stream_id, unnest(runs) AS q FROM last))"""


def run_events(spark, d):
    """Reservations, their ends, what is undone or deleted, and requests that are reserved again."""
    e, i = table(spark, d, "events"), F.col("event_id")
    gen = F.when(i % 70 == 0, F.lit(0)).when(i % 13 == 0, F.lit(1)).otherwise(i + 1)
    req = F.concat(F.lit("r"), i.cast("string")).alias("request_id")
    stream = F.concat(F.lit("s"), (F.col("user_id") % 400).cast("string")).alias("stream_id")
    turn = F.floor(i / 3) % 4
    end = F.when(turn == 2, "cancel").when(turn == 3, "fail").otherwise("publish")
    undone = F.when(i % 60 < 20, "rollback").otherwise("delete")
    at = lambda seq, kind, g=gen: F.struct(seq.alias("seq"), kind.alias("kind"), g.alias("generation"))
    each = [
        at(i * 10, F.lit("reserve")),
        F.when(i % 7 != 0, at(i * 10 + 1 + (i % 3) * 4000, end)),
        F.when((i % 20 < 2) & (i % 60 < 40), at(i * 10 + 9002, undone)),
        F.when(i % 17 == 5, at(i * 10 + 9003, F.lit("delete"))),
        F.when(i % 9 == 4, at(i * 10 + 9004, F.lit("reserve"), gen + 1200)),
    ]
    out = e.select(req, stream, (i % 10 == 0).alias("baseline"), (i % 11 == 0).alias("experiment"), F.explode(F.array_compact(F.array(*each))).alias("e"))
    return out.select("request_id", "stream_id", "e.generation", "baseline", "experiment", "e.seq", "e.kind")


def states(spark, d):
    return runs.run_states(runs.replayed(run_events(spark, d)))


@register("i05_run_history", STATES + " SELECT stream_id, request_id, generation, seq, status FROM states WHERE stream_id = 's7' AND status NOT IN ('deleted', 'refused')")
def i05(spark, d):
    return results.run_history(states(spark, d), "s7").select("stream_id", "request_id", "generation", "seq", "status")


@register("i06_current_run", STATES + " SELECT stream_id, arg_max(request_id, seq) AS request_id, generation FROM states JOIN last USING (stream_id) WHERE status = 'published' AND generation = head GROUP BY stream_id, generation")
def i06(spark, d):
    changes = stored(runs.replayed(run_events(spark, d)), "changes")
    return results.current_runs(runs.run_states(changes), runs.stream_heads(changes))


@register("i07_baseline_run", STATES + " SELECT stream_id, base AS request_id FROM last WHERE base IS NOT NULL")
def i07(spark, d):
    return results.baseline_runs(runs.stream_heads(runs.replayed(run_events(spark, d))))


@register("i08_supersede", STATES + " SELECT request_id, seq, status FROM states")
def i08(spark, d):
    return states(spark, d).select("request_id", "seq", "status")


@register("i08_resumed_states", STATES + " SELECT request_id, seq, status FROM states")
def i08_resumed(spark, d):
    """The same from states that are stored three times on the way."""
    events = run_events(spark, d)
    last = events.agg(F.max("seq")).first()[0] or 0
    changes, _ = runs.replayed_in_steps(events, [last // 4, last // 2, 3 * last // 4])
    return runs.run_states(changes).select("request_id", "seq", "status")


@register("i09_last_good", STATES + " SELECT stream_id, max(generation) AS generation FROM states WHERE status = 'published' AND NOT experiment GROUP BY stream_id")
def i09(spark, d):
    return results.last_good(states(spark, d))


@register("i10_cancelled_runs", STATES + " SELECT request_id, stream_id FROM states WHERE status = 'cancelled'")
def i10(spark, d):
    return states(spark, d).where("status = 'cancelled'").select("request_id", "stream_id")


@register("i12_drop_run", STATES + " SELECT stream_id, count(*) FILTER (WHERE status <> 'deleted') AS kept, count(*) FILTER (WHERE status = 'deleted') AS gone FROM states GROUP BY stream_id")
def i12(spark, d):
    gone = F.col("status") == "deleted"
    return states(spark, d).groupBy("stream_id").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("gone"))


@register("i11_query_results", "SELECT row_ordinal, CAST(business_key AS VARCHAR) AS business_key, mean, q25, q75 FROM (" + PREDICTED + ")")
def i11(spark, d):
    root, x = fresh_path(spark, "results"), stored(as_results(spark, d), "as-results")
    n = x.count()
    register_results(x.withColumn("mean", F.col("mean") * 2), root, "a", n)
    register_results(x, root, "b", n)
    return query_results(spark, root, "b").select("row_ordinal", "business_key", "mean", "q25", "q75")


@register("i13_error_by_group", "SELECT CAST(o_orderdate AS DATE) AS day, round(avg(abs(truth - mean)), 3) AS mae, round(sqrt(avg((truth - mean) * (truth - mean))), 3) AS rmse, count(*) AS n FROM (" + PREDICTED + ") GROUP BY 1")
def i13(spark, d):
    out = results.error_by_group(predicted(spark, d), F.to_date("o_orderdate").alias("day"), "truth", "mean")
    return out.select("day", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), "n")


@register("i14_max_abs_error", "SELECT round(max(abs(truth - mean)), 6) AS max_abs_error, arg_max(row_ordinal, {'a': abs(truth - mean), 'b': -row_ordinal}) AS at_ordinal FROM (" + PREDICTED + ")")
def i14(spark, d):
    p = stored(predicted(spark, d), "predicted")
    out = results.max_abs_error(p.select("row_ordinal", F.col("truth").alias("mean")), p)
    return out.select(F.round("max_abs_error", 6).alias("max_abs_error"), "at_ordinal")


EDITS = [{"column": "q25", "kind": "offset", "value": 5.0, "start": 10, "end": 500}, {"column": "mean", "kind": "factor", "value": 2.0, "start": 100}, {"column": "q75", "kind": "fixed", "value": 1.0, "end": 50}]


@register("i15_derive_scenario", "SELECT row_ordinal, CASE WHEN row_ordinal BETWEEN 10 AND 500 THEN q25 + 5 ELSE q25 END AS q25, CASE WHEN row_ordinal >= 100 THEN mean * 2 ELSE mean END AS mean, CASE WHEN row_ordinal <= 50 THEN 1 ELSE q75 END AS q75 FROM (" + PREDICTED + ")")
def i15(spark, d):
    return results.derive_scenario(predicted(spark, d), EDITS).select("row_ordinal", "q25", "mean", "q75")


@register("i16_scenario_lineage", "SELECT 'hot' AS scenario_id, 'base' AS baseline_id, 'base' AS parent_id, '0:q25=offset 5.0;1:mean=factor 2.0;2:q75=fixed 1.0' AS modifications, count(*) AS rows FROM orders")
def i16(spark, d):
    out = results.scenario_lineage(results.derive_scenario(predicted(spark, d), EDITS), "hot", "base", "base", EDITS)
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("modifications"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.withColumn("modifications", flat)


@register("i16_ordinal_mapping", """SELECT s.o AS scenario_ordinal, b.o AS baseline_ordinal, s.k AS business_key FROM
(SELECT o_custkey AS k, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS t FROM orders WHERE o_orderkey % 7 <> 3) s
LEFT JOIN (SELECT o_custkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders WHERE o_orderkey % 5 <> 1) b ON s.k = b.k AND s.t = b.t""")
def i16_mapping(spark, d):
    """Rows of a scenario in another order than its baseline's, by keys that repeat."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("business_key"))
    base = global_index(o.where("o_orderkey % 5 <> 1"), ["o_orderkey"])
    return results.ordinal_mapping(base, global_index(o.where("o_orderkey % 7 <> 3"), [F.col("o_orderkey").desc()]))


RUNS = "(SELECT event_type AS experiment_id, 'r' || (event_id // 2) AS request_id, 'snap' || (user_id % 5) AS snapshot FROM events)"


def of_experiments(spark, d):
    """Requests of experiments, each reported twice or so."""
    return table(spark, d, "events").select(F.col("event_type").alias("experiment_id"), F.concat(F.lit("r"), F.floor(F.col("event_id") / 2).cast("string")).alias("request_id"), F.concat(F.lit("snap"), (F.col("user_id") % 5).cast("string")).alias("input_snapshot_id"))


@register("i17_experiment_runs", f"SELECT experiment_id, request_id, min(snapshot) AS input_snapshot_id, n_snapshots FROM {RUNS} JOIN (SELECT experiment_id, count(DISTINCT snapshot) AS n_snapshots FROM {RUNS} GROUP BY 1) USING (experiment_id) GROUP BY experiment_id, request_id, n_snapshots")
def i17(spark, d):
    return results.experiment_runs(of_experiments(spark, d))


@register("i17_experiment_snapshots", f"SELECT experiment_id, snapshot AS input_snapshot_id, count(DISTINCT request_id) AS requests FROM {RUNS} GROUP BY 1, 2")
def i17_snapshots(spark, d):
    return results.experiment_snapshots(of_experiments(spark, d))


@register("i18_axis_order", "SELECT event_id, row_number() OVER (ORDER BY v IS NULL, v, event_id) - 1 AS position FROM (SELECT event_id, CASE WHEN event_type <> 'error' AND event_id % 11 > 1 THEN value END AS v FROM events)")
def i18(spark, d):
    """Numbers as text, some of them null, blank or infinite."""
    k = F.col("event_id") % 11
    v = F.when(k == 0, "  ").when(k == 1, "Infinity").when(F.col("event_type") != "error", F.concat(F.lit(" "), F.col("value").cast("string")))
    return results.axis_order(table(spark, d, "events").select("event_id", v.alias("v")), "v", "event_id").select("event_id", "position")


@register("i19_scope_window", "SELECT row_ordinal, mean FROM (" + PREDICTED + ") WHERE row_ordinal BETWEEN 21 AND 301")
def i19(spark, d):
    return results.scope_window(predicted(spark, d), 300.5, 20.5, "row_ordinal").select("row_ordinal", "mean")


@register("i20_series_bounds", "SELECT min(o_orderdate) AS x_min, max(o_orderdate) AS x_max, round(lo - (hi - lo) * 0.12, 4) AS y_min, round(hi + (hi - lo) * 0.12, 4) AS y_max FROM (SELECT o_orderdate, min(least(mean, q25, q75, truth)) OVER () AS lo, max(greatest(mean, q25, q75, truth)) OVER () AS hi FROM (" + PREDICTED + ")) GROUP BY lo, hi")
def i20(spark, d):
    return results.series_bounds(predicted(spark, d), "o_orderdate").select("x_min", "x_max", F.round("y_min", 4).alias("y_min"), F.round("y_max", 4).alias("y_max"))


@register("i21_interval_available", "SELECT bool_and(q25 IS NOT NULL AND q75 IS NOT NULL) AS available, count(*) FILTER (WHERE business_key % 9 = 0) AS gaps FROM (" + PREDICTED + ")")
def i21(spark, d):
    return results.interval_available(predicted(spark, d).withColumn("truth", F.when(F.col("business_key") % 9 != 0, F.col("truth"))))


@register("i21_series_segments", """SELECT event_id, CASE WHEN known THEN CAST(sum(CASE WHEN known AND NOT before THEN 1 ELSE 0 END) OVER w AS BIGINT) END AS segment, CASE WHEN NOT known THEN CAST(sum(CASE WHEN NOT known AND before2 THEN 1 ELSE 0 END) OVER w AS BIGINT) END AS gap,
bool_and(event_id % 1000 <> 999) OVER () AS interval FROM (SELECT *, coalesce(lag(known) OVER (ORDER BY event_id), false) AS before, coalesce(lag(known) OVER (ORDER BY event_id), true) AS before2 FROM (SELECT event_id, event_type <> 'error' AND event_id % 13 > 2 AS known FROM events)) WINDOW w AS (ORDER BY event_id)""")
def i21_segments(spark, d):
    """Lines and gaps of a series: some values are missing or not finite, and some points have no interval."""
    e = F.col("event_id")
    truth = F.when((F.col("event_type") == "error") | (e % 13 == 0), None).when(e % 13 < 3, float("nan")).otherwise(F.col("value"))
    x = table(spark, d, "events").select("event_id", truth.alias("truth"), F.lit(0.0).alias("q25"), F.when(e % 1000 != 999, F.lit(1.0)).alias("q75"))
    return results.series_segments(x, ["event_id"]).select("event_id", "segment", "gap", "interval")


def changed(df):
    k = F.col("o_orderkey")
    return df.where(k % 100 != 3).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 50 == 0, 1.0).when(k % 50 == 1, 1e-8).otherwise(0.0)).withColumn("o_orderstatus", F.when(k % 70 == 0, "X").otherwise(F.col("o_orderstatus")))


@register("j01_diff_tables", "SELECT o_orderkey, '<row>' AS \"column\" FROM orders WHERE o_orderkey % 100 = 3 UNION ALL SELECT o_orderkey, 'o_totalprice' FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey % 100 <> 3 UNION ALL SELECT o_orderkey, 'o_orderstatus' FROM orders WHERE o_orderkey % 70 = 0 AND o_orderkey % 100 <> 3")
def j01(spark, d):
    o = table(spark, d, "orders")
    return recon.diff_tables(changed(o), o, on="o_orderkey").select("o_orderkey", "column")


@register("j02_normalize_cells", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS ts, round(value, 6) AS value FROM events")
def j02(spark, d):
    return recon.normalize_cells(table(spark, d, "events").select("event_id", "ts", "value"))


@register("k01_latest_per_stream", """SELECT stream_id, generation, request_id FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY generation DESC, seq DESC) AS n FROM (
SELECT 's' || (user_id % 400) AS stream_id, CASE WHEN event_id % 70 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 1 ELSE event_id + 1 END + x AS generation, event_id * 10 + CASE WHEN x > 0 THEN 9004 ELSE 0 END AS seq, 'r' || event_id AS request_id
FROM events, (VALUES (0), (1200)) AS t(x) WHERE x = 0 OR event_id % 9 = 4)) WHERE n = 1""")
def k01(spark, d):
    """All reservations, over a stream of files that is stopped and started again; a batch that was committed comes a second time."""
    path, out, cp = (fresh_path(spark, n) for n in ("latest-in", "latest-out", "latest-cp"))
    x = run_events(spark, d).where("kind = 'reserve'").select("stream_id", "generation", "seq", "request_id")
    sink = upserter(out, ["stream_id"], ["generation", "seq"], buckets=16)
    for k in range(2):
        x.where(F.col("seq") % 2 == k).repartition(3).write.mode("append").parquet(path)
        src = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 2).parquet(path)
        src.writeStream.option("checkpointLocation", cp).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    sink(x.limit(100).withColumn("generation", F.lit(1 << 40)), 0)
    return upserted(spark, out).select("stream_id", "generation", "request_id")


@register("k02_run_state", STATES + " SELECT request_id, seq, status FROM states")
def k02(spark, d):
    """The state machine over a stream of files, in ten micro-batches; each reservation's last status."""
    path, out = fresh_path(spark, "runs-in"), fresh_path(spark, "runs-out")
    events = run_events(spark, d)
    part = max(1, (events.agg(F.max("seq")).first()[0] or 0) // 10)
    for tenth in runs.in_steps(events, [part * k - 1 for k in range(1, 10)]):  # files are read in the order of their times, and a stream has one file in each tenth
        tenth.repartition(4, "stream_id").write.mode("append").parquet(path)
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(path)
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        q = run_state(src).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "runs-cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    return runs.run_states(spark.read.parquet(out)).select("request_id", "seq", "status")


@register("k03_score_stream", LINEAR + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mean / 10) AS tens FROM p")
def k03(spark, d):
    """All rows of the table arrive as files and get the scores that the batch gives them."""
    x, state = fitted(spark, d)
    path, out = fresh_path(spark, "rows-in"), fresh_path(spark, "rows-out")
    x.write.parquet(path)
    score_stream(spark.readStream.schema(x.schema).parquet(path), state, out, fresh_path(spark, "rows-cp"), keep=tuple(KEY)).awaitTermination()
    return spark.read.parquet(out).select(*KEY, F.round(F.col("mean").cast("double") / 10).alias("tens"))
