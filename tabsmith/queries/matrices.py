"""Queries of feature matrices, preprocessing and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions import distributions as dist
from tabsmith.operators import features as ft
from tabsmith.operators import inputs, prep
from tabsmith.operators.catalog import logical_digest
from tabsmith.operators.order import global_index
from tabsmith.operators.scorer import Ridge, Scorer, fit_context, predict, register_scorer
from tabsmith.queries.core import register, table
from tabsmith.queries.storage import PRICE, digest_sql
from tabsmith.storage import fresh_path, stored

X = ["l_quantity", "l_discount", "l_tax"]
Y = "l_extendedprice"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register("f01_float32", "SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS price FROM orders")
def f01(spark, d):
    return ft.to_float32(table(spark, d, "orders"), ["o_totalprice"], keep=["o_orderkey"]).select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))


@register("f01_overflow", "SELECT count(*) FILTER (WHERE l_extendedprice * 1e34 > 3.4028235677973366e38) AS big, CAST(0 AS BIGINT) AS l_quantity FROM lineitem")
def f01_overflow(spark, d):
    return ft.overflow_counts(table(spark, d, "lineitem").withColumn("big", F.col(Y) * 1e34), ["big", "l_quantity"])


@register("f02_int_range", "SELECT count(*) FILTER (WHERE k > 2147483647) AS k, count(*) FILTER (WHERE b < 0) AS b FROM (SELECT o_orderkey * 1000000 AS k, o_custkey - 500 AS b FROM orders)")
def f02(spark, d):
    x = table(spark, d, "orders").select((F.col("o_orderkey") * 1000000).alias("k"), (F.col("o_custkey") - 500).alias("b"))
    return ft.range_counts(x, {"k": "int32", "b": "uint32"})


@register("f03_nulls_to_nan", "SELECT event_id, CASE WHEN event_type = 'error' OR value IS NULL THEN true ELSE false END AS missing FROM events")
def f03(spark, d):
    x = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return ft.to_float32(x, ["value"], keep=["event_id"]).select("event_id", F.isnan("value").alias("missing"))


@register("f04_infinities", "SELECT count(*) FILTER (WHERE l_discount = 0) AS r, CAST(0 AS BIGINT) AS l_tax FROM lineitem")
def f04(spark, d):
    x = table(spark, d, "lineitem").withColumn("r", F.when(F.col("l_discount") == 0, float("inf")).otherwise(F.col("l_quantity")))
    return ft.infinity_counts(x, ["r", "l_tax"])


@register("f05_bad_targets", "SELECT count(*) FILTER (WHERE event_type = 'error' OR value IS NULL) AS missing, count(*) FILTER (WHERE event_type = 'click' AND value IS NOT NULL) AS not_finite FROM events")
def f05(spark, d):
    t = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "click", F.col("value") * float("inf")).otherwise(F.col("value"))
    return ft.bad_targets(table(spark, d, "events").withColumn("t", t), "t")


@register("f06_row_slice", "SELECT o_orderkey, row_ordinal FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_ordinal FROM orders) WHERE row_ordinal BETWEEN 100 AND 599")
def f06(spark, d):
    x = global_index(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return ft.row_slice(x, 100, 500).select("o_orderkey", "row_ordinal")


@register(
    "f07_prediction_input",
    """SELECT l_orderkey % 5 = 4 AS held_out, count(*) AS n, round(sum(CAST(CAST(l_discount AS FLOAT) AS DOUBLE)), 2) AS discounts, count(*) FILTER (WHERE l_orderkey % 5 = 4) AS truths
    FROM lineitem GROUP BY 1""",
)
def f07(spark, d):
    x = table(spark, d, "lineitem")
    p = ft.prepare_prediction_input(x.where("l_orderkey % 5 < 4"), x.where("l_orderkey % 5 = 4"), Y, X)
    a = p.train.agg(F.lit(False).alias("held_out"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_discount").cast("double")), 2).alias("discounts"), F.lit(0).cast("long").alias("truths"))
    return a.union(p.predict.agg(F.lit(True), F.count(F.lit(1)), F.round(F.sum(F.col("l_discount").cast("double")), 2), F.count("truth")))


@register("f08_materialize_training", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_ordinal, o_orderkey, CAST(CAST(o_custkey AS FLOAT) AS DOUBLE) AS x, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS y, 'training' AS kind, '[\"F\"]' AS args, 'y' AS target FROM orders WHERE o_orderstatus = 'F'")
def f08(spark, d):
    """A training matrix as a snapshot, read back by its id beside what made it."""
    table(spark, d, "orders").createOrReplaceTempView("orders")
    root = fresh_path(spark, "inputs")
    sid = inputs.materialize_input(spark, root, "SELECT o_orderkey, o_custkey AS x, o_totalprice AS y FROM orders WHERE o_orderstatus = ?", ["F"], ["x"], "y", ["o_orderkey"], ["o_orderkey"])
    made = inputs.provenance(spark, root).where(F.col("snapshot_id") == sid).select("kind", "args", "target")
    return inputs.input_rows(spark, root, sid).select("row_ordinal", "o_orderkey", F.col("x").cast("double"), F.col("y").cast("double")).crossJoin(F.broadcast(made))  # one row


@register("g01_constant_stats", "SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_quantity) AS n, count(*) - count(l_quantity) AS nans, count(DISTINCT l_quantity) > 1 AS kept, false AS one_kept FROM lineitem")
def g01(spark, d):
    x = table(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    kept = prep.select_non_constant(x, ["l_quantity", "one"])
    return prep.constant_stats(x, ["l_quantity"]).select("l_quantity.*", F.lit("l_quantity" in kept).alias("kept"), F.lit("one" in kept).alias("one_kept"))


@register("g02_row_fingerprint")
def g02(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return prep.row_fingerprint(x, ["o_totalprice", "o_custkey"], 30000, "fp").select("o_orderkey", F.col("fp").cast("double").alias("fp"))


@register("g03_row_fingerprint_distinct")
def g03(spark, d):
    x = table(spark, d, "lineitem").select(*KEY, *X)
    return prep.row_fingerprint_distinct(x, ["l_discount", "l_tax"], 7, "l_partkey", "fp").groupBy("l_discount", "l_tax").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fp").alias("fingerprints"))


BOUNDS = """WITH a AS (SELECT avg(l_extendedprice) - 1.5 * stddev_samp(l_extendedprice) AS lo, avg(l_extendedprice) + 1.5 * stddev_samp(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT avg(l_extendedprice) - 1.5 * stddev_samp(l_extendedprice) AS lo, avg(l_extendedprice) + 1.5 * stddev_samp(l_extendedprice) AS hi FROM lineitem, a WHERE l_extendedprice BETWEEN a.lo AND a.hi)"""


@register("g04_clip_bounds", BOUNDS + " SELECT round(lo, 3) AS lo, round(hi, 3) AS hi FROM b")
def g04(spark, d):
    lo, hi = prep.clip_bounds(table(spark, d, "lineitem"), [Y], 1.5)[Y]
    return spark.createDataFrame([(lo, hi)], "lo double, hi double").select(F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"))


@register("g05_soft_clip", "SELECT o_orderkey, round(least(200000 + ln(1 + abs(greatest(50000 - ln(1 + abs(o_totalprice)), o_totalprice))), greatest(50000 - ln(1 + abs(o_totalprice)), o_totalprice)), 5) AS v FROM orders")
def g05(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(prep.soft_clip(F.col("o_totalprice"), 50000.0, 200000.0), 5).alias("v"))


@register("g06_standardizer", "SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS scale, 1.0 AS flat FROM lineitem".replace("1.0 AS", "CAST(1 AS DOUBLE) AS"))
def g06(spark, d):
    s = prep.standardizer(table(spark, d, "lineitem").withColumn("c", F.lit(3.0)), ["l_quantity", "c"])
    return spark.createDataFrame([(*s["l_quantity"], s["c"][1])], "mean double, scale double, flat double").select(F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"), "flat")


@register("g07_target_statistics", "SELECT round(CAST(CAST(avg(o_totalprice) AS FLOAT) AS DOUBLE), 0) AS mean, round(CAST(CAST(stddev_pop(o_totalprice) AS FLOAT) AS DOUBLE), 0) AS scale FROM orders")
def g07(spark, d):
    return spark.createDataFrame([prep.target_statistics(table(spark, d, "orders"), "o_totalprice")], "mean double, scale double").select(F.round("mean", 0).alias("mean"), F.round("scale", 0).alias("scale"))


@register("g08_standardize", "SELECT o_orderkey, round((o_totalprice - m) / s, 8) AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def g08(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(prep.standardize(F.col("o_totalprice"), *prep.standardizer(o, ["o_totalprice"])["o_totalprice"]), 8).alias("z"))


def fitted(spark, d):
    x = stored(table(spark, d, "lineitem").select(*KEY, *X, Y).withColumn("row_id", F.xxhash64(*KEY, *X, Y)), "train")
    return x, prep.fit_preprocessing(x, X, Y, "row_id", fingerprint=False, shift=1)


@register(
    "g09_transform_features",
    """WITH s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_discount) AS dm, stddev_pop(l_discount) AS ds, avg(l_tax) AS tm, stddev_pop(l_tax) AS ts FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - qm) / qs, 4) AS q, round((l_discount - dm) / ds, 4) AS d, round((l_tax - tm) / ts, 4) AS t FROM lineitem, s""",
)
def g09(spark, d):
    x, state = fitted(spark, d)
    m = prep.transform_features(x, state, keep=KEY)
    return m.select(*KEY, *[F.round(F.col(c).cast("double"), 4).alias(a) for c, a in zip(X, "qdt", strict=True)])


@register(
    "g10_fit_preprocessing",
    """SELECT 'l_discount' AS feature, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS scale FROM lineitem
    UNION ALL SELECT 'l_quantity', round(avg(l_quantity), 6), round(stddev_pop(l_quantity), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) FROM lineitem""",
)
def g10(spark, d):
    _, state = fitted(spark, d)
    rows = [(c, *state.scales[c]) for c in state.used]
    return spark.createDataFrame(rows, "feature string, mean double, scale double").select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@register("g10_with_fingerprint", "SELECT 'l_discount' AS feature, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS scale, count(*) * 3 AS salt FROM lineitem UNION ALL SELECT 'l_quantity', round(avg(l_quantity), 6), round(stddev_pop(l_quantity), 6), count(*) * 3 FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6), count(*) * 3 FROM lineitem")
def g10_with(spark, d):
    """With the fingerprint as a feature; its own scale is a hash's, and is tested elsewhere."""
    x = table(spark, d, "lineitem").select(*X, Y).withColumn("row_id", F.xxhash64(*X, Y))
    state = prep.fit_preprocessing(x, X, Y, "row_id", seed=3)
    rows = [(c, *state.scales[c], state.salt) for c in state.used if c in X]
    return spark.createDataFrame(rows, "feature string, mean double, scale double, salt long").select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"), "salt")


@register("g11_standardize_clamp", "SELECT o_orderkey, round(least(greatest((o_totalprice - 150000) / 80000, -1), 1), 8) AS z FROM orders")
def g11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(prep.standardize_clamp(F.col("o_totalprice"), 150000.0, 80000.0, -1.0, 1.0), 8).alias("z"))


WEIGHT = "sum(x * t) / sum(x * x) AS w FROM (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS t FROM lineitem)"


@register("g12_univariate_weights", f"SELECT round(w, 6) AS w FROM (SELECT {WEIGHT})")
def g12(spark, d):
    x = table(spark, d, "lineitem")
    s = prep.standardizer(x, ["l_quantity", Y])
    z = x.select(*[prep.standardize(F.col(c), *s[c]).alias(c) for c in s])
    return spark.createDataFrame([(prep.univariate_weights(z, ["l_quantity"], Y)["l_quantity"],)], "w double").select(F.round("w", 6).alias("w"))


LINEAR = """WITH s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_discount) AS dm, stddev_pop(l_discount) AS ds, avg(l_tax) AS tm, stddev_pop(l_tax) AS ts, avg(l_extendedprice) AS ym, stddev_pop(l_extendedprice) AS ys FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - qm) / qs AS q, (l_discount - dm) / ds AS d, (l_tax - tm) / ts AS t, (l_extendedprice - ym) / ys AS y, ym, ys FROM lineitem, s),
w AS (SELECT sum(q * y) / sum(q * q) AS wq, sum(d * y) / sum(d * d) AS wd, sum(t * y) / sum(t * t) AS wt FROM z),
p AS (SELECT z.*, (wq * q + wd * d + wt * t) * ys + ym AS mean FROM z, w)"""


@register("g13_score_linear", LINEAR + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(mean / 10) AS tens FROM p")
def g13(spark, d):
    x, state = fitted(spark, d)
    out = prep.score_linear(prep.transform_features(x, state, keep=KEY), state, KEY)
    return out.select(*KEY, F.round(F.col("mean").cast("double") / 10).alias("tens"))


@register("g14_inverse_target", "SELECT o_orderkey, round(CAST(CAST((o_totalprice - 1000) / 500 * 500 + 1000 AS FLOAT) AS DOUBLE), 1) AS v FROM orders")
def g14(spark, d):
    z = (F.col("o_totalprice") - 1000) / 500
    return table(spark, d, "orders").select("o_orderkey", F.round(prep.inverse_target(z, 1000.0, 500.0).cast("double"), 1).alias("v"))


MATRIX = digest_sql("(SELECT o_orderkey, CAST(CAST(o_custkey AS FLOAT) AS DOUBLE) AS c, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS p FROM orders)", {"o_custkey": "CAST(CAST(c AS BIGINT) AS VARCHAR)", "o_totalprice": "CASE WHEN p = floor(p) THEN CAST(CAST(p AS BIGINT) AS VARCHAR) ELSE CAST(p AS VARCHAR) END"}, "o_orderkey")


@register("g15_training_digest", "WITH " + MATRIX + " SELECT digest, count(*) AS n FROM blocks_all, orders GROUP BY digest")
def g15(spark, d):
    m = global_index(ft.to_float32(table(spark, d, "orders"), ["o_custkey", "o_totalprice"], keep=["o_orderkey"]), ["o_orderkey"])
    return spark.createDataFrame([(logical_digest(m.drop("o_orderkey"), ordinal="row_ordinal"), m.count())], "digest string, n long")


PAIRS = digest_sql("orders", {"o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_totalprice": PRICE}, "o_orderkey")


@register("g16_context_id", "WITH " + PAIRS + """ SELECT shift, sha256('{"args":[],"config":{"shift":' || shift || '},"features":["o_custkey"],"model":"linear","sql":"SELECT 1","target":"o_totalprice","training":"' || digest || '","version":"1"}') AS context_id FROM blocks_all, (VALUES (0), (1), (0)) AS t(shift)""")
def g16(spark, d):
    digest = logical_digest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    ids = [(s, prep.context_id("linear", "1", digest, "SELECT 1", [], ["o_custkey"], "o_totalprice", {"shift": s})) for s in (0, 1, 0)]
    return spark.createDataFrame(ids, "shift int, context_id string")


@register("g17_fit_or_reuse", """SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale, reused FROM (SELECT 'l_discount' AS feature, avg(l_discount) AS mean, stddev_pop(l_discount) AS scale FROM lineitem
    UNION ALL SELECT 'l_quantity', avg(l_quantity), stddev_pop(l_quantity) FROM lineitem UNION ALL SELECT 'l_tax', avg(l_tax), stddev_pop(l_tax) FROM lineitem), (VALUES (false), (true)) AS t(reused)""")
def g17(spark, d):
    path = fresh_path(spark, "contexts")
    made = [prep.fit_or_reuse(spark, path, "ctx-1", lambda: fitted(spark, d)[1]) for _ in range(2)]
    rows = [(c, *s, reused) for state, reused in made for c, s in state.scales.items()]
    return spark.createDataFrame(rows, "feature string, mean double, scale double, reused boolean").select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"), "reused")


BINS = 64
BORDERS = [float(k) for k in range(BINS + 1)]
P = "SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) / 0.5 - list_max(embedding) / CAST(0.5 AS DOUBLE))) AS e FROM embeddings)"


def probs(spark, d):
    return table(spark, d, "embeddings").select("vec_id", dist.softmax(F.col("embedding"), 0.5).alias("p"))


@register("h01_softmax", f"SELECT vec_id, round(list_max(p), 8) AS top, round(list_sum(p), 6) AS total, len(p) AS n FROM ({P})")
def h01(spark, d):
    return probs(spark, d).select("vec_id", F.round(F.array_max("p"), 8).alias("top"), F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.size("p").cast("long").alias("n"))


@register("h02_rebin", f"SELECT vec_id, round(list_sum(p[1:16]), 8) AS a, round(list_sum(p[17:32]), 8) AS b, round(list_sum(p[33:64]), 8) AS c FROM ({P})")
def h02(spark, d):
    # logits that were not softmaxed before: a Python UDF can not take an expression with lambdas
    out = table(spark, d, "embeddings").select("vec_id", dist.rebin(F.col("embedding"), BORDERS, [0.0, 16.0, 32.0, 64.0], logits=True, temperature=0.5).alias("r"))
    return out.select("vec_id", *[F.round(F.get("r", F.lit(k)), 8).alias(n) for k, n in enumerate("abc")])


MEANS = [float(x) for x in dist.bucket_means(BORDERS)]


@register("h03_decode_mean", f"SELECT vec_id, round(list_sum(list_transform(list_zip(p, [{', '.join(f'{m!r}' for m in MEANS)}]::DOUBLE[]), lambda z: z[1] * z[2])) * 2 + 10, 6) AS mean FROM ({P})")
def h03(spark, d):
    mean = dist.decode_mean(F.col("embedding"), MEANS, 10.0, 2.0, logits=True, temperature=0.5)
    return table(spark, d, "embeddings").select("vec_id", mean.alias("mean")).select("vec_id", F.round("mean", 6).alias("mean"))


#: Default borders of 64 bins: the mirrored control points at their places, as SQL.
FIXED = ", ".join(f"({float(p)}, {v})" for p, v in [*dist.CONTROLS, *((5000 - p, -v) for p, v in dist.CONTROLS[-2::-1])])
DEFAULTS = f"""cp AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM (VALUES {FIXED}) AS t(x, y)),
bo AS (SELECT k, CASE WHEN k = 64 THEN 128 ELSE y + (y1 - y) * (k * 5000 / CAST(64 AS DOUBLE) - x) / (x1 - x) END AS b FROM range(65) r(k), cp WHERE k * 5000 / CAST(64 AS DOUBLE) >= x AND (k * 5000 / CAST(64 AS DOUBLE) < x1 OR x1 IS NULL)),
bm AS (SELECT list(m ORDER BY k) AS ms FROM (SELECT k, CASE WHEN k = 0 THEN b1 - (b1 - b) * {dist.TAIL_MEAN!r} WHEN k = 63 THEN b + (b1 - b) * {dist.TAIL_MEAN!r} ELSE (b + b1) / 2 END AS m FROM (SELECT k, b, lead(b) OVER (ORDER BY k) AS b1 FROM bo) WHERE k < 64))"""


@register("h03_default_borders", f"WITH {DEFAULTS} SELECT vec_id, CASE WHEN label <> 3 AND label <> 2 THEN round(list_sum(list_transform(list_zip(p, ms), lambda z: z[1] * z[2])) * 2 + 10, 6) END AS mean FROM ({P}) JOIN (SELECT vec_id AS v, label FROM embeddings) ON v = vec_id, bm")
def h03_default(spark, d):
    """Means over the default borders; some rows have no logits, or too few."""
    means = dist.bucket_means(dist.default_borders(BINS))
    x = table(spark, d, "embeddings").withColumn("e", F.when(F.col("label") == 2, F.slice("embedding", 1, 9)).when(F.col("label") != 3, F.col("embedding")))
    out = x.select("vec_id", dist.decode_mean(F.col("e"), means, 10.0, 2.0, logits=True, temperature=0.5).alias("mean"))
    return out.select("vec_id", F.round("mean", 6).alias("mean"))


CDF = f"SELECT vec_id, k, p[k] AS m, list_sum(p[1:k]) AS c FROM (SELECT vec_id, p, unnest(range(1, 65)) AS k FROM ({P}))"


@register(
    "h04_decode_quantiles",
    f"""SELECT vec_id, round(min((k - 1) + (0.25 - (c - m)) / m) FILTER (WHERE c >= 0.25 AND c - m < 0.25), 6) AS q25, round(min((k - 1) + (0.75 - (c - m)) / m) FILTER (WHERE c >= 0.75 AND c - m < 0.75), 6) AS q75
    FROM (SELECT * FROM ({CDF}) WHERE c >= 0.25 AND c - m < 0.25 OR c >= 0.75 AND c - m < 0.75) GROUP BY vec_id""",
)
def h04(spark, d):
    out = table(spark, d, "embeddings").select("vec_id", dist.decode_quantiles(F.col("embedding"), BORDERS, logits=True, temperature=0.5).alias("q"))
    return out.select("vec_id", F.round(F.get("q", F.lit(0)), 6).alias("q25"), F.round(F.get("q", F.lit(1)), 6).alias("q75"))


@register("h05_decode_quantile_mean", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) / len(embedding) * 3 + 5, 6) AS v FROM embeddings")
def h05(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(dist.decode_quantile_mean(F.col("embedding"), 5.0, 3.0), 6).alias("v"))


@register("h06_check_distribution", "SELECT count(*) AS rows, count(*) FILTER (WHERE label = 1) AS wrong_length, count(*) FILTER (WHERE label = 2) AS not_logits, count(*) FILTER (WHERE label = 3) AS no_mass FROM embeddings")
def h06(spark, d):
    odd = F.when(F.col("label") == 1, F.slice("embedding", 1, 10)).when(F.col("label") == 2, F.transform("embedding", lambda v: v * float("inf"))).when(F.col("label") == 3, F.transform("embedding", lambda v: F.lit(float("-inf")).cast("float"))).otherwise(F.col("embedding"))
    return dist.check_distribution(table(spark, d, "embeddings").withColumn("e", odd), "e", 64)


@register("l01_scorer", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(q), 3) AS size FROM (SELECT *, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS q FROM lineitem)")
def l01(spark, d):
    x, state = fitted(spark, d)
    x = global_index(x, [*KEY, "row_id"])
    at = state.used.index("l_quantity")
    register_scorer("size_of_first", lambda s, m: abs(m[:, s]), at)
    found = predict(x, state, name="size_of_first")
    return x.select(*KEY, "row_ordinal").join(found, "row_ordinal").select(*KEY, F.round(F.col("mean").cast("double"), 3).alias("size"))


RIDGE = """WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_extendedprice) AS my FROM lineitem),
c AS (SELECT sum((l_quantity - mq) * (l_quantity - mq)) + 10 AS qq, sum((l_quantity - mq) * (l_discount - md)) AS qd, sum((l_discount - md) * (l_discount - md)) + 10 AS dd, sum((l_quantity - mq) * (l_extendedprice - my)) AS qy, sum((l_discount - md) * (l_extendedprice - my)) AS dy FROM lineitem, m),
b AS (SELECT (qy * dd - dy * qd) / (qq * dd - qd * qd) AS bq, (dy * qq - qy * qd) / (qq * dd - qd * qd) AS bd FROM c)"""


@register("l01_fit_ridge", RIDGE + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reused, round(my + bq * (l_quantity - mq) + bd * (l_discount - md), 2) AS mean FROM lineitem, m, b, (VALUES (false), (true)) AS t(reused)")
def l01_fit(spark, d):
    """Ridge regression fitted by partial states over the partitions, stored by its id; scored with the fitted and with the stored context."""
    x, path, names = table(spark, d, "lineitem"), fresh_path(spark, "contexts"), ["l_quantity", "l_discount"]
    model, out = Ridge(10.0), None
    identity = prep.context_id("ridge", "1", "lineitem", "TABLE lineitem", [], names, "l_extendedprice", {"penalty": 10})
    for _ in range(2):
        context, reused = fit_context(spark, path, identity, "ridge", model, x, names, "l_extendedprice")
        part = Scorer(model.predict, context, kind=float).score(x, names, KEY).withColumn("reused", F.lit(reused))
        out = part if out is None else out.union(part)
    return out.select(*KEY, "reused", F.round("mean", 2).alias("mean"))
