"""Queries of the relational surface, splits and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators import dataset as ds
from tabsmith.operators import inputs
from tabsmith.operators.order import global_index
from tabsmith.plans.readonly import preview, query, with_row_ordinal
from tabsmith.queries.core import register, table, views
from tabsmith.storage import fresh_path


def sql_query(name: str, text: str, tables: tuple[str, ...], args: list | None = None, oracle: str | None = None) -> None:
    """A statement that reads alike in both dialects."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return query(spark, text, args)

    register(name, oracle or text)(run)


sql_query("c01_readonly_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000", ("orders",))
sql_query(
    "c02_typed_parameters",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?",
    ("orders",),
    [100000.0, "F"],
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F'",
)
sql_query("c03_projection", "SELECT l_orderkey, l_linenumber, l_quantity AS x, l_quantity * 2 AS price FROM lineitem", ("lineitem",))
sql_query("c04_filter", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND value >= 10 AND event_type <> 'error'", ("events",))
sql_query("c05_inner_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN (SELECT c_custkey AS o_custkey, c_name FROM customer) USING (o_custkey)", ("orders", "customer"))
sql_query("c06_left_join", "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000) USING (c_custkey)", ("customer", "orders"))
sql_query("c07_group_by", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", ("lineitem",))
sql_query("c08_distinct_count", "SELECT COUNT(*) AS n, COUNT(DISTINCT l_orderkey) AS orders, COUNT(DISTINCT l_partkey) AS parts FROM lineitem", ("lineitem",))
sql_query("c09_cte", "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), ks AS (SELECT * FROM (VALUES (1), (2), (3)) AS t(n)) SELECT big.o_custkey, big.n FROM big JOIN ks ON big.n = ks.n", ("orders",))
sql_query("c09_table_statement", "TABLE nation", ("nation",), None, "SELECT * FROM nation")
sql_query("c11_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100", ("orders",))
sql_query("c13_except_columns", "SELECT * EXCEPT (c_acctbal, c_name) FROM customer", ("customer",), None, "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer")


@register("c10_total_order", "SELECT event_id, row_number() OVER (ORDER BY value ASC NULLS LAST, event_id) - 1 AS row_ordinal FROM events")
def c10(spark, d):
    return with_row_ordinal(table(spark, d, "events").select("event_id", "value"), ["value", "event_id"]).select("event_id", "row_ordinal")


@register("c12_rank_of_all", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate ASC NULLS LAST, o_orderkey) AS r, count(*) OVER () AS n FROM orders")
def c12(spark, d):
    x = global_index(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "r", start=1)
    return x.crossJoin(x.agg(F.count(F.lit(1)).alias("n"))).select("o_orderkey", "r", "n")  # one row beside


@register("c14_preview", "SELECT (SELECT count(*) FROM events) AS total, event_id FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 200)")
def c14(spark, d):
    n, top = preview(table(spark, d, "events").select("event_id").orderBy("event_id"), 200)
    return top.select(F.lit(n).cast("long").alias("total"), "event_id")


@register("c15_row_ordinal", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice NULLS LAST, o_orderkey) - 1 AS row_ordinal FROM orders")
def c15(spark, d):
    return with_row_ordinal(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_ordinal")


@register("c16_materialize", "SELECT o_custkey, n, row_number() OVER (ORDER BY o_custkey) - 1 AS row_ordinal, 'snap-1' AS source_snapshot, CAST(3 AS BIGINT) AS revision, 'SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey > ? GROUP BY o_custkey' AS sql FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey > 7 GROUP BY o_custkey)")
def c16(spark, d):
    """A query's rows frozen under an id, twice, beside its definition."""
    views(spark, d, "orders")
    root, sql = fresh_path(spark, "frozen"), "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey > ? GROUP BY o_custkey"
    sid, _ = [inputs.freeze_query(spark, root, sql, [7], order=["o_custkey"], source_snapshot="snap-1", revision=3) for _ in range(2)]
    made = inputs.provenance(spark, root).where(F.col("snapshot_id") == sid).select("source_snapshot", "revision", "sql")
    return inputs.input_rows(spark, root, sid).crossJoin(F.broadcast(made))  # one row


DATASET = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def orders_dataset(spark: SparkSession, d: str) -> DataFrame:
    views(spark, d, "orders")
    return ds.build_dataset(spark, DATASET, ["o_orderkey"])


@register("e01_build_dataset", "SELECT row_number() OVER (ORDER BY o_orderkey) AS __row_id, o_orderkey, o_custkey, o_totalprice FROM orders")
def e01(spark, d):
    return orders_dataset(spark, d).select("__row_id", "o_orderkey", "o_custkey", "o_totalprice")


RANKED = "SELECT *, row_number() OVER (ORDER BY o_orderdate ASC NULLS LAST, o_orderkey) AS r, count(*) OVER () AS n FROM orders"


@register("e02_ratio_split", f"SELECT o_orderkey, CASE WHEN r <= n * 4 // 5 THEN 'train' ELSE 'test' END AS side FROM ({RANKED})")
def e02(spark, d):
    train, test = ds.ratio_split(orders_dataset(spark, d), "o_orderdate")
    return train.select("o_orderkey", F.lit("train").alias("side")).union(test.select("o_orderkey", F.lit("test").alias("side")))


@register("e02_train_by_priority", f"SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM ({RANKED.replace('AS n', 'AS total')}) WHERE r <= total * 4 // 5 GROUP BY o_orderpriority")
def e02_train(spark, d):
    train, _ = ds.ratio_split(orders_dataset(spark, d), "o_orderdate")
    return train.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@register("e03_time_split", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' THEN 'train' ELSE 'test' END AS side FROM events WHERE ts IS NOT NULL")
def e03(spark, d):
    train, test = ds.time_split(table(spark, d, "events"), "ts", "2024-01-10T02:00:00+02:00")
    return train.select("event_id", F.lit("train").alias("side")).union(test.select("event_id", F.lit("test").alias("side")))


@register("e04_default_cutoff", "SELECT ts AS cutoff FROM (SELECT ts, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events WHERE ts IS NOT NULL) WHERE i = least(n - 1, n * 4 // 5)")
def e04(spark, d):
    return ds.default_cutoff(table(spark, d, "events"), "ts", "event_id")


@register("e05_split_overlap", "SELECT true AS verifiable, count(*) AS overlap FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 5 < 4 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 4)")
def e05(spark, d):
    o = table(spark, d, "orders")
    return ds.split_overlap(o.where("o_orderkey % 5 < 4"), o.where("o_orderkey % 5 = 4"), "o_custkey")


@register(
    "e06_leakage_check",
    """WITH x AS (SELECT o_totalprice, o_orderdate, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    a AS (SELECT max(l_shipdate) AS last, bool_and(o_orderdate <= l_shipdate) AS ok FROM x WHERE l_shipdate < TIMESTAMP '1998-01-01'),
    b AS (SELECT min(l_shipdate) AS first, bool_and(o_orderdate <= l_shipdate) AS ok FROM x WHERE l_shipdate >= TIMESTAMP '1998-01-01')
    SELECT true AS target_absent, a.ok AND b.ok AS available_in_time, last < first AS train_before_predict, a.ok AND b.ok AND last < first AS ok FROM a, b""",
)
def e06(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_totalprice", "o_orderdate", "l_shipdate")
    train, rest = ds.time_split(x, "l_shipdate", "1998-01-01T00:00:00")
    return ds.leakage_check(train, rest.drop("o_totalprice"), target="o_totalprice", time="l_shipdate", available="o_orderdate")


@register("e07_numeric_columns", "SELECT name FROM (SELECT 'l_orderkey' AS name, count(l_orderkey) AS n FROM lineitem UNION ALL SELECT 'l_partkey', count(l_partkey) FROM lineitem UNION ALL SELECT 'l_suppkey', count(l_suppkey) FROM lineitem UNION ALL SELECT 'l_linenumber', count(l_linenumber) FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity) FROM lineitem UNION ALL SELECT 'l_extendedprice', count(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax) FROM lineitem) WHERE n > 0")
def e07(spark, d):
    return spark.createDataFrame([(c,) for c in ds.numeric_columns(table(spark, d, "lineitem"))], "name string")


RENAMED = "SELECT l_orderkey AS order_id, l_partkey AS id, l_suppkey AS supplier, l_linenumber AS line_ordinal, l_quantity AS quantity, l_discount AS discount_available_at, l_tax AS idle, l_extendedprice AS price, l_shipdate AS ship_timestamp, l_returnflag AS flag FROM lineitem"


@register("e08_column_roles", f"""SELECT string_agg(column_name, ',') AS features, 'price' AS target, (SELECT min(column_name) FROM (DESCRIBE {RENAMED}) WHERE contains(column_name, 'timestamp')) AS time
FROM (DESCRIBE {RENAMED}) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AND column_name NOT IN ('id', 'price') AND NOT ends_with(column_name, '_id') AND NOT contains(column_name, 'ordinal') AND NOT contains(column_name, 'available_at')""")
def e08(spark, d):
    views(spark, d, "lineitem")
    train, test = ds.time_split(query(spark, RENAMED), "ship_timestamp", "1998-01-01T00:00:00")
    r = ds.column_roles(train, test, "price")
    return spark.createDataFrame([(",".join(r["features"]), r["target"], r["time"])], "features string, target string, time string")


@register("e09_check_schema", "SELECT count(*) AS n FROM orders")
def e09(spark, d):
    o = table(spark, d, "orders")
    n = ds.check_schema(o, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], min_rows=3)
    return spark.createDataFrame([(n,)], "n long")


@register("e10_validate_experiment", "SELECT count(*) FILTER (WHERE o_orderkey % 5 < 4) AS train_rows, count(*) FILTER (WHERE o_orderkey % 5 = 4) AS test_rows, 1 AS features FROM orders")
def e10(spark, d):
    o = table(spark, d, "orders")
    return ds.validate_experiment(o.where("o_orderkey % 5 < 4"), o.where("o_orderkey % 5 = 4"), "o_totalprice", ["o_custkey"])
