"""Queries of sources, sinks and the catalog. What they read was written from the given tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tabsmith.operators import catalog, recon
from tabsmith.queries.core import register, table
from tabsmith.sources import readers, writers
from tabsmith.sources.arrow_ipc import read_arrow_ipc, stream_arrow_ipc, write_arrow_ipc
from tabsmith.storage import fresh_path, stored


def mixed_cells(spark, d):
    """Customers with null, empty and quoted text."""
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, None).when(k % 5 == 1, "").when(k % 5 == 2, F.concat(F.lit('a,"b" '), F.col("c_name"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.alias("note"), "c_acctbal")


CELLS = "SELECT {key} AS c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '' WHEN c_custkey % 5 = 2 THEN 'a,\"b\" ' || c_name ELSE c_name END AS note, c_acctbal FROM customer"


@register("a01_read_csv", CELLS.format(key="CAST(c_custkey AS DOUBLE)"))
def a01(spark, d):
    path = fresh_path(spark, "csv")
    writers.write_csv(mixed_cells(spark, d), path)
    return readers.read_csv(spark, path)


@register("a01_cells_with_line_breaks", "SELECT CAST(page_id AS DOUBLE) AS page_id, url, html FROM pages")
def a01_breaks(spark, d):
    """Pages with their HTML in cells: line breaks, commas and quotes."""
    path = fresh_path(spark, "csv")
    writers.write_csv(table(spark, d, "pages").select("page_id", "url", "html"), path)
    return readers.read_csv(spark, path, types={"url": "string", "html": "string"})


@register("a02_read_json_rows", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def a02(spark, d):
    path = fresh_path(spark, "json")
    k = F.get_json_object("props", "$.k").cast("long")
    table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000)).agg(F.collect_list(F.struct("event_id", k.alias("k"))).alias("rows")).select(F.struct("rows").alias("data")).write.json(path)
    return readers.read_json_rows(spark, path, "$.data.rows", lines=True)


@register("a02_json_documents", "SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN 'a \"}],{[ ' || event_type || chr(10) ELSE event_type END AS event_type FROM events")
def a02_documents(spark, d):
    """Two documents that hold all rows in one array each, below other arrays; some texts have brackets, quotes and line breaks."""
    path, pieces, e = fresh_path(spark, "json"), fresh_path(spark, "json-pieces"), table(spark, d, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('a "}],{[ '), "event_type", F.lit("\n"))).otherwise(F.col("event_type"))
    row = F.to_json(F.struct("event_id", "user_id", text.alias("event_type")))
    # a file's lines in order: what comes before the rows, the rows with commas, what comes after
    part = F.pmod("event_id", F.lit(2))
    rows = e.select(part.alias("doc"), F.col("event_id").alias("no"), F.concat(F.lit(" , "), row).alias("value"))
    ends = spark.range(2).select(F.col("id").alias("doc"), F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("no"), F.lit('{"meta": {"rows": [{"event_id": 0}], "n": [1, [2]]}, "data": {"other": [{"a": [3]}], "rows": [ {"event_id": -1}').alias("value")), F.struct(F.lit(1 << 60).alias("no"), F.lit('], "tail": "]}"}, "last": [[{"x": 1}]]}').alias("value")))).alias("e")).select("doc", "e.*")
    rows.unionByName(ends).repartitionByRange("doc", "no").sortWithinPartitions("doc", "no").select("doc", "value").write.partitionBy("doc").option("lineSep", "\n").text(pieces)
    writers.join_files(spark, {f"{pieces}/doc={k}": f"{path}/doc={k}/document.json" for k in range(2)})
    found = [readers.read_json_rows(spark, f"{path}/doc={k}", "$.data.rows") for k in range(2)]
    return found[0].unionByName(found[1]).where("event_id >= 0")


@register("a03_read_parquet", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM orders")
def a03(spark, d):
    path = fresh_path(spark, "days")
    table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice").write.parquet(path)
    return readers.read_parquet(spark, path)


@register("a04_read_arrow_ipc", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def a04(spark, d):
    path = fresh_path(spark, "arrow")
    write_arrow_ipc(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate").repartition(3), path)
    return read_arrow_ipc(spark, path)


@register("a04_arrow_by_batch", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 500 AND 900 OR o_orderkey > 50000")
def a04_batches(spark, d):
    """Two columns and a range of keys of files of many batches, each file with a range of the keys."""
    path = fresh_path(spark, "arrow")
    write_arrow_ipc(table(spark, d, "orders").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey"), path, rows=256)
    names = ["o_orderkey", "o_totalprice"]
    x = read_arrow_ipc(spark, path, columns=names, where=[("o_orderkey", ">=", 500), ("o_orderkey", "<=", 900)])
    return x.union(read_arrow_ipc(spark, path, columns=names, where=[("o_orderkey", ">", 50000)]))


@register("a04_arrow_stream", "SELECT event_id, event_type, value FROM events")
def a04_stream(spark, d):
    """Files that arrive in two batches, as a stream."""
    path, out, cp = (fresh_path(spark, n) for n in ("arrow", "arrow-out", "arrow-cp"))
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    for k in range(2):
        write_arrow_ipc(e.where(F.col("event_id") % 2 == k).repartition(3), path)
        stream_arrow_ipc(spark, path, e.schema).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(once=True).start().awaitTermination()
    return spark.read.parquet(out)


@register("a05_union_by_name", "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier")
def a05(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return readers.union_by_name(a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@register("a06_infer_types", """SELECT 'event_id' AS column_name, CASE WHEN bool_and(TRY_CAST(event_id AS DOUBLE) IS NOT NULL) THEN 'number' ELSE 'string' END AS type FROM events
UNION ALL SELECT 'ts', CASE WHEN bool_and(TRY_CAST(ts AS TIMESTAMP) IS NOT NULL) THEN 'timestamp' ELSE 'string' END FROM events
UNION ALL SELECT 'event_type', CASE WHEN bool_and(TRY_CAST(event_type AS DOUBLE) IS NOT NULL) THEN 'number' ELSE 'string' END FROM events
UNION ALL SELECT 'odd', 'boolean' FROM events HAVING count(*) > 0 UNION ALL SELECT 'big', 'string' FROM events HAVING count(*) > 0 UNION ALL SELECT 'none', 'null' FROM events HAVING count(*) > 0""")
def a06(spark, d):
    e = table(spark, d, "events")
    return readers.inference(e.select(*[F.col(c).cast("string").alias(c) for c in ("event_id", "ts", "event_type")], (F.col("event_id") % 2 == 1).cast("string").alias("odd"), (F.col("event_id") + F.lit(9007199254740992)).cast("string").alias("big"), F.lit(None).cast("string").alias("none")))


@register("a07_cast_declared", "SELECT count(*) FILTER (WHERE TRY_CAST(substr(o_orderpriority, 1, 1) || CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE '' END AS DOUBLE) IS NULL) AS v, CAST(0 AS BIGINT) AS k FROM orders")
def a07(spark, d):
    v = F.concat(F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderkey") % 9 == 0, "x").otherwise(""))
    return readers.type_losses(table(spark, d, "orders").select(v.alias("v"), F.col("o_orderkey").cast("string").alias("k")), {"v": "number", "k": "number"})


@register("a08_check_lossless", "SELECT CAST(0 AS BIGINT) AS l_quantity, count(*) FILTER (WHERE l_discount = 0) AS r, count(*) FILTER (WHERE l_orderkey > 0) AS big FROM lineitem")
def a08(spark, d):
    x = table(spark, d, "lineitem").select("l_quantity", F.when(F.col("l_discount") == 0, float("nan")).otherwise(1.0).alias("r"), (F.col("l_orderkey") + F.lit(9007199254740991)).alias("big"))
    return readers.lossy_counts(x)


@register("a09_reject_empty", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def a09(spark, d):
    return readers.reject_empty(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey"))


@register("a10_synthetic_hourly", """SELECT source_row_id, business_key, timestamp_utc, t AS temperature_c, w AS wind_speed_ms, s AS solar_wm2, h AS hour_utc, round(18 + 0.31 * t + 0.52 * w + 0.006 * s + 0.17 * h, 4) AS demand_mwh FROM (
SELECT 'row-' || right('000' || o_orderkey, greatest(4, length(CAST(o_orderkey AS VARCHAR)))) AS source_row_id, 'meter-' || lpad(CAST(o_orderkey % 8 AS VARCHAR), 2, '0') AS business_key, TIMESTAMP '2025-01-01' + to_hours(CAST(o_orderkey AS INTEGER)) AS timestamp_utc,
round(7.5 + ((17 * o_orderkey + 3) % 181) / CAST(10 AS DOUBLE), 6) AS t, round(((29 * o_orderkey + 7) % 91) / CAST(10 AS DOUBLE), 6) AS w, round(greatest(0, sin((o_orderkey % 24 - 6) * pi() / 12)) * (650 + (11 * o_orderkey) % 120), 6) AS s, CAST(o_orderkey % 24 AS INTEGER) AS h FROM orders)""")
def a10(spark, d):
    out = readers.synthetic_hourly(table(spark, d, "orders"), "o_orderkey")
    return out.withColumn("demand_mwh", F.round("demand_mwh", 4))


@register("a11_audit_files", "SELECT 'nation' AS name, 'length' AS fault, 1 AS files FROM nation HAVING count(*) > 0 UNION ALL SELECT 'region', 'extra', 1 FROM region HAVING count(*) > 0 UNION ALL SELECT 'none', 'missing', 1 FROM region HAVING count(*) > 0 UNION ALL SELECT 'orders', 'sha256', count(DISTINCT o_orderkey // 10000) FROM orders")
def a11(spark, d):
    """Files of four tables, one of them in as many files as it has ten thousands of keys, against a manifest with faults."""
    path = fresh_path(spark, "files")
    o = table(spark, d, "orders").withColumn("g", F.floor(F.col("o_orderkey") / 10000))
    o.repartition("g").write.partitionBy("g").parquet(f"{path}/orders")
    for n in ("nation", "region", "customer"):
        table(spark, d, n).repartition(1).write.parquet(f"{path}/{n}")  # small tables
    tail = F.element_at(F.split("path", F.lit(path.split("://")[-1] + "/")), -1)
    files = stored(catalog.raw_digest(spark, path, recursive=True).select(tail.alias("name"), "length", "sha256"), "manifest")
    files = files.where(F.col("name").endswith(".parquet"))
    of = F.element_at(F.split("name", "/"), 1)
    m = files.where(of != "region").select("name", (F.col("length") + (of == "nation").cast("long")).alias("length"), F.when(of == "orders", "0").otherwise(F.col("sha256")).alias("sha256"))
    m = m.union(m.agg(F.lit("none/part-0.parquet"), F.max("length"), F.max("sha256")))
    found = readers.audit_files(spark, path, m).where(F.col("name").endswith(".parquet"))
    return found.groupBy(of.alias("name"), "fault").agg(F.count(F.lit(1)).alias("files"))


@register("b01_write_csv", "SELECT count(*) AS lines, count(*) FILTER (WHERE c_custkey % 5 = 0) AS nulls, count(*) FILTER (WHERE c_custkey % 5 = 1) AS empties, count(*) FILTER (WHERE c_custkey % 5 = 2) AS quoted FROM customer")
def b01(spark, d):
    path = fresh_path(spark, "csv")
    writers.write_csv(mixed_cells(spark, d), path)
    v = spark.read.text(path).where(~F.col("value").startswith("c_custkey"))
    return v.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value").contains(",\\N,")).alias("nulls"), F.count_if(F.col("value").contains(',"",')).alias("empties"), F.count_if(F.col("value").contains(',"a,""b"" ')).alias("quoted"))


@register("b02_write_csv_quoted", "SELECT count(*) AS lines, count(*) FILTER (WHERE c_custkey % 5 < 2) AS empties FROM customer")
def b02(spark, d):
    path = fresh_path(spark, "quoted")
    writers.write_csv_quoted(mixed_cells(spark, d), path)
    v = spark.read.text(path).where(~F.col("value").startswith('"c_custkey'))
    return v.agg(F.count_if(F.col("value").startswith('"') & F.col("value").endswith('"')).alias("lines"), F.count_if(F.col("value").contains(',"",') | F.col("value").contains(",,")).alias("empties"))


@register("b03_write_json", CELLS.format(key="c_custkey"))
def b03(spark, d):
    path = fresh_path(spark, "json")
    writers.write_json(mixed_cells(spark, d), path)
    return spark.read.schema("c_custkey long, note string, c_acctbal double").json(path)


@register("b04_write_parquet", CELLS.format(key="c_custkey"))
def b04(spark, d):
    path = fresh_path(spark, "parquet")
    writers.write_parquet(mixed_cells(spark, d), path)
    return spark.read.parquet(path)


@register("b05_write_arrow_ipc", CELLS.format(key="c_custkey"))
def b05(spark, d):
    path = fresh_path(spark, "arrow")
    write_arrow_ipc(mixed_cells(spark, d), path)
    return read_arrow_ipc(spark, path)


@register("b06_write_with_metadata", "SELECT 3 AS columns, true AS aggregation, 'csv' AS format, count(*) AS rows FROM (SELECT o_custkey FROM orders GROUP BY o_custkey)")
def b06(spark, d):
    path = fresh_path(spark, "export")
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    writers.write_with_metadata(x, path, "csv", sql="SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey", target=None, source_snapshot="orders")
    m = writers.read_metadata(spark, path)
    return spark.read.csv(f"{path}/data", header=True).agg(F.lit(len(m["schema"])).alias("columns"), F.lit(m["aggregation"]).alias("aggregation"), F.lit(m["format"]).alias("format"), F.count(F.lit(1)).alias("rows"))


@register("b07_register_results", "SELECT r AS request_id, count(*) AS n, CAST(0 AS BIGINT) AS lo, count(*) - 1 AS hi FROM orders, (VALUES ('007'), ('7'), ('one-2')) AS t(r) GROUP BY r")
def b07(spark, d):
    from tabsmith.queries.publication import as_results

    root, x = fresh_path(spark, "results"), stored(as_results(spark, d), "as-results")
    n = x.count()
    for request in ("007", "7", "one-2", "007"):
        writers.register_results(x, root, request, n)
    return writers.all_results(spark, root).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_ordinal").alias("lo"), F.max("row_ordinal").alias("hi"))


def saved(spark, d):
    root = fresh_path(spark, "snapshots")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    for df in (o, o, o.where("o_orderkey % 2 = 0")):
        catalog.save_snapshot(df, root, "orders", "parquet", ["o_orderkey"])
    return root


@register("b08_save_snapshot", "SELECT 'orders' AS source, CAST(1 AS INTEGER) AS version, count(*) AS rows FROM orders UNION ALL SELECT 'orders', 2, count(*) FROM orders WHERE o_orderkey % 2 = 0")
def b08(spark, d):
    return catalog.snapshots(spark, saved(spark, d)).select("source", "version", "rows")


@register("d01_table_stats", """SELECT 'o_orderkey' AS column_name, count(*) AS row_count, count(*) - count(o_orderkey) AS nulls, CAST(min(o_orderkey) AS DOUBLE) AS min, CAST(max(o_orderkey) AS DOUBLE) AS max, round(avg(o_orderkey), 3) AS mean FROM orders
UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice), min(o_totalprice), max(o_totalprice), round(avg(o_totalprice), 3) FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), NULL, NULL, NULL FROM orders""")
def d01(spark, d):
    out = catalog.table_stats(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"))
    return out.select("column_name", "row_count", "nulls", "min", "max", F.round("mean", 3).alias("mean"))


@register("d02_key_set", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def d02(spark, d):
    return catalog.key_set(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


def digest_sql(source: str, cells: dict[str, str], key: str, name: str = "blocks") -> str:
    """CTEs ``name`` (block digests) and ``name_all`` (the table's), of rows as JSON made from the cells' texts in SQL."""
    body = " || ',' || ".join(f"'\"{c}\":' || coalesce('\"' || {x} || '\"', 'null')" for c, x in cells.items())
    head = json.dumps(list(cells))
    return f"""{name}_rows AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS p, sha256('{{' || {body} || '}}') AS h FROM {source}),
{name} AS (SELECT p // 4096 AS block, sha256(string_agg(h, '' ORDER BY p)) AS digest FROM {name}_rows GROUP BY 1),
{name}_all AS (SELECT sha256('{head}' || string_agg(digest, '' ORDER BY block)) AS digest FROM {name})"""


#: Integers and doubles of this size are written alike in both dialects.
PRICE = "CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END"
DAY = "strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.000000Z')"
SHIFTED = "CAST(o_orderkey + 9007199254740992 AS VARCHAR)"


@register("d03_logical_digest", "WITH " + digest_sql("orders", {"k": SHIFTED, "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_totalprice": PRICE, "o_orderstatus": "o_orderstatus", "o_orderdate": DAY}, "o_orderkey") + " SELECT block, digest FROM blocks")
def d03(spark, d):
    """Digests of rows that were dealt otherwise, written and read from JSON, with integers that no double holds."""
    path = fresh_path(spark, "digest")
    n = table(spark, d, "orders").select((F.col("o_orderkey") + F.lit(9007199254740992)).alias("k"), "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    writers.write_json(n.repartition(3), path)
    return catalog.block_digests(spark.read.schema(n.schema).json(path), ["o_orderkey"])


@register("d04_raw_digest", "SELECT g, CAST(sum(octet_length(encode(line))) AS BIGINT) AS length, sha256(string_agg(line, '' ORDER BY o_orderkey)) AS sha256 FROM (SELECT o_orderkey, o_orderkey // 1000 AS g, o_orderkey || ' ' || o_orderstatus || chr(10) AS line FROM orders) GROUP BY g")
def d04(spark, d):
    """A text file for each thousand of orders' keys; every other file is read in pieces."""
    path = fresh_path(spark, "lines")
    o = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 1000).alias("g"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderstatus").alias("value"))
    o.repartition("g").sortWithinPartitions("g", "o_orderkey").select("g", "value").write.partitionBy("g").text(path)
    whole = catalog.raw_digest(spark, path).agg(F.expr("percentile_approx(length, 0.5)")).first()[0]
    return catalog.raw_digest(spark, path, whole=whole).select(F.regexp_extract("path", r"/g=(\d+)/", 1).cast("long").alias("g"), "length", "sha256")


def saved_sql(name: str, where: str) -> str:
    """CTEs ``name...`` with the digest of a snapshot of orders."""
    return digest_sql(f"(SELECT * FROM orders WHERE {where})", {"o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_totalprice": PRICE, "o_orderdate": DAY}, "o_orderkey", name)


@register("d05_snapshot_id", f"""WITH {saved_sql('a', 'true')}, {saved_sql('b', 'o_orderkey % 2 = 0')}
SELECT digest AS logical_digest, sha256('{{"digest": "' || digest || '", "format": "parquet", "types": {{"o_orderdate": "timestamp_ntz", "o_orderkey": "bigint", "o_totalprice": "double"}}}}') AS snapshot_id FROM (SELECT * FROM a_all UNION ALL SELECT * FROM b_all)""")
def d05(spark, d):
    return catalog.snapshots(spark, saved(spark, d)).select("snapshot_id", "logical_digest")


def registry(spark, d):
    """Versions made from orders: a source for each customer."""
    from pyspark.sql import Window

    v = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderkey").cast("string").alias("snapshot_id"), v.alias("version"), F.col("o_orderstatus").alias("status"))


REGISTRY = "SELECT 'c' || o_custkey AS source, CAST(o_orderkey AS VARCHAR) AS snapshot_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderkey FROM orders"


@register("d06_register_version", f"SELECT 'c' || c_custkey AS source, coalesce(v, 0) + 1 AS version FROM customer LEFT JOIN (SELECT source, max(version) AS v FROM ({REGISTRY}) GROUP BY source) ON source = 'c' || c_custkey")
def d06(spark, d):
    new = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source"), F.lit("new").alias("snapshot_id"))
    return catalog.next_versions(registry(spark, d), new).select("source", F.col("version").cast("long").alias("version"))


def uses(spark, d):
    """An item uses its order's snapshot; that of every third order is not in use."""
    return table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey")).cast("string").alias("snapshot_id"))


@register("d07_reference_counts", "SELECT CAST(k AS VARCHAR) AS snapshot_id, count(*) AS \"references\" FROM (SELECT l_orderkey AS k FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY k")
def d07(spark, d):
    return catalog.reference_counts(uses(spark, d), registry(spark, d).where("status = 'P'"))


@register("d08_collect_unreferenced", f"WITH r AS ({REGISTRY}) SELECT source, snapshot_id, version FROM r WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 <> 0) AND (source, version) NOT IN (SELECT source, max(version) FROM r GROUP BY source)")
def d08(spark, d):
    return catalog.collect_unreferenced(registry(spark, d), catalog.reference_counts(uses(spark, d))).select("source", "snapshot_id", F.col("version").cast("long").alias("version"))


@register("d09_verify_snapshot", "SELECT 'whole' AS snapshot, o_orderkey, o_totalprice, o_orderdate, row_number() OVER (ORDER BY o_orderkey) - 1 AS __ordinal FROM orders")
def d09(spark, d):
    """The rows of those snapshots that are what was written: one whole, one tampered with, one unknown."""
    root = saved(spark, d)
    first, second = [r["snapshot_id"] for r in catalog.snapshots(spark, root).orderBy("version").collect()]
    spark.read.parquet(f"{root}/data/snapshot_id={second}").limit(1).write.mode("append").partitionBy(catalog.SEGMENT).parquet(f"{root}/data/snapshot_id={second}")
    found = {n: catalog.read_snapshot(spark, root, i, verify=True) for n, i in (("whole", first), ("tampered", second), ("unknown", "none"))}
    parts = [df.select(F.lit(n).alias("snapshot"), "o_orderkey", "o_totalprice", "o_orderdate", "__ordinal") for n, df in found.items() if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@register("d09_changed_blocks", """SELECT block, CASE WHEN bool_and(gone) THEN 'missing' ELSE 'changed' END AS fault FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS block, o_orderkey % 701 = 0 AS other, row_number() OVER (ORDER BY o_orderkey DESC) <= 200 AS gone FROM orders) GROUP BY block HAVING bool_or(other) OR bool_or(gone)""")
def d09_blocks(spark, d):
    """The blocks of a snapshot in which some prices are not what was written, and of which the last rows are gone."""
    root = fresh_path(spark, "snapshots")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    sid = catalog.save_snapshot(o, root, "orders", "parquet", ["o_orderkey"], block=64, segment=1024)
    n, other = o.count(), fresh_path(spark, "tampered")
    price = F.when(F.col("o_orderkey") % 701 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    catalog.read_snapshot(spark, root, sid).where(F.col("__ordinal") < n - 200).withColumn("o_totalprice", price).write.parquet(other)
    found = catalog.digest_tree(spark.read.parquet(other), ordinal="__ordinal", block=64)
    return catalog.changed_blocks(found, catalog.snapshot_tree(spark, root, sid))


@register("j01_diff_snapshots", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS __ordinal, 'o_totalprice' AS \"column\", o_orderkey FROM orders QUALIFY o_orderkey % 701 = 0 UNION ALL SELECT row_number() OVER (ORDER BY o_orderkey) - 1, 'o_orderstatus', o_orderkey FROM orders QUALIFY o_orderkey % 997 = 0")
def j01_snapshots(spark, d):
    """Cells in which two snapshots differ, from the blocks that their digest trees name."""
    root, k = fresh_path(spark, "snapshots"), F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.select("o_orderkey", F.when(k % 701 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(k % 997 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    ids = [catalog.save_snapshot(x, root, "orders", "parquet", ["o_orderkey"], block=64, segment=1024) for x in (o, new)]
    found = catalog.diff_snapshots(spark, root, *ids)
    keys = catalog.read_snapshot(spark, root, ids[0]).select("__ordinal", "o_orderkey")
    return found.select("__ordinal", "column").join(keys, "__ordinal")


def experiments(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("x"), (F.col("user_id") % 100).cast("string")).alias("id"), F.col("event_id").alias("revision"), F.col("props").alias("body"))


@register("d10_save_experiment", "SELECT 'x' || (user_id % 100) AS id, event_id AS revision FROM events WHERE event_id % 4 = 0")
def d10(spark, d):
    e = experiments(spark, d)
    return catalog.save_experiments(e.where("revision % 4 <> 0"), e.where("revision % 4 < 2")).select("id", "revision")


@register("d11_latest_revision", "SELECT 'x' || (user_id % 100) AS id, max(event_id) AS revision, arg_max(props, event_id) AS body FROM events GROUP BY 1")
def d11(spark, d):
    return catalog.latest_revisions(experiments(spark, d))


@register("d12_strip_credentials", "SELECT event_id, '{\"k\":\"' || json_extract_string(props, '$.k') || '\",\"list\":[{\"type\":\"' || event_type || '\"}],\"inner\":{\"user\":\"' || user_id || '\"}}' AS params FROM events")
def d12(spark, d):
    """Secrets at the top, in a list of structs and in a map."""
    k, user = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    params = F.struct(k.alias("k"), k.alias("apiToken"), F.array(F.struct(F.col("event_type").alias("type"), user.alias("PASSWORD_2"))).alias("list"), F.create_map(F.lit("user"), user, F.lit("authorization"), k).alias("inner"))
    x = table(spark, d, "events").select("event_id", params.alias("params"))
    return x.select("event_id", F.to_json(catalog.strip_credentials(F.col("params"), x.schema["params"].dataType)).alias("params"))


@register("d13_restore_check", """WITH x AS (SELECT l_orderkey // 40 AS id, CASE WHEN l_orderkey // 40 % 9 <> 2 THEN l_orderkey END AS s FROM lineitem), e AS (SELECT CAST(id AS VARCHAR) AS id, count(s) AS n, count(DISTINCT CASE WHEN o_orderkey IS NULL THEN s END) AS missing FROM x LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 7 AND o_orderkey % 97 <> 0) ON s = o_orderkey GROUP BY 1)
SELECT id, CASE WHEN missing > 0 THEN 'needs-data' WHEN n = 0 THEN 'corrupt' ELSE 'restored' END AS status, missing FROM e UNION ALL SELECT DISTINCT 'x' || c_custkey, 'missing', 0 FROM customer""")
def d13(spark, d):
    """Experiments made of orders' keys, some with none; snapshots of some keys are gone, of others corrupt; ids that no experiment has."""
    snap = F.when(F.floor(F.col("l_orderkey") / 40) % 9 != 2, F.col("l_orderkey").cast("string"))
    e = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 40).cast("string").alias("id")).agg(F.collect_list(snap).alias("snapshots"))
    r = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("snapshot_id"), "o_orderkey")
    wanted = e.select("id").union(table(spark, d, "customer").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string"))))
    out = catalog.restore_check(e, r.where("o_orderkey % 50 <> 7"), r.where("o_orderkey % 97 = 0"), wanted)
    return out.select("id", "status", F.size("missing").cast("long").alias("missing"))


@register("j03_round_trip", "SELECT format, true AS same_digest, true AS has_metadata, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || '\"a\",' || chr(10) ELSE c_name END AS c_name, c_acctbal, c_mktsegment FROM customer, (VALUES ('csv'), ('parquet'), ('arrow')) AS t(format)")
def j03(spark, d):
    """The rows that come back from each format, beside what the check by digest says; some names have line breaks and quotes."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit('\n"a",\n'))).otherwise(F.col("c_name"))
    c = table(spark, d, "customer").select("c_custkey", name.alias("c_name"), "c_acctbal", "c_mktsegment")
    said = writers.round_trip_check(c, fresh_path(spark, "trip"), ["c_custkey"])
    out = None
    for fmt, back in writers.round_trip(c, fresh_path(spark, "trip")).items():
        part = back.select(F.lit(fmt).alias("format"), F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal", "c_mktsegment")
        out = part if out is None else out.union(part)
    return out.join(F.broadcast(said), "format")  # three rows


@register("j04_stats_check", "SELECT 'c_acctbal' AS column_name, 'mean' AS \"column\" FROM customer HAVING count(*) > 0")
def j04(spark, d):
    s = stored(catalog.table_stats(table(spark, d, "customer").select("c_custkey", "c_acctbal")), "stats")
    wrong = s.withColumn("mean", F.col("mean") + F.when(F.col("column_name") == "c_acctbal", 0.5).otherwise(1e-9))
    return recon.stats_check(s, wrong).select("column_name", "column")
