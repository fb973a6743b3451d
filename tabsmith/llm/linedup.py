"""Line dedup over overlapping windows of three lines, in DataFrame operations only.

Every three consecutive lines are hashed; of windows that occur more than once in the whole corpus
all occurrences but the first, by (doc_id, line number), are dropped, and a line goes if any dropped
window covers it. A document of one or two lines is one window of all its lines.

Defined cases: a null text has no lines and keeps null; windows of blank lines only don't count; rows
that share a doc_id are versions of one document, so windows at the same line of both are one
occurrence; null ids come first; a text of any length is one row, whose lines and covered lines are arrays, and must fit a task's memory some ten times; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import join_counted, materialize, same, table, text_key


def drop_repeated_lines(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """``doc_id, text`` → ``doc_id, n_lines, n_removed, removed`` (line numbers from 0), ``kept_text``."""
    lines = F.split("text", "\n")
    base = docs.select("doc_id", "text", text_key(F.col("text")).alias("_v"))
    # lines of a window that lie beyond the last one are null and hash as nothing
    at = [F.get(F.col("_l"), F.col("pos") + k) for k in range(width)]
    starts = F.sequence(F.lit(0), F.greatest(F.size("_l") - width, F.lit(0)))
    rows = base.where("text is not null").withColumn("_l", lines).withColumn("pos", F.explode(starts))
    rows = rows.where(F.trim(F.concat_ws("", *at)) != "")
    rows = rows.select("doc_id", "_v", "pos", F.struct(F.xxhash64(*at).alias("h1"), F.xxhash64(F.lit(1), *at).alias("h2")).alias("key"))
    rows = materialize(rows, "line-windows")

    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max(F.struct("doc_id", "pos")).alias("last"), F.count(F.lit(1)).alias("_n"))
    first = materialize(first.where(~same(F.col("first"), F.col("last"))).drop("last"), "line-repeated")
    # a window that a great part of all texts have is joined by broadcast
    later = join_counted(rows, first, "key", rows.count(), written=True).where(~same(F.struct("doc_id", "pos"), F.col("first")))
    drop = later.groupBy("doc_id", "_v").agg(F.collect_set("pos").alias("_starts"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (width - 1))))))

    d, g = base.alias("d"), drop.alias("g")
    out = d.join(g, same(F.col("d.doc_id"), F.col("g.doc_id")) & (F.col("d._v") == F.col("g._v")), "left").select("d.doc_id", "text", "_starts")
    out = out.withColumn("_l", lines).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("_l")))
    gone = F.filter(covered, lambda i: i < F.col("n_lines"))
    out = out.withColumn("removed", F.coalesce(gone, F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("removed"))
    kept = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_l"), i)), "\n"))
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", kept.alias("kept_text"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), "kept_text")


OP5_SQL = """
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT doc_id, ls, unnest(range(0, greatest(len(ls) - 3, 0) + 1)) AS pos FROM l
), h AS (
  SELECT doc_id, pos, [ls[pos + 1], ls[pos + 2], ls[pos + 3]] AS k FROM w
  WHERE trim(concat(ls[pos + 1], ls[pos + 2], ls[pos + 3])) <> ''
), f AS (
  SELECT k, min({'d': doc_id, 'p': pos}) AS first FROM h GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT h.doc_id, unnest(range(h.pos, h.pos + 3)) AS i
  FROM h JOIN f ON h.k = f.k WHERE {'d': h.doc_id, 'p': h.pos} <> f.first
), g AS (
  SELECT doc_id, list(i ORDER BY i) AS r FROM gone JOIN l USING (doc_id) WHERE i < len(ls) GROUP BY doc_id
)
SELECT d.doc_id,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
       CAST(coalesce(len(r), 0) AS INTEGER) AS n_removed,
       coalesce(array_to_string(r, ','), '') AS removed,
       CASE WHEN r IS NULL THEN d.text ELSE array_to_string(
         list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(r, i - 1)), chr(10)) END AS kept_text
FROM documents d LEFT JOIN g USING (doc_id)
"""
