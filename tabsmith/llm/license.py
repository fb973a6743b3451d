"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

DataFrame operations only. Words are runs of other characters than ASCII blanks, controls and punctuation,
in lower case. A template's shingles are of five words, or of all its words if it has fewer. A text is cut in
windows of four shingles, every second word starting one (two shingles for a size below five), templates in
pieces of at most four; a window and a piece collide if any of 16 minima is equal. A piece lies within a
window to half at least, or is one of its four shingles, which collides with probability 1-(3/4)^16 = 0.99 in
each of the two windows that have it; for four shared shingles of eight it is 1-2^-16. Shingle hashes are
random words, so the minimum of hash xor seed serves as a random order.

A minimum that a window shares with a piece is that of a shingle they share. So a text's shingles are hashed once, where the
first word is the first of a template's shingle; places that hold a template's shingle are kept, and only the windows
about these are made and banded, which loses none. A template that a window retrieves is found if somewhere within one and
a half times its length stand ``least`` of its distinct shingles.

Defined cases: null and empty texts hold no template; a text that has a template several times has one
row for it, at the first place; of the places with ``least`` shingles the first counts; rows with the same doc_id are one document, but a
template is sought in each text by itself; a null doc_id is a document; a text of any length takes time by its length and must
fit a task's memory some thirty times, as an array of words; an empty table or no templates give an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import materialize, same, table, text_key
from tabsmith.llm.license_texts import NOTICES, TEXTS

#: Name → text.
TEMPLATES = NOTICES | TEXTS
SIZE, BANDS, STEP = 5, 16, 2
SEEDS = [(k * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64) - (1 << 63) for k in range(1, BANDS + 1)]


def word_array(text: Column) -> Column:
    found = F.split(F.lower(text), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    return F.when(found[0] == "", F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)


def shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def shingle_set(words: Column, size: int) -> Column:
    n = F.size(words) - size
    return F.when(n >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: shingle(words, i, size)))).otherwise(F.array().cast("array<long>"))


def lowest(hashes: Column, seed: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(seed))))


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows, as one literal."""
    names = [x.split(":")[0] for x in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def prepared(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Each template's shingle size, shingles and the minima of its pieces; as large as the template list."""
    if not templates:
        return []
    out = []
    rows = listed(spark, list(templates.items()), "name:string,text:string").withColumn("w", F.filter(word_array(F.col("text")), lambda x: x != ""))
    sized = rows.select("name", "w", F.least(F.size("w"), F.lit(SIZE)).alias("k")).where("k > 0").collect()
    for k in sorted({r["k"] for r in sized}):
        part = rows.where(F.least(F.size("w"), F.lit(SIZE)) == k).select("name", "w", F.size("w").alias("n"), shingle_set(F.col("w"), k).alias("s"))
        starts = F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)), F.lit(4))
        piece = part.withColumn("p", F.explode(F.transform(starts, lambda i: F.slice("s", F.greatest(F.least(i, F.size("s") - 4), F.lit(0)) + 1, 4))))
        least = F.array(*[lowest(F.col("p"), s) for s in SEEDS])
        for r in piece.groupBy("name", "w", "n", "s").agg(F.collect_list(least).alias("m")).orderBy("name").collect():
            out.append({"name": r["name"], "words": r["n"], "k": k, "firsts": r["w"][: r["n"] - k + 1], "shingles": r["s"], "minima": r["m"]})
    return out


def only_with(df: DataFrame, has: Column, *columns: str) -> DataFrame:
    """Rows with ``has``. A Generate, not a filter, so that what ``has`` reads is not computed again below it."""
    return df.select("doc_id", "ver", F.explode(F.when(has, F.array(F.struct(*columns)))).alias("_x")).select("doc_id", "ver", "_x.*")


def places(base: DataFrame, known: list[dict]) -> DataFrame:
    """``doc_id, ver, w`` (words) → ``doc_id, ver, hits, windows`` of texts that hold a template's shingle: the places and hashes of such
    shingles, and the hashes of all shingles of the windows about them, each with its shingle size ``k``."""
    w, firsts = F.col("w"), sorted({x for t in known for x in t["firsts"]})
    sizes = sorted({t["k"] for t in known})
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get(w, i).isin(firsts))
    x = only_with(base.withColumn("starts", starts), F.size("starts") > 0, "w", "starts")

    def held(k: int) -> Column:
        mine = sorted({h for t in known if t["k"] == k for h in t["shingles"]})
        return F.filter("starts", lambda i: shingle(w, i, k).isin(mine))

    x = x.select("doc_id", "ver", "w", *[held(k).alias(f"at{k}") for k in sizes])
    some = F.greatest(*[F.size(f"at{k}") for k in sizes], F.lit(0)) > 0
    x = only_with(x, some, "w", *[f"at{k}" for k in sizes])

    def hits(k: int) -> Column:
        return F.transform(f"at{k}", lambda i: F.struct(F.lit(k).alias("k"), i.alias("i"), shingle(w, i, k).alias("h")))

    def windows(k: int) -> Column:
        wide = 4 if k == SIZE else STEP
        about = F.transform(f"at{k}", lambda i: F.filter(F.sequence(F.greatest(i - wide + 1, F.lit(0)), i), lambda s: s % STEP == 0))
        return F.transform(F.array_distinct(F.flatten(about)), lambda s: F.struct(F.lit(k).alias("k"), s.alias("i"), F.array(*[shingle(w, s + j, k) for j in range(wide)]).alias("h")))

    return x.select("doc_id", "ver", F.concat(*map(hits, sizes)).alias("hits"), F.concat(*map(windows, sizes)).alias("windows"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, least: float = 0.8) -> DataFrame:
    """``doc_id, text`` → a row per document and template found: ``doc_id, license, containment, first_word``
    (of the first place that has it), ``windows`` (that retrieved it)."""
    spark = docs.sparkSession
    known = prepared(spark, TEMPLATES if templates is None else templates)
    if not known:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).cast("long").alias("windows")).where(F.lit(False))
    base = docs.select("doc_id", text_key(F.col("text")).alias("ver"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    found = materialize(places(base, known), "license-places")
    # both lists are as large as the template list
    pairs = sorted({(t["k"] * BANDS + b, v, n) for n, t in enumerate(known) for m in t["minima"] for b, v in enumerate(m)})
    index = listed(spark, pairs, "band:int,value:bigint,t:int")
    wanted = listed(spark, [(n, t["name"], t["k"], h, t["words"], len(t["shingles"])) for n, t in enumerate(known) for h in t["shingles"]], "t:int,license:string,k:int,h:bigint,words:int,n:int")

    each = F.array(*[F.struct((F.col("k") * BANDS + b).alias("band"), lowest(F.col("h"), s).alias("value")) for b, s in enumerate(SEEDS)])
    cand = found.select("doc_id", "ver", F.inline("windows")).select("doc_id", "ver", "i", F.inline(each))
    cand = cand.join(F.broadcast(index), ["band", "value"]).select("doc_id", "ver", "t", "i").distinct()
    cand = cand.groupBy("doc_id", "ver", "t").agg(F.count(F.lit(1)).alias("windows"))
    held = found.select("doc_id", "ver", F.inline("hits")).join(F.broadcast(wanted), ["k", "h"]).drop("k").distinct()
    c, x = cand.alias("c"), held.alias("x")
    held = x.join(c, same(F.col("x.doc_id"), F.col("c.doc_id")) & (F.col("x.ver") == F.col("c.ver")) & (F.col("x.t") == F.col("c.t"))).select("x.*", "windows")
    ahead = Window.partitionBy("doc_id", "ver", "t").orderBy("place").rangeBetween(0, 1500)
    held = held.withColumn("place", F.floor(F.col("i") * 1000 / F.col("words")))
    held = held.withColumn("containment", F.size(F.collect_set("h").over(ahead)) / F.col("n")).where(F.col("containment") >= least - 1e-9)
    return held.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("i").alias("first_word"), F.max("windows").alias("windows"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("windows")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Brute force: every template against the shingles of every text.
OP8_SQL = (
    r"""
WITH t AS (SELECT license, regexp_extract_all(lower(body), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM (VALUES """
    + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())
    + r""") AS x(license, body)
), ts AS (
  SELECT DISTINCT license, len(w) AS words, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM t, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS u(i)
), tn AS (
  SELECT license, count(*) AS n FROM ts GROUP BY license
), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM documents WHERE text IS NOT NULL
), h AS (
  SELECT doc_id, k, i - 1 AS i, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM ts) AS ks, unnest(range(1, len(w) - k + 2)) AS u(i)
), m AS (
  SELECT doc_id, license, i, s, n, floor(i * 1000 / words) AS place FROM h JOIN ts USING (k, s) JOIN tn USING (license)
), c AS (
  SELECT a.doc_id, a.license, a.i, count(DISTINCT b.s) / a.n AS containment FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.license = b.license AND b.place BETWEEN a.place AND a.place + 1500
  GROUP BY a.doc_id, a.license, a.i, a.n
)
SELECT doc_id, license, max(containment) AS containment, CAST(min(i) AS INTEGER) AS first_word FROM c WHERE containment >= 0.8 - 1e-9 GROUP BY doc_id, license
"""
)
