"""Substring dedup: MinHash banding over paragraphs cut where the text itself says so.

A document's words are cut into paragraphs of about eleven words before each word whose hash (with the next word's) is
the least within five words on either side. Line breaks don't count: a passage has the same cuts wherever it stands and
however it is wrapped, but for its first and last words, so its inner paragraphs are equal in all documents. Only at
the ends of a document can a paragraph have less than five words; it is not compared.

1. A paragraph's key in each of 3 bands is one MinHash of its five-word shingles: at a Jaccard similarity of 0.8
   a pair shares a key with probability 1-0.2^3 = 0.99, equal paragraphs always do. The keys are written, one row a document,
   and sorted once; only paragraphs with a key that occurs more than once go on.
2. Of these, different paragraphs that share a key are banded again, more finely, linked to a leader of their bucket by exact
   similarity (see ``near.candidate_links``) and grouped by components; all pairs of a group are compared in
   blocks, and similar ones joined to one class by components.
3. All occurrences of a class but the first, by (doc_id, text, word), are to be removed. Neighbouring repeated
   paragraphs of a document are one passage; a passage counts from ``least_words`` words on. (Of
   a passage of fifty words inside other text about thirty stand in whole paragraphs.)
4. A changed word spoils its paragraph, and the edges of a passage are in none. So runs below ``least_words``, and runs beside
   another, are seeds: each is held with the words around it against the first and last occurrence of its classes, and of its classes with that of
   the repeated paragraph before or after (which two copies of a passage share beyond an edit), and grown
   word by word to both sides by a banded alignment (equal words count 1, others -2). A stretch of
   ``least_stretch`` words of which the share ``similar`` is equal in order is a passage too. The words are kept as
   16-bit marks from the second reading of the texts, so there is no third.

With ``across``, what is repeated within one document only is no passage.

Defined cases: null and empty texts have no paragraph; rows equal in doc_id and text are one document, rows of one
doc_id with other texts are documents of their own (``ver`` tells them apart); a null doc_id orders first; a text of any length is one
row, and must fit a task's memory about forty times; an empty table gives an empty result; other columns are ignored. The pairs compared in a group of many different but colliding
paragraphs grow with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import discard, join_counted, materialize, same, table
from tabsmith.llm.components import components
from tabsmith.llm.near import _beside, candidate_links, compare, lowered, numbered, set_jaccard, set_keys, shared_keys  # noqa: F401
from tabsmith.llm.numtext import MOST_ROWS, U64, Words, band_keys, list_array, minhash, mix64, pieces, seeds, shingles

SIZE, SIMILAR, BANDS, ROWS, REACH = 5, 0.8, 3, 1, 5
#: Bands among the paragraphs that share a key: 1-(1-0.8^6)^16 = 0.992 at 0.8, and small buckets below.
FINE_BANDS, FINE_ROWS = 16, 6
#: Words before and from a seed's first word on that are aligned, how far an alignment may leave the diagonal, and what an unequal
#: word costs. Runs at most ``BESIDE`` words apart are grown over the gap.
BEFORE, AFTER, DRIFT, COST, BESIDE = 60, 90, 4, 2, 40


def cuts(w: Words, reach: int = REACH) -> np.ndarray:
    """Whether each word starts a paragraph."""
    n = len(w.hash)
    start = np.zeros(n, bool)
    start[w.first[:-1][w.first[:-1] < n]] = True
    row = np.cumsum(start)
    with np.errstate(over="ignore"):
        h = w.hash.copy()
        h[:-1] = mix64(w.hash[:-1] + (w.hash[1:] << U64(1)))
    least = np.ones(n, bool)
    for d in range(1, min(reach, n - 1) + 1):
        apart = row[d:] != row[:-d]
        least[d:] &= apart | (h[d:] < h[:-d])
        least[:-d] &= apart | (h[:-d] <= h[d:])
    return start | least


def paragraphs(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """In slices: each paragraph's row, first word in the row, number of words, shingles and their offsets."""
    at = np.flatnonzero(cuts(w)) if len(w.hash) else np.zeros(0, np.int64)
    end = np.append(at[1:], len(w.hash))[: len(at)]
    row = np.searchsorted(w.first, at, "right") - 1
    for k in range(0, len(at), MOST_ROWS):
        a, e, r = at[k : k + MOST_ROWS], end[k : k + MOST_ROWS], row[k : k + MOST_ROWS]
        lo = a[0]
        part = Words(w.data, w.start[lo : e[-1]], w.end[lo : e[-1]], w.hash[lo : e[-1]], np.append(a, e[-1]) - lo)
        value, off = shingles(part, SIZE)
        size = e - a
        keep = size >= SIZE
        value = value[np.repeat(keep, np.diff(off))]
        off = np.concatenate([[0], np.cumsum(np.diff(off)[keep])])
        yield r[keep], (a - w.first[r])[keep], size[keep], value, off


def _keys(sown: np.ndarray):
    """The keys of all paragraphs of a document, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in pieces(batch):
                found = [(row, band_keys(minhash(value, off, sown), BANDS, ROWS)) for row, _, _, value, off in paragraphs(w)]
                row = np.concatenate([np.zeros(0, np.int64), *[r for r, _ in found]])
                key = np.concatenate([np.zeros((0, BANDS), U64), *[k for _, k in found]])
                off = np.searchsorted(row, np.arange(part.num_rows + 1)) * BANDS
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ver"), list_array(key.reshape(-1).view(np.int64), off, pa.int64())], ["doc_id", "ver", "keys"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``no, key`` sorted by no → a row of keys for each no. The last of a batch waits for the next."""

    def out(no: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.append(True, no[1:] != no[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(no[at]), list_array(key, np.append(at, len(no)), pa.int64())], ["no", "keys"])

    key, no = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, no = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in ((key, "key"), (no, "no")))
        last = int(np.searchsorted(no, no[-1], "left")) if len(no) else 0
        if last:
            yield out(no[:last], key[:last])
            key, no = key[last:], no[last:]
    if len(no):
        yield out(no, key)


ITEMS = "doc_id long, ver long, first int, words int, cls binary, n_shingles int, shingles array<long>, bands array<long>, marks binary"


def _items(sown: np.ndarray):
    """Paragraphs of a document whose keys are among ``keys``; and, with ``first`` null, all its words as ``marks``."""
    names = [x.split()[0] for x in ITEMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in pieces(batch):
                n = part.num_rows
                ids, ver, wanted = part.column("doc_id"), part.column("ver"), part.column("keys")
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, ver, *none, marks(w)], names)
                koff, kval = wanted.offsets.to_numpy(), wanted.values.to_numpy().view(U64)
                own = np.repeat(np.arange(n), np.diff(koff))
                sought = kval[koff[0] : koff[-1]] ^ mix64(own.astype(U64))
                for row, first, size, value, off in paragraphs(w):
                    key = band_keys(minhash(value, off, sown), BANDS, ROWS)
                    hit = np.flatnonzero(np.isin(key ^ mix64(row.astype(U64))[:, None], sought).any(axis=1))
                    keep = np.zeros(len(off) - 1, bool)
                    keep[hit] = True
                    mine = value[np.repeat(keep, np.diff(off))]
                    o = np.concatenate([[0], np.cumsum(np.diff(off)[hit])])
                    at = pa.array(row[hit])
                    cols = [
                        ids.take(at),
                        ver.take(at),
                        pa.array(first[hit], pa.int32()),
                        pa.array(size[hit], pa.int32()),
                        pa.array(set_keys(mine, o), pa.binary()),
                        pa.array(np.diff(o), pa.int32()),
                        list_array(mine.view(np.int64), o, pa.int64()),
                        list_array(key[hit].reshape(-1).view(np.int64), np.arange(len(hit) + 1) * BANDS, pa.int64()),
                        pa.nulls(len(hit), pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def marks(w: Words) -> pa.Array:
    """Two bytes for each word of a row."""
    short = (mix64(w.hash) >> U64(48)).astype("<u2")
    return pa.Array.from_buffers(pa.binary(), len(w.first) - 1, [None, pa.py_buffer((w.first * 2).astype(np.int32)), pa.py_buffer(short.tobytes())])


def _finely(fine: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("shingles")
            off = col.offsets.to_numpy().astype(np.int64)
            value = col.values.to_numpy()[off[0] : off[-1]].view(U64)
            key = band_keys(minhash(value, off - off[0], fine), FINE_BANDS, FINE_ROWS)
            bands = list_array(key.reshape(-1).view(np.int64), np.arange(len(key) + 1) * FINE_BANDS, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("no"), col, bands], ["no", "shingles", "bands"])

    return run


def grow(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of two matrices of words (negative where there is none): how many words of either the best
    alignment from their starts takes, and how many of them are equal."""
    n, size = x.shape
    wide, none = 2 * DRIFT + 1, np.int32(-(1 << 20))
    steps = np.arange(wide) - DRIFT
    score = np.full((wide + 2, n), none)  # by y's lead over x, with a border on either side
    equal = np.zeros((wide + 2, n), np.int32)
    for k in range(DRIFT, wide):
        score[k + 1] = -COST * steps[k]
    best, took_x, took_y, same_ = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(size):
        old, was = score.copy(), equal.copy()
        for k in range(wide):
            j = i + steps[k]
            now, have = old[k + 2] - COST, was[k + 2]  # x's word has no partner
            if 0 <= j < y.shape[1]:
                hit = x[:, i] == y[:, j]
                by = old[k + 1] + np.where(hit, 1, -COST)
                better = by > now
                now, have = np.where(better, by, now), np.where(better, was[k + 1] + hit, have)
            if j >= 0:
                by = score[k] - COST  # y's word has no partner
                better = by > now
                now, have = np.where(better, by, now), np.where(better, equal[k], have)
            elif j < -1:
                now = np.full(n, none)
            score[k + 1], equal[k + 1] = now, have
            up = now > best
            best = np.where(up, now, best)
            took_x, took_y, same_ = np.where(up, i + 1, took_x), np.where(up, j + 1, took_y), np.where(up, have, same_)
    return took_x, took_y, same_


def _stretches(least_stretch: int, similar: float):
    def matrix(col: pa.Array, at: np.ndarray, sign: int, size: int, pad: int) -> np.ndarray:
        out = np.full((len(at), size), pad, np.int32)
        for k, raw in enumerate(col.to_pylist()):
            v = np.frombuffer(raw, "<u2")
            v = v[at[k] :][:size] if sign > 0 else v[: at[k]][::-1][:size]
            out[k, : len(v)] = v
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                ax, ay = batch.column("at").to_numpy(), batch.column("to_at").to_numpy()
                left, right = (grow(matrix(batch.column("near"), ax, s, n, -1), matrix(batch.column("to_near"), ay, s, n, -2)) for s, n in ((-1, BEFORE), (1, AFTER)))
                long, other, equal = (a + b for a, b in zip(left, right, strict=True))
                keep = np.flatnonzero((long >= least_stretch) & (equal >= similar * np.maximum(long, other)))
                first = batch.column("first").to_numpy()[keep] - left[0][keep]
                rows = pa.array(keep)
                of = [batch.column(c).take(rows) for c in ("doc_id", "ver", "gone", "kept_doc")]
                yield pa.RecordBatch.from_arrays([*of[:2], pa.array(first, pa.int32()), pa.array(long[keep], pa.int32()), *of[2:]], ["doc_id", "ver", "first", "words", "gone", "kept_doc"])

    return run


DOC = ["doc_id", "ver"]


def _same_doc(a: str, b: str, *more: str) -> Column:
    """Whether rows under two aliases are of one document, and have equal ``more``."""
    out = same(F.col(f"{a}.doc_id"), F.col(f"{b}.doc_id"))
    for c in ("ver", *more):
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def _grown(words: DataFrame, rep: DataFrame, least_words: int, least_stretch: int, similar: float) -> DataFrame:
    """``doc_id, ver, first, words, gone, kept_doc`` of stretches about the paragraphs of short or neighbouring runs; ``words``: the
    documents' marks."""
    seed = rep.where((F.col("run_words") < least_words) | (F.col("beside") <= BESIDE))
    place = F.struct(*DOC, "first")
    pairs = seed.select(*DOC, "first", "run", F.explode(F.array("lead", "last")).alias("to"))
    for beside in ("next", "prior"):
        # of occurrences between the first and the last, those whose repeated paragraph beside is of one class too
        two = rep.where(F.col(beside).isNotNull()).select(F.struct("lead", beside).alias("key"), place.alias("place"))
        two = two.groupBy("key").agg(F.min("place").alias("_lead"), F.max("place").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        own = seed.where(F.col(beside).isNotNull()).select(*DOC, "first", "run", F.struct("lead", beside).alias("key"))
        own = join_counted(own, two, "key", rep.count())
        pairs = pairs.unionByName(own.select(*DOC, "first", "run", F.explode(F.array("_lead", "_last")).alias("to")))
    pairs = pairs.where(~same(place, F.col("to")))
    # along one diagonal all seeds of a run grow alike
    shift = F.col("to.first") - F.col("first")
    pairs = pairs.groupBy(*DOC, "run", F.col("to.doc_id").alias("to_doc"), F.col("to.ver").alias("to_ver"), shift.alias("shift")).agg(F.min("first").alias("first"))
    pairs = materialize(pairs.select(*DOC, "first", "to_doc", "to_ver", (F.col("first") + F.col("shift")).alias("to_first")), "passage-seeds")
    target = pairs.select(F.col("to_doc").alias("doc_id"), F.col("to_ver").alias("ver"), F.col("to_first").alias("first"))
    firsts = pairs.select(*DOC, "first").union(target).groupBy(*DOC).agg(F.collect_set("first").alias("firsts"))
    held = words.alias("d").join(firsts.alias("f"), _same_doc("d", "f")).select("d.doc_id", "d.ver", "marks", "firsts")

    def around(first: Column) -> Column:
        low = F.greatest(first - BEFORE, F.lit(0))
        return F.struct(first.alias("first"), F.substr("marks", 2 * low + 1, 2 * (first + AFTER - low)).alias("near"), (first - low).alias("at"))

    near = materialize(held.select(*DOC, F.inline(F.transform("firsts", around))).dropDuplicates([*DOC, "first"]), "passage-around")
    of = pairs.alias("p").join(near.alias("x"), _same_doc("p", "x", "first")).select("p.*", "near", "at")
    to = near.select(F.col("doc_id").alias("to_doc"), F.col("ver").alias("to_ver"), F.col("first").alias("to_first"), F.col("near").alias("to_near"), F.col("at").alias("to_at"))
    equal = same(F.col("p.to_doc"), F.col("y.to_doc")) & (F.col("p.to_ver") == F.col("y.to_ver")) & (F.col("p.to_first") == F.col("y.to_first"))
    both = of.alias("p").join(to.alias("y"), equal)
    gone = F.struct("p.to_doc", "p.to_ver", "p.to_first") < F.struct("p.doc_id", "p.ver", "p.first")
    both = both.select("p.doc_id", "p.ver", "p.first", "near", "at", "to_near", "to_at", gone.alias("gone"), F.when(gone, F.col("p.to_doc")).otherwise(F.col("p.doc_id")).alias("kept_doc"))
    return both.mapInArrow(_stretches(least_stretch, similar), "doc_id long, ver long, first int, words int, gone boolean, kept_doc long")


def _numbered(rep: DataFrame) -> DataFrame:
    """With ``run``, the number of the run of neighbouring rows of a document."""
    along = Window.partitionBy(*DOC).orderBy("first", "words")
    before = F.max(F.col("first") + F.col("words")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rep = rep.withColumn("new", F.coalesce((F.col("first") - before >= SIZE).cast("int"), F.lit(1)))
    return rep.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def _with_sizes(rep: DataFrame) -> DataFrame:
    """Rows once a place, with the words of their run and the words between it and the nearest run."""
    along = Window.partitionBy(*DOC).orderBy("first", "words")
    rep = _numbered(rep.withColumn("again", F.coalesce(F.lag("first").over(along) == F.col("first"), F.lit(False))).where("not again").drop("again"))
    ends = F.max(F.col("first") + F.col("words")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rep = rep.withColumn("ends", ends)
    to_next, own = F.lead("first").over(along) - F.col("ends"), Window.partitionBy(*DOC, "run")
    ahead, back = F.lead("first").over(along) - F.col("first"), F.col("first") - F.lag("first").over(along)
    rep = rep.withColumns({"next": F.when(ahead <= BESIDE, F.lead("lead").over(along)), "prior": F.when(back <= BESIDE, F.lag("lead").over(along))})
    rep = rep.withColumns({"after": F.when(to_next >= SIZE, to_next), "before": F.when(F.lag("run").over(along) != F.col("run"), F.lag("ends").over(along))})
    beside = F.least(F.max("after").over(own), F.min("first").over(own) - F.max("before").over(own))
    return rep.withColumns({"run_words": F.sum("words").over(own), "beside": beside}).drop("after", "before", "ends")


def _repeated_items(low: DataFrame, sown: np.ndarray) -> DataFrame:
    """A written table of the paragraphs that share a key with another, and of their documents' marks (see ``ITEMS``)."""
    keyed = low.mapInArrow(_keys(sown), "doc_id long, ver long, keys array<long>").withColumn("no", F.monotonically_increasing_id())
    keyed = materialize(keyed, "passage-keys")
    keys = keyed.select("no", F.explode("keys").alias("key"))
    shared = shared_keys(keys, keyed.agg(F.sum(F.size("keys"))).first()[0] or 0)
    wanted = shared.repartition("no").sortWithinPartitions("no").mapInArrow(_listed, "no long, keys array<long>")
    wanted = materialize(wanted.join(keyed.select("no", *DOC), "no").drop("no"), "passage-wanted")
    discard(keyed)
    # the keys of a partition's documents are held in a hash table, so that texts need not be sorted
    found = low.alias("d").join(wanted.hint("shuffle_hash").alias("k"), _same_doc("d", "k")).select("d.doc_id", "d.ver", "text", "keys")
    items = materialize(found.mapInArrow(_items(sown), ITEMS), "passage-items")
    discard(wanted)
    return items


def _twice(items: DataFrame, similar: float, across: bool) -> DataFrame:
    """A written table ``cls, lead, last, _n``: of classes that, with those that similar ones join, have more than one place, the first and last place,
    and the class's own number of paragraphs."""
    fine = seeds(FINE_BANDS * FINE_ROWS, 4)
    place = F.struct(*DOC, "first")
    classes = items.groupBy("cls").agg(F.first("bands").alias("bands"), F.first("shingles").alias("shingles"), F.first("n_shingles").alias("n_shingles"), F.min(place).alias("lead"), F.max(place).alias("last"), F.count(F.lit(1)).alias("_n"))
    classes = materialize(numbered(classes), "passage-classes")
    keyed = classes.select("no", F.explode("bands").alias("key"))
    several = keyed.groupBy("key").agg(F.min("no").alias("a"), F.max("no").alias("b")).where("a <> b").select("key")
    mixed = keyed.join(several, "key", "left_semi").select("no").distinct()
    few = classes.select("no", "shingles").join(mixed, "no", "left_semi")
    few = materialize(few.mapInArrow(_finely(fine), "no long, shingles array<long>, bands array<long>"), "passage-mixed")
    edges = candidate_links(few, "shingles", set_jaccard, link=2 * similar - 1, done=similar)
    discard(few)
    groups = components(edges)
    discard(edges)
    member = groups.union(groups.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "no")
    member = member.join(classes.select("no", "shingles", "n_shingles"), "no").withColumn("weight", F.lit(1).cast("long"))
    member = materialize(member, "passage-groups")
    discard(groups)
    near = materialize(compare(member, least=similar), "passage-near")
    discard(member)
    joined = components(near.select(F.col("no").alias("u"), F.col("low").alias("v")))
    alike = joined.union(joined.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "no")
    alike = materialize(alike.join(classes.select("no", "lead", "last"), "no"), "passage-alike")
    ends = alike.groupBy("root").agg(F.min("lead").alias("_lead"), F.max("last").alias("_last"), F.count(F.lit(1)).alias("_n"))
    ends = join_counted(alike.select("no", "root"), ends, "root", alike.count()).select("no", "_lead", "_last")
    lead, last = F.coalesce("_lead", "lead"), F.coalesce("_last", "last")
    out = classes.select("no", "cls", "lead", "last", "_n").join(ends, "no", "left").select("cls", lead.alias("lead"), last.alias("last"), "_n")
    apart = ~same(F.col("lead"), F.col("last"))
    if across:
        apart = ~same(F.col("lead.doc_id"), F.col("last.doc_id")) | (F.col("lead.ver") != F.col("last.ver"))
    out = materialize(out.where(apart), "passage-twice")
    discard(near, joined, alike, classes)
    return out


def repeated_passages(docs: DataFrame, *, least_words: int = 24, similar: float = SIMILAR, least_stretch: int = 45, across: bool = False) -> DataFrame:
    """``doc_id, text`` → a row per repeated passage of a document: ``doc_id, ver, first_word, end_word, words``
    (in repeated paragraphs or stretches), ``removed_words``, ``kept_doc`` (where its first paragraph occurs first)."""
    items = _repeated_items(lowered(docs), seeds(BANDS * ROWS, 3))
    cells = items.where("first is not null")
    twice = _twice(cells, similar, across)
    rep = join_counted(cells.select(*DOC, "first", "words", "cls"), twice, "cls", cells.count(), written=True)
    rep = rep.withColumns({"gone": ~same(F.struct(*DOC, "first"), F.col("lead")), "kept_doc": F.col("lead.doc_id")}).drop("cls")
    rep = materialize(_with_sizes(rep), "passage-repeated")
    discard(twice)
    grown = _grown(items.where("first is null").select(*DOC, "marks"), rep, least_words, least_stretch, similar)
    all_ = rep.select(*DOC, "first", "words", "gone", "kept_doc", F.col("words").alias("whole"), F.lit(False).alias("grown"))
    all_ = _numbered(all_.union(grown.select(*DOC, "first", "words", "gone", "kept_doc", F.lit(0), F.lit(True))))
    earlier = Window.partitionBy(*DOC, "run").orderBy("first", "words").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("first") + F.col("words")
    # rows overlap; each counts the words that none before it has
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("first"), F.coalesce(F.max(end).over(earlier), F.col("first"))))
    leaves = F.greatest(F.lit(0), end - F.greatest(F.col("first"), F.coalesce(F.max(F.when(F.col("gone"), end)).over(earlier), F.col("first"))))
    out = all_.withColumns({"fresh": fresh, "leaves": F.when(F.col("gone"), leaves).otherwise(0)}).groupBy(*DOC, "run").agg(
        F.min("first").alias("first_word"),
        F.max(end).alias("end_word"),
        F.sum("fresh").alias("words"),
        F.sum("leaves").alias("removed_words"),
        F.min_by("kept_doc", F.struct("first", "words", "kept_doc")).alias("kept_doc"),
        F.sum("whole").alias("whole"),
        F.max("grown").alias("grown"),
    )
    return out.where((F.col("whole") >= least_words) | F.col("grown")).drop("run", "whole", "grown")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("ver")
