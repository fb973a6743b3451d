"""Language ID by spans: script ranges narrow the candidates, then Viterbi over per-word scores.

A word's score for a language is the sum of log-probabilities of its letter triples (word ends
included), from hashed counts of labelled documents. A word in a script that a language was hardly seen in is
ruled out for it; words without letters, or in a script no language was seen in, score alike. The best
path over a document's words pays ``penalty`` for each change of language and so cuts the text in spans; the
document's language is that of most letters (as UTF-8 bytes), and its score that language's part of them.

``train_docs`` bounds the training sample: about so many documents of each language, chosen by a hash
of the id. Everything else covers whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so are all texts if nothing
was learned; texts with letters in unseen scripts only get the language of most training text and score 0;
ties go to the language that sorts first; a text of any length is one row, and must fit a task's memory about forty times, and more with many languages; null labels aren't learned from; rows repeat if they do in the input;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.common import table
from tabsmith.llm.numtext import _KIND, _LOWER, Words, pieces

BUCKETS, SEGMENT, RULED_OUT, FEW = 1 << 15, 128, -60.0, 16
#: Scripts by ranges of code points. Of a word's scripts the one that stands last in this list counts (kana before Han, as Japanese words mix them). What
#: lies in no range is no letter.
RANGES = (
    ("Latin", 0x41, 0x5A), ("Latin", 0x61, 0x7A), ("Latin", 0xC0, 0x24F), ("Latin", 0x250, 0x2AF), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0xFF21, 0xFF5A),
    ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F), ("Cyrillic", 0x1C80, 0x1C8F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x591, 0x5F4), ("Hebrew", 0xFB1D, 0xFB4F),
    ("Arabic", 0x600, 0x6FF), ("Arabic", 0x750, 0x77F), ("Arabic", 0x8A0, 0x8FF), ("Arabic", 0xFB50, 0xFDFF), ("Arabic", 0xFE70, 0xFEFC), ("Syriac", 0x700, 0x74F), ("Thaana", 0x780, 0x7BF),
    ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F), ("Gujarati", 0xA80, 0xAFF), ("Oriya", 0xB00, 0xB7F), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F),
    ("Kannada", 0xC80, 0xCFF), ("Malayalam", 0xD00, 0xD7F), ("Sinhala", 0xD80, 0xDFF), ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF), ("Tibetan", 0xF00, 0xFFF), ("Myanmar", 0x1000, 0x109F),
    ("Georgian", 0x10A0, 0x10FF), ("Georgian", 0x1C90, 0x1CBF), ("Ethiopic", 0x1200, 0x139F), ("Cherokee", 0x13A0, 0x13FF), ("Khmer", 0x1780, 0x17FF), ("Mongolian", 0x1800, 0x18AF),
    ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Han", 0xF900, 0xFAFF), ("Han", 0x20000, 0x323AF), ("kana", 0x3041, 0x30FF), ("kana", 0x31F0, 0x31FF), ("kana", 0xFF66, 0xFF9F),
    ("Hangul", 0x1100, 0x11FF), ("Hangul", 0x3130, 0x318F), ("Hangul", 0xAC00, 0xD7AF), ("other", 0x1400, 0x177F), ("other", 0x1900, 0x1C7F), ("other", 0xA000, 0xABFF), ("other", 0x10000, 0x1CFFF),
)
NAMES = ("none", *dict.fromkeys(n for n, _, _ in RANGES))
SCRIPTS = len(NAMES)
_BY_START = sorted((a, b, NAMES.index(n)) for n, a, b in RANGES)
#: From each of these code points on a script holds, up to the next.
_EDGES = np.array([x for a, b, _ in _BY_START for x in (a, b + 1)])
_HOLDS = np.array([x for _, _, s in _BY_START for x in (s, 0)], np.uint8)
_ASCII = np.zeros(256, np.uint8)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = NAMES.index("Latin")


def triples(w: Words) -> np.ndarray:
    """The bucket of the letter triple around each byte."""
    c = np.where(_KIND[w.data], _LOWER[w.data], 32).astype(np.uint32) if len(w.data) else np.zeros(0, np.uint32)
    at = np.full(len(c) + 2, 32, np.uint32)
    at[1:-1] = c
    h = at[:-2] * np.uint32(0x9E3779B1) + at[1:-1] * np.uint32(0x85EBCA77) + at[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64)


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the UTF-8 characters of two bytes or more that begin at ``at``."""
    first, more = data[at].astype(np.int64), [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    two, three = (first & 0x1F) << 6 | more[0], (first & 0xF) << 12 | more[0] << 6 | more[1]
    return np.where(first < 0xE0, two, np.where(first < 0xF0, three, (first & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]))


def scripts(w: Words) -> np.ndarray:
    """Each word's script, of several the one with the greatest number; none if it has no letter."""
    s = _ASCII[w.data]
    leads = np.flatnonzero(w.data >= 0xC2)
    place = np.searchsorted(_EDGES, code_points(w.data, leads), "right") - 1
    s[leads] = np.where(place >= 0, _HOLDS[np.maximum(place, 0)], 0)
    return np.maximum.reduceat(s, w.start) if len(w.start) else np.zeros(0, np.uint8)


def inside(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words' bytes, and each word's offset in them."""
    size = w.end - w.start
    off = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(w.start - off[:-1], size) + np.arange(off[-1]), off


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages, float32
    allowed: np.ndarray  # scripts x languages, bool
    default: int


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, w in pieces(batch):
            if not len(w.start):
                continue
            label = np.array(part.column("lang").to_pylist(), object)[w.row]
            script = scripts(w)
            at, off = inside(w)
            bucket, owner = triples(w)[at], np.repeat(np.arange(len(w.start)), np.diff(off))
            for lang in set(label):
                mine = (label == lang) & (script > 0)
                have = counts.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                have[:BUCKETS] += np.bincount(bucket[mine[owner]], minlength=BUCKETS)
                have[BUCKETS:] += np.bincount(script[mine], minlength=SCRIPTS)
    for lang, have in counts.items():
        k = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(have[k], pa.int64())], ["lang", "bucket", "n"])


def train(labelled: DataFrame, *, train_docs: int = 3000, seed: int = 5) -> Model:
    """``doc_id, text, lang`` → a model. The driver receives counts of at most ``BUCKETS`` triples a language."""
    known = labelled.where("lang is not null")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20)) / F.lit(1 << 20)
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool), 0)
    part = F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, min(1.0, train_docs / n))])
    drawn = known.where(draw < part[F.col("lang")]).select("lang", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    counts = drawn.mapInArrow(_counter, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(per)
    number = {lang: k for k, lang in enumerate(langs)}
    seen = np.zeros((BUCKETS + SCRIPTS, len(langs)))
    seen[counts["bucket"].to_numpy(), counts["lang"].map(number).to_numpy()] = counts["n"].to_numpy()
    grams, script = seen[:BUCKETS], seen[BUCKETS:]
    logs = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    allowed = script > 0.005 * np.maximum(script.sum(axis=0), 1)
    return Model(langs, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), allowed, int(grams.sum(axis=0).argmax()))


def word_scores(w: Words, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Words x languages, and which words tell languages apart."""
    at, off = inside(w)
    score = np.add.reduceat(m.table[triples(w)[at]], off[:-1], axis=0)
    allowed = m.allowed[scripts(w)]
    tells = allowed.any(axis=1)
    score[~allowed] += np.float32(RULED_OUT)
    score[~tells] = 0
    return score, tells


def viterbi(score: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, over a chain in which a change costs ``penalty`` except at ``starts``, where a document begins.
    Time and memory go with words x languages for many languages, words x languages squared for up to ``FEW``."""
    n, k = score.shape
    if n == 0 or k == 0:
        return np.zeros(n, np.int64)
    return by_segments(score, starts, penalty) if k <= FEW else by_documents(score, starts, penalty)


def by_documents(score: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """All documents advance together, a word of each at a time, the longest first."""
    n, k = score.shape
    begin = np.unique(np.append(0, starts[starts < n]))
    size = np.diff(np.append(begin, n))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    d = score[begin].astype(np.float64)
    best, stay = np.zeros(n, np.int16), np.zeros((n, k), bool)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # documents that have so many words
    for t in range(1, size[0]):
        m = active[t]
        now, at = d[:m], begin[:m] + t
        best[at] = now.argmax(axis=1)
        top = now.max(axis=1, keepdims=True) - penalty
        stay[at] = now >= top
        d[:m] = np.maximum(now, top) + score[at]
    path = np.zeros(n, np.int64)
    state = d.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        path[at] = state[:m]
        if t:
            state[:m] = np.where(stay[at, state[:m]], state[:m], best[at])
    return path


def by_segments(score: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, over a chain in which a change costs ``penalty`` except at
    ``starts``, where a document begins. The chain is cut in segments of ``SEGMENT`` words; all segments are
    worked on at once for each language before them, then joined, then traced back at once."""
    n, k = score.shape
    rows = -(-n // SEGMENT)
    s = np.zeros((rows * SEGMENT, k), np.float32)
    s[:n] = score
    cost = np.full(rows * SEGMENT, penalty, np.float32)
    cost[starts[starts < n]] = 0
    s, cost = s.reshape(rows, SEGMENT, k), cost.reshape(rows, SEGMENT)
    best = np.empty((SEGMENT, rows, k), np.int8)
    stay = np.empty((SEGMENT, rows, k, k), bool)
    d = np.where(np.eye(k, dtype=bool)[None], np.float32(0), np.float32(-1e9)) * np.ones((rows, 1, 1), np.float32)
    for c in range(SEGMENT):
        best[c] = d.argmax(axis=2)
        top = d.max(axis=2, keepdims=True) - cost[:, c, None, None]
        stay[c] = d >= top
        d = np.maximum(d, top) + s[:, c, None, :]
    before = np.zeros(rows, np.int64)
    came = np.empty((rows, k), np.int64)
    v = np.zeros(k)
    for r in range(rows):
        through = v[:, None] + d[r]
        came[r], v = through.argmax(axis=0), through.max(axis=0)
        v = v - v.max()
    now = np.empty(rows, np.int64)
    state = int(v.argmax())
    for r in range(rows - 1, -1, -1):
        now[r] = state
        state = before[r] = came[r, state]
    path = np.empty((rows, SEGMENT), np.int64)
    each = np.arange(rows)
    for c in range(SEGMENT - 1, -1, -1):
        path[:, c] = now
        now = np.where(stay[c][each, before, now], now, best[c][each, before])
    return path.reshape(-1)[:n]


def _labeller(m: Model, penalty: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, w in pieces(batch):
                docs, k = part.num_rows, max(len(m.langs), 1)
                letters, path = np.zeros((docs, k), np.int64), np.zeros(len(w.start), np.int64)
                if len(w.start) and m.langs:
                    score, tells = word_scores(w, m)
                    path = viterbi(score, w.first[:-1], penalty)
                    weight = np.where(tells, w.end - w.start, 0)
                    np.add.at(letters, (w.row, path), weight)
                total, win = letters.sum(axis=1), letters.argmax(axis=1)
                win = np.where(total > 0, win, m.default)
                part_of = letters[np.arange(docs), win] / np.maximum(total, 1)
                known = np.array(part.column("letters").to_pylist(), bool) & bool(m.langs)
                names = [m.langs[x] if ok else "und" for x, ok in zip(win, known, strict=True)]
                cols = [part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, part_of, 0.0), pa.float64())]
                new = np.ones(len(path), bool)
                new[1:] = path[1:] != path[:-1]
                new[w.first[:-1][w.first[:-1] < len(path)]] = True
                at = np.flatnonzero(new)
                off = np.searchsorted(at, w.first)
                if spans:
                    row = w.row[at] if len(at) else at
                    last = np.append(at[1:], len(path))
                    lang = pa.array([m.langs[x] if m.langs else "und" for x in path[at]], pa.string())
                    span = pa.StructArray.from_arrays([pa.array(at - w.first[row], pa.int32()), pa.array(last - w.first[row], pa.int32()), lang], ["first_word", "end_word", "lang"])
                    cols.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), span))
                else:
                    cols.append(pa.array(np.diff(off), pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "spans" if spans else "n_spans"])

    return run


def label(docs: DataFrame, model: Model, *, penalty: float = 12.0, spans: bool = True) -> DataFrame:
    """``doc_id, text`` → ``doc_id, lang_pred, score, spans`` (ranges of words with their language; else their number)."""
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"), has.alias("letters"))
    last = "spans array<struct<first_word:int,end_word:int,lang:string>>" if spans else "n_spans int"
    return rows.mapInArrow(_labeller(model, penalty, spans), f"doc_id long, lang_pred string, score double, {last}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return label(docs, model, spans=False).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
