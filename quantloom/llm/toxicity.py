"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary labelled texts, are discounted in the Kneser-Ney manner. Each
level's discounted counts of a class are smoothed by what the level below says, in proportion to the counts of both
classes together, which are the shared backoff: a bigram leans on its word, the word on ever shorter starts (its
first 7 to 4 letters), and the last on a uniform share. Words and starts count distinct predecessors, exactly, not
occurrences, so a text that was copied many times does not pass for evidence; bigrams count occurrences, all of them,
however rare their words. What both classes know equally, or neither knows, has the same likelihood in both.

A text's statistics are length-normalised differences of the two log-likelihoods, over the whole text, over
its most toxic runs of RUNS words and over its TOPS most toxic distinct words; a logistic curve on them gives the score. The curve is fitted on labelled
rows that the counts left out.

Counts are kept by hash, words in BUCKETS, starts in STEM_BUCKETS and bigrams in PAIRS places, which bounds what the
driver and the executors hold whatever the size of the corpus; every labelled row outside the held-out and the
calibration part is counted. The curve is fitted on at most CALIBRATION rows, those of least hash.

Edge cases: a null text counts as empty; an empty text has zero statistics and is scored like any other; a very
long text is read whole; repeated rows get equal scores; empty tables give empty results; without labels of both
classes the score is the smoothed share of toxic labels. Labels, ids, languages and sources are never inputs of a
score; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import dataclasses
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, texts

BUCKETS = 1 << 20
#: Letters of the word starts that a word backs off to, the last first.
STEMS = (7, 6, 5, 4)
STEM_BUCKETS = 1 << 18
#: Weight of a shorter start against one type of a longer.
PRIOR = 1.0
RUNS = (2, 8, 32)
DISCOUNT = 0.9
#: So many of a text's most toxic words, wherever they stand.
TOPS = (1, 3, 6)
#: Places of bigrams, in shards by the shortest start of the word and SALT classes of the word before it.
PAIRS, SHARDS, SALT = 1 << 22, 1 << 10, 32
#: Bits of the filter by which texts without a label are left out before the join.
FILTER = 1 << 24
#: Weight of the word's evidence against one occurrence of a bigram.
PAIR_PRIOR = 8.0
WIDTH = len(RUNS) + len(TOPS) + 2
CALIBRATION = 20_000
_WORD = re.compile(r"[^\W_]+")
#: Places of words and of each start in one array.
_FIRST = (0, *(BUCKETS + i * STEM_BUCKETS for i in range(len(STEMS))))
_ALL = BUCKETS + len(STEMS) * STEM_BUCKETS
_M = np.uint64(0x9E3779B97F4A7C15)
#: Words whose pairs a task holds before it sends them on.
HELD = 300_000


class Hasher:
    """Word and stem buckets of texts; keeps what it has hashed up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, data: bytes) -> np.ndarray:
        """Rows (word bucket, a bucket for each of STEMS, 64-bit digest of the word), first a row for the text's start."""
        if len(self.known) > 400_000:
            self.known.clear()
        known, out = self.known, [(0,) * (2 + len(STEMS))]
        for w in _WORD.findall(data.decode("utf-8", "replace").lower()):
            got = known.get(w)
            if got is None:
                got = known[w] = (zlib.crc32(w.encode()) % (BUCKETS - 1) + 1, *(zlib.crc32(w[:k].encode()) % STEM_BUCKETS for k in STEMS), xxhash.xxh64_intdigest(w.encode()) - (1 << 63))
            out.append(got)
        return np.array(out, np.int64)


def _shard(before: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Shard of the bigrams of a predecessor (digest) and a word (bucket of its shortest start)."""
    salt = (_mixed(before, np.zeros(1, np.int64)) % np.uint64(SALT)).astype(np.int64)
    return (_mixed(start, salt) % np.uint64(SHARDS)).astype(np.int64)


def _pair_place(before: np.ndarray, word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Place of the bigrams of a predecessor (digest) and a word (bucket, and that of its shortest start)."""
    room = PAIRS // SHARDS
    return _shard(before, start) * room + (_mixed(before, word) % np.uint64(room)).astype(np.int64)


def _mixed(u: np.ndarray, k: np.ndarray) -> np.ndarray:
    """64-bit digests of pairs."""
    x = (u.astype(np.uint64) * _M) ^ (k.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclasses.dataclass
class Counts:
    """By class: distinct predecessors of words and starts, occurrences of bigrams."""

    word: np.ndarray
    stem: np.ndarray
    pair: np.ndarray

    def __post_init__(self) -> None:
        #: Types and bigrams by class, and what brings a class to the rate of both together.
        self.total = total = np.maximum(self.word.sum(axis=1, dtype=float), 1.0)
        both = total.sum()
        rate = (both / total).astype(np.float32)
        tokens = np.maximum(self.pair.sum(axis=1, dtype=float), 1.0)
        pair_rate = (tokens.sum() / tokens).astype(np.float32)
        level = lambda x, by: (np.maximum(x - DISCOUNT, 0) * by[(slice(None), *[None] * (x.ndim - 1))], np.maximum(x.sum(axis=0) - DISCOUNT, 0))
        self.start, self.start_all = level(self.stem, rate)
        word, word_all = level(self.word, rate)
        self.free = DISCOUNT / both
        self.unigram, self.unigram_all = (word / both).astype(np.float32), (word_all / both).astype(np.float32)
        pair, pair_all = level(self.pair, pair_rate)
        # Half precision: shares of a thousandth don't matter, nor do counts beyond some 60,000.
        self.high, self.high_all = np.minimum(pair, 6e4).astype(np.float16), np.minimum(pair_all, 6e4).astype(np.float16)
        del self.word, self.stem, self.pair

    def ratios(self, rows: np.ndarray) -> list[np.ndarray]:
        """By class: likelihood of each word after the word before it, over that in both classes together."""
        w = rows[1:, 0]
        pair = _pair_place(rows[:-1, -1], w, rows[1:, len(STEMS)])
        out = []
        for c in (0, 1):
            ratio = np.ones(len(w))
            for k in reversed(range(len(STEMS))):
                s = rows[1:, 1 + k]
                ratio = (self.start[c, k][s] + PRIOR * ratio) / (self.start_all[k][s] + PRIOR)
            ratio = (self.unigram[c][w] + self.free * np.maximum(ratio, 1e-3)) / (self.unigram_all[w] + self.free)
            out.append((self.high[c][pair].astype(float) + PAIR_PRIOR * ratio) / (self.high_all[pair].astype(float) + PAIR_PRIOR))
        return out

    def differences(self, rows: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word under the toxic less that under the ordinary model."""
        ordinary, toxic = self.ratios(rows)
        return np.log(toxic / ordinary)


def statistics(d: np.ndarray, words: np.ndarray) -> list[float]:
    """Length-normalised differences of a text of these words: over all of it, the greatest runs, the greatest words."""
    if not len(d):
        return [0.0] * WIDTH
    total = np.concatenate([[0.0], np.cumsum(d)])
    out = [float(total[-1] / len(d))]
    for k in RUNS:
        k = min(k, len(d))
        out.append(float((total[k:] - total[:-k]).max() / k))
    order = np.argsort(-d, kind="stable")
    first = np.unique(words[order], return_index=True)[1]
    top = np.sort(d[order][first])[::-1]
    return [*out, *(float(top[:k].sum() / k) for k in TOPS), float(np.log1p(len(d)))]


def learnable(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(y, part, text) of the rows whose label may be learnt from; part 3 is the calibration part."""
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0)).cast("int")
    src = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Most texts have no label: a bitmap of hashed ids (FILTER bits, FILTER / 64 rows at most) spares moving them.
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    marks = use.where("doc_id is not null").groupBy(F.shiftright(place("doc_id"), 6).alias("_word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(doc_id), {FILTER}) & 63 as int)))").alias("_bits"))
    src = src.join(F.broadcast(marks), F.shiftright(place("doc_id"), 6) == F.col("_word"))
    src = src.where(F.expr(f"shiftright(_bits, cast(pmod(xxhash64(doc_id), {FILTER}) & 63 as int)) & 1L = 1L")).select("doc_id", "text")
    return src.join(use.hint("shuffle_hash"), "doc_id").select("y", part.alias("part"), "doc_id", "text")


def _gather(found: DataFrame, columns: list[str]) -> DataFrame:
    """Sums by place, at most BUCKETS rows by word and STEM_BUCKETS by start, and a row of lists by part with its bigrams, PAIRS at most."""
    return found.groupBy("k").agg(*[F.sum(c).alias(c) for c in columns], *[F.first(c).alias(c) for c in ("at", "c0", "c1")])


def _pairs(held: tuple[list, list], parts: int) -> Iterator[pa.RecordBatch]:
    """By class and part of the shards: each distinct (predecessor, word) pair and its occurrences.

    Pairs are ordered by predecessor, which stands once with the number of its pairs; words are rows of places.
    """
    for y, rows in enumerate(held):
        if not rows:
            continue
        r = np.concatenate(rows)
        _, at, n = np.unique(_mixed(r[:, -1], r[:, -2]), return_index=True, return_counts=True)
        r = r[at]
        part = _shard(r[:, -1], r[:, len(STEMS)]) % parts
        order = np.lexsort((r[:, 0], r[:, -1], part))
        r, n, part = r[order], n[order], part[order]
        edge = np.nonzero(np.diff(part))[0] + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(r)]):
            own = r[lo:hi]
            head = np.nonzero(np.concatenate([[True], np.diff(own[:, -1]) != 0]))[0]
            _, first, word = np.unique(own[:, -2], return_index=True, return_inverse=True)
            column = lambda v, kind: pa.array([v.astype(kind)], pa.list_(pa.from_numpy_dtype(kind)))
            yield pa.RecordBatch.from_arrays([pa.array([int(part[lo])], pa.int32()), pa.array([y], pa.int32()), column(own[head, -1], np.int64), column(np.diff(np.append(head, len(own))), np.int32), column(word, np.int32), column(n[lo:hi], np.int32), column(own[first, :-2].ravel(), np.int32)], names=["part", "y", "before", "runs", "word", "n", "places"])


_TYPES = "k long, t0 long, t1 long, at array<int>, c0 array<int>, c1 array<int>"


def _types(t: pa.Table) -> pa.Table:
    """Rows (k, t0, t1): distinct predecessors of words and starts by class; and one (at, c0, c1): occurrences of bigrams, of one part."""
    out, bigrams = [], []
    flat = lambda name, i: t[name][i].values.to_numpy()
    for y in (0, 1):
        own = [i for i, v in enumerate(t["y"].to_pylist()) if v == y]
        if not own:
            continue
        before = np.concatenate([np.repeat(flat("before", i), flat("runs", i)) for i in own])
        n = np.concatenate([flat("n", i) for i in own])
        places = np.concatenate([flat("places", i).reshape(-1, len(_FIRST))[flat("word", i)] for i in own])
        for col, first in enumerate(_FIRST):
            k = places[:, col] + first
            each, at = np.unique(k, return_inverse=True)
            distinct = np.unique(_mixed(before, k), return_index=True)[1]
            out.append((each, *[np.bincount(at[distinct], minlength=len(each)) * (c == y) for c in (0, 1)]))
        bigrams.append((_pair_place(before, places[:, 0], places[:, len(STEMS)]), n * (y == 0), n * (y == 1)))
    place, *counts = (np.concatenate(c) for c in zip(*bigrams))
    each, at = np.unique(place, return_inverse=True)
    lists = [each, *[np.bincount(at, c).astype(np.int64) for c in counts]]
    k, t0, t1 = (np.concatenate(c).astype(np.int64) for c in zip(*out))
    rows = len(k)
    some = lambda v: pa.array([None] * rows + [v.astype(np.int32)], pa.list_(pa.int32()))
    add = lambda v, last: pa.array(np.append(v, last), pa.int64())
    return pa.table([add(k, -1 - t["part"][0].as_py()), add(t0, 0), add(t1, 0), *map(some, lists)], names=[x.split()[0] for x in _TYPES.split(", ")])


def count(train: DataFrame) -> Counts:
    """The counts of a table (y, text)."""

    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        held: tuple[list, list] = ([], [])
        size = 0
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), texts(b)):
                r = h(t)
                held[y].append(np.column_stack([r[1:], r[:-1, -1]]))
                size += len(r)
                if size >= HELD:
                    yield from _pairs(held, parts)
                    held, size = ([], []), 0
        yield from _pairs(held, parts)

    src = train.select("y", F.col("text").cast("string").alias("text"))
    # Pairs of one shard meet in one part, so distinct pairs are counted there, and the counts of all parts add up.
    got = src.mapInArrow(words, "part int, y int, before array<long>, runs array<int>, word array<int>, n array<int>, places array<int>")
    got = _gather(got.groupBy("part").applyInArrow(_types, _TYPES), ["t0", "t1"])
    got = got.select(F.col("k").cast("int"), *[F.col(c).cast("float") for c in ("t0", "t1")], "at", "c0", "c1").toArrow()
    types, pair = np.zeros((2, _ALL), np.float32), np.zeros((2, PAIRS), np.float32)
    k = got["k"].to_numpy()
    plain = k >= 0
    for c in (0, 1):
        types[c][k[plain]] = got[f"t{c}"].to_numpy()[plain]
        for i in np.nonzero(~plain)[0].tolist():
            pair[c][got["at"][i].values.to_numpy()] = got[f"c{c}"][i].values.to_numpy()
    del got, k
    return Counts(types[:, :BUCKETS], types[:, BUCKETS:].reshape(2, len(STEMS), STEM_BUCKETS), pair)


@dataclasses.dataclass
class Model:
    """The shared counts and the logistic curve on standardised statistics."""

    counts: Broadcast | None
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weight[:-1] + self.weight[-1], -30, 30)))


def measure(df: DataFrame, counts: Broadcast) -> DataFrame:
    """All columns of df but text, and x: the statistics of text."""
    keep = [c for c in df.columns if c != "text"]
    schema = df.select(*keep, F.array().cast("array<double>").alias("x")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, h = counts.value, Hasher()
        for b in batches:
            x = [statistics(own.differences(r), r[1:, 0]) for r in map(h, texts(b))]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return df.mapInArrow(run, schema)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and offset by Newton steps on the ridge-penalised log-likelihood, classes as they are."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    pen = np.full(len(w), ridge * np.sqrt(len(x)))
    pen[-1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen) + 1e-9 * np.eye(len(w)), a.T @ (y - p) - pen * w)
        step *= min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Counts from the learning part, curve from the calibration part."""
    k = WIDTH
    sums = labels.where(~held_out(F.col("doc_id"))).agg(F.count(F.when(F.col(label) == 1, 1)).alias("n1"), F.count(F.when(F.col(label) == 0, 1)).alias("n0")).first()
    prior = (sums["n1"] + 1) / (sums["n1"] + sums["n0"] + 2)
    flat = Model(None, np.zeros(k), np.ones(k), np.append(np.zeros(k), np.log(prior / (1 - prior))))
    if not sums["n1"] or not sums["n0"]:
        return flat
    # Texts are shuffled once, to meet their labels; every further pass reads the table of labelled texts.
    rows = materialize(learnable(docs, labels, label), "labelled")
    counts = docs.sparkSession.sparkContext.broadcast(count(rows.where("part <> 3")))
    # Measured where the texts lie; only statistics are ordered and limited.
    sample = lambda part: measure(part.select("y", "doc_id", "text"), counts).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION).toPandas()
    seen = sample(rows.where("part = 3"))
    if len(seen) < 4 or seen["y"].nunique() < 2:
        seen = sample(rows)
    if not len(seen):
        return flat
    x, y = np.stack(seen["x"].to_numpy()), seen["y"].to_numpy(float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return Model(counts, mean, scale, _logistic(np.clip((x - mean) / scale, -8, 8), y))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    x = measure(src, model.counts) if model.counts else src.select("doc_id", F.array_repeat(F.lit(0.0), WIDTH).alias("x"))
    curve = dataclasses.replace(model, counts=None)

    @F.pandas_udf("double")
    def scored(v: pd.Series) -> pd.Series:
        return pd.Series(curve.score(np.stack(v.to_numpy()))) if len(v) else pd.Series([], dtype=float)

    out = x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
