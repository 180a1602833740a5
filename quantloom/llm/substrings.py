"""Exact removal of repeated substrings by sparse suffix sorting with bucket-pointer refinement.

A byte is removed when a LENGTH-byte string that covers it also starts anywhere else. Suffixes are sorted
only where that can matter, and only as deep as LENGTH:

1. Every LENGTH-byte window is put under its anchor, the q-gram of least hash in it. Equal windows have equal
   anchors at equal distances, and neighbouring windows mostly share one, so the windows under an anchor are
   a range of starts, told by the anchor's hash and the bytes that the range covers (its context).
2. Contexts are counted by (anchor hash, digest). A context that stands twice is repeated whole. An anchor
   hash with one context that stands once holds no repeat. What is left are anchor hashes with several
   different contexts: these are the initial q-gram buckets.
3. Within slices of whole buckets, suffixes of the contexts get bucket numbers by their q-gram, which are
   refined by sorting on (own bucket, bucket of a later offset), at depths 64, 128, 256 and LENGTH.
   Every refinement uses the numbers that the last one gave; suffixes alone in a bucket take no further part.
   Windows that share their last bucket are repeated.
4. Buckets of over HOT different contexts aren't gathered: their windows are counted by 128-bit digests with
   map-side sums, one row by window, and the repeated ones are joined back.

Texts that stand twice and have at least LENGTH bytes are repeated whole; one of them stands for all in the
steps above. Only digests and ranges of the corpus are shuffled, and compressed texts of one copy each.

Edge cases: a null text counts as empty; texts under LENGTH bytes keep everything; repeated rows are copies
of each other; matches never cross rows; empty tables give empty results; other columns are ignored. Anchor
hashes and digests together have 128 bits; that two different contexts share both is not guarded against.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

LENGTH = 400
#: Bytes of the anchors' q-grams (a power of two).
GRAM = 32
#: Bytes of text whose windows are handled at once.
SLICE = 1 << 20
#: Bytes of contexts that are sorted at once, when their buckets allow.
SORTED = 1 << 20
HOT = 4096
_B = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 30) - 1)


def gram_hashes(x: np.ndarray, q: int = GRAM) -> np.ndarray:
    """64-bit hashes of all q-grams: a polynomial, doubled log2(q) times, and mixed."""
    h, b, k = x.astype(np.uint64) + np.uint64(1), _B, 1
    while k < q:
        h = h[:-k] * b + h[k:]
        b = np.uint64(int(b) * int(b) & 0xFFFFFFFFFFFFFFFF)
        k *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """Least key of every window of width keys: minima from both ends of blocks, two by two."""
    n = len(key)
    pad = -n % width
    full = np.concatenate([key, np.full(pad, np.iinfo(key.dtype).max, key.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: bytes, first: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, hash, start, end) of every range: windows that start in [start, end] (in data) share an anchor.

    first: starts of the texts in data, and its end. Ranges don't cross texts.
    """
    none = np.zeros(0, np.int64)
    x = np.frombuffer(data, np.uint8)
    if len(x) < length:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(x)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    at = (window_minima(key, length - GRAM + 1) & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(at)]
    ok = np.arange(len(at)) + length <= first[text + 1]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    start = np.nonzero(new & ok)[0]
    # A range ends before the next change, or where windows of its text end.
    change = np.append(np.nonzero(new)[0], len(at))
    end = change[np.searchsorted(change, start, "right")] - 1
    end = np.minimum(end, first[text[start] + 1] - length)
    return text[start], h[at[start]], start, end


def _pieces(docs: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Slices (text numbers, offsets in them, bytes, starts): short texts together, long ones in overlapping parts."""
    who, offset, parts, total = [], [], [], 0
    for i, d in enumerate(docs):
        if len(d) < length:
            continue
        for at in range(0, len(d) - length + 1, SLICE):
            part = d[at : at + SLICE + length - 1]
            if parts and total + len(part) > SLICE:
                yield who, offset, b"".join(parts), np.cumsum([0, *map(len, parts)])
                who, offset, parts, total = [], [], [], 0
            who.append(i)
            offset.append(at)
            parts.append(part)
            total += len(part)
    if parts:
        yield who, offset, b"".join(parts), np.cumsum([0, *map(len, parts)])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


_RANGES = "doc_id long, n long, sha string, blob binary, h array<long>, dg array<long>, s array<int>, e array<int>"


def ranges(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, sha, blob, h, dg, s, e): size, digest, compressed bytes, and the ranges of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        digest = xxhash.xxh3_64_intdigest

        def flush(ids: pa.Array, part: list[bytes]) -> pa.RecordBatch:
            h, dg, s, e, owner = [], [], [], [], []
            for who, offset, data, first in _pieces(part, length):
                t, hh, ss, ee = anchors(data, first, length)
                dg.append(np.array([digest(data[a : b + length]) for a, b in zip(ss.tolist(), ee.tolist())], np.uint64))
                move = np.array(offset, np.int64) - first[:-1]
                owner.append(np.array(who, np.int64)[t])
                h.append(hh)
                s.append(ss + move[t])
                e.append(ee + move[t])
            cat = lambda v, k: np.concatenate(v) if v else np.zeros(0, k)
            offsets = pa.array(np.searchsorted(cat(owner, np.int64), np.arange(len(part) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(_signed(cat(v, np.uint64)))) for v in (h, dg)]
            lists += [pa.ListArray.from_arrays(offsets, pa.array(cat(v, np.int64).astype(np.int32))) for v in (s, e)]
            blob = pa.array([pack.compress(t) if len(t) >= length else None for t in part], pa.binary())
            return pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in part], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in part]), blob, *lists], names=["doc_id", "n", "sha", "blob", "h", "dg", "s", "e"])

        for b in batches:
            done, part, total = 0, [], 0
            for i, t in enumerate(texts(b)):
                part.append(t)
                total += len(t)
                if total > 8 * SLICE or i + 1 == b.num_rows:
                    yield flush(b.column(0).slice(done, i + 1 - done), part)
                    done, part, total = i + 1, [], 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _RANGES)


def refine(data: np.ndarray, end: np.ndarray, want: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the wanted window starts share their LENGTH bytes with another wanted one.

    data: contexts end to end; end: by position, where its context ends; want: window starts, in order.
    """
    n = len(data)
    # Initial buckets: q-grams by their hashes, of the greatest q that is a power of two and under length, GRAM at most.
    depth = 1
    while depth * 2 <= min(GRAM, length - 1):
        depth *= 2
    if n < length:
        return np.zeros(len(want), bool)
    gram = gram_hashes(data, depth)
    order = np.argsort(gram)
    ranked = gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    bucket = np.zeros(n, np.int64)
    bucket[order] = np.cumsum(new) - 1
    # The last places start no whole q-gram, and no window.
    bucket[len(gram) :] = bucket.max() + 1 + np.arange(n - len(gram))
    while depth < length:
        step = min(depth, length - depth)
        last = depth + step >= length
        at = want if last else np.arange(n)
        at = at[at + depth + step <= end[at]]
        # Alone in its bucket: alone for good. It keeps its number, and takes no part in sorting.
        size = np.bincount(bucket)
        live = at[(size[bucket[at]] > 1) & (size[bucket[at + step]] > 1)]
        key = bucket[live] * np.int64(bucket.max() + 1) + bucket[live + step]
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(len(live), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        number = np.cumsum(new) - 1
        if last:
            count = np.bincount(number, minlength=1)
            hit = np.zeros(len(live), bool)
            hit[order] = count[number] > 1
            found = np.zeros(n, bool)
            found[live[hit]] = True
            return found[want]
        # Numbers by refined bucket for those sorted, fresh ones for all others.
        fresh = np.arange(n, dtype=np.int64) + len(live)
        fresh[live[order]] = number
        there = np.zeros(n + len(live), bool)
        there[fresh] = True
        bucket = (np.cumsum(there) - 1)[fresh]
        depth += step
    raise ValueError("length must be over 1")


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of true."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] - 1


def _sort_contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, dg, lo, hi) of contexts that come ordered by h: runs of repeated window starts, from the context's start."""
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def flush() -> pa.RecordBatch:
        size = np.array([len(c) for _, _, c in held], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(c for _, _, c in held), np.uint8)
        end = np.repeat(first[1:], size)
        want = np.nonzero(np.arange(len(data)) + length <= end)[0]
        flag = np.zeros(len(data), bool)
        flag[want] = refine(data, end, want, length)
        rows = []
        for i, (h, dg, _) in enumerate(held):
            lo, hi = runs(flag[first[i] : first[i + 1]])
            if len(lo):
                rows.append((h, dg, lo.tolist(), hi.tolist()))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["h", "dg", "lo", "hi"])

    for b in batches:
        for h, dg, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if held and held[-1][0] != h and total >= SORTED:
                yield flush()
                held, total = [], 0
            held.append((h, dg, c.as_py()))
            total += len(held[-1][2])
    if held:
        yield flush()


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, dg, context) for rows (blob, wanted: h, dg, s, e)."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        h, dg, c, total = [], [], [], 0
        for blob, want in zip(b.column(0), b.column(1)):
            data = unpack.decompress(blob.as_py())
            for w in want.as_py():
                h.append(w["h"])
                dg.append(w["dg"])
                c.append(data[w["s"] : w["e"] + length])
                total += len(c[-1])
            if total > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(dg, pa.int64()), pa.array(c, pa.binary())], names=["h", "dg", "context"])
                h, dg, c, total = [], [], [], 0
        if h:
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(dg, pa.int64()), pa.array(c, pa.binary())], names=["h", "dg", "context"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, dg, p, w1, w2): one row by window of a hot context, with a 128-bit digest."""
    digest = xxhash.xxh3_128_digest
    names = ["h", "dg", "p", "w1", "w2"]
    for b in batches:
        for h, dg, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            data = c.as_py()
            n = len(data) - length + 1
            w = np.frombuffer(b"".join(digest(data[p : p + length]) for p in range(n)), "<i8").reshape(n, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, dg)), pa.array(np.arange(n, dtype=np.int32)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], names=names)


def _cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(bytes removed, runs removed, digest of the rest) for half-open spans in any order."""
    at, gone, count, kept, edge = 0, 0, 0, hashlib.sha256(), -1
    for a, b in sorted(spans):
        if b <= at and edge >= 0:
            continue
        if a > edge or edge < 0:
            kept.update(data[max(at, 0) : a])
            count += 1
            gone += b - a
        else:
            gone += b - edge
        at = edge = max(b, edge)
    kept.update(data[at:])
    return gone, count, kept.hexdigest()


def removals(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(u, doc_id, n, sha, blob, copies, lo, hi): every row with the repeated window starts of its text.

    copies: rows with this text. lo and hi: runs of window starts; empty where copies is over 1, as then all are.
    """
    t = materialize(ranges(docs, length).withColumn("u", F.monotonically_increasing_id()), "ranges")
    one = materialize(t.where(F.col("n") >= length).groupBy("sha").agg(F.min("u").alias("u"), F.count("*").alias("copies")), "texts")
    every = t.select("u", "h", "dg", "s", "e").join(one.select("u"), "u").select("u", F.inline(F.arrays_zip("h", "dg", "s", "e")))
    kinds = materialize(every.groupBy("h", "dg").agg(F.count("*").alias("c"), F.min(F.struct("u", "s", "e")).alias("pick")), "kinds")
    buckets = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("c").alias("all")).where("all > 1")
    known = materialize(kinds.join(buckets, "h"), "buckets")
    whole = known.where("c > 1").select("h", "dg", F.array(F.lit(0)).alias("lo"), F.array(F.col("pick.e") - F.col("pick.s")).alias("hi"))
    # Contexts of buckets that hold several kinds, from the one text picked for each kind.
    asked = known.where("kinds > 1").select(F.col("pick.u").alias("u"), F.struct("h", "dg", F.col("pick.s").alias("s"), F.col("pick.e").alias("e")).alias("w"), (F.col("kinds") > hot).alias("hot"))
    asked = asked.groupBy("u", "hot").agg(F.collect_list("w").alias("want"))
    pulled = t.select("u", "blob").join(asked, "u")
    schema = "h long, dg long, context binary"
    cool = pulled.where("not hot").select("blob", "want").mapInArrow(lambda b: _contexts(b, length), schema)
    parts = cool.repartition("h").sortWithinPartitions("h").mapInArrow(lambda b: _sort_contexts(b, length), "h long, dg long, lo array<int>, hi array<int>")
    found = materialize(parts, "sorted")
    if not known.where(F.col("kinds") > hot).isEmpty():
        warm = pulled.where("hot").select("blob", "want").mapInArrow(lambda b: _contexts(b, length), schema)
        rows = materialize(warm.mapInArrow(lambda b: _windows(b, length), "h long, dg long, p int, w1 long, w2 long"), "windows")
        twice = rows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
        single = rows.join(twice, ["w1", "w2"], "left_semi").groupBy("h", "dg").agg(F.collect_list("p").alias("lo"))
        found = found.unionByName(single.select("h", "dg", "lo", F.col("lo").alias("hi")))
    found = whole.unionByName(found.join(whole.select("h", "dg"), ["h", "dg"], "left_anti"))
    spans = every.join(found, ["h", "dg"]).select("u", F.transform("lo", lambda x: x + F.col("s")).alias("lo"), F.transform("hi", lambda x: x + F.col("s")).alias("hi"))
    spans = spans.groupBy("u").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    # Copies and spans are put together by row first, so that the compressed texts move once more only.
    again = t.where(F.col("n") >= length).select("u", "sha").join(one.where("copies > 1").select("sha", "copies"), "sha").select("u", "copies")
    marks = materialize(again.join(spans, "u", "full"), "marks")
    return t.select("u", "doc_id", "n", "sha", "blob").join(marks, "u", "left").select("u", "doc_id", "n", "sha", "blob", F.coalesce("copies", F.lit(1)).alias("copies"), "lo", "hi")


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            out = []
            for doc, n, sha, copies, blob, lo, hi in zip(*(col[c].to_pylist() for c in ("doc_id", "n", "sha", "copies")), col["blob"], col["lo"], col["hi"]):
                if copies > 1:
                    out.append((doc, n, n, 1, empty))
                elif not lo.is_valid:
                    out.append((doc, n, 0, 0, sha))
                else:
                    spans = [(a, z + length) for a, z in zip(lo.as_py(), hi.as_py())]
                    out.append((doc, n, *_cut(unpack.decompress(blob.as_py()), spans)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=[x.split()[0] for x in _REPORT.split(", ")])

    slim = removals(docs, length, hot).withColumn("blob", F.when(F.col("lo").isNotNull() & (F.col("copies") == 1), F.col("blob")))
    return slim.mapInArrow(run, _REPORT)
