"""Benchmark decontamination with suffix arrays over the training words.

Every shard of the documents (SHARD words at most, a longer document alone) is a sequence of word numbers, with
a zero after each document and in place of words that no test item has. Ranks of its next 1, 2, 4 ... words are
made by prefix doubling together with those of the test items, so that both are comparable; they order the
suffix array, in which every test suffix is found by binary search, all at once. Suffixes that share a test
window of ``window`` words (a shorter item is one window) lie side by side; matches that go on from window to
window become one verbatim match with its place, item and offset. longest_matches() gives the longest match of
every test suffix, however short or long, and where it stands. Documents with too much of it are removed.

The test items go to the executors in blocks of at most BLOCK words, so what is broadcast has a fixed bound;
further blocks are further passes over the rows, which carry the matches found so far: no pass shuffles.

Edge cases: null texts have no words; an item without words has no window; a document without words is clean
(n_hit 0, n_words 0, not contaminated); repeated rows are judged alike, repeated items count once by id and
items with a null id hit words but are not listed; a very long text is a shard of its own; empty tables give
empty results or clean documents. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Words of test items that one pass broadcasts at most (an item is never cut).
BLOCK = 1_000_000
#: Words of documents that one suffix array holds, a longer document alone.
SHARD = 1_000_000
#: Pairs of a document and a window's item that are held at once.
PAIRS = 1 << 21
#: A-Z become a-z; 0-9, a-z and bytes of 0x80 and above stay; all else becomes a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_NONE = np.zeros(0, np.int64)


def words(data: bytes) -> list[bytes]:
    """Lower-cased words of one text."""
    return data.translate(_WORDS).split()


class Items:
    """One block of test items: vocabulary, word numbers with a 0 after each item, and the window at each suffix."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        size = np.array([len(w) + 1 for _, w in rows], np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.seq = np.zeros(int(self.first[-1]), np.int32)
        for (_, w), at in zip(rows, self.first.tolist()):
            self.seq[at : at + len(w)] = [self.number.setdefault(x, len(self.number) + 1) for x in w]
        #: Item of each position, by its number among rows; null ids are listed nowhere.
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int32), size)
        self.id = np.array([0 if i is None else i for i, _ in rows], np.int64)
        self.listed = np.array([i is not None for i, _ in rows], bool)
        #: Window length at each position where a window starts, else 0.
        n = (size - 1)[self.owner] if len(rows) else _NONE
        k = np.minimum(n, window)
        offset = np.arange(len(self.seq)) - self.first[self.owner]
        self.need = np.where(offset + k <= n, k, 0).astype(np.int32) if len(rows) else _NONE.astype(np.int32)
        self.need[self.seq == 0] = 0


class Ranks:
    """Ranks of the next 1, 2, 4 ... words of every position of a sequence, by prefix doubling."""

    def __init__(self, seq: np.ndarray, depth: int) -> None:
        n = len(seq)
        self.by = [np.append(seq, 0).astype(np.int64)]
        step = 1
        while step * 2 <= depth:
            last = self.by[-1]
            ahead = np.zeros(n + 1, np.int64)
            ahead[: max(0, n - step)] = last[step:n]
            key = last * (n + 2) + ahead
            order = np.argsort(key)
            ranked = key[order]
            rank = np.zeros(n + 1, np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
            self.by.append(rank)
            step *= 2

    def key(self, at: np.ndarray, k: int) -> np.ndarray:
        """Numbers in the order of the next k words of the positions; equal where these are equal."""
        j = min(k.bit_length() - 1, len(self.by) - 1)
        if k > 2 << j:
            raise ValueError("ranks aren't that deep")
        rank = self.by[j]
        end = len(rank) - 1
        return rank[at] * (end + 2) + rank[np.minimum(at + k - (1 << j), end)]


def _numbered(docs: list[list[bytes]], items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of documents end to end, each followed by a 0, and their starts."""
    size = np.array([len(d) + 1 for d in docs], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    seq = np.zeros(int(first[-1]), np.int32)
    get = items.number.get
    for d, p in zip(docs, first.tolist()):
        seq[p : p + len(d)] = np.fromiter(map(get, d, repeat(0)), np.int32, len(d))
    return seq, first


def find(seq: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, window length, test position) of every place of a shard where a test window stands.

    A window that several test positions have is told by the first of them.
    """
    kinds = np.unique(items.need[items.need > 0]).tolist()
    # Positions followed by fewer known words than the shortest window hold no window.
    zero = np.nonzero(seq == 0)[0]
    ahead = zero[np.searchsorted(zero, np.arange(len(seq)))] - np.arange(len(seq)) if len(zero) else np.zeros(len(seq), np.int64)
    at = np.nonzero(ahead >= kinds[0])[0] if kinds else _NONE
    if not len(at):
        return _NONE, _NONE, _NONE
    # Stretches of the shard that hold such positions, and the test items, are ranked together.
    near = np.zeros(len(seq) + 1, np.int64)
    np.add.at(near, at, 1)
    np.add.at(near, np.minimum(at + items.window, len(seq)), -1)
    kept = np.nonzero(np.cumsum(near)[:-1] > 0)[0]
    gap = np.ones(len(kept), np.int64)
    gap[1:] = np.diff(kept) > 1
    place = np.arange(len(kept)) + np.cumsum(gap)
    both = np.zeros(int(place[-1]) + 2 + len(items.seq), np.int32)
    both[place] = seq[kept]
    base = int(place[-1]) + 2
    both[base:] = items.seq
    ranks = Ranks(both, items.window)
    mine = place[np.searchsorted(kept, at)]
    sa = np.argsort(ranks.key(mine, items.window), kind="stable")
    out = []
    for k in kinds:
        test = np.nonzero(items.need == k)[0]
        keys, first = np.unique(ranks.key(test + base, k), return_index=True)
        column = ranks.key(mine[sa], k)  # in order, as the suffix array is
        lo, hi = np.searchsorted(column, keys, "left"), np.searchsorted(column, keys, "right")
        n = hi - lo
        inside = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = at[sa[inside]]
        out.append((found, np.full(len(found), k), np.repeat(test[first], n)))
    p, k, t = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((k, p))
    return p[order], k[order], t[order]


def longest(seq: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(length, position) of the longest match of every test position's suffix in a shard; position -1 for none."""
    n = len(items.seq)
    at = np.nonzero(seq)[0]
    if not n or not len(at):
        return np.zeros(n, np.int64), np.full(n, -1)
    depth = 1 << int(np.diff(items.first).max()).bit_length()
    both = np.concatenate([seq, [0], items.seq])
    ranks = Ranks(both, depth).by[-1]
    base = len(seq) + 1
    sa = at[np.argsort(ranks[at], kind="stable")]
    place = np.searchsorted(ranks[sa], ranks[base:-1], "left")
    best, where = np.zeros(n, np.int64), np.full(n, -1)
    # The longest common prefix is that with a neighbour in the order.
    for side in (place - 1, place):
        own = sa[np.clip(side, 0, len(sa) - 1)]
        size, live = np.zeros(n, np.int64), np.arange(n)
        while len(live):
            a, b = both[own[live] + size[live]], both[base + live + size[live]]
            live = live[(a == b) & (a > 0)]
            size[live] += 1
        better = size > best
        best[better], where[better] = size[better], own[better]
    return best, where


def blocks(bench: DataFrame, window: int = 13, item_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The test items in blocks of a bounded number of words, taken from an iterator over partitions; one block at least."""
    rows: list[tuple[int | None, list[bytes]]] = []
    total = 0
    src = bench.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    some = False
    for r in src.toLocalIterator(prefetchPartitions=False):
        w = words((r["text"] or "").encode())
        if w:
            if rows and total + len(w) > BLOCK:
                yield Items(rows, window)
                rows, total, some = [], 0, True
            rows.append((r["item_id"], w))
            total += len(w)
    if rows or not some:
        yield Items(rows, window)


def _shards(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows with the words of their texts, SHARD words together at most, or one row."""
    for b in batches:
        done, part, total = 0, [], 0
        for i, text in enumerate(texts(b, column)):
            w = words(text)
            if part and total + len(w) > SHARD:
                yield b.slice(done, i - done), part
                done, part, total = i, [], 0
            part.append(w)
            total += len(w) + 1
        if part:
            yield b.slice(done), part


_MATCH = "struct<start:bigint,length:bigint,item:bigint,offset:bigint>"
_FIELDS = ("start", "length", "item", "offset")


def _lists(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row of each element of a list column, and the elements."""
    flat = col.flatten()
    n = np.diff(col.offsets.to_numpy())
    return np.repeat(np.arange(len(col)), n), flat


def _as_lists(row: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """A list column of n rows from elements ordered by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


def _union(row: np.ndarray, kind: np.ndarray, start: np.ndarray, item: np.ndarray, earlier: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, item) for pairs (row, kind), whose items are item[start[kind]:start[kind + 1]], and earlier ones."""
    held, total, out = [], 0, earlier
    n = start[kind + 1] - start[kind]
    cut = np.searchsorted(np.cumsum(n), np.arange(PAIRS, int(n.sum()) + PAIRS, PAIRS), "right") if len(n) else []
    for a, b in zip([0, *cut[:-1]], cut) if len(n) else []:
        b = max(b, a + 1)
        m = n[a:b]
        at = np.repeat(start[kind[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        pair = np.unique(np.column_stack([np.concatenate([out[0], np.repeat(row[a:b], m)]), np.concatenate([out[1], item[at]])]), axis=0)
        out = pair[:, 0], pair[:, 1]
    return out


def marked(docs: DataFrame, bench: DataFrame, window: int = 13, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(columns of docs as c0, c1 ..., n_words, n_hit, items, matches): what every document shares with the test items.

    matches: verbatim matches of a window at least, in words: where it starts, its length, an item that has it and
    the place there. items: distinct ids of items of which a window occurs, in order. keep: columns to return, all by default.
    """
    spark = docs.sparkSession
    number = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = number[text_col]
    kept = [number[c] for c in (docs.columns if keep is None else keep)]
    out = docs.select(*[(F.col(f"`{c}`").cast("string") if c == text_col else F.col(f"`{c}`")).alias(n) for c, n in number.items()])
    out = out.select(*dict.fromkeys([*kept, text]), F.lit(None).cast("array<bigint>").alias("items"), F.lit(None).cast(f"array<{_MATCH}>").alias("matches"))
    every = list(blocks(bench, window))
    for i, items in enumerate(every):
        shared = spark.sparkContext.broadcast(items)
        names = list(dict.fromkeys([*kept, text])) if i + 1 < len(every) else kept
        schema = out.select(*names, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), "items", "matches").schema

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            own = shared.value
            # Items of each distinct window: test positions by the first position that has the same words.
            at = np.nonzero(own.need)[0]
            first = np.zeros(len(own.seq), np.int64)
            if len(at):
                ranks = Ranks(own.seq, own.window)
                for k in np.unique(own.need[at]).tolist():
                    t = at[own.need[at] == k]
                    _, one, which = np.unique(ranks.key(t, k), return_index=True, return_inverse=True)
                    first[t] = t[one][which]
                del ranks
            at = at[own.listed[own.owner[at]]] if len(at) else at
            pair = np.unique(np.column_stack([first[at], own.id[own.owner[at]]]), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            start = np.searchsorted(pair[:, 0], np.arange(len(own.seq) + 1))
            for b, part in _shards(batches, text):
                n = len(part)
                seq, begin = _numbered(part, own)
                p, k, t = find(seq, own)
                d = np.searchsorted(begin, p, "right") - 1
                # Windows that follow each other in document and item are one match.
                new = np.ones(len(p), bool)
                new[1:] = (np.diff(p) != 1) | (np.diff(t) != 1) | (k[1:] != k[:-1])
                head = np.nonzero(new)[0]
                run_ = np.diff(np.append(head, len(p)))
                row, begins, length = d[head], p[head] - begin[d[head]], run_ + k[head] - 1
                owner = own.owner[t[head]]
                found = [begins, length, np.where(own.listed[owner], own.id[owner], 0) if len(owner) else _NONE, t[head] - own.first[owner]]
                nameless = np.zeros(len(row), bool) if not len(owner) else ~own.listed[owner]
                old_row, old = _lists(b.column(b.schema.get_field_index("matches")))
                every_row = np.concatenate([old_row, row])
                fields = [np.concatenate([old.field(f).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), v]) for f, v in zip(range(4), found)]
                blank = np.concatenate([old.field(2).is_null().to_numpy(zero_copy_only=False), nameless])
                order = np.lexsort((fields[1], fields[0], every_row))
                every_row, fields, blank = every_row[order], [f[order] for f in fields], blank[order]
                # Words covered.
                edge = np.zeros(len(seq) + 1, np.int64)
                np.add.at(edge, begin[every_row] + fields[0], 1)
                np.add.at(edge, begin[every_row] + fields[0] + fields[1], -1)
                covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
                hit = covered[begin[1:]] - covered[begin[:-1]]
                old_row, old_items = _lists(b.column(b.schema.get_field_index("items")))
                mine = np.unique(np.column_stack([d, t]), axis=0) if len(d) else np.zeros((0, 2), np.int64)
                item_row, item = _union(mine[:, 0], mine[:, 1], start, pair[:, 1], (old_row, old_items.to_numpy(zero_copy_only=False).astype(np.int64)))
                struct = pa.StructArray.from_arrays([pa.array(f, pa.int64(), mask=blank) if i == 2 else pa.array(f, pa.int64()) for i, f in enumerate(fields)], names=list(_FIELDS))
                arrays = [b.column(b.schema.get_field_index(c)) for c in names]
                arrays += [pa.array([len(x) for x in part], pa.int64()), pa.array(hit, pa.int64()), _as_lists(item_row, pa.array(item, pa.int64()), n), _as_lists(every_row, struct, n)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_words", "n_hit", "items", "matches"])

        out = out.mapInArrow(run, schema)
        if i + 1 < len(every):
            out = out.drop("n_words", "n_hit")
    return out


def _contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, bench: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    Contaminated: n_hit > 0 and 20 * n_hit >= n_words. The matches themselves are in marked().
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return marked(src, bench, window, keep=["doc_id"]).select(
        F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), _contaminated().alias("contaminated")
    )


def longest_matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(item_id, offset, length, doc_id, start): the longest verbatim match of every test suffix in the documents, in words.

    Of equal lengths that of the smallest id and place stays; suffixes without a match and items without an id are left out.
    Every shard sends one row by suffix, which are reduced by partial maxima.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in blocks(bench):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b, part in _shards(batches, "text"):
                seq, begin = _numbered(part, own)
                size, place = longest(seq, own)
                t = np.nonzero((size > 0) & (own.listed[own.owner] if len(own.seq) else False))[0]
                d = np.searchsorted(begin, place[t], "right") - 1
                arrays = [pa.array(own.id[own.owner[t]]), pa.array(t - own.first[own.owner[t]]), pa.array(size[t]), b.column(0).take(pa.array(d)), pa.array(place[t] - begin[d])]
                yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "offset", "length", "doc_id", "start"])

        found = src.mapInArrow(run, "item_id long, offset long, length long, doc_id long, start long")
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("item_id", "offset").agg(F.max(F.struct("length", (-F.col("doc_id")).alias("d"), (-F.col("start")).alias("s"))).alias("m"))
    return best.select("item_id", "offset", F.col("m.length").alias("length"), (-F.col("m.d")).alias("doc_id"), (-F.col("m.s")).alias("start"))


def keep_clean(docs: DataFrame, bench: DataFrame, window: int = 13) -> DataFrame:
    """The documents, all columns, that are not contaminated; repeated rows are judged alike, a null text is clean."""
    out = marked(docs, bench, window).where(~_contaminated())
    kind = docs.schema["text"].dataType
    return out.select(*[F.col(f"c{i}").cast(kind if c == "text" else docs.schema[i].dataType).alias(c) for i, c in enumerate(docs.columns)])
