"""SimHash near-duplicate groups by tiled exact comparison.

Each text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are cut into radius + 1 parts;
two within the radius share at least one of them whole, so fingerprints are compared within groups that share
a part. Every group is ordered by population count and cut into tiles of one count: a count moves by one at most
for every bit that differs, so tile pairs whose counts differ beyond the radius hold no link and are skipped.
The pairs of tiles that remain are compared in full with numpy exclusive-or and bit counts. Small groups are
compared many at a time; those of over TILE fingerprints are dealt out by tiles, large tiles in chunks. Each
comparison returns a spanning forest of what it linked, never all pairs.

Edge cases: null and empty texts (or texts of white space) have fingerprint zero and link like any other; a very
long text is hashed whole, in slices; repeated rows share a fingerprint and hence a group; an empty table gives
an empty result; columns other than the id and the text are ignored. A null id takes part in links but is never
the smallest id unless all ids of its group are null.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, components, free, materialize, texts

#: Fingerprints a tile aims at. Twice as many are held at once in a comparison.
TILE = 4096
_BLOCK = 1 << 20


def fingerprint(data: bytes, words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one text's UTF-8 bytes."""
    w = data.translate(LOWER).split()  # splits at exactly 0x20 and 0x09-0x0D
    if not w:
        return 0
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    k = min(words, len(w))
    first, last = (end - size)[: len(w) - k + 1].tolist(), end[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[i:j], seed) for i, j in zip(first, last)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, more: Sequence[str] = ()) -> DataFrame:
    """(id, fp) and further columns of docs: the signed 64-bit view of each text's fingerprint, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, words, seed) for t in texts(b, "text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["id", "fp", *more])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more)
    return src.mapInArrow(run, src.select("id", F.lit(0).cast("long").alias("fp"), *more).schema)


def _hook(label: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Roots by node, with the nodes of every link r-c brought under one root, the smallest."""
    while True:
        lr, lc = label[r], label[c]
        m = np.minimum(lr, lc)
        if not ((lr != m) | (lc != m)).any():
            return label
        # Only roots are hooked, so that what earlier blocks joined stays together; links stay until both ends have one root.
        np.minimum.at(label, lr, m)
        np.minimum.at(label, lc, m)
        while ((up := label[label]) != label).any():
            label = up


def _within(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (node, root) that join what lies within the radius inside of each group: a spanning forest."""
    key = group.astype(np.int64) * 128 + np.bitwise_count(fp)
    order = np.argsort(key, kind="stable")
    key, x = key[order], fp[order]
    label = np.arange(len(fp))
    # Partners of a fingerprint: those after it in its group whose population counts are at most radius greater.
    last = np.searchsorted(key, np.minimum(key + radius, key // 128 * 128 + 127), "right")
    n = last - np.arange(len(x)) - 1
    total = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(total, total[at] + _BLOCK, "right")) - 1)
        m = n[at:end]
        r = np.repeat(np.arange(at, end), m)
        c = np.arange(len(r)) - np.repeat(total[at:end] - total[at], m) + r + 1
        hit = np.bitwise_count(x[r] ^ x[c]) <= radius
        if hit.any():
            label = _hook(label, order[r[hit]], order[c[hit]])
        at = end
    node = np.nonzero(label != np.arange(len(label)))[0]
    return node, label[node]


def _across(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (node, root) into a and b, end to end, that join what lies within the radius between two tiles."""
    label = np.arange(len(a) + len(b))
    step = max(1, _BLOCK // max(1, len(b)))
    for i in range(0, len(a), step):
        r, c = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        if len(r):
            label = _hook(label, r + i, c + len(a))
    node = np.nonzero(label != np.arange(len(label)))[0]
    return node, label[node]


def links(distinct: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) exactly as all pairs within the radius do."""
    at = [64 * i // (radius + 1) for i in range(radius + 2)]
    word = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1).cast("long")) for lo, hi in zip(at, at[1:])]
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), w.alias("word")) for i, w in enumerate(word)]))
    base = distinct.select("fp", parts.alias("x")).select("fp", "x.part", "x.word", (F.bit_count("fp") - F.bit_count("x.word")).alias("rest"))
    base = materialize(base, "parts")
    # Groups over a tile are dealt out by the population count of their other bits, and each of these in chunks.
    sizes = base.groupBy("part", "word", "rest").agg(F.count("*").alias("c"))
    large = sizes.groupBy("part", "word").agg(F.sum("c").alias("total")).where(F.col("total") > tile).select("part", "word")
    cut = materialize(sizes.join(large, ["part", "word"]).select("part", "word", "rest", F.ceil(F.col("c") / F.lit(tile)).cast("int").alias("n")), "cuts")
    key = ["part", "word", "rest", "chunk"]
    placed = base.join(cut, ["part", "word", "rest"], "left").select(
        "part", "word", F.when(F.col("n").isNotNull(), F.col("rest")).otherwise(-1).alias("rest"), F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("n"))).otherwise(0).cast("int").alias("chunk"), "fp"
    )
    tiles = materialize(placed.groupBy(*key).agg(F.collect_list("fp").alias("fps")).where((F.size("fps") > 1) | (F.col("rest") >= 0)), "tiles")
    own = tiles.where(F.size("fps") > 1).select("fps", F.array().cast("array<long>").alias("fps2"), F.lit(True).alias("same"))
    # Pairs of tiles of one group: those whose population counts differ beyond the radius are left out.
    near = cut.withColumn("gap", F.explode(F.array(*[F.lit(i) for i in range(radius + 1)]))).withColumn("rest2", F.col("rest") + F.col("gap"))
    near = near.join(cut.select("part", "word", F.col("rest").alias("rest2"), F.col("n").alias("n2")), ["part", "word", "rest2"])
    near = near.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    first = F.when(F.col("gap") == 0, F.col("chunk") + 1).otherwise(0)
    near = near.where(first < F.col("n2")).withColumn("chunk2", F.explode(F.sequence(first, F.col("n2") - 1)))
    right = tiles.select("part", "word", F.col("rest").alias("rest2"), F.col("chunk").alias("chunk2"), F.col("fps").alias("fps2"))
    cross = near.join(tiles, key).join(right, ["part", "word", "rest2", "chunk2"]).select("fps", "fps2", F.lit(False).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, rite, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            lo, ro = left.offsets.to_numpy(), rite.offsets.to_numpy()
            lv, rv = left.values.to_numpy().view(np.uint64), rite.values.to_numpy().view(np.uint64)
            alone = np.array(same, bool)
            # All tiles that are compared with themselves, at once.
            size = np.diff(lo)
            flat, tile_of = lv[lo[0] : lo[-1]], np.repeat(np.arange(len(same)), size)
            inside = alone[tile_of]
            flat, tile_of = flat[inside], tile_of[inside]
            node, root = _within(flat, tile_of, radius)
            out_a, out_b = [flat[node]], [flat[root]]
            for k in np.nonzero(~alone)[0].tolist():
                a, b = lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]]
                node, root = _across(a, b, radius)
                both = np.concatenate([a, b])
                out_a.append(both[node])
                out_b.append(both[root])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])

    return own.unionByName(cross).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(id, fp, component): the group of every row, named by the smallest id reachable through links."""
    fp = materialize(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    least = _rooted(fp.groupBy("fp").agg(F.min("id").alias("first")), radius, tile)
    roots = least.groupBy("root").agg(F.min("first").alias("component"))
    final = least.join(roots, "root").select("fp", "component")
    return fp.join(final, "fp").select("id", "fp", "component")


def _rooted(classes: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fp, first, root): the rows of a table (fp, first), one by fingerprint, and the fingerprint that names their group."""
    classes = materialize(classes, "classes")
    joined = components(links(classes, radius, tile))
    info = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    return materialize(info, "rooted")


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The documents, all columns, less all but one of each near-duplicate group: that of the smallest id stays.

    Rows are told apart by id, text and all other columns together, so rows that share an id but not a group all
    count; of equal ids in a group the row of least text digest, then of least digest of the other columns, stays,
    and of rows equal in everything one. A row without an id stays only where no row of its group has one. Null
    and empty texts are one group; an empty table gives an empty result.
    """
    none, own, text, rest = free(docs, "_none", "_own", "_text", "_rest")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    named = [none, own, text, rest]
    keyed = docs.withColumns({none: F.col("doc_id").isNull(), own: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), text: F.xxhash64("text"), rest: F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")})
    fp = materialize(fingerprints(keyed, "doc_id", "text", more=named), "fingerprints")
    least = _rooted(fp.groupBy("fp").agg(F.min(F.struct(*named)).alias("first")), radius, TILE)
    stay = least.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return keyed.join(stay, named, "left_semi").dropDuplicates(named).drop(*named)
