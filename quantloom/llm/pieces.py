"""SentencePiece encoding and decoding with a forward pass shared over common prefixes.

A text is marked (spaces become U+2581, one is put in front) and cut before every mark. The distinct marked
words of a slice of documents are sorted, which lays them out as a trie in depth-first order, and one forward
pass walks it: the state at each depth is the last piece of the best segmentation of that prefix, kept on a
stack, so a common prefix is computed once. Ids are read off by going back along the stack.

The public model is a BPE model: its scores are merge ranks, and the segmentation it defines is the result of
merging, not the path of the greatest score sum. The forward state is therefore chosen by the rule under which
BPE obeys a forward recursion: a piece may follow the last piece of a shorter prefix only if merging the two
alone would leave both whole. Exactly one candidate passes at each depth. Runs of several marks and words of
over LONG characters are merged directly with a heap.

Edge cases: a null or empty text has no ids and decodes to the empty string; characters outside the model
become byte pieces; a literal U+2581 decodes to a space, as in the library; repeated rows get equal rows;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words longer than this are merged with a heap: their prefixes are rarely shared.
LONG = 64
#: Marked words kept between slices; beyond it the memory starts afresh.
KEPT = 500_000
#: Bytes of text whose distinct words are sorted together.
SLICE = 4_000_000
_RUNS = re.compile(r" *[^ ]+| +")


def default_model() -> str:
    """Path of the public 32k piece model on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary, merge ranks and the shared forward pass of one BPE model."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte = [0] * 256
        self.surface: list[bytes] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.surface.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            else:
                self.ids[p], self.rank[p] = i, sp.get_score(i)
                self.surface.append(p.encode().replace(MARK.encode(), b" "))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces of this model run across words")
        #: Ends of pieces: how far back a piece that ends at a place can start.
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        self.packed = {p: np.array([i], "<i4").tobytes() for p, i in self.ids.items()}
        #: piece before ("" for none) -> piece -> whether the two stay apart.
        self.pairs: dict[str, dict[str, bool]] = {}
        self.kept_pairs = 0
        self.known: dict[str, bytes] = {}

    def merge(self, s: str) -> list[str]:
        """Direct BPE: the best-ranked adjacent pair first, the leftmost among equals."""
        part: list[str | None] = list(s)
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0:
                both = part[i] + part[right[i]]
                if both in self.rank:
                    heapq.heappush(heap, (-self.rank[both], i, right[i], both))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] is None or right[i] != j or part[j] is None or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [p for p in part if p is not None]

    def _follows(self, before: str, piece: str) -> bool:
        """Whether merging both alone leaves them whole; remembered up to a bound."""
        if self.kept_pairs > 1_000_000:
            self.pairs.clear()
            self.kept_pairs = 0
        ok = self.merge(before + piece) == ([before, piece] if before else [piece])
        self.pairs.setdefault(before, {})[piece] = ok
        self.kept_pairs += 1
        return ok

    def _bytes(self, part: str) -> bytes:
        """Packed ids of a piece, or of the bytes of a character outside the model."""
        got = self.packed.get(part)
        return got if got is not None else np.array([self.byte[b] for b in part.encode()], "<i4").tobytes()

    def _pack(self, parts: Iterable[str]) -> bytes:
        return b"".join(map(self._bytes, parts))

    def learn(self, words: Iterable[str]) -> None:
        """Ids of marked words (a space for the mark) into memory: depth-first over their trie."""
        stack: list[str] = []  # stack[d]: the last piece of the first d+1 characters
        path = ""
        ids, tails, pairs, packed, empty = self.ids, self.tails, self.pairs, self.packed, {}
        for raw in sorted(words):
            w = raw.replace(" ", MARK)
            size = len(w)
            if size > LONG or w.startswith(MARK + MARK):
                self.known[raw] = self._pack(self.merge(w))
                continue
            d, top = 0, min(len(path), size)
            while d < top and path[d] == w[d]:
                d += 1
            del stack[d:]
            for i in range(d, size):
                # Pieces that end here, found by growing backwards; the longest are tried first.
                end, start, found = i + 1, i, [w[i]]
                while start:
                    start -= 1
                    p = w[start:end]
                    if p not in tails:
                        break
                    if p in ids:
                        found.append(p)
                for p in reversed(found):
                    before = stack[i - len(p)] if len(p) <= i else ""
                    ok = pairs.get(before, empty).get(p)
                    if ok or (ok is None and self._follows(before, p)):
                        stack.append(p)
                        break
                else:
                    raise AssertionError(f"no piece ends at {i} of {w!r}")
            path = w
            parts, i = [], size
            while i:
                p = stack[i - 1]
                parts.append(packed.get(p) or self._bytes(p))
                i -= len(p)
            parts.reverse()
            self.known[raw] = b"".join(parts)

    @staticmethod
    def cut(text: str) -> list[str]:
        """Marked words of a text, with a space for each mark."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return _RUNS.findall(" " + text)
        return [" " + w for w in text.split(" ")]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Distinct words that aren't known yet are learnt together."""
        cut = [self.cut(t) for t in texts]
        fresh = {w for ws in cut for w in ws} - self.known.keys()
        if len(self.known) + len(fresh) > KEPT:
            self.known.clear()
            fresh = {w for ws in cut for w in ws}
        self.learn(fresh)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<i4") for ws in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces side by side, marks as spaces, without the first one."""
        return b"".join(map(self.surface.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


_loaded: dict[str, Pieces] = {}


def _pieces(key: str, model: bytes) -> Pieces:
    """One instance by model and Python worker."""
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def tokenize(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, text_sha256, lossless): ids of every row's whole text, and what they decode to.

    model: path of a BPE SentencePiece model on the driver; its bytes (some 500 KB) go to the executors.
    """
    path = model or default_model()
    with open(path, "rb") as f:
        data = f.read()
    key = hashlib.sha256(data).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _pieces(key, shared.value)

        def flush(doc_ids: pa.Array, part: list[str]) -> pa.RecordBatch:
            ids = own.encode(part)
            plain = [own.decode(x.tolist()) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in plain]
            return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in ids], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(sha), pa.array([a == b for a, b in zip(plain, part)])], names=["doc_id", "n_tokens", "ids", "text_sha256", "lossless"])

        for b in batches:
            done, part, total = 0, [], 0
            for i, t in enumerate(b.column(1)):
                s = t.as_py() or ""
                if part and total + len(s) > SLICE:
                    yield flush(b.column(0).slice(done, i - done), part)
                    done, part, total = i, [], 0
                part.append(s)
                total += len(s)
            if part:
                yield flush(b.column(0).slice(done), part)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens int, ids array<int>, text_sha256 string, lossless boolean")
