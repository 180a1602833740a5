"""Lossless WebP (VP8L): a decoder of the whole format and a writer of media columns.

The decoder works on many images at once, one pixel of each a step: it reads prefix codes (simple and normal,
with meta codes), back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms, giving arrays of pixels.

The writer stores bytes as pixels (red, green, blue, alpha in the bytes' order), HEIGHT rows of WIDTH pixels
an image at most; further bytes go to further images, whose files follow one another. By estimated size it
picks for each image no transform, a palette, a predictor (left or top), subtract-green or cross-colour, and
with or without a colour cache; pixels that repeat become back-references. Prefix codes are Huffman codes.

Edge cases of media(): a null or empty text is 64 zero bytes; equal texts give equal rows; repeated rows
repeat; very long texts are many images, of which a bounded number of which is handled at once; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

WIDTH, HEIGHT = 16, 128
#: Images that are written at once and read at once, and payload bytes that a task holds before it hands rows on.
GROUP, READ, HELD = 1024, 4096, 8 << 20
# Order in which code lengths of the code-length code are stored, and the neighbours of short distance codes.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEIGHBOURS = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_FACTOR = 0x1E35A7BD
_LITERALS, _LENGTHS, _DISTANCES = 256, 24, 40
#: Bits of the writer's colour cache, of its longest green and other prefix codes, and the pixels of its shortest back-reference.
CACHE_BITS, LONGEST, LEAST_RUN = 6, (10, 9, 9, 9, 9), 4
#: Bits of a pixel's number among those of GROUP images.
PLACE = 21
_NEAR = np.array(NEIGHBOURS, np.int64)
#: Numbers of 15 bits, read backwards.
_BACK = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], np.int64)
#: How often each part of the decoder ran in this process, in images.
USED: dict[str, int] = {}


def _used(part: str, n: int) -> None:
    if n:
        USED[part] = USED.get(part, 0) + n


class Streams:
    """Bits of many byte strings, least significant first, each read at a place of its own."""

    def __init__(self, parts: list[bytes]) -> None:
        size = np.array([len(p) for p in parts], np.int64)
        first = np.concatenate([[0], np.cumsum(size + 8)])
        flat = np.frombuffer(b"".join(p + bytes(8) for p in parts) + bytes(8), np.uint8)
        n = len(flat) - 7
        #: The eight bytes from every byte on, as one number; only its low bits are used, so that its sign doesn't matter.
        self.word = np.zeros(n, np.int64)
        view = self.word.view(np.uint8).reshape(n, 8)
        for i in range(8):
            view[:, i] = flat[i : i + n]
        self.at = first[:-1] * 8
        self.end = self.at + size * 8

    def peek(self, who) -> np.ndarray:
        """At least 57 right bits from each one's place on."""
        at = self.at[who]
        return self.word.take(at >> 3, mode="clip") >> (at & 7)

    def read(self, who, n) -> np.ndarray:
        """n bits of each (a number, or one by stream)."""
        n = np.asarray(n, np.int64)
        out = self.peek(who) & ((np.int64(1) << n) - 1)
        self.at[who] += n
        return out

    def check(self, who) -> None:
        if (self.at[who] > self.end[who]).any():
            raise ValueError("the bit stream ends early")


def tables(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Look-up rows of canonical prefix codes (code lengths by row), and their bits: symbol << 4 | length by the next bits.

    A code of one symbol takes no bits; a code of none is symbol 0.
    """
    size = lengths.copy()
    used = (size > 0).sum(axis=1)
    size[used == 0, 0] = 1
    bits = int(size[used > 1].max()) if (used > 1).any() else 0
    row, symbol = np.nonzero(size)
    length = size[row, symbol]
    length = np.where(used[row] > 1, length, 0)
    share = 1 << (bits - length)
    if (np.bincount(row, share, len(size)) != 1 << bits).any():
        raise ValueError("a prefix code isn't complete")
    ranked = np.sort((row << 4 | length) << 12 | symbol)
    length = ranked >> 12 & 15
    high = np.repeat(((ranked & 4095) << 4 | length).astype(np.uint16), 1 << (bits - length)).reshape(len(size), 1 << bits)
    return high[:, _BACK[np.arange(1 << bits) << (15 - bits)]], bits


def read_codes(s: Streams, who: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Code lengths of one prefix code of each stream, over alphabets of these sizes."""
    most = int(size.max())
    out = np.zeros((len(who), most), np.int64)
    simple = s.read(who, 1) == 1
    at = np.nonzero(simple)[0]
    if len(at):
        two = s.read(who[at], 1) == 1
        out[at, s.read(who[at], np.where(s.read(who[at], 1) == 1, 8, 1))] = 1
        out[at[two], s.read(who[at[two]], 8)] = 1
    at = np.nonzero(~simple)[0]
    if not len(at):
        return out
    outer = np.zeros((len(at), 19), np.int64)
    n = 4 + s.read(who[at], 4)
    for i, symbol in enumerate(LENGTH_ORDER):
        has = np.nonzero(i < n)[0]
        outer[has, symbol] = s.read(who[at[has]], 3)
    table, bits = tables(outer)
    left = size[at].copy()
    cut = np.nonzero(s.read(who[at], 1) == 1)[0]
    left[cut] = 2 + s.read(who[at[cut]], 2 + 2 * s.read(who[at[cut]], 3))
    place, last, limit = np.zeros(len(at), np.int64), np.full(len(at), 8), size[at]
    found: list[tuple[np.ndarray, ...]] = []
    while True:
        live = np.nonzero((place < limit) & (left > 0))[0]
        if not len(live):
            break
        left[live] -= 1
        x = s.peek(who[at[live]])
        e = table[live, x & ((1 << bits) - 1)].astype(np.int64)
        symbol, used = e >> 4, e & 15
        x = x >> used
        # 16 repeats the last length 3 to 6 times, 17 and 18 repeat zero 3 to 10 and 11 to 138 times.
        extra = np.select([symbol == 16, symbol == 17, symbol == 18], [2, 3, 7], 0)
        many = np.select([symbol == 16, symbol == 17, symbol == 18], [3, 3, 11], 1) + (x & ((1 << extra) - 1))
        value = np.where(symbol < 16, symbol, np.where(symbol == 16, last[live], 0))
        s.at[who[at[live]]] += used + extra
        found.append((at[live], place[live], many, value))
        place[live] += many
        plain = (symbol < 16) & (symbol > 0)
        last[live[plain]] = symbol[plain]
    if (place > limit).any():
        raise ValueError("code lengths run over their alphabet")
    row, start, many, value = (np.concatenate(c) for c in zip(*found))
    flat = np.repeat(row * most + start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    out.reshape(-1)[flat] = np.repeat(value, many)
    return out


def _extra(s: Streams, who: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Lengths or distances from their prefix codes and extra bits."""
    n = np.maximum(code - 2, 0) >> 1
    more = s.read(who, n)
    return np.where(code < 4, code + 1, ((2 + (code & 1)) << n) + more + 1)


def read_images(s: Streams, who: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> list[np.ndarray]:
    """One entropy-coded image of each stream, as ARGB numbers in one row."""
    if not len(who):
        return []
    # The longest first, so that those still being read stand in front.
    order = np.argsort(-(width * height), kind="stable")
    who, width, height = who[order], width[order], height[order]
    n, k = width * height, len(who)
    caching = s.read(who, 1) == 1
    cache_bits = np.zeros(k, np.int64)
    cache_bits[caching] = s.read(who[caching], 4)
    _used("cache", int(caching.sum()))
    groups, step, meta = np.ones(k, np.int64), np.zeros(k, np.int64), {}
    if main:
        has = np.nonzero(s.read(who, 1) == 1)[0]
        if len(has):
            _used("meta", len(has))
            step[has] = s.read(who[has], 3) + 2
            w, h = -(-width[has] >> step[has]), -(-height[has] >> step[has])
            for i, at, cols in zip(has.tolist(), read_images(s, who[has], w, h, False), w.tolist()):
                meta[i] = (at >> 8 & 0xFFFF).astype(np.int64).reshape(-1, cols)
                groups[i] = meta[i].max() + 1
    # Row of each stream's and group's codes in the look-up tables.
    sizes = [_LITERALS + _LENGTHS + np.where(cache_bits > 0, 1 << cache_bits, 0), *[np.full(k, m) for m in (_LITERALS, _LITERALS, _LITERALS, _DISTANCES)]]
    first = np.zeros((k, int(groups.max())), np.int64)
    lengths: list[list[np.ndarray]] = [[] for _ in sizes]
    rows = 0
    for g in range(int(groups.max())):
        has = np.nonzero(groups > g)[0]
        first[has, g] = rows + np.arange(len(has))
        rows += len(has)
        for kept, size in zip(lengths, sizes):
            got = read_codes(s, who[has], size[has])
            kept.append(np.pad(got, ((0, 0), (0, int(size.max()) - got.shape[1]))))
    code = [tables(np.concatenate(x)) for x in lengths]
    flat, wide = [t.reshape(-1) for t, _ in code], [b for _, b in code]
    mask = [(1 << b) - 1 for b in wide]
    close = sum(wide[:4]) <= 56
    out = np.zeros((int(n[0]), k), np.uint32)
    # Bytes of a pixel: blue, green, red, alpha.
    channel = out.astype("<u4", copy=False).view(np.uint8).reshape(int(n[0]), k, 4)
    caches = np.zeros((k, int(1 << cache_bits.max())), np.uint32) if caching.any() else None
    shift = (32 - cache_bits).astype(np.uint32)
    left, back = np.zeros(k, np.int64), np.zeros(k, np.int64)
    at, word = s.at[who], s.word
    row = first[:, 0]
    base = [row << b for b in wide]
    for t in range(int(n[0])):
        m = int(np.searchsorted(-n, -t, "left"))
        copying = left[:m] > 0
        busy = bool(copying.any())
        i = np.nonzero(~copying)[0] if busy else slice(0, m)
        if meta:
            row = first[:, 0].copy()
            for j, v in meta.items():
                if j < m:
                    row[j] = first[j, v[t // width[j] >> step[j], t % width[j] >> step[j]]]
            base = [row << b for b in wide]
        p = at[i]
        x = word.take(p >> 3, mode="clip") >> (p & 7)
        e = flat[0].take(base[0][i] + (x & mask[0]))
        symbol, own_bits = e >> 4, e & 15
        used, total = own_bits, own_bits
        now = channel[t]
        now[i, 1] = symbol
        for c, byte in ((1, 2), (2, 0), (3, 3)):
            x = x >> used if close else word.take(p + total >> 3, mode="clip") >> (p + total & 7)
            e = flat[c].take(base[c][i] + (x & mask[c]))
            now[i, byte] = e >> 4
            used = e & 15
            total = total + used
        other = symbol >= _LITERALS
        if other.any():
            at[i] = p + np.where(other, own_bits, total)
            place = np.arange(m) if not busy else i
            ref = np.nonzero(other & (symbol < _LITERALS + _LENGTHS))[0]
            if len(ref):
                own = place[ref]
                s.at[who[own]] = at[own]
                length = _extra(s, who[own], symbol[ref].astype(np.int64) - _LITERALS)
                e = flat[4].take(base[4][own] + (s.peek(who[own]) & mask[4])).astype(np.int64)
                s.at[who[own]] += e & 15
                d = _extra(s, who[own], e >> 4)
                near = _NEAR[np.minimum(d, len(_NEAR)) - 1]
                d = np.where(d <= len(_NEAR), np.maximum(1, near[:, 0] + near[:, 1] * width[own]), d - len(_NEAR))
                if (d > t).any() or (t + length > n[own]).any():
                    raise ValueError("a back-reference leaves the image")
                at[own], left[own], back[own] = s.at[who[own]], length, d
                busy = True
                copying[own] = True
                _used("references", len(ref))
            hit = np.nonzero(symbol >= _LITERALS + _LENGTHS)[0]
            if len(hit):
                own = place[hit]
                out[t, own] = caches[own, symbol[hit].astype(np.int64) - _LITERALS - _LENGTHS]
        else:
            at[i] = p + total
        if busy:
            c = np.nonzero(copying)[0]
            out[t, c] = out[t - back[c], c]
            left[c] -= 1
        if caches is not None:
            c = np.nonzero(caching[:m])[0]
            v = out[t, c]
            caches[c, (np.uint32(CACHE_FACTOR) * v) >> shift[c]] = v
    s.at[who] = at
    s.check(who)
    got: list[np.ndarray] = [out[:0, 0]] * k
    for j, place in enumerate(order.tolist()):
        got[place] = out[: n[j], j].copy()
    return got


def _channels(argb: np.ndarray) -> np.ndarray:
    """Red, green, blue, alpha as whole numbers in a last axis."""
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], axis=-1).astype(np.int64)


def _predict(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Prediction of one pixel from its neighbours, each four channels."""
    half = lambda a, b: (a + b) >> 1
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return half(half(left, right), top)
        case 6:
            return half(left, corner)
        case 7:
            return half(left, top)
        case 8:
            return half(corner, top)
        case 9:
            return half(top, right)
        case 10:
            return half(half(left, corner), half(top, right))
        case 11:
            # The nearer of left and top to left + top - corner, by the sum over the channels.
            return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
        case 12:
            return np.clip(left + top - corner, 0, 255)
        case 13:
            mean = half(left, top)
            diff = mean - corner
            return np.clip(mean + np.where(diff < 0, -(-diff >> 1), diff >> 1), 0, 255)
    return np.array([0, 0, 0, 255])


def _unpredict(image: np.ndarray, mode: np.ndarray, step: int) -> np.ndarray:
    """Adds predictions to residuals, row by row; runs that predict from above or from the left alone in bulk."""
    height, width, _ = image.shape
    out = image
    out[0, 0] = (out[0, 0] + [0, 0, 0, 255]) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        modes = np.repeat(mode[y >> step], 1 << step)[:width]
        if (modes == modes[0]).all() and modes[0] in (0, 1, 2, 3, 4, 8, 9):
            m = int(modes[0])
            if m == 1:
                out[y] = np.cumsum(row, axis=0) & 255
            elif m == 0:
                row[1:, 3] = (row[1:, 3] + 255) & 255
            else:
                corner, right = above[:-1], np.vstack([above[2:], row[:1]])[: width - 1]
                guess = {2: above[1:], 3: right, 4: corner, 8: (corner + above[1:]) >> 1, 9: (above[1:] + right) >> 1}[m]
                row[1:] = (row[1:] + guess) & 255
            continue
        for x in range(1, width):
            right = above[x + 1] if x + 1 < width else row[0]
            row[x] = (row[x] + _predict(int(modes[x]), row[x - 1], above[x], above[x - 1], right)) & 255
    return out


def _restore(argb: np.ndarray, height: int, now: int, todo: list[tuple]) -> np.ndarray:
    """Pixels (height, width, 4) from an entropy-coded image and its transforms, the last undone first."""
    if not todo:
        return argb.astype("<u4", copy=False).view(np.uint8).reshape(height, now, 4)[..., [2, 1, 0, 3]]
    image = _channels(argb).reshape(height, now, 4)
    for kind, step, extra, before in reversed(todo):
        if kind == 2:
            image[..., [0, 2]] = (image[..., [0, 2]] + image[..., [1]]) & 255
        elif kind == 1:
            by = extra[np.arange(height)[:, None] >> step, np.arange(before)[None] >> step]
            signed = lambda x: (x & 255 ^ 128) - 128
            delta = lambda t, c: signed(t) * signed(c) >> 5
            image[..., 0] = (image[..., 0] + delta(by[..., 2], image[..., 1])) & 255
            image[..., 2] = (image[..., 2] + delta(by[..., 1], image[..., 1]) + delta(by[..., 0], image[..., 0])) & 255
        elif kind == 3:
            index = image[..., 1]
            if step:
                width_bits = 8 >> step
                index = (index[..., None] >> (np.arange(1 << step) * width_bits) & ((1 << width_bits) - 1)).reshape(height, -1)[:, :before]
            table = np.vstack([extra, np.zeros((256 - len(extra), 4), np.int64)])
            image = table[index]
        else:
            image = _unpredict(image, extra[..., 1] & 15, step)
    return image.astype(np.uint8)


_PARTS = {0: "predictor", 1: "cross-colour", 2: "subtract-green", 3: "palette"}


def decode_images(parts: list[bytes]) -> list[np.ndarray]:
    """Pixels (height, width, 4: red, green, blue, alpha) of VP8L bit streams, all at once."""
    if not parts:
        return []
    s, who = Streams(parts), np.arange(len(parts))
    if (s.read(who, 8) != 0x2F).any():
        raise ValueError("not a lossless WebP stream")
    width, height = s.read(who, 14) + 1, s.read(who, 14) + 1
    s.read(who, 1)
    if s.read(who, 3).any():
        raise ValueError("unknown version")
    s.check(who)
    todo: list[list[tuple]] = [[] for _ in parts]
    now, more = width.copy(), who[s.read(who, 1) == 1]
    while len(more):
        kind = s.read(more, 2)
        if any(t[0] == k for i, k in zip(more.tolist(), kind.tolist()) for t in todo[i]):
            raise ValueError("a transform stands twice")
        for k, part in _PARTS.items():
            own = more[kind == k]
            _used(part, len(own))
            if k == 2:
                for i in own.tolist():
                    todo[i].append((k, 0, None, int(now[i])))
            elif k < 2 and len(own):
                step = s.read(own, 3) + 2
                w, h = -(-now[own] >> step), -(-height[own] >> step)
                for i, p, q, cols, image in zip(own.tolist(), step.tolist(), h.tolist(), w.tolist(), read_images(s, own, w, h, False)):
                    todo[i].append((k, p, _channels(image).reshape(q, cols, 4), int(now[i])))
            elif len(own):
                n = s.read(own, 8) + 1
                for i, c, image in zip(own.tolist(), n.tolist(), read_images(s, own, n, np.ones(len(own), np.int64), False)):
                    pack = 3 if c <= 2 else 2 if c <= 4 else 1 if c <= 16 else 0
                    todo[i].append((k, pack, np.cumsum(_channels(image), axis=0) & 255, int(now[i])))
                    now[i] = -(-now[i] >> pack)
        more = more[s.read(more, 1) == 1]
    return [_restore(x, int(height[i]), int(now[i]), todo[i]) for i, x in enumerate(read_images(s, who, now, height, True))]


def decode_image(data: bytes) -> np.ndarray:
    """Pixels of one VP8L bit stream."""
    return decode_images([data])[0]


def files(data: bytes) -> Iterator[bytes]:
    """The VP8L streams of WebP files that follow one another."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end, at = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12
        while at < end:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at : at + 4] == b"VP8L":
                yield data[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)


def decode_all(stored: list[bytes]) -> Iterator[list[np.ndarray]]:
    """For each string of WebP files that follow one another, its pixel arrays; READ images are read at once."""
    held: list[tuple[int, bytes]] = []
    got: dict[int, list[np.ndarray]] = {}
    sent = 0
    for i, data in enumerate(stored):
        held += [(i, x) for x in files(data)]
        if len(held) >= READ or i + 1 == len(stored):
            # Images of like size side by side, so that the work of a group isn't that of its longest.
            order = sorted(range(len(held)), key=lambda j: len(held[j][1]))
            images: list[np.ndarray | None] = [None] * len(held)
            for a in range(0, len(order), READ):
                part = order[a : a + READ]
                for j, image in zip(part, decode_images([held[j][1] for j in part])):
                    images[j] = image
            for (owner, _), image in zip(held, images):
                got.setdefault(owner, []).append(image)
            held = []
            while sent <= i:
                yield got.pop(sent, [])
                sent += 1


def decode(data: bytes) -> list[np.ndarray]:
    """Pixel arrays of WebP files that follow one another."""
    return next(decode_all([data]))


def code_lengths(count: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of Huffman codes over the counts of each row, no longer than most; a lone symbol has length 1.

    Counts are halved, and the code made anew, where it is too long.
    """
    count, out = count.astype(np.int64), np.zeros(count.shape, np.int64)
    todo = np.arange(len(count))
    while len(todo):
        own = count[todo]
        used = (own > 0).sum(axis=1)
        n = int(used.max())
        far = np.iinfo(np.int64).max >> 2
        order = np.argsort(np.where(own > 0, own, far), axis=1, kind="stable")[:, :n]
        row = np.arange(len(todo))
        leaf = np.full((len(todo), n + 2), far)
        leaf[:, :n] = np.take_along_axis(own, order, axis=1)
        leaf[:, :n][np.arange(n) >= used[:, None]] = far
        # Two queues: leaves by count, and inner nodes in the order of their making, which is that of their counts.
        inner = np.full(leaf.shape, far)
        above_leaf, above = np.zeros(leaf.shape, np.int64), np.zeros(leaf.shape, np.int64)
        flat = [x.reshape(-1) for x in (leaf, inner, above_leaf, above)]
        # Rows with most symbols in front; places in the flat queues.
        by = np.argsort(-used, kind="stable")
        start = by * (n + 2)
        i, j = start.copy(), start.copy()
        for step in range(n - 1):
            m = int(np.searchsorted(-used[by], -(step + 1), "left"))
            total = 0
            for _ in range(2):
                p, q = i[:m], j[:m]
                a, b = flat[0].take(p), flat[1].take(q)
                first = a <= b
                flat[2][p[first]] = step
                flat[3][q[~first]] = step
                p += first
                q += ~first
                total = total + np.minimum(a, b)
            flat[1][start[:m] + step] = total
        depth = np.zeros((len(todo), n + 2), np.int64)
        for step in range(n - 3, -1, -1):
            live = row[used - 2 > step]
            depth[live, step] = depth[live, above[live, step]] + 1
        size = np.where(np.arange(n) < used[:, None], np.where(used[:, None] > 1, np.take_along_axis(depth, above_leaf[:, :n], axis=1) + 1, 1), 0)
        whole = np.zeros(own.shape, np.int64)
        np.put_along_axis(whole, order, size, axis=1)
        out[todo] = whole
        again = size.max(axis=1, initial=0) > most
        todo = todo[again]
        count[todo] = np.where(count[todo] > 0, np.maximum(count[todo] >> 1, 1), 0)
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of each row as bits in the order of writing << 4 | their number; a lone symbol takes none."""
    row, symbol = np.nonzero(np.where((lengths > 0).sum(axis=1, keepdims=True) > 1, lengths, 0))
    ranked = np.sort((row << 4 | lengths[row, symbol]) << 12 | symbol)
    row, length, symbol = ranked >> 16, ranked >> 12 & 15, ranked & 4095
    # In units of the longest code, codes are the sums of the shares before them.
    share = np.int64(1) << (15 - length)
    start = np.cumsum(share) - share
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    start -= np.repeat(start[first], np.diff(np.append(np.nonzero(first)[0], len(row))))
    out = np.zeros(lengths.shape, np.int64)
    out[row, symbol] = _BACK[start] << 4 | length
    return out


class Tokens:
    """Values of some bits each, by image, in the order in which they are added to it."""

    def __init__(self) -> None:
        self.image: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        self.size: list[np.ndarray] = []

    def add(self, image, value, size) -> None:
        image, value, size = np.broadcast_arrays(np.asarray(image), value, size)
        self.image.append(image.ravel())
        self.value.append(value.ravel().astype(np.uint64))
        self.size.append(size.ravel().astype(np.int64))

    def streams(self, n: int) -> list[bytes]:
        """The bytes of n images."""
        image = np.concatenate(self.image)
        order = np.argsort(image, kind="stable")
        image, value, size = image[order], np.concatenate(self.value)[order], np.concatenate(self.size)[order]
        total = np.bincount(image, size, n).astype(np.int64)
        whole = (total + 7) // 8
        first = np.concatenate([[0], np.cumsum(whole)])
        before = np.concatenate([[0], np.cumsum(total)])[:-1]
        at = np.cumsum(size) - size - before[image] + first[image] * 8
        low, shift = at >> 6, (at & 63).astype(np.uint64)
        buf = np.zeros(int(first[-1]) // 8 + 3, np.uint64)
        np.add.at(buf, low, value << shift)
        np.add.at(buf, low + 1, np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0)))
        data = buf.astype("<u8").tobytes()
        return [data[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def put_codes(out: Tokens, image: np.ndarray, lengths: np.ndarray) -> None:
    """One prefix code of each image: a simple one for a lone symbol, else code lengths with runs of zeros, in a code of their own."""
    used = (lengths > 0).sum(axis=1)
    lone = np.nonzero(used <= 1)[0]
    out.add(image[lone], 1 | 0 << 1 | 1 << 2 | lengths[lone].argmax(axis=1) << 3, 11)
    at = np.nonzero(used > 1)[0]
    if not len(at):
        return
    own, size = lengths[at], lengths.shape[1]
    flat = own.reshape(-1)
    edge = np.ones(len(flat), bool)
    edge[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    edge[::size] = True
    start = np.nonzero(edge)[0]
    run, value = np.diff(np.append(start, len(flat))), flat[start]
    # Zeros go in runs of 138, the rest of them as one run, or one by one where fewer than 3.
    zero = value == 0
    full, rest = np.where(zero, run // 138, 0), np.where(zero, run % 138, 0)
    single = np.where(zero, np.where(rest < 3, rest, 1), 1)
    n = full + single
    owner = np.repeat(np.arange(len(start)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    rest, big = rest[owner], k < full[owner]
    symbol = np.where(~zero[owner], value[owner], np.where(big | (rest >= 11), 18, np.where(rest >= 3, 17, 0)))
    more = np.where(big, 127, np.where(rest >= 11, rest - 11, rest - 3))
    extra = np.select([symbol == 17, symbol == 18], [3, 7], 0)
    row = start[owner] // size
    outer = code_lengths(np.bincount(row * 19 + symbol, minlength=len(at) * 19).reshape(-1, 19), 7)
    got = codes(outer)[row, symbol]
    out.add(image[at], (19 - 4) << 1, 5)
    out.add(np.repeat(image[at], 19), outer[:, LENGTH_ORDER].reshape(-1), 3)
    out.add(image[at], 0, 1)
    out.add(image[at][row], got >> 4 | np.where(extra > 0, more, 0) << (got & 15), (got & 15) + extra)


def _prefixed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix code, extra bits, their number) of lengths or distances."""
    x = v - 1
    n = np.maximum(np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) - 1, 0)
    high = x >> n
    return np.where(x < 4, x, 2 * n + 2 + (high & 1)), np.where(x < 4, 0, x & ((1 << n) - 1)), np.where(x < 4, 0, n)


def references(argb: np.ndarray, first: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of runs of pixels that stood before in their image."""
    none = (np.zeros(0, np.int64),) * 3
    n = len(argb)
    if n < LEAST_RUN + 1:
        return none
    h = argb.astype(np.uint64) + np.uint64(1)
    g = h[: n - LEAST_RUN + 1].copy()
    for i in range(1, LEAST_RUN):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : n - LEAST_RUN + 1 + i]
    g = (g ^ g >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + image[: len(g)].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    # The place stands in the low bits: one sort, equal grams in the order of their places.
    low = np.uint64((1 << PLACE) - 1)
    g = np.sort(g & ~low | np.arange(len(g), dtype=np.uint64))
    same = (g[1:] ^ g[:-1]) <= low
    order = (g & low).astype(np.int64)
    here, there = order[1:][same], order[:-1][same]
    ok = (image[here] == image[there]) & (here + LEAST_RUN <= first[image[here] + 1])
    for i in range(LEAST_RUN):
        ok &= argb[np.minimum(here + i, n - 1)] == argb[np.minimum(there + i, n - 1)]
    here, there = here[ok], there[ok]
    by = np.argsort(here)
    places, lengths, distances, end = [], [], [], 0
    for p, q in zip(here[by].tolist(), there[by].tolist()):
        if p < end:
            continue
        stop = int(first[image[p] + 1])
        length, step = LEAST_RUN, 16
        while p + length < stop:
            many = min(step, stop - p - length)
            differ = argb[p + length : p + length + many] != argb[q + length : q + length + many]
            if differ.any():
                length += int(differ.argmax())
                break
            length += many
            step *= 4
        length = min(length, 4096)
        end = p + length
        places.append(p)
        lengths.append(length)
        distances.append(p - q)
    return (np.array(places, np.int64), np.array(lengths, np.int64), np.array(distances, np.int64)) if places else none


_LOG = np.arange(WIDTH * HEIGHT + 1) * np.log2(np.maximum(np.arange(WIDTH * HEIGHT + 1), 1))
_COST = np.where(np.arange(len(_LOG)) > 0, 5 - _LOG, 0).astype(np.float32)


def _bits(count: np.ndarray) -> np.ndarray:
    """Estimated bits of an image's symbols with these counts (last axis), and of their code."""
    return _LOG[count.sum(axis=-1)] + _COST[count].sum(axis=-1)


def _count(image: np.ndarray, value: np.ndarray, n: int, size: int) -> np.ndarray:
    return np.bincount(image * size + value, minlength=n * size).reshape(n, size)


def put_images(out: Tokens, owner: np.ndarray, parts: list[np.ndarray], main: bool) -> None:
    """Entropy-coded images (ARGB numbers), those of the main kind with references and, where it helps, a colour cache."""
    k = len(parts)
    if not k:
        return
    argb = np.concatenate(parts)
    size = np.array([len(p) for p in parts], np.int64)
    first, image = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(k), size)
    # A pixel is a literal unless a reference covers it or the cache holds it.
    token = np.zeros(len(argb), np.int64)
    place = length = distance = np.zeros(0, np.int64)
    if main:
        place, length, distance = references(argb, first, image)
        cover = np.zeros(len(argb) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + length, -1)
        token[np.cumsum(cover)[:-1] > 0] = 1
        key = ((np.uint32(CACHE_FACTOR) * argb) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
        ranked = np.sort((image << CACHE_BITS | key) << PLACE | np.arange(len(argb)))
        order = ranked & ((1 << PLACE) - 1)
        seen = argb[order]
        hit = np.zeros(len(argb), bool)
        hit[order[1:]] = ((ranked[1:] ^ ranked[:-1]) < 1 << PLACE) & (seen[1:] == seen[:-1])
        hit &= token == 0
    by = argb.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    channel = [np.ascontiguousarray(by[:, x]) for x in (1, 2, 0, 3)]
    slot = image * 256
    tally = lambda at: [np.bincount(slot[at] + c[at], minlength=k * 256).reshape(k, 256) for c in channel]
    count = tally(np.nonzero(token == 0)[0] if len(place) else slice(None))
    caching = np.zeros(k, bool)
    if main and hit.any():
        at = np.nonzero(hit)[0]
        fewer = [a - b for a, b in zip(count, tally(at))]
        with_cache = np.concatenate([fewer[0], _count(image[at], key[at], k, 1 << CACHE_BITS)], axis=1)
        caching = (np.bincount(image[at], minlength=k) > 0) & (_bits(with_cache) + sum(map(_bits, fewer[1:])) < sum(map(_bits, count)))
        token[at[caching[image[at]]]] = 2
        count = [np.where(caching[:, None], b, a) for a, b in zip(count, fewer)]
    ref_code, ref_extra, ref_bits = _prefixed(length)
    far_code, far_extra, far_bits = _prefixed(distance + len(NEIGHBOURS))
    at = image[place]
    green = np.concatenate([count[0], _count(at, ref_code, k, _LENGTHS)], axis=1)
    cached = token == 2
    if cached.any():
        green = np.concatenate([green, _count(image[cached], key[cached], k, 1 << CACHE_BITS)], axis=1)
    lengths = [code_lengths(c, most) for c, most in zip((green, *count[1:], _count(at, far_code, k, _DISTANCES)), LONGEST)]
    if main:
        out.add(owner, np.where(caching, 1 | CACHE_BITS << 1, 0), np.where(caching, 5, 1))
        out.add(owner, 0, 1)
    else:
        out.add(owner, 0, 1)
    some = np.nonzero(caching)[0]
    rest = np.nonzero(~caching)[0]
    for i, v in enumerate(lengths):
        if i:
            put_codes(out, owner, v)
        else:
            put_codes(out, owner[rest], v[rest, : _LITERALS + _LENGTHS])
            put_codes(out, owner[some], v[some])
    # Code and bits in one number; those of a literal's four channels follow one another.
    packed = [codes(v) for v in lengths]
    value, wide = np.zeros(len(argb), np.int64), np.zeros(len(argb), np.int64)
    own = np.nonzero(token == 0)[0]
    v, n, of = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), slot[own]
    for c, e in zip(channel, packed):
        got = np.ascontiguousarray(e[:, :256]).reshape(-1).take(of + c[own])
        v |= got >> 4 << n
        n += got & 15
    value[own], wide[own] = v, n
    if cached.any():
        got = packed[0][image[cached], _LITERALS + _LENGTHS + key[cached]]
        value[cached], wide[cached] = got >> 4, got & 15
    # A reference is a length and its extra bits, a distance and its extra bits, at most 10 + 11 + 9 + 13 bits.
    got, far = packed[0][at, _LITERALS + ref_code], packed[4][at, far_code]
    v, n = got >> 4, got & 15
    for x, y in ((ref_extra, ref_bits), (far >> 4, far & 15), (far_extra, far_bits)):
        v, n = v + (x << n), n + y
    value[place], wide[place] = v, n
    written = token != 1
    written[place] = True
    out.add(owner[image[written]], value[written], wide[written])


def _modelled(pixels: np.ndarray, start: np.ndarray, image: np.ndarray, k: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Estimated bits by image and way of writing it, and the channels (red, green, blue, alpha) that each way leaves.

    Ways: 0 as it is, 1 predicted from the left, 2 from above, 3 less green, 4 cross-colour (blue less red).
    """
    # Differences of bytes wrap around by themselves.
    by = pixels.reshape(-1, WIDTH, 4)
    left = by.copy()
    left[:, 1:] -= by[:, :-1]
    above = by.copy()
    above[1:] -= by[:-1]
    row = start[:-1] // WIDTH
    first = above[:, 0].copy()
    first[row] = by[row, 0] - np.array([0, 0, 0, 255], np.uint8)
    left[:, 0] = first
    above[row] = left[row]
    r, g, b, a = (np.ascontiguousarray(pixels[:, i]) for i in range(4))
    whole = [r, g, b, a]
    ways = [whole, list(left.reshape(-1, 4).T), list(above.reshape(-1, 4).T), [r - g, g, b - g, a], [r, g, b - r, a]]
    at = image * 256
    bits = lambda v: _bits(np.bincount(at + v, minlength=k * 256).reshape(k, 256))
    plain = [bits(v) for v in whole]
    cost = np.stack([sum(p if v is o else bits(v) for v, o, p in zip(w, whole, plain)) for w in ways], axis=1)
    cost[:, 1:3] += 64
    cost[:, 4] += 64
    return cost, ways


def encode_images(images: list[np.ndarray]) -> list[bytes]:
    """WebP files of pixel arrays (height, WIDTH, 4), each way of writing chosen by estimated size."""
    k = len(images)
    size = np.array([i.shape[0] * WIDTH for i in images], np.int64)
    height = size // WIDTH
    pixels = np.concatenate([i.reshape(-1, 4) for i in images])
    start, image = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(k), size)
    cost, ways = _modelled(pixels, start, image, k)
    argb = lambda r, g, b, a: (a.astype(np.uint32) << 24 | r.astype(np.uint32) << 16 | g.astype(np.uint32) << 8 | b)
    # Palettes: distinct pixels of each image, and every pixel's number among them.
    whole = argb(*ways[0])
    ranked = np.sort((image.astype(np.uint64) << np.uint64(32) | whole) << np.uint64(PLACE) | np.arange(len(whole), dtype=np.uint64))
    order = (ranked & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    new = np.ones(len(order), bool)
    new[1:] = (ranked[1:] ^ ranked[:-1]) >= 1 << PLACE
    kinds = np.bincount(image[order], new, k).astype(np.int64)
    number = np.zeros(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    base = np.concatenate([[0], np.cumsum(kinds)])
    number -= base[image]
    colours = whole[order[new]]
    fits = (kinds <= 256)[image]
    index_bits = _bits(_count(image[fits], number[fits], k, 256))
    palette = np.where(kinds <= 256, index_bits + kinds * 30 + 40, np.inf)
    way = np.argmin(np.column_stack([cost, palette]), axis=1)
    written = np.split(whole, start[1:-1])
    for i in np.nonzero((way > 0) & (way < 5))[0].tolist():
        written[i] = argb(*(v[start[i] : start[i + 1]] for v in ways[way[i]]))
    out, own = Tokens(), np.arange(k)
    out.add(own, 0x2F | (WIDTH - 1) << 8 | (height - 1) << 22, 36)
    out.add(own, 1, 4)  # alpha is used, version 0
    one = lambda w: own[way == w]
    for w, kind, pixel in ((1, 0, 1 << 8), (2, 0, 2 << 8), (4, 1, 32 << 16)):
        # Present, kind, blocks of 512 pixels: an image of one pixel.
        out.add(one(w), 1 | kind << 1 | 7 << 3, 6)
        put_images(out, one(w), [np.array([pixel], np.uint32)] * len(one(w)), False)
    out.add(one(3), 1 | 2 << 1, 3)
    some = one(5)
    out.add(some, 1 | 3 << 1 | (kinds[some] - 1) << 3, 11)
    tables_ = []
    for i in some.tolist():
        c = _channels(colours[base[i] : base[i + 1]])
        tables_.append(argb(*(np.diff(c, axis=0, prepend=0) & 255).T).astype(np.uint32))
        pack = 3 if kinds[i] <= 2 else 2 if kinds[i] <= 4 else 1 if kinds[i] <= 16 else 0
        n = number[start[i] : start[i + 1]].reshape(-1, 1 << pack)
        written[i] = ((n << np.arange(1 << pack) * (8 >> pack)).sum(axis=1) << 8 | 0xFF000000).astype(np.uint32)
    put_images(out, some, tables_, False)
    out.add(own, 0, 1)
    put_images(out, own, written, True)
    files_ = []
    for stream in out.streams(k):
        pad = b"\0" * (len(stream) & 1)
        files_.append(b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad)
    return files_


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


def store_all(payloads: list[bytes]) -> Iterator[bytes]:
    """WebP files of each of these byte strings, a multiple of 64 bytes each; GROUP images are written at once."""
    parts: list[np.ndarray] = []
    owner: list[int] = []
    files_: dict[int, list[bytes]] = {}
    done = 0
    for i, data in enumerate(payloads):
        rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH, 4)
        for a in range(0, len(rows), HEIGHT):
            parts.append(rows[a : a + HEIGHT])
            owner.append(i)
            if len(parts) >= GROUP:
                for j, f in zip(owner, encode_images(parts)):
                    files_.setdefault(j, []).append(f)
                parts, owner = [], []
                while done < i:
                    yield b"".join(files_.pop(done))
                    done += 1
    if parts:
        for j, f in zip(owner, encode_images(parts)):
            files_.setdefault(j, []).append(f)
    while done < len(payloads):
        yield b"".join(files_.pop(done))
        done += 1


def store(data: bytes) -> bytes:
    """WebP files of bytes, a multiple of 64 of them."""
    return next(store_all([data]))


def features(images: list[np.ndarray]) -> str:
    """Rows, mean and deviation of each channel (thousandths), and a 64-bit sketch of 8 x 8 brightness, above its mean or not."""
    image = np.concatenate(images).astype(np.int64) if len(images) > 1 else images[0].astype(np.int64)
    flat = image.reshape(-1, 4)
    n = len(flat)
    total, square = flat.sum(axis=0), (flat * flat).sum(axis=0)
    mean = total * 1000 // n
    spread = [int(v) for v in np.sqrt(np.maximum(square * n - total * total, 0).astype(float)) * 1000 // n]
    light = image.sum(axis=(1, 2))
    grid = image.sum(axis=2).reshape(len(image), 8, 2).sum(axis=2)
    at = np.arange(8) * len(image) // 8
    cells = np.add.reduceat(grid, at, axis=0) * len(image) // np.maximum(np.diff(np.append(at, len(image))), 1)[:, None]
    bits = np.packbits((cells * 64 > cells.sum()).reshape(-1)).tobytes().hex()
    return f"{len(image)}x{WIDTH};{','.join(map(str, mean.tolist()))};{','.join(map(str, spread))};{int(light.max())};{bits}"


def column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every row's text, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, done, total, part = b.column(0), 0, 0, []
            for i, t in enumerate(texts(b)):
                part.append(t)
                total += len(t)
                if total > HELD or i + 1 == b.num_rows:
                    stored = list(store_all([payload(t) for t in part]))
                    yield pa.RecordBatch.from_arrays([ids.slice(done, i + 1 - done), pa.array([len(t) for t in part], pa.int64()), pa.array(stored, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    done, total, part = i + 1, 0, []

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measured(media: DataFrame) -> DataFrame:
    """Digests and features of a table (doc_id, n_bytes, media), from the decoded pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            media_ = [m.as_py() for m in b.column(2)]
            for doc, n, stored, images in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), media_, decode_all(media_)):
                data = b"".join(x.tobytes() for x in images)
                rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(images)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    return media.mapInArrow(run, _SCHEMA)


def media(docs: DataFrame) -> DataFrame:
    """Every text stored as lossless WebP, read back and measured."""
    return measured(column(docs))
