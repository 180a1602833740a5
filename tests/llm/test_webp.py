"""The lossless WebP decoder against streams from a writer of its own: every transform, code form and token."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quantloom.llm import webp


class Out:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> i & 1 for i in range(n)]

    def code(self, c):
        v, n = c
        self.bits += [v >> (n - 1 - i) & 1 for i in range(n)]

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def tree_lengths(rng, symbols, most):
    """Lengths of a complete code over the symbols, from a random binary tree no deeper than most."""
    out = {}

    def split(part, depth):
        if len(part) == 1:
            out[part[0]] = depth
            return
        room = 1 << (most - depth - 1)
        low, high = max(1, len(part) - room), min(len(part) - 1, room)
        k = rng.randint(low, high)
        split(part[:k], depth + 1)
        split(part[k:], depth + 1)

    part = list(symbols)
    rng.shuffle(part)
    split(part, 0)
    return out


def canonical(lengths):
    code, before, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        out[s] = (code, n)
        code, before = code + 1, n
    return out


def put_code(o, rng, used, size):
    """Writes a prefix code for the used symbols; returns symbol -> (code, bits)."""
    used = sorted(used) or [0]
    if len(used) <= 2 and max(used) < 256 and rng.random() < 0.8:
        o.put(1, 1)
        o.put(len(used) - 1, 1)
        wide = used[0] > 1 or rng.random() < 0.5
        o.put(int(wide), 1)
        o.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            o.put(used[1], 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    if len(used) == 1:
        used = sorted({used[0], (used[0] + 1) % size})
    lengths = tree_lengths(rng, used, 15)
    line = [lengths.get(s, 0) for s in range(size)]
    items, i, last = [], 0, 8
    while i < size:
        j = i
        while j < size and line[j] == line[i]:
            j += 1
        run = j - i
        if line[i] == 0 and run >= 11 and rng.random() < 0.9:
            run = min(run, 138)
            items.append((18, run - 11, 7))
        elif line[i] == 0 and run >= 3:
            run = min(run, 10)
            items.append((17, run - 3, 3))
        elif line[i] and line[i] == last and run >= 3:
            run = min(run, 6)
            items.append((16, run - 3, 2))
        else:
            run = 1
            items.append((line[i], 0, 0))
            last = line[i] or last
        i += run
    limited = rng.random() < 0.5
    if limited:
        while items and items[-1][0] in (0, 17, 18):
            items.pop()
        limited = len(items) >= 2
    if not limited:
        total = sum({16: 3, 17: 3, 18: 11}.get(s, 1) + e for s, e, _ in items)
        while total < size:
            items.append((0, 0, 0))
            total += 1
    kinds = {s for s, _, _ in items}
    if len(kinds) == 1:
        kinds.add(0 if 0 not in kinds else 1)
    outer = canonical(tree_lengths(rng, sorted(kinds), 7))
    o.put(0, 1)
    o.put(15, 4)
    for s in webp.LENGTH_ORDER:
        o.put(outer.get(s, (0, 0))[1], 3)
    o.put(int(limited), 1)
    if limited:
        o.put(4, 3)
        o.put(len(items) - 2, 10)
    for s, extra, n in items:
        o.code(outer[s])
        o.put(extra, n)
    return canonical(lengths)


def prefix(v):
    """Prefix code and extra bits of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    n = v.bit_length() - 1
    half = v >> (n - 1) & 1
    return 2 * n + half, v - ((2 + half) << (n - 1)), n - 1


def put_pixels(o, rng, px, width, main, cache_bits=0, groups=1):
    n = len(px)
    o.put(int(cache_bits > 0), 1)
    if cache_bits:
        o.put(cache_bits, 4)
    meta = None
    if main:
        o.put(int(groups > 1), 1)
        if groups > 1:
            o.put(0, 3)
            w, h = -(-width // 4), -(-(n // width) // 4)
            cells = [rng.randrange(groups) for _ in range(w * h)]
            cells[0] = groups - 1
            put_pixels(o, rng, [0xFF000000 | c << 8 for c in cells], w, False)
            meta = lambda i: cells[i // width // 4 * w + i % width // 4]
    cache, tokens, i = [0] * (1 << cache_bits), [], 0
    slot = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < n:
        g = meta(i) if meta else 0
        best = None
        for d in [1, width, width + 1, 2, max(1, width - 1), rng.randrange(1, n + 1)]:
            if d <= i:
                m = 0
                while i + m < n and px[i + m] == px[i + m - d] and m < 300:
                    m += 1
                if m >= 2 and (best is None or m > best[0]):
                    best = (m, d)
        if best and rng.random() < 0.9:
            m, d = best
            short = [k + 1 for k, (x, y) in enumerate(webp.NEIGHBOURS) if max(1, x + y * width) == d]
            tokens.append((g, "copy", prefix(m), prefix(rng.choice(short) if short and rng.random() < 0.7 else d + 120)))
        elif cache_bits and cache[slot(px[i])] == px[i]:
            m = 1
            tokens.append((g, "cache", slot(px[i]), None))
        else:
            m = 1
            tokens.append((g, "lit", px[i], None))
        for k in range(m):
            if cache_bits:
                cache[slot(px[i + k])] = px[i + k]
        i += m
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    used = [[set() for _ in range(5)] for _ in range(groups)]
    for g, kind, a, b in tokens:
        if kind == "lit":
            for c, shift in enumerate((8, 16, 0, 24)):
                used[g][c].add(a >> shift & 255)
        elif kind == "cache":
            used[g][0].add(280 + a)
        else:
            used[g][0].add(256 + a[0])
            used[g][4].add(b[0])
    codes = [[put_code(o, rng, used[g][c], sizes[c]) for c in range(5)] for g in range(groups)]
    for g, kind, a, b in tokens:
        if kind == "lit":
            for c, shift in enumerate((8, 16, 0, 24)):
                o.code(codes[g][c][a >> shift & 255])
        elif kind == "cache":
            o.code(codes[g][0][280 + a])
        else:
            o.code(codes[g][0][256 + a[0]])
            o.put(a[1], a[2])
            o.code(codes[g][4][b[0]])
            o.put(b[1], b[2])


def guess(mode, L, T, TL, TR):
    """A pixel's prediction by the format's definitions, channel by channel."""
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [x + y - z for x, y, z in zip(L, T, TL)]
        return L if sum(abs(a - b) for a, b in zip(p, L)) < sum(abs(a - b) for a, b in zip(p, T)) else T
    if mode == 12:
        return [clamp(x + y - z) for x, y, z in zip(L, T, TL)]
    if mode == 13:
        return [clamp(a + int((a - z) / 2)) for a, z in zip(avg(L, T), TL)]
    return [[0, 0, 0, 255], L, T, TR, TL, avg(avg(L, TR), T), avg(L, TL), avg(L, T), avg(TL, T), avg(T, TR), avg(avg(L, TL), avg(T, TR))][mode]


def argb(p):
    return [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in p.reshape(-1, 4)]


def encode(rng, image, kinds, cache_bits=0, groups=1):
    """A VP8L stream of image (height, width, 4) with these transforms, in their order."""
    h, w, _ = image.shape
    o = Out()
    o.put(0x2F, 8)
    o.put(w - 1, 14)
    o.put(h - 1, 14)
    o.put(1, 1)
    o.put(0, 3)
    now = image.astype(int)
    for kind in kinds:
        o.put(1, 1)
        o.put(kind, 2)
        h, w, _ = now.shape
        if kind == 2:
            now = now.copy()
            now[..., [0, 2]] = (now[..., [0, 2]] - now[..., [1]]) % 256
        elif kind in (0, 1):
            o.put(0, 3)
            bw, bh = -(-w // 4), -(-h // 4)
            side = np.array([[[rng.randrange(256), rng.randrange(14) if kind == 0 else rng.randrange(256), rng.randrange(256), 255] for _ in range(bw)] for _ in range(bh)])
            put_pixels(o, rng, argb(side), bw, False)
            old = now
            now = now.copy()
            for y in range(h):
                for x in range(w):
                    s = side[y // 4, x // 4]
                    if kind == 0:
                        if x == y == 0:
                            p = [0, 0, 0, 255]
                        elif y == 0:
                            p = old[y, x - 1]
                        elif x == 0:
                            p = old[y - 1, x]
                        else:
                            tr = old[y - 1, x + 1] if x + 1 < w else old[y, 0]
                            p = guess(int(s[1]), *(list(map(int, v)) for v in (old[y, x - 1], old[y - 1, x], old[y - 1, x - 1], tr)))
                        now[y, x] = (old[y, x] - np.array(p)) % 256
                    else:
                        sg = lambda v: (int(v) ^ 128) - 128
                        d = lambda t, c: (sg(t) * sg(c)) >> 5
                        r, g, b, _ = old[y, x]
                        now[y, x, 0] = (r - d(s[2], g)) % 256
                        now[y, x, 2] = (b - d(s[1], g) - d(s[0], r)) % 256
        else:
            colours = sorted({tuple(map(int, p)) for p in now.reshape(-1, 4)})
            o.put(len(colours) - 1, 8)
            table = np.array(colours)
            delta = np.vstack([table[:1], (table[1:] - table[:-1]) % 256])
            put_pixels(o, rng, argb(delta), len(colours), False)
            index = np.array([colours.index(tuple(map(int, p))) for p in now.reshape(-1, 4)]).reshape(h, w)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            pw = -(-w >> pack)
            now = np.zeros((h, pw, 4), int)
            now[..., 3] = 255
            for x in range(w):
                now[:, x >> pack, 1] |= index[:, x] << ((x & ((1 << pack) - 1)) * (8 >> pack))
    o.put(0, 1)
    put_pixels(o, rng, argb(now), now.shape[1], True, cache_bits, groups)
    return o.bytes()


def picture(rng, h, w, colours):
    base = [[rng.randrange(256) for _ in range(4)] for _ in range(colours)]
    rows = []
    for y in range(h):
        rows.append(list(rows[-1]) if rows and rng.random() < 0.3 else [rng.choice(base) for _ in range(w)])
    return np.array(rows, np.uint8)


@pytest.mark.parametrize("seed", range(30))
def test_decoder_inverts_every_transform(seed):
    rng = random.Random(seed)
    few = seed % 3 == 0
    image = picture(rng, rng.randrange(1, 14), rng.randrange(1, 22), rng.choice([1, 2, 3, 9, 40]) if few else 400)
    kinds = [3] if few else []
    for k in rng.sample([0, 1, 2], rng.randrange(4)):
        kinds.append(k)
    data = encode(rng, image, kinds, rng.choice([0, 0, 3, 7]), rng.choice([1, 1, 3]))
    assert (webp.decode_image(data) == image).all()


def test_broken_streams_raise():
    image = picture(random.Random(1), 6, 6, 50)
    data = encode(random.Random(1), image, [2])
    for bad in (data[: len(data) // 2], b"\0" + data[1:], b""):
        with pytest.raises(ValueError):
            webp.decode_image(bad)
    with pytest.raises(ValueError):
        webp.decode(b"JUNKJUNKJUNKJUNK")


def test_stored_bytes_come_back():
    rng = np.random.default_rng(3)
    for data in (b"", b"a", b"a" * 64, bytes(range(256)) * 3, rng.integers(0, 256, 70_000, np.uint8).tobytes(), b"ab" * 600_000):
        full = webp.payload(data)
        assert len(full) % 64 == 0 and len(full) >= 64 and full.startswith(data) and not full[len(data) :].strip(b"\0")
        stored = webp.store(full)
        assert struct.unpack("<I", stored[4:8])[0] + 8 <= len(stored)
        images = webp.decode(stored)
        assert b"".join(i.tobytes() for i in images) == full
        assert all(i.shape[1:] == (webp.WIDTH, 4) and len(i) <= webp.HEIGHT for i in images)


def test_media_rows(spark):
    texts = [None, "", "x", "Ünï", "same", "same", "y" * 5000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "same", 6)], "doc_id long, text string, n_bytes int")
    got = {str(r["doc_id"]): r for r in webp.media(df).collect()}
    assert len(got) == 8
    for i, t in enumerate(texts):
        r, full = got[str(i)], webp.payload((t or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert tuple(got["4"])[1:] == tuple(got["5"])[1:] == tuple(got["None"])[1:] and got["0"][1:] == got["1"][1:]
    assert webp.media(df.limit(0)).count() == 0


def test_writer_uses_every_part_where_it_shrinks():
    rng = random.Random(1)
    grey = b"".join(bytes([v, v, v, 255]) for v in rng.choices(range(256), k=3000))
    green = b"".join(bytes([(v + 3) & 255, v, rng.randrange(256), 255]) for v in rng.choices(range(256), k=3000))
    blue = b"".join(bytes([v, rng.randrange(256), (v + 3) & 255, 255]) for v in rng.choices(range(256), k=3000))
    palette = b"".join(rng.choices([rng.randbytes(4) for _ in range(12)], k=4000))
    smooth = b"".join(bytes([(x * 5 + y * 3 + rng.randrange(3)) & 255, (x * 5 + rng.randrange(2)) & 255, y & 255, 255]) for y in range(128) for x in range(16))
    line = b"the same line stands here again and again\n" * 300
    prose = " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "consectetur"]) for _ in range(900)).encode()
    texts = [t.encode() for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:100] if t]
    cases = [webp.payload(c) for c in (grey, green, blue, palette, smooth, line, prose, b"a" * 5000, b"", *texts)]
    webp.USED.clear()
    stored = list(webp.store_all(cases))
    assert [b"".join(i.tobytes() for i in images) for images in webp.decode_all(stored)] == cases
    assert set(webp.USED) >= {"predictor", "cross-colour", "subtract-green", "palette", "cache", "references"}
    assert len(stored[5]) < len(cases[5]) // 20 and len(stored[6]) < len(cases[6]) * 0.6 and len(stored[3]) < len(cases[3]) // 5
    # What is stored doesn't depend on what stands beside it.
    assert stored == [webp.store(c) for c in cases]


def test_writer_round_trips_random_bytes():
    rng = random.Random(5)
    cases = []
    for _ in range(150):
        n, kinds = rng.choice([0, 1, 5, 63, 64, 65, 300, 2000, 8192, 8193, 17000]), rng.choice([1, 2, 3, 5, 17, 60, 256])
        b = bytes(rng.choices(range(kinds), k=n))
        if rng.random() < 0.4 and n:
            b = (b[: rng.randint(1, 80)] * n)[:n]
        cases.append(webp.payload(b))
    assert [b"".join(i.tobytes() for i in images) for images in webp.decode_all(list(webp.store_all(cases)))] == cases


def test_code_lengths_are_huffmans():
    import heapq

    rng = np.random.default_rng(2)
    count = rng.integers(0, 50, (40, 30)) ** 2 * (rng.random((40, 30)) < 0.6)
    lengths = webp.code_lengths(count, 15)
    for own, got in zip(count, lengths):
        heap = [int(c) for c in own if c]
        cost = 0
        heapq.heapify(heap)
        while len(heap) > 1:
            heapq.heappush(heap, merged := heapq.heappop(heap) + heapq.heappop(heap))
            cost += merged
        assert len([c for c in own if c]) < 2 or (own * got).sum() == cost
    assert (webp.code_lengths(2 ** np.arange(20)[None], 7) <= 7).all()
