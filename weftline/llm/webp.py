"""Lossless WebP (VP8L): a reader of whole streams, and a writer for payload bytes.

The reader knows prefix codes (simple and coded lengths), several groups of them chosen by
an entropy image, back-references with the two-dimensional distance codes, the colour
cache, and the predictor, cross-colour, subtract-green and palette transforms.  Images
with one group are read in step with each other: each step writes one pixel of every
image.  Others, and the small images inside a stream, are read one symbol at a time.

The writer cuts a payload into tiles of at most TILE bytes, each an image of its own with
four samples to a pixel.  Tiles of few colours get a palette; the rest is written with
runs as back-references, a colour cache and prefix codes made from fixed weights, all
tiles at once.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

WIDTH = 48
UNIT = 576
TILE = UNIT * 14
CACHE_BITS = 10
_HASH = 0x1E35A7BD
_TABLE = 15

# Fixed values of the format: the order in which code length code lengths stand.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The places of the near distance codes: by distance, then by |x|, positive x first.
NEAR = sorted(
    [(x, y) for y in range(8) for x in range(-7, 9) if (y or x > 0) and not (x == 8 and y > 7)],
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)


class Corrupt(ValueError):
    pass


# -- bits


class Bits:
    def __init__(self, data: bytes) -> None:
        self.value, self.size, self.at = int.from_bytes(data, "little"), 8 * len(data), 0

    def read(self, n: int) -> int:
        out = (self.value >> self.at) & ((1 << n) - 1)
        self.at += n
        return out


class Sink:
    def __init__(self) -> None:
        self.value = self.at = 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.at + 7) // 8, "little")


def reverse(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code as it stands in the stream, length); a lone symbol takes no bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0]: (0, 0)}
    out, code = {}, 0
    for n in range(1, 16):
        code <<= 1
        for s in used:
            if lengths[s] == n:
                out[s] = (reverse(code, n), n)
                code += 1
    if code != 1 << 15:
        raise Corrupt("a prefix code is not complete")
    return out


def table(lengths: list[int]) -> np.ndarray:
    """For each 15 bits ahead: symbol << 4 | length."""
    out = np.zeros(1 << _TABLE, np.int32)
    for s, (code, n) in canonical(lengths).items():
        out[code :: 1 << n] = s << 4 | n
    return out


# -- prefix codes of a stream


def read_lengths(bits: Bits, alphabet: int) -> list[int]:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        names = [bits.read(8 if wide else 1)]
        if two:
            names.append(bits.read(8))
        for s in names:
            lengths[s] = 1
        return lengths
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    codes = {(c, n): s for s, (c, n) in canonical(own).items()}
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = read_symbol(bits, codes)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        value, n = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + n > alphabet:
            raise Corrupt("code lengths run over")
        lengths[at : at + n] = [value] * n
        at += n
    return lengths


def read_symbol(bits: Bits, codes: dict[tuple[int, int], int]) -> int:
    code = 0
    for n in range(16):
        if (code, n) in codes:
            return codes[code, n]
        code |= bits.read(1) << n
    raise Corrupt("no such code")


def write_lengths(sink: Sink, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        sink.write(1, 1)
        sink.write(len(used) - 1, 1)
        sink.write(1, 1)
        for s in used:
            sink.write(s, 8)
        return
    runs: list[tuple[int, int, int]] = []  # (symbol, extra, extra bits)
    at = 0
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at]:
            n += 1
        left, value = n, lengths[at]
        if value:
            runs.append((value, 0, 0))
            left -= 1
        while left:
            if value and left >= 3:
                k = min(left, 6)
                runs.append((16, k - 3, 2))
            elif not value and left >= 11:
                k = min(left, 138)
                runs.append((18, k - 11, 7))
            elif not value and left >= 3:
                k = min(left, 10)
                runs.append((17, k - 3, 3))
            else:
                k = 1
                runs.append((value, 0, 0))
            left -= k
        at += n
    counts = [0.0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    own = huffman(counts, 7)
    sink.write(0, 1)
    sink.write(15, 4)
    for k in LENGTH_ORDER:
        sink.write(own[k], 3)
    sink.write(0, 1)
    codes = canonical(own)
    for s, extra, n in runs:
        sink.write(*codes[s])
        sink.write(extra, n)


def huffman(weights: list[float], limit: int = 15) -> list[int]:
    """Code lengths of a complete code; small weights are raised until none is longer than limit."""
    used = [s for s, w in enumerate(weights) if w > 0]
    lengths = [0] * len(weights)
    if len(used) <= 1:
        for s in used:
            lengths[s] = 1
        return lengths
    floor = 0.0
    while True:
        heap = [(max(weights[s], floor), i, (s,)) for i, s in enumerate(used)]
        heapq.heapify(heap)
        depth, n = dict.fromkeys(used, 0), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
            n += 1
        if max(depth.values()) <= limit:
            for s, d in depth.items():
                lengths[s] = d
            return lengths
        floor = max(2 * floor, sum(weights) / (1 << limit))


# -- reading one image, symbol by symbol


def prefixed(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_groups(bits: Bits, n: int, cache: int) -> list[list[list[int]]]:
    return [[read_lengths(bits, a) for a in (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)] for _ in range(n)]


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    cache = bits.read(4) if bits.read(1) else 0
    meta = None
    groups = 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        meta = (read_image(bits, across, -(-height >> shift)) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    lengths = read_groups(bits, groups, cache)
    tables = [[table(x) for x in g] for g in lengths]
    n = width * height
    out = [0] * n
    colours = [0] * (1 << cache)

    def symbol(t: np.ndarray) -> int:
        e = int(t[(bits.value >> bits.at) & 0x7FFF])
        bits.at += e & 15
        return e >> 4

    i = 0
    while i < n:
        t = tables[int(meta[(i // width >> shift) * across + (i % width >> shift)]) if meta is not None else 0]
        s = symbol(t[0])
        if s < 256:
            red, blue, alpha = symbol(t[1]), symbol(t[2]), symbol(t[3])
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            end = i + 1
        elif s < 280:
            size = prefixed(bits, s - 256)
            back = distance(prefixed(bits, symbol(t[4])), width)
            end = i + size
            if back > i or end > n:
                raise Corrupt("a back-reference leaves the image")
            for k in range(i, end):
                out[k] = out[k - back]
        else:
            out[i] = colours[s - 280]
            end = i + 1
        if cache:
            for k in range(i, end):
                colours[(_HASH * out[k] & 0xFFFFFFFF) >> (32 - cache)] = out[k]
        i = end
    if bits.at > bits.size:
        raise Corrupt("the stream ends too soon")
    return np.array(out, np.uint32)


# -- transforms


def channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) of alpha, red, green, blue as signed integers."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: int, left: list[int], top: list[int], right: list[int], corner: list[int]) -> list[int]:
    """The prediction from the left, top, top-right and top-left pixels."""

    def mean(a: list[int], b: list[int]) -> list[int]:
        return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    def clamp(v: int) -> int:
        return 0 if v < 0 else min(v, 255)

    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, right)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    return [255, 0, 0, 0]


def predict(argb: np.ndarray, width: int, modes: np.ndarray, shift: int, undo: bool) -> np.ndarray:
    """Adds (undo) or takes away the prediction of each pixel."""
    n = len(argb)
    given = channels(argb).tolist()
    out = [None] * n
    known = out if undo else given
    across = -(-width >> shift)
    kinds = ((modes >> 8) & 15).tolist()
    for i in range(n):
        x, y = i % width, i // width
        if not i:
            p = [255, 0, 0, 0]
        elif not y:
            p = known[i - 1]
        elif not x:
            p = known[i - width]
        else:
            p = predicted(kinds[(y >> shift) * across + (x >> shift)], known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        out[i] = [(a + b if undo else a - b) & 255 for a, b in zip(given[i], p, strict=True)]
    return joined(np.array(out))


def cross(argb: np.ndarray, width: int, parts: np.ndarray, shift: int, undo: bool) -> np.ndarray:
    c = channels(argb)
    i = np.arange(len(argb))
    own = channels(parts[(i // width >> shift) * -(-width >> shift) + (i % width >> shift)])

    def delta(t: np.ndarray, colour: np.ndarray) -> np.ndarray:
        return (t.astype(np.int8).astype(np.int32) * (colour & 255).astype(np.int8).astype(np.int32)) >> 5

    sign = 1 if undo else -1
    red = c[:, 1] + sign * delta(own[:, 3], c[:, 2])
    blue = c[:, 3] + sign * (delta(own[:, 2], c[:, 2]) + delta(own[:, 1], red if undo else c[:, 1]))
    return joined(np.stack([c[:, 0], red, c[:, 2], blue], axis=-1))


def subtract_green(argb: np.ndarray, undo: bool) -> np.ndarray:
    c = channels(argb)
    sign = 1 if undo else -1
    return joined(np.stack([c[:, 0], c[:, 1] + sign * c[:, 2], c[:, 2], c[:, 3] + sign * c[:, 2]], axis=-1))


def bundle(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def unpalette(argb: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    k = bundle(len(colours))
    green = ((argb >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
    x = np.arange(width)
    index = (green[:, x >> k] >> ((x & ((1 << k) - 1)) * (8 >> k)).astype(np.uint32)) & np.uint32((1 << (8 >> k)) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[index].ravel()


# -- reading a file


def head(data: bytes) -> tuple[Bits, int, int, list[tuple]]:
    """The stream after its transforms, the image's size, and the transforms."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise Corrupt("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Corrupt("unknown version")
    transforms: list[tuple] = []
    now = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            shift = bits.read(3) + 2
            transforms.append((kind, now, shift, read_image(bits, -(-now >> shift), -(-height >> shift))))
        elif kind == 2:
            transforms.append((2, now))
        else:
            n = bits.read(8) + 1
            deltas = channels(read_image(bits, n, 1))
            transforms.append((3, now, joined(np.cumsum(deltas, axis=0))))
            now = -(-now >> bundle(n))
    return bits, now, height, transforms


def undo(argb: np.ndarray, height: int, transforms: list[tuple]) -> np.ndarray:
    for t in reversed(transforms):
        if t[0] == 0:
            argb = predict(argb, t[1], t[3], t[2], True)
        elif t[0] == 1:
            argb = cross(argb, t[1], t[3], t[2], True)
        elif t[0] == 2:
            argb = subtract_green(argb, True)
        else:
            argb = unpalette(argb, t[1], height, t[2])
    return argb


def decode(data: bytes) -> np.ndarray:
    """The pixels of one file, symbol by symbol."""
    bits, width, height, transforms = head(data)
    return undo(read_image(bits, width, height, True), height, transforms)


class Batch:
    """Reads many files in step; their tables are made once for each different set of codes."""

    def __init__(self) -> None:
        # What follows the size: (whole bytes, mask and bits of the next byte, bits to the pixels, number of the codes).
        self.plain: list[tuple[bytes, int, int, int, int]] = []
        self.sets: list[tuple[int, np.ndarray]] = []  # (cache bits, five tables)

    def _codes(self, data: bytes) -> tuple[int, int, int, int, list[tuple]] | None:
        """(bit where pixels begin, width, height, codes), if there is one group."""
        for known, mask, rest, end, number in self.plain:
            if data.startswith(known, 25) and data[25 + len(known)] & mask == rest:
                a = int.from_bytes(data[21:25], "little")
                return end, (a & 0x3FFF) + 1, (a >> 14 & 0x3FFF) + 1, number, []
        bits, width, height, transforms = head(data)
        begin = bits.at
        cache = bits.read(4) if bits.read(1) else 0
        if bits.read(1):
            return None
        lengths = read_groups(bits, 1, cache)[0]
        self.sets.append((cache, np.concatenate([table(x) for x in lengths])))
        number = len(self.sets) - 1
        if not transforms and begin == 33:
            whole, over = 21 + bits.at // 8, (1 << bits.at % 8) - 1
            if whole < len(data):
                self.plain.append((data[25:whole], over, data[whole] & over, bits.at, number))
        return bits.at, width, height, number, transforms

    def decode(self, files: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(files)  # type: ignore[list-item]
        if len(self.sets) > 64:
            self.__init__()
        lanes = []
        for i, f in enumerate(files):
            got = self._codes(f)
            if got is None:
                out[i] = decode(f)
            else:
                lanes.append((i, *got))
        if not lanes:
            return out
        lanes.sort(key=lambda x: -x[2] * x[3])
        pixels = self._run([files[x[0]] for x in lanes], np.array([x[1] for x in lanes]), np.array([x[2] for x in lanes]), np.array([x[2] * x[3] for x in lanes]), np.array([x[4] for x in lanes]))
        for x, p in zip(lanes, pixels, strict=True):
            out[x[0]] = undo(p, x[3], x[5]) if x[5] else p
        return out

    def _run(self, files: list[bytes], begin: np.ndarray, width: np.ndarray, size: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        n = len(files)
        pads = [f[21:] + b"\0" * (12 - (len(f) - 21) % 4) for f in files]
        words = np.frombuffer(b"".join(pads), "<u4").astype(np.uint64)
        word_at = np.cumsum([0, *(len(p) // 4 for p in pads)])[:-1]
        limit = (word_at + np.array([len(p) // 4 for p in pads])) * 32
        pos = word_at * 32 + begin
        tables = np.concatenate([t for _, t in self.sets])
        base = codes * (5 << _TABLE)
        cache = np.array([c for c, _ in self.sets])[codes]
        cache_at = np.cumsum(np.concatenate([[0], 1 << cache]))
        colours = np.zeros(cache_at[-1], np.uint32)
        cache_at, shift = cache_at[:-1], (32 - cache).astype(np.uint64)
        out_at = np.cumsum(np.concatenate([[0], size]))
        out = np.zeros(out_at[-1], np.uint32)
        ends, out_at = out_at[1:], out_at[:-1]
        copy, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
        mask, low = np.uint64((1 << _TABLE) - 1), np.uint64(31)
        near = np.array(NEAR)

        def ahead(p: np.ndarray) -> np.ndarray:
            k = p >> 5
            return (words[k] | words[k + 1] << np.uint64(32)) >> (p.astype(np.uint64) & low)

        def value(prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Value of prefix codes; moves the bit place of lanes ``at``."""
            extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
            got = ahead(pos[at]) & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))
            pos[at] += extra
            return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + got.astype(np.int64) + 1)

        any_cache = bool(cache.any())
        live = n
        step = 0
        while live:
            while live and size[live - 1] <= step:
                live -= 1
            if not live:
                break
            p = pos[:live]
            to = out_at[:live] + step
            v = ahead(p)
            b = base[:live]
            e = tables[b + (v & mask).astype(np.int64)]
            busy = copy[:live] > 0
            s = e >> 4
            literal = (s < 256) & ~busy
            n1 = e & 15
            v2 = v >> n1.astype(np.uint64)
            r = tables[b + (1 << _TABLE) + (v2 & mask).astype(np.int64)]
            p3 = p + n1 + (r & 15)
            v3 = ahead(p3)
            bl = tables[b + (2 << _TABLE) + (v3 & mask).astype(np.int64)]
            n3 = bl & 15
            al = tables[b + (3 << _TABLE) + (v3 >> n3.astype(np.uint64) & mask).astype(np.int64)]
            colour = ((al >> 4).astype(np.uint32) << np.uint32(24)) | ((r >> 4) << 16 | s << 8 | bl >> 4).astype(np.uint32)
            moved = np.where(literal, p3 + n3 + (al & 15), np.where(busy, p, p + n1))
            other = np.flatnonzero(~literal)
            pos[:live] = moved
            if len(other):
                fresh = ~busy[other]
                hit = other[fresh & (s[other] >= 280)]
                colour[hit] = colours[cache_at[hit] + s[hit] - 280]
                ref = other[fresh & (s[other] < 280)]
                if len(ref):
                    copy[ref] = value(s[ref].astype(np.int64) - 256, ref)
                    d = tables[base[ref] + (4 << _TABLE) + (ahead(pos[ref]) & mask).astype(np.int64)]
                    pos[ref] += d & 15
                    code = value((d >> 4).astype(np.int64), ref)
                    xy = near[np.minimum(code, 120) - 1]
                    back[ref] = np.where(code > 120, code - 120, np.maximum(1, xy[:, 0] + xy[:, 1] * width[ref]))
                    if (back[ref] > step).any() or (copy[ref] > size[ref] - step).any():
                        raise Corrupt("a back-reference leaves the image")
                going = other[copy[other] > 0]
                colour[going] = out[to[going] - back[going]]
                copy[going] -= 1
            out[to] = colour
            if any_cache:
                slot = ((colour.astype(np.uint64) * np.uint64(_HASH)) & np.uint64(0xFFFFFFFF)) >> shift[:live]
                colours[cache_at[:live] + slot.astype(np.int64)] = colour
            step += 1
        if (pos > limit).any():
            raise Corrupt("a stream ends too soon")
        return [out[a:b] for a, b in zip(out_at, ends, strict=True)]


# -- writing


def riff(stream: bytes) -> bytes:
    body = b"\x2f" + stream
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(body) % 2) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix code, extra value, extra bits) of a length or distance code of 1 or more."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 1
    half = v >> (n - 1) & 1
    return 2 * n + half, v & ((1 << (n - 1)) - 1), n - 1


def write_image(sink: Sink, argb: np.ndarray, main: bool = False, cache: int = 0, runs: bool = True, meta: tuple[int, int, np.ndarray] | None = None) -> None:
    """One image, symbol by symbol.  meta: (width, shift, groups of blocks) writes several groups of codes."""
    pixels = argb.tolist()
    events: list[tuple[int, int, int, int]] = []  # (place, kind, value, length)
    colours = [None] * (1 << cache)
    i = 0
    while i < len(pixels):
        n = 0
        if runs and i and pixels[i] == pixels[i - 1]:
            while i + n < len(pixels) and n < 4096 and pixels[i + n] == pixels[i]:
                n += 1
        c = pixels[i]
        slot = (_HASH * c & 0xFFFFFFFF) >> (32 - cache) if cache else 0
        if n >= 3:
            events.append((i, 1, n, 0))
        elif cache and colours[slot] == c:
            events.append((i, 2, slot, 0))
            n = 1
        else:
            events.append((i, 0, c, 0))
            n = 1
        if cache:
            colours[slot] = c
        i += n
    sink.write(1 if cache else 0, 1)
    if cache:
        sink.write(cache, 4)

    def group(i: int) -> int:
        if meta is None:
            return 0
        width, shift, blocks = meta
        return int(blocks[(i // width >> shift) * -(-width >> shift) + (i % width >> shift)])

    groups = 1
    if main:
        sink.write(meta is not None, 1)
        if meta is not None:
            sink.write(meta[1] - 2, 3)
            write_image(sink, meta[2].astype(np.uint32) << np.uint32(8))
            groups = int(meta[2].max()) + 1
    counts = [[[0.0] * a for a in (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)] for _ in range(groups)]
    for at, kind, v, _ in events:
        g = counts[group(at)]
        if kind == 0:
            for k, s in enumerate((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24)):
                g[k][s] += 1
        elif kind == 1:
            g[0][256 + prefix_of(v)[0]] += 1
            g[4][1] += 1
        else:
            g[0][280 + v] += 1
    codes = []
    for g in counts:
        own = [huffman(c) for c in g]
        for x in own:
            write_lengths(sink, x)
        codes.append([canonical(x) if any(x) else {} for x in own])
    for at, kind, v, _ in events:
        g = codes[group(at)]
        if kind == 0:
            for k, s in enumerate((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24)):
                sink.write(*g[k][s])
        elif kind == 1:
            p, extra, n = prefix_of(v)
            sink.write(*g[0][256 + p])
            sink.write(extra, n)
            sink.write(*g[4][1])
        else:
            sink.write(*g[0][280 + v])


def start(sink: Sink, width: int, height: int) -> None:
    sink.write(width - 1, 14)
    sink.write(height - 1, 14)
    sink.write(1, 1)
    sink.write(0, 3)


def write_palette(argb: np.ndarray, width: int) -> bytes:
    """A file of at most 256 colours."""
    colours, index = np.unique(argb, return_inverse=True)
    height = len(argb) // width
    sink = Sink()
    start(sink, width, height)
    sink.write(1, 1)
    sink.write(3, 2)
    sink.write(len(colours) - 1, 8)
    c = channels(colours)
    write_image(sink, joined(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int32))))
    sink.write(0, 1)
    k = bundle(len(colours))
    grid = index.reshape(height, width)
    pad = -width % (1 << k)
    grid = np.pad(grid, ((0, 0), (0, pad))).reshape(height, -1, 1 << k)
    packed = (grid << (np.arange(1 << k) * (8 >> k))).sum(axis=2)
    write_image(sink, (packed.ravel() << 8).astype(np.uint32) | np.uint32(0xFF000000), True)
    return riff(sink.bytes())


def _weights() -> tuple[list[float], list[float]]:
    """Weights of samples, and of the symbols of the first code, for prose in Latin letters."""
    w = [0.15] * 256
    for k, c in enumerate("etaoinshrdlucmfwypvbgkqjxz"):
        w[ord(c)] = 100 * 0.86**k + 1
        w[ord(c.upper())] = 2
    for c, v in ((" ", 150), (".", 10), (",", 10), ("\n", 4), ("\xc3", 25)):
        w[ord(c)] = v
    for b in range(0xA0, 0xC0):
        w[b] = 2
    for b in b"0123456789-'\"!?|:;()#$%&*":
        w[b] = max(w[b], 1.5)
    w[255] = 4
    total = sum(w)
    return w, [0.6 * x for x in w] + [1.0 if k < 12 else 0.2 for k in range(24)] + [0.4 * total / (1 << CACHE_BITS)] * (1 << CACHE_BITS)


class Writer:
    """Tiles of bytes as files, all at once, with codes that are the same for every tile."""

    def __init__(self) -> None:
        samples, first = _weights()
        own, green = huffman(samples), huffman(first)
        sink = Sink()
        sink.write(0, 1)  # no transform
        sink.write(1, 1)
        sink.write(CACHE_BITS, 4)
        sink.write(0, 1)
        for lengths in (green, own, own, own, [0, 1] + [0] * 38):
            write_lengths(sink, lengths)
        self.fixed, self.fixed_bits = sink.value, sink.at

        def arrays(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
            codes = canonical(lengths)
            return np.array([codes[s][0] for s in range(len(lengths))], np.uint64), np.array([codes[s][1] for s in range(len(lengths))], np.int64)

        self.green, self.green_n = arrays(green)
        self.own, self.own_n = arrays(own)
        prefixes = [prefix_of(v) for v in range(1, 4097)]
        self.run = np.array([(int(self.green[256 + p]) | e << int(self.green_n[256 + p])) for p, e, n in prefixes], np.uint64)
        self.run_n = np.array([int(self.green_n[256 + p]) + n for p, e, n in prefixes], np.int64)

    def write(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """A file for each tile data[bounds[t] : bounds[t + 1]], whole UNITs of bytes."""
        pixel = np.ascontiguousarray(data).view("<u4").astype(np.uint32)  # red, green, blue, alpha from low to high
        at = bounds // 4
        tiles = len(bounds) - 1
        tile = np.repeat(np.arange(tiles), np.diff(at))
        place = np.arange(len(pixel)) - at[tile]
        red, green, blue, alpha = (((pixel >> np.uint32(s)) & np.uint32(255)).astype(np.uint32) for s in (0, 8, 16, 24))
        argb = alpha << np.uint32(24) | red << np.uint32(16) | green << np.uint32(8) | blue
        same = np.zeros(len(pixel), bool)
        same[1:] = (argb[1:] == argb[:-1]) & (place[1:] > 0)
        # Runs of at least three pixels like the one before.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        first, n = edge[0::2], edge[1::2] - edge[0::2]
        first, n = first[n >= 3], n[n >= 3]
        skip = np.zeros(len(pixel) + 1, np.int64)
        np.add.at(skip, first, 1)
        np.add.at(skip, first + n, -1)
        covered = np.cumsum(skip[:-1]) > 0
        # The cache holds a colour if the last pixel of its slot had it.
        slot = (((argb.astype(np.uint64) * np.uint64(_HASH)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.int64)
        key = np.sort(((tile.astype(np.int64) << CACHE_BITS | slot) << 13) | place)
        order = at[key >> (13 + CACHE_BITS)] + (key & 8191)
        hit = np.zeros(len(pixel), bool)
        hit[order[1:]] = (key[1:] >> 13 == key[:-1] >> 13) & (argb[order[1:]] == argb[order[:-1]])
        # Few colours: every slot's changes are few; the exact number is counted for those alone.
        changes = np.bincount(tile[~hit], minlength=tiles)
        few = np.flatnonzero(changes <= 16)
        few = few[[len(np.unique(argb[at[t] : at[t + 1]])) <= 16 for t in few]] if len(few) else few
        starts = np.zeros(len(pixel), np.int64)
        starts[first] = n
        event = np.flatnonzero(~covered | (starts > 0))
        run, cached = starts[event], hit[event]
        a, b = self.green[green[event]], self.own[red[event]]
        an, bn = self.green_n[green[event]], self.own_n[red[event]]
        low, low_n = a | b << an.astype(np.uint64), an + bn
        c, d = self.own[blue[event]], self.own[alpha[event]]
        cn, dn = self.own_n[blue[event]], self.own_n[alpha[event]]
        high, high_n = c | d << cn.astype(np.uint64), cn + dn
        k = 280 + slot[event]
        low, low_n = np.where(cached, self.green[k], low), np.where(cached, self.green_n[k], low_n)
        is_run = run > 0
        low[is_run], low_n[is_run] = self.run[run[is_run] - 1], self.run_n[run[is_run] - 1]
        short = cached | is_run
        high, high_n = np.where(short, np.uint64(0), high), np.where(short, 0, high_n)
        total = low_n + high_n
        of = tile[event]
        first_event = np.searchsorted(of, np.arange(tiles))
        begin = np.cumsum(total) - total
        head_bits = 32 + self.fixed_bits
        size = np.diff(np.append(begin[first_event], total.sum())) + head_bits
        words = -(-size // 32) + 1
        word_at = np.cumsum(words) - words
        pos = begin - begin[first_event][of] + (word_at * 32 + head_bits)[of]
        buffer = np.zeros(int(words.sum()) + 2, np.uint32)
        for v, p in ((low, pos), (high, pos + low_n)):
            v = v << (p & 31).astype(np.uint64)
            w = p >> 5
            buffer += np.bincount(w, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), len(buffer)).astype(np.uint32)
            buffer += np.bincount(w + 1, (v >> np.uint64(32)).astype(np.float64), len(buffer)).astype(np.uint32)
        raw = buffer.view(np.uint8)
        special = set(few.tolist())
        out = []
        for t in range(tiles):
            if t in special:
                out.append(write_palette(argb[at[t] : at[t + 1]], WIDTH))
                continue
            height = int(at[t + 1] - at[t]) // WIDTH
            front = (WIDTH - 1) | (height - 1) << 14 | 1 << 28 | self.fixed << 32
            n = (int(size[t]) + 7) // 8
            body = bytearray(raw[4 * word_at[t] : 4 * word_at[t] + n].tobytes())
            lead = front.to_bytes((head_bits + 7) // 8, "little")
            last = body[len(lead) - 1] | lead[-1] if head_bits % 8 else lead[-1]
            body[: len(lead)] = lead
            body[len(lead) - 1] = last
            out.append(riff(bytes(body)))
        return out


def samples(argb: np.ndarray) -> np.ndarray:
    """The bytes of pixels: red, green, blue, alpha."""
    u = np.uint32
    return (argb >> u(16) & u(255) | argb & u(0xFF00) | (argb & u(255)) << u(16) | argb & u(0xFF000000)).astype("<u4").view(np.uint8)
