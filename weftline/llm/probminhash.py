"""ProbMinHash signatures of weighted word shingles, as whole-array steps.

Each shingle of a text is a Poisson process whose rate is its weight.  Its arrivals,
drawn from hashes of the shingle, fall into registers at random; a register keeps the
shingle of its earliest arrival.  A shingle stops as soon as its next arrival is later
than every register of the text.  Two texts agree in a register with the probability
Jaccard similarity of their weighted shingles, which is the Jaccard similarity where
all weights are equal.
"""

from __future__ import annotations

import numpy as np

from weftline.llm.common import CHUNK_BYTES

WORDS = 5
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_POWER = 0xD6E8FEB86659FD93

#: Letters and digits in lower case (with the two-byte letters after C3); 0 between words.
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the words before each text."""
    out, begins = [], []
    a = 0
    while a < len(data):
        b = min(a + CHUNK_BYTES, len(data))
        fold = _FOLD[data[a:b]]
        if b < len(data):  # end between words, or at a text's end
            rest = _FOLD[data[b : b + CHUNK_BYTES]]
            gap = np.flatnonzero(rest == 0)
            more = int(gap[0]) if len(gap) else len(rest)
            if more:
                fold = np.concatenate([fold, rest[:more]])
                b += more
        upper = np.flatnonzero((fold[1:] >= 0x80) & (fold[1:] <= 0x9E) & (fold[1:] != 0x97) & (fold[:-1] == 0xC3)) + 1
        fold[upper] += 0x20
        solid = fold > 0
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        inner = offsets[(offsets > a) & (offsets < b)] - a
        start[inner] |= solid[inner]
        begin = np.flatnonzero(start)
        if len(begin):
            run = np.cumsum(start) - 1
            place = np.arange(len(fold)) - begin[np.maximum(run, 0)]
            longest = int(place[solid].max()) + 1
            power = np.full(longest, _POWER, np.uint64)
            power[0] = 1
            power = np.cumprod(power, dtype=np.uint64)
            v = fold.astype(np.uint64)
            v[solid] *= power[place[solid]]
            out.append(scramble(np.add.reduceat(v, begin) + _M1))
            begins.append(begin + a)
        a = b
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(out), np.searchsorted(np.concatenate(begins), offsets)


def shingles(words: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words (a shorter text's words are one), and those before each text."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(to[-1]) - np.repeat(to[:-1] - at[:-1], count)
    end = np.repeat(at[1:], count)
    h = np.full(len(first), np.uint64(k), np.uint64)
    for i in range(k):
        inside = first + i < end
        w = words[np.minimum(first + i, len(words) - 1)] if len(words) else words
        h = np.where(inside, scramble(h * _M1 + w), h)
    return h, to


def counted(h: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted: (text, hash, times)."""
    text = np.repeat(np.arange(len(to) - 1), np.diff(to))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def weight(times: np.ndarray) -> np.ndarray:
    """A repeated shingle weighs more, but less than it is repeated."""
    return 1.0 + np.log(times)


def signatures(text: np.ndarray, h: np.ndarray, w: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers: the shingle that came first in each register; 0 for a text without shingles."""
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    x = np.zeros(len(h))
    seed = scramble(h)
    while len(h):
        seed = seed + _M1
        r = scramble(seed)
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        place = text * registers + (scramble(r + _M2) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, place, x)
        won = earliest[place] == x
        winner[place[won]] = h[won]
        latest = earliest.reshape(texts, registers).max(axis=1)
        go = x <= latest[text]
        text, h, w, x, seed = text[go], h[go], w[go], x[go], seed[go]
    return winner.reshape(texts, registers)


def plain_signatures(sign: np.ndarray, text: np.ndarray, h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Signatures with all weights 1: those of ``sign``, except of texts that repeat a shingle."""
    again = np.unique(text[times > 1])
    if not len(again):
        return sign
    own = np.isin(text, again)
    out = sign.copy()
    out[again] = signatures(np.searchsorted(again, text[own]), h[own], np.ones(int(own.sum())), len(again), sign.shape[1])
    return out


def sketch_bits(sign: np.ndarray) -> np.ndarray:
    """One bit of each register, from its shingle and its number: registers with one shingle have independent bits."""
    return (scramble(sign + np.arange(1, sign.shape[1] + 1, dtype=np.uint64) * _M1) & np.uint64(1)).astype(np.uint8)


def band_keys(sign: np.ndarray, bands: int) -> np.ndarray:
    """texts x bands: a 64-bit hash of each band's registers."""
    parts = sign.reshape(len(sign), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        h = scramble(h * _M1 + parts[:, :, i])
    return h.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of two texts' shingles, or their probability Jaccard similarity if that is
    larger; each text is its sorted shingles and their weights."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    plain = len(ia) / (len(ha) + len(hb) - len(ia))
    if plain >= 1 or (wa.max() == 1 and wb.max() == 1):
        return plain
    return max(plain, probability_jaccard(wa, wb, ia, ib))


def probability_jaccard(wa: np.ndarray, wb: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> float:
    """sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    x, y = wa[ia], wb[ib]
    # Common shingles sorted by b / a: for d, those before it count by a / a_d, those after by b / b_d.
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    a_low = np.concatenate([[0], np.cumsum(x)])
    b_high = np.concatenate([np.cumsum(y[::-1])[::-1], [0]])
    k = np.searchsorted(ratio, ratio, side="right")
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    total = (only_a + a_low[k]) / x + (only_b + b_high[k]) / y
    return float((1 / total).sum())
