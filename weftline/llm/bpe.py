"""Byte-level BPE by speculation and verification.

A text is cut into words by the public byte-level pattern, words are encoded once
each, and ids are spread back by vector gathers.  For a new word, greedy longest
match over a trie proposes tokens; a vectorised test asks for every adjacent pair of
proposed tokens whether BPE could leave that boundary standing; words in which a pair
fails are merged exactly.  Every encoded text is decoded again and compared with its
bytes; a text that differs (two words with one 64-bit hash) is encoded word by word.

Null and empty texts have no tokens.  A special token's string in a text becomes its id.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from weftline.llm.common import CHUNK_BYTES, expand, frugal, prepare, row_chunks, text_buffer

VOCABULARY = "byte_bpe_50k.json"

# White space of the pattern, and the pattern itself.
SPACES = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

_SLOW = regex.compile(PATTERN)
_WORDLIKE = regex.compile(r"[\p{L}\p{N}]")
#: The library's own cutting, asked only for characters that this Python's tables do not know as letters or numbers.
_LIBRARY = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
#: Bytes whose class is not settled by the byte alone: then the pattern itself cuts the text.
#: Two-byte letters have a lead byte C3..C9 (C3 97 and C3 B7 are signs).
_UNSETTLED = np.zeros(256, bool)
_UNSETTLED[[0xC2, *range(0xCA, 256)]] = True
_L, _N, _S, _O = 0, 1, 2, 3
_CLASS = np.full(256, _O, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _L
_CLASS[48:58] = _N
_CLASS[[9, 10, 11, 12, 13, 32]] = _S

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def unsettled(data: np.ndarray) -> bool:
    if _UNSETTLED[data].any():
        return True
    lead = np.flatnonzero(data[:-1] == 0xC3)
    return bool(np.isin(data[lead + 1], (0x97, 0xB7)).any())


class Probe:
    """Open-addressed map of non-negative int64 keys to int32, read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            slot, first = np.unique(at, return_index=True)
            free = self.keys[slot] < 0
            put = left[first[free]]
            self.keys[slot[free]], self.values[slot[free]] = keys[put], values[put]
            keep = np.ones(len(left), bool)
            keep[first[free]] = False
            left, at = left[keep], (at[keep] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for word, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.token[i] = word
        self.lens = np.array([len(t) for t in self.token], np.int64)
        self.flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        digits = [b"%d," % i for i in range(size)]
        self.digit_lens = np.array([len(d) for d in digits], np.int64)
        self.digit_flat = np.frombuffer(b"".join(digits), np.uint8)
        self.digit_starts = np.concatenate([[0], np.cumsum(self.digit_lens)[:-1]])
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        left, right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        self.rank = np.full(size, -1, np.int64)
        keys, made, ranks = [], [], []
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            keys.append(x << 20 | y)
            made.append(z)
            ranks.append(k)
            self.merge[x, y] = (k, z)
            if self.rank[z] < 0:
                left[z], right[z], self.rank[z] = x, y, k
        self.left, self.right = left, right
        self.of_rank = np.array(made, np.int32)
        self.pair_rank = Probe(np.array(keys), np.array(ranks))
        self._trie({i for i in vocab.values()})
        self.reset()

    def _trie(self, ids: set[int]) -> None:
        edges: dict[int, int] = {}
        accept = [-1]
        for i in ids:
            node = 0
            for b in self.token[i]:
                key = node << 8 | b
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(accept)
                    accept.append(-1)
                node = nxt
            accept[node] = i
        self.accept = np.array(accept, np.int32)
        self.edge = Probe(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))

    # -- words already encoded: an open-addressed table of hashes, and the words' ids in one array

    #: Words kept before the memory of words is emptied.
    CACHE_WORDS = 400_000
    _BITS = 21

    def reset(self) -> None:
        self.slot_hash = np.zeros(1 << self._BITS, np.uint64)
        self.slot_word = np.zeros(1 << self._BITS, np.int32)
        self.known = 0
        self.known_at = np.zeros(1 << 12, np.int64)
        self.known_len = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 12, np.uint16 if len(self.token) <= 65536 else np.uint32)
        self.n_ids = 0
        for word, i in self.special.items():
            data = np.frombuffer(word, np.uint8)
            self._remember(hashes(data, np.array([0]), np.array([len(data)])), np.array([i]), np.array([1]))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for one not seen yet."""
        mask = (1 << self._BITS) - 1
        at = (h >> np.uint64(64 - self._BITS)).astype(np.int64)
        found = self.slot_hash[at]
        out = np.where(found == h, self.slot_word[at], -1)
        more = np.flatnonzero((found != h) & (found != 0))
        while len(more):
            at[more] = (at[more] + 1) & mask
            found = self.slot_hash[at[more]]
            hit = found == h[more]
            out[more[hit]] = self.slot_word[at[more[hit]]]
            more = more[~hit & (found != 0)]
        return out

    def _remember(self, h: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """Adds words whose hashes differ from each other and from those known."""
        n = self.known + len(h)
        while n > len(self.known_at):
            self.known_at, self.known_len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.known_at, self.known_len))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.known_at[self.known : n] = self.n_ids + np.cumsum(lens) - lens
        self.known_len[self.known : n] = lens
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        left, word = np.arange(len(h)), np.arange(self.known, n)
        at = (h >> np.uint64(64 - self._BITS)).astype(np.int64)
        while len(left):
            free = self.slot_hash[at] == 0
            self.slot_hash[at[free]] = h[left[free]]
            won = free & (self.slot_hash[at] == h[left])
            self.slot_word[at[won]] = word[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self._BITS) - 1)
        self.known = n

    # -- one word list

    def propose(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of each word: (word of each token, token), in order."""
        end = start + size
        word, pos = np.arange(len(start)), start.copy()
        node = np.zeros(len(start), np.int64)
        best, best_end = np.full(len(start), -1, np.int32), start.copy()
        begun = start.copy()
        out_w, out_p, out_t = [], [], []
        while len(word):
            live = pos < end[word]
            step = np.full(len(word), -1, np.int64)
            step[live] = self.edge.get(node[live] << 8 | data[pos[live]])
            go = step >= 0
            node = np.where(go, step, 0)
            pos = pos + go
            hit = np.where(go, self.accept[node], -1)
            best, best_end = np.where(hit >= 0, hit, best), np.where(hit >= 0, pos, best_end)
            stop = ~go
            if stop.any():
                out_w.append(word[stop])
                out_p.append(begun[stop])
                out_t.append(best[stop])
                pos, begun = np.where(stop, best_end, pos), np.where(stop, best_end, begun)
                best = np.where(stop, -1, best)
                keep = ~stop | (pos < end[word])
                word, pos, node, best, best_end, begun = word[keep], pos[keep], node[keep], best[keep], best_end[keep], begun[keep]
        w, p, t = np.concatenate(out_w), np.concatenate(out_p), np.concatenate(out_t)
        order = np.lexsort((p, w))
        return w[order], t[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE, given the bytes of both tokens, leaves the boundary between them.

        Both derivations are undone from the latest merge backwards.  While x (the end of
        what is left of a) and y (the start of b) both stand, a merge of x with y would
        have come first if its rank is below that of the merge that took x, or not above
        that of the merge that took y (equal merges go from left to right).
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        far = np.iinfo(np.int64).max
        x_taken, y_taken = np.full(len(a), far), np.full(len(a), far)
        while len(at):
            r = self.pair_rank.get(x << 20 | y).astype(np.int64)
            bad = (r >= 0) & (r < x_taken) & (r <= y_taken)
            ok[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            # Of one merge on both sides, the right copy was made last.
            undo_x = (rx > ry) & (rx >= 0)
            undo_y = ~undo_x & (ry >= 0)
            go = ~bad & (undo_x | undo_y)
            x_taken = np.where(undo_x, rx, x_taken)
            y_taken = np.where(undo_y, ry, y_taken)
            x, y = np.where(undo_x, self.right[x], x).astype(np.int64), np.where(undo_y, self.left[y], y).astype(np.int64)
            at, x, y, x_taken, y_taken = at[go], x[go], y[go], x_taken[go], y_taken[go]
        return ok

    def exact(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word by exact merging."""
        size = np.array([len(w) for w in words], np.int64)
        w, t = self.merged(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        return [x.tolist() for x in np.split(t, np.searchsorted(w, np.arange(1, len(words))))]

    def merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges by rank, leftmost first: words of similar length in step with each other, long ones
        by a heap.  Returns (word of each token, token), in order."""
        out_w, out_t = [], []
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], 64, side="right"))
        at = 0
        while at < short:
            width = min(64, max(6, int(size[order[at]]) * 5 // 4 + 1))
            end = min(at + 8_000, int(np.searchsorted(size[order], width, side="right")))
            group = order[at:end]
            at = end
            w, t = self._in_step(data, start[group], size[group], width)
            out_w.append(group[w])
            out_t.append(t)
        for i in order[short:]:
            ids = self._heap(data[start[i] : start[i] + size[i]].tobytes())
            out_w.append(np.full(len(ids), i))
            out_t.append(np.array(ids, np.int32))
        w, t = np.concatenate(out_w), np.concatenate(out_t)
        order = np.argsort(w, kind="stable")
        return w[order], t[order]

    def _in_step(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        far = np.iinfo(np.int32).max
        inside = np.arange(width)[None, :] < size[:, None]
        place = np.minimum(start[:, None] + np.arange(width)[None, :], len(data) - 1)
        sym = np.where(inside, self.of_byte[data[place]], -1)
        rank = np.full((len(start), width), far, np.int32)
        both = inside[:, 1:]
        got = self.pair_rank.get(sym[:, :-1][both].astype(np.int64) << 20 | sym[:, 1:][both])
        rank[:, :-1][both] = np.where(got >= 0, got, far)
        cols, out = np.arange(width)[None, :], sym.copy()
        live = np.arange(len(start))
        while len(live):
            row = np.arange(len(live))
            col = rank.argmin(axis=1)
            some = rank[row, col] < far
            if not some.all():
                out[live[~some]] = sym[~some]
                live, col, sym, rank = live[some], col[some], sym[some], rank[some]
                row = np.arange(len(live))
            if not len(live):
                break
            merged = self.of_rank[rank[row, col]]
            take = np.minimum(cols + (cols > col[:, None]), width - 1)
            sym, rank = np.take_along_axis(sym, take, 1), np.take_along_axis(rank, take, 1)
            sym[:, -1], rank[:, -1] = -1, far
            sym[row, col] = merged
            for at in (col - 1, col):
                ok = (at >= 0) & (at + 1 < width)
                r, c = row[ok], at[ok]
                b = sym[r, c + 1].astype(np.int64)
                new = np.full(len(r), far, np.int32)
                has = b >= 0
                got = self.pair_rank.get(sym[r[has], c[has]].astype(np.int64) << 20 | b[has])
                new[has] = np.where(got >= 0, got, far)
                rank[r, c] = new
        whole = out >= 0
        return np.nonzero(whole)[0], out[whole]

    def _heap(self, word: bytes) -> list[int]:
        sym = [int(self.of_byte[b]) for b in word]
        prev, nxt = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap = [(self.merge[p][0], i, *p) for i in range(len(sym) - 1) if (p := (sym[i], sym[i + 1])) in self.merge]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = self.merge[a, b][1], -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] >= 0 and (p := (sym[k], sym[nxt[k]])) in self.merge:
                    heapq.heappush(heap, (self.merge[p][0], k, *p))
        return [s for s in sym if s >= 0]

    def words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each word, by proposal, test and, where that fails, exact merges."""
        w, t = self.propose(data, start, size)
        same = np.flatnonzero(w[1:] == w[:-1])
        failed = np.unique(w[same[~self.compatible(t[same], t[same + 1])]])
        if not len(failed):
            return t, np.bincount(w, minlength=len(start))
        again = np.zeros(len(start), bool)
        again[failed] = True
        keep = ~again[w]
        fw, ft = self.merged(data, start[failed], size[failed])
        w2, t2 = np.concatenate([w[keep], failed[fw]]), np.concatenate([t[keep], ft])
        order = np.argsort(w2, kind="stable")
        return t2[order], np.bincount(w2, minlength=len(start))

    # -- texts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offsets of each text in them."""
        out, counts = [], []
        for i, j in row_chunks(offsets):
            rows = data[offsets[i] : offsets[j]]
            cuts = offsets[i : j + 1] - offsets[i]
            if j == i + 1 and len(rows) > 4 * CHUNK_BYTES:
                n = 0
                for a, b in pairwise(self._pieces(rows)):
                    ids, _ = self._encode_rows(rows[a:b], np.array([0, b - a]))
                    out.append(ids)
                    n += len(ids)
                counts.append(np.array([n]))
                continue
            ids, n = self._encode_rows(rows, cuts)
            out.append(ids)
            counts.append(n)
        if not out:
            return np.zeros(0, self.ids.dtype), np.zeros(1, np.int64)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _pieces(self, data: np.ndarray) -> list[int]:
        """Places where a long text can be cut without changing a word.

        White space after an ASCII character that is none always starts a word; in a text whose
        bytes settle their classes any change of class does, unless after an apostrophe.
        """
        plain = not unsettled(data) and not any(s in data.tobytes() for s in self.special)
        cuts, at = [0], CHUNK_BYTES
        while at < len(data):
            w = data[at - 1 : at + CHUNK_BYTES]
            kind = _CLASS[w]
            good = (kind[1:] == _S) & (kind[:-1] != _S) & (w[:-1] < 128)
            if plain:
                good |= (kind[1:] != kind[:-1]) & (kind[:-1] != _S) & (w[:-1] != 39)
            found = np.flatnonzero(good)
            at += int(found[0]) if len(found) else CHUNK_BYTES
            if len(found):
                cuts.append(at)
                at += CHUNK_BYTES
        return [*cuts, len(data)]

    def _encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, self.ids.dtype), np.zeros(len(offsets) - 1, np.int64)
        start = word_starts(data, offsets, [*self.special])
        size = np.diff(np.append(start, len(data)))
        ids, lens = self._lookup(data, start, size)
        row_of_word = np.searchsorted(start, offsets[1:-1])
        total = np.concatenate([[0], np.cumsum(lens)])
        ends = np.concatenate([total[row_of_word], [total[-1]]])
        counts = np.diff(np.concatenate([[0], ends]))
        back = expand(self.flat, self.starts, self.lens, ids)
        if len(back) != len(data) or not np.array_equal(back, data):
            return self._encode_plainly(data, offsets)
        return ids, counts

    def _lookup(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes(data, start, size)
        word = self._find(h)
        new = np.flatnonzero(word < 0)
        if len(new):
            uniq, first = np.unique(h[new], return_index=True)
            if self.known + len(uniq) > self.CACHE_WORDS and self.known > len(self.special):
                self.reset()
                return self._lookup(data, start, size)
            first = new[first]
            self._remember(uniq, *self.words(data, start[first], size[first]))
            word[new] = self._find(h[new])
        return expand(self.ids, self.known_at, self.known_len, word), self.known_len[word]

    def _encode_plainly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        raw = data.tobytes()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            n = len(ids)
            row = data[a:b]
            if b > a:
                starts = [*word_starts(row, np.array([0, b - a]), [*self.special]).tolist(), int(b - a)]
                words = [raw[a + x : a + y] for x, y in zip(starts, starts[1:], strict=False)]
                for w, e in zip(words, self.exact(words), strict=True):
                    ids += [self.special[w]] if w in self.special else e
            counts.append(len(ids) - n)
        return np.array(ids, self.ids.dtype), np.array(counts, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return expand(self.flat, self.starts, self.lens, ids).tobytes()

    def digits(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas, with one at the end."""
        return expand(self.digit_flat, self.digit_starts, self.digit_lens, ids).tobytes()


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the words that tile ``data``."""
    longest = int(size.max())
    power = np.full(longest, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    v = power[np.arange(len(data)) - np.repeat(start, size)]
    v *= data.astype(np.uint64) + np.uint64(1)
    h = np.add.reduceat(v, start)
    h ^= h >> np.uint64(29)
    h *= _MULT
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1))


def word_starts(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where the pattern's words start; the texts tile ``data``."""
    raw = data.tobytes()
    settled = not unsettled(data) and not any(s in raw for s in special)
    if settled:
        return _settled_starts(data, offsets)
    parts = []
    i, n = 0, len(offsets) - 1
    odd = []
    for k in range(n):
        t = raw[offsets[k] : offsets[k + 1]]
        odd.append(unsettled(data[offsets[k] : offsets[k + 1]]) or any(s in t for s in special))
    while i < n:
        j = i + 1
        if odd[i]:
            parts.append(offsets[i] + _pattern_starts(raw[offsets[i] : offsets[j]], special))
        else:
            while j < n and not odd[j]:
                j += 1
            if offsets[j] > offsets[i]:
                parts.append(offsets[i] + _settled_starts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        i = j
    return np.concatenate(parts).astype(np.int64)


@lru_cache(maxsize=1 << 16)
def _seen_as(c: str) -> str:
    """A character as the library's tables class it: one that only newer tables call a letter or number
    is stood for by a sign of as many bytes."""
    if not _WORDLIKE.match(c) or len(_LIBRARY.pre_tokenize_str(c + "!")) > 1:
        return c
    return {2: "\x80", 3: "\ue000"}.get(len(c.encode("utf-8", "surrogatepass")), "\U000f0000")


def _pattern_starts(raw: bytes, special: list[bytes]) -> np.ndarray:
    text = raw.decode("utf-8", "surrogatepass")
    for c in {c for c in set(text) if not c.isalnum() and _seen_as(c) != c}:
        text = text.replace(c, _seen_as(c))
    cut = re.split("(" + "|".join(re.escape(s.decode()) for s in special) + ")", text) if special else [text]
    lens = []
    for k, piece in enumerate(cut):
        lens += [len(piece.encode())] if k % 2 else [len(w.encode("utf-8", "surrogatepass")) for w in _SLOW.findall(piece)]
    return np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64) if lens else np.zeros(0, np.int64)


def _settled_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(data)
    kind = _CLASS[data]
    doc = np.zeros(n + 1, bool)
    doc[offsets] = True
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= doc[:n]
    begin = run.copy()
    # A word's first letter after white space of the same text: that space, if it is U+0020, belongs
    # to the word; else it stands alone, and what came before it in its run is another word.
    head = np.flatnonzero(run[1:] & ~doc[1:n] & (kind[1:] != _S) & (kind[:-1] == _S)) + 1
    begin[head - 1] = True
    begin[head[data[head - 1] == 32]] = False
    quote = np.flatnonzero((data == 39) & begin)
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == _L) & ~doc[quote + 1]]
    if len(quote):
        c1 = data[quote + 1]
        two = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
        nxt = np.minimum(quote + 2, n - 1)
        c2 = np.where((quote + 2 < n) & ~doc[quote + 2], data[nxt], 0)
        three = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        for which, width in ((two, 2), (three, 3)):
            q = quote[which]
            begin[q + 1] = False
            after = q + width
            after = after[after < n]
            begin[after[(kind[after] == _L)]] = True
    return np.flatnonzero(begin)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (the tokens as little-endian unsigned 32-bit integers) and the decoded text."""
    prepare(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            ids, at = c.encode(data, offsets)
            ids = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([c.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded text."""
    prepare(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_chunks(offsets):
                ids, at = c.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sha_i, sha_d = [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    own = ids[a:b]
                    sha_i.append(hashlib.sha256(c.digits(own)[:-1]).hexdigest())
                    sha_d.append(hashlib.sha256(c.decode(own)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(sha_i), pa.array(sha_d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
