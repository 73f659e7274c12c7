"""Packing of token sequences by cutting-stock column generation.

Texts are encoded once and kept with their length as a table in the shared folder.
What is left of each document beyond whole sequences is counted in a histogram of
``CAPACITY / UNIT`` sizes, rounded up.  A linear program over that histogram finds how
often each pattern of sizes should be used; columns are priced by a knapsack dynamic
program.  Each task then takes the rounded share of each pattern for a window of its
own rows, assigns the window's documents, ranked by size, and fills what is left of each
sequence with pieces cut from documents that no pattern took.  A task ends with fewer
tokens than one sequence; they become sequences whose lengths are powers of two.

No row is shuffled: only the histogram crosses tasks.  A null or empty text is the end
token alone; repeated rows are packed each; further columns are ignored; an empty table
gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import VOCABULARY, codec
from weftline.llm.common import frugal, materialize, prepare, row_chunks, text_buffer

CAPACITY = 2048
UNIT = 16
END_ID = 1
#: Tokens that a task packs at once.
WINDOW = 4_000_000


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (with the end token; 16-bit where the vocabulary allows)."""
    prepare(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_chunks(offsets):
                ids, at = c.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, at[1:], END_ID)
                at = at + np.arange(len(at))
                raw, width = ids.tobytes(), ids.itemsize
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array([raw[a * width : b * width] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def knapsack(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes 1..len(value) with a sum of at most ``room``."""
    best, choice = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        k = min(c, len(value))
        got = value[:k] + best[c - 1 :: -1][:k]
        j = int(got.argmax())
        best[c], choice[c] = (got[j], j + 1) if got[j] > best[c - 1] else (best[c - 1], 0)
    taken, c = np.zeros(len(value), np.int64), room
    while c > 0:
        if choice[c]:
            taken[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[room]), taken


def patterns(demand: np.ndarray, room: int) -> list[tuple[float, np.ndarray]]:
    """Uses of each pattern in an optimal fractional solution: min sum x, A x >= demand, x >= 0.

    A revised simplex that begins with one pattern for each size; demand[k] is of size k + 1.  It runs until
    no pattern prices below its cost; demands are set apart by a trace of a piece, so that no two ratios tie
    and no step comes back to an earlier basis.
    """
    m = len(demand)
    demand = demand + 1e-7 * (1 + np.arange(m) / m) * (1 + demand.sum() / 1e6)
    columns = [np.where(np.arange(m) == k, room // (k + 1), 0) for k in range(m)]
    inverse = np.diag([1.0 / c[k] for k, c in enumerate(columns)])
    x = inverse @ demand
    while True:
        value, column = knapsack(np.maximum(inverse.sum(axis=0), 0), room)
        if value <= 1 + 1e-9:
            break
        d = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        theta = ratio[r]
        x = np.maximum(x - theta * d, 0)
        x[r] = theta
        pivot = inverse[r] / d[r]
        inverse -= np.outer(d, pivot)
        inverse[r] = pivot
        columns[r] = column
    return [(float(u), c) for u, c in zip(x, columns, strict=True) if u > 1e-3]


class Packer:
    """Packs windows of documents; what fills no whole sequence waits for the next window."""

    def __init__(self, plan: list[tuple[float, np.ndarray]], total: int, capacity: int, unit: int) -> None:
        self.plan = sorted(plan, key=lambda p: (-p[0], p[1].tolist()))
        self.total, self.capacity, self.unit = max(total, 1), capacity, unit
        self.next_sequence = 0
        self.rest: list[tuple[int, int, int]] = []  # (document, start, length)

    def window(self, doc: np.ndarray, length: np.ndarray, last: bool) -> list[tuple[int, int, int, int, int]]:
        """(document, start, length, sequence, offset) of each piece."""
        cap, out = self.capacity, []
        for d, n in zip(doc.tolist(), length.tolist(), strict=True):
            for s in range(0, n - cap + 1, cap):
                out.append((d, s, cap, self.next_sequence, 0))
                self.next_sequence += 1
        tail = length % cap
        some = np.flatnonzero(tail)
        size = -(-tail[some] // self.unit)
        # Ranked documents of each size: the fullest of a size first.
        ranked: dict[int, list[tuple[int, int, int]]] = {}
        for k in some[np.lexsort((doc[some], -tail[some], size))].tolist():
            t = int(tail[k])
            ranked.setdefault(-(-t // self.unit), []).append((int(doc[k]), int(length[k]) - t, t))
        for v in ranked.values():
            v.reverse()
        share = len(some) / self.total
        sequences: list[list[tuple[int, int, int]]] = []
        for use, column in self.plan:
            need = [(int(k) + 1, int(column[k])) for k in np.flatnonzero(column)][::-1]
            times = min([round(use * share), *(len(ranked.get(k, ())) // c for k, c in need)])
            for _ in range(times):
                sequences.append([ranked[k].pop() for k, c in need for _ in range(c)])
        filler = self.rest + [p for k in sorted(ranked, reverse=True) for p in reversed(ranked[k])]
        slack = [cap - sum(p[2] for p in s) for s in sequences]
        have, want = sum(p[2] for p in filler), sum(slack)
        while sequences and have < want:  # too few tokens to fill them all: the last sequence fills others
            s, k = sequences.pop(), slack.pop()
            filler += s
            have, want = have + cap - k, want - k
        filler.reverse()
        for s, k in zip(sequences, slack, strict=True):
            s += self._cut(filler, k)
        while have - want >= cap:
            sequences.append(self._cut(filler, cap))
            have -= cap
        left = have - want
        if last:
            while left:
                part = 1 << (left.bit_length() - 1)
                sequences.append(self._cut(filler, part))
                left -= part
        self.rest = filler[::-1]
        for s in sequences:
            offset = 0
            for d, start, n in s:
                out.append((d, start, n, self.next_sequence, offset))
                offset += n
            self.next_sequence += 1
        return out

    @staticmethod
    def _cut(filler: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
        taken = []
        while n:
            d, start, size = filler.pop()
            if size > n:
                filler.append((d, start + n, size - n))
                size = n
            taken.append((d, start, size))
            n -= size
        return taken


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, unit: int = UNIT, window: int = WINDOW) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = materialize(encoded(docs, path), "tokens")
    sizes = -(-capacity // unit)
    size = F.ceil(F.col("n_tokens") % capacity / unit).cast("int").alias("size")
    counted = {r["size"]: r["count"] for r in tokens.select(size).groupBy("size").count().collect() if r["size"]}
    demand = np.array([counted.get(k + 1, 0) for k in range(sizes)], float)
    total = int(demand.sum())
    plan = patterns(demand, sizes) if total else []
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(plan, total, capacity, unit)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        held: dict[int, tuple] = {}  # documents of which pieces are still to come: (doc_id, ids)
        fresh: list[int] = []
        serial = waiting = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            doc = np.array(fresh, np.int64)
            length = np.array([len(held[d][1]) for d in fresh], np.int64)
            pieces = packer.window(doc, length, last)
            rows = [(held[d][0], s, n, zlib.crc32(held[d][1][s : s + n].astype("<u4").tobytes()), len(held[d][1]), first + q, o) for d, s, n, q, o in pieces]
            keep = {p[0] for p in packer.rest}
            for d in [d for d in held if d not in keep]:
                del held[d]
            fresh.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), id_type), *(pa.array(list(c), pa.int64()) for c in columns[1:])], NAMES) if rows else None

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            wide = np.dtype("<u2")
            for doc_id, n, raw in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True):
                buffer = raw.as_py()
                if n and len(buffer) == 4 * n:
                    wide = np.dtype("<u4")
                held[serial] = (doc_id, np.frombuffer(buffer, wide))
                fresh.append(serial)
                serial += 1
                waiting += n
                if waiting >= window:
                    if (out := flush(False)) is not None:
                        yield out
                    waiting = 0
        if id_type is not None and (fresh or packer.rest) and (out := flush(True)) is not None:
            yield out

    return tokens.mapInArrow(frugal(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
