"""Language identification as a mixture of languages.

A byte-trigram model of each language is counted on a sample of labelled texts of bounded
expected size.  Each word of a text gets its likelihood under every language; expectation
maximisation estimates the languages' shares in the text.  The languages are then taken
in the order of their shares, the model is fitted again for the first one, two, ... of
them, and the set with the best penalised likelihood is chosen.  The prediction is the
language with the largest share in that set, the score its share.

A text that is null or has no letter is ``und`` with score 0.  A table without labelled
rows teaches no language: every text is ``und``.  Repeated rows and further columns do
not matter.  Very long texts are read in pieces, and none is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import CHUNK_BYTES, frugal, prepare, row_chunks, text_buffer

#: Texts for each language that the model is expected to be counted on, at most.
SAMPLE_PER_LANGUAGE = 1500
BUCKETS = 1 << 16
#: Nats that each further language of a text costs, besides half the log of its words.
PENALTY = 6.0
ROUNDS = 12

#: Bytes in lower case; what is no letter becomes a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte letters after C3."""
    out = _FOLD[data]
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[upper] += 0x20
    return out


def trigrams(b: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes that end one place after each byte; spaces stand before and after."""
    x = np.empty(len(b) + 2, np.uint32)
    x[0] = x[-1] = 32
    x[1:-1] = b
    h = x[:-2] * np.uint32(0x9E3779B1)
    h ^= x[1:-1] * np.uint32(0x85EBCA6B) << np.uint32(7)
    h ^= x[2:] * np.uint32(0xC2B2AE35) << np.uint32(3)
    h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(16)).astype(np.int64)


def learning_rows(docs: DataFrame) -> Column:
    return F.col("lang").isNotNull() & F.col("text").isNotNull()


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about a megabyte that end between words."""
    a = 0
    while a < len(data):
        b = min(a + CHUNK_BYTES, len(data))
        while b < len(data):
            rest = folded(data[b : b + 4096])
            gap = np.flatnonzero(rest == 32)
            if len(gap):
                b += int(gap[0])
                break
            b += len(rest)
        yield a, b
        a = b


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        p = counts + 0.02
        self.log = np.log(p / p.sum(axis=1, keepdims=True)).T.astype(np.float32) if len(languages) else np.zeros((BUCKETS, 0), np.float32)
        # Against their mean: only differences between languages count.
        if len(languages):
            self.log -= self.log.mean(axis=1, keepdims=True)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each word under each language, and the words before each text."""
        out, begins = [], []
        for a, end in pieces(data):
            b = folded(data[a:end])
            solid = b != 32
            start = solid.copy()
            start[1:] &= ~solid[:-1]
            bounds = offsets[(offsets > a) & (offsets < a + len(b))] - a
            start[bounds] |= solid[bounds]
            begin = np.flatnonzero(start)
            if not len(begin):
                continue
            rows = self.log[trigrams(b)]
            rows[~solid] = 0
            out.append(np.add.reduceat(rows, begin, axis=0))
            begins.append(begin + a)
        if not out:
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(len(offsets), np.int64)
        return np.concatenate(out), np.searchsorted(np.concatenate(begins), offsets)

    @staticmethod
    def mix(like: np.ndarray, row: np.ndarray, n: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Expectation maximisation for all texts at once: shares and log likelihood (of scaled words)."""
        for _ in range(rounds):
            part = share[row] * like
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
            share = np.add.reduceat(part, first, axis=0) / n[:, None]
        total = np.log(np.maximum((share[row] * like).sum(axis=1), 1e-30))
        return share, np.add.reduceat(total, first)

    def infer(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: best language (-1: none), its share, and all shares."""
        k, texts = len(self.languages), len(offsets) - 1
        best, score, shares = np.full(texts, -1), np.zeros(texts), np.zeros((texts, k))
        ll, at = self.words(data, offsets)
        n = np.diff(at)
        some = np.flatnonzero(n)
        if not k or not len(some):
            return best, score, shares
        first, n = at[:-1][some], n[some]
        row = np.repeat(np.arange(len(some)), n)
        like = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -30))
        full, _ = self.mix(like, row, n, first, np.full((len(some), k), 1.0 / k, np.float32), ROUNDS)
        order = np.argsort(-full, axis=1, kind="stable")
        value, chosen = np.full(len(some), -np.inf), np.zeros_like(full)
        for size in range(1, k + 1):
            inside = np.zeros_like(full)
            np.put_along_axis(inside, order[:, :size], 1.0, axis=1)
            start = np.maximum(full, 1e-3) * inside
            share, total = self.mix(like, row, n, first, start / start.sum(axis=1, keepdims=True), 0 if size == 1 else ROUNDS // 2)
            total = total - (size - 1) * (PENALTY + 0.5 * np.log(n))
            better = total > value
            value = np.where(better, total, value)
            chosen[better] = share[better]
        best[some] = chosen.argmax(axis=1)
        score[some] = np.clip(chosen.max(axis=1), 0, 1)
        shares[some] = chosen
        return best, score, shares


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Counts trigrams on labelled texts; a language with more than ``per_language`` of them gives
    the share of its rows, chosen by a hash of text and doc_id, that is expected to come to so many."""
    prepare(docs.sparkSession)
    labelled = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(learning_rows(docs))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003)
    sample = labelled.filter(draw < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                row = data[offsets[k] : offsets[k + 1]]
                for a, end in pieces(row):
                    b = folded(row[a:end])
                    own += np.bincount(trigrams(b)[b != 32], minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = sample.select("lang", "text").mapInArrow(frugal(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most languages x BUCKETS rows, whatever the input.
    table = rows.toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    number = {lang: i for i, lang in enumerate(languages)}
    which = np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
    counts[which, table["bucket"].to_numpy()] = table["n"].to_numpy()
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, keep: list[str], result: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_shares")) -> DataFrame:
    """The columns ``keep``, and the language, its share and all shares (of the chosen set, as a map) under the names ``result``."""
    body = "_" * (1 + max(map(len, keep), default=0))  # no column that is kept
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.log))  # languages x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model([], np.zeros((0, BUCKETS)))
        own.languages, own.log = sent.value
        names = np.array([*own.languages, "und"])
        for batch in batches:
            texts = batch.column(len(keep))
            data, offsets = text_buffer(texts)
            for i, j in row_chunks(offsets):
                piece = data[offsets[i] : offsets[j]]
                best, score, shares = own.infer(piece, offsets[i : j + 1] - offsets[i])
                doubt = np.flatnonzero(best >= 0)
                for k in doubt:
                    a, b = offsets[i + k] - offsets[i], offsets[i + k + 1] - offsets[i]
                    head = piece[a : min(b, a + 64)]
                    plain = ((head | 32) >= 97) & ((head | 32) <= 122)
                    if not plain.any() and not any(map(str.isalpha, texts[i + int(k)].as_py())):
                        best[k], score[k], shares[k] = -1, 0, 0
                maps = [[(own.languages[x], float(r[x])) for x in np.flatnonzero(r)] for r in shares]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in range(len(keep))), pa.array(names[best].tolist()), pa.array(score.astype(float)), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                    [*keep, *result],
                )

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias(body))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep))
    return rows.mapInArrow(frugal(run), ", ".join(x for x in (schema, f"`{result[0]}` string, `{result[1]}` double, `{result[2]}` map<string, double>") if x))
