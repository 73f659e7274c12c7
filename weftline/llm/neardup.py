"""Near-duplicate classes: ProbMinHash, banding, verification, connected components.

Texts with the same words are one node (texts without words: with the same characters but
white space).  Two nodes are linked if the Jaccard similarity of their five-word shingles,
plain or weighted by repeats, is THRESHOLD or more; classes are the components of all
links.  Signatures and bands are over both: a text that repeats shingles has bands of unit
weights beside the weighted ones, in any other text they are the same.

No bucket is joined with itself.  In each of a few rounds a node is compared with one other
node, the leader that it meets in most of its buckets; what belongs together is mostly
joined by then.  Nodes whose buckets still hold several components get longer signatures,
whose bands of DEEP_ROWS registers tell less similar texts apart, and meet only where they
share one of those.  There each pair of different components is met, a growing number of
leaders at a time: a leader, never of the bucket's largest component, meets its whole bucket
and leaves it, until one component is left.  Pairs whose sketches (a bit of each register)
differ by over 4.5 standard deviations more than a similarity of 0.8 does are not compared
further.  A pair of similarity 0.8 that no third text joins is found with probability 0.967
(0.9999 in the first bands, 0.967 in the longer ones), one of 0.85 with 0.9999.

Null and empty texts are copies of each other.  A text of fewer than five words is one
shingle.  Rows that repeat doc_id and text are one document, a null doc_id ranks last, ties
are broken by doc_id and text hash, texts of any length are taken whole, an empty table
gives an empty result, and further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import probminhash as pm
from weftline.llm.common import CHUNK_BYTES, freed, frugal, materialize, prepare, row_chunks, text_buffer

THRESHOLD = 0.8
BANDS, ROWS = 32, 6
DEEP_BANDS, DEEP_ROWS = 120, 16
ROUNDS = 3
#: Rows of (doc_id, hash), or of two nodes, that are broadcast to find their texts or shingles; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Keys of bands (8 bytes) that are broadcast to find their members.
BROADCAST_KEYS = 1_000_000
#: Links (32 bytes) whose components one task finds; those of more are found by passing labels.
ONE_TASK_LINKS = 250_000
BLANK = b" \t\n\x0b\x0c\r"


def _few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (a written table of numbers and ids), to be broadcast if there are no more than ``most``."""
    return F.broadcast(rows) if rows.count() <= most else rows


def text_hash(column: str = "text"):
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _listed(sign: np.ndarray, flat: np.ndarray, bands: int, some: np.ndarray) -> pa.Array:
    """Keys of the bands of weighted signatures, and of plain ones where those differ; none for texts not in ``some``."""
    keys, plain = pm.band_keys(sign, bands), pm.band_keys(flat, bands)
    own = np.concatenate([np.ones(keys.shape, bool), plain != keys], axis=1) & some[:, None]
    return _lists(np.concatenate([keys, plain], axis=1)[own], np.concatenate([[0], np.cumsum(own.sum(axis=1))]))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), node (128 bits of the words), keys of the bands."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_chunks(offsets):
                at = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                words, to = pm.word_hashes(part, at)
                raw = words.tobytes()
                node = [
                    hashlib.blake2b(raw[8 * a : 8 * b] if b > a else part[x:y].tobytes().translate(None, BLANK), digest_size=16, person=b"words" if b > a else b"none").digest()
                    for a, b, x, y in zip(to[:-1], to[1:], at[:-1], at[1:], strict=True)
                ]
                text, h, times = pm.counted(*pm.shingles(words, to))
                sign = pm.signatures(text, h, pm.weight(times), j - i, BANDS * ROWS)
                keys = _listed(sign, pm.plain_signatures(sign, text, h, times), BANDS, np.diff(to) > 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i), pa.array(node, pa.binary()), keys], ["doc_id", "th", "node", "keys"])

    rows = docs.select("doc_id", text_hash().alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, node binary, keys array<long>")


def shingled(texts: DataFrame) -> DataFrame:
    """node, its sorted distinct shingles and how often each stands there (null where all stand once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_chunks(offsets):
                text, h, times = pm.counted(*pm.shingles(*pm.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
                at = np.searchsorted(text, np.arange(j - i + 1))
                again = np.zeros(j - i, bool)
                again[text[times > 1]] = True
                counts = pa.array([times[a:b].astype(np.int32) if r else None for a, b, r in zip(at[:-1], at[1:], again, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), _lists(h.view(np.int64), at), counts], ["node", "h", "times"])

    return texts.select("node", "text").mapInArrow(frugal(run), "node binary, h array<long>, times array<int>")


def _row(column: pa.Array, i: int) -> np.ndarray:
    """The i-th list of a list column, without a copy."""
    a, b = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
    return column.values.slice(a, b - a).to_numpy(zero_copy_only=False)


def verified(pairs: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes whose shingles are similar enough."""

    def side(batch: pa.RecordBatch, name: str, i: int) -> tuple[np.ndarray, np.ndarray]:
        h = _row(batch.column(f"h_{name}"), i).view(np.uint64)
        counts = batch.column(f"times_{name}")
        return h, pm.weight(_row(counts, i)) if counts[i].is_valid else np.ones(len(h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([pm.similarity(side(batch, "a", i), side(batch, "b", i)) >= threshold for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    named = lambda x: features.select(F.col("node").alias(x), F.col("h").alias(f"h_{x}"), F.col("times").alias(f"times_{x}"))
    # Each side meets the pairs by itself, so only the shingles of pairs travel, on a key that no hot node shares.
    sent = _few(pairs)
    both = named("a").join(sent, "a").join(named("b").join(sent, "b"), ["a", "b"])
    return both.select("a", "b", "h_a", "times_a", "h_b", "times_b").mapInArrow(frugal(run), "a binary, b binary")


def _united(edges: DataFrame) -> DataFrame:
    """(comp, to): the smallest of each component, for all comps that edges (a, b) name; one task reads all edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list[bytes], list[bytes]] = ([], [])
        for batch in batches:
            for side, name in zip(sides, ("a", "b"), strict=True):
                side.append(b"".join(batch.column(name).to_pylist()))
        # Digests of 16 bytes: two numbers, in the order of Spark's binary.
        both = np.frombuffer(b"".join(sides[0] + sides[1]), ">u8").astype(np.uint64).view([("high", np.uint64), ("low", np.uint64)])
        names, at = np.unique(both, return_inverse=True)
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        top = np.arange(len(names))
        while (top[a] != top[b]).any():
            x, y = top[a], top[b]
            np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
            while (top[top] != top).any():
                top = top[top]
        raw = np.ascontiguousarray(names).view(np.uint64).astype(">u8").tobytes()
        own = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(names), [None, pa.py_buffer(raw)])
        for i in range(0, len(names), 10_000):
            part = top[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([own.slice(i, len(part)).cast(pa.binary()), own.take(pa.array(part)).cast(pa.binary())], ["comp", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(frugal(run), "comp binary, to binary")


def _passed(edges: DataFrame) -> DataFrame:
    """The rows of ``_united`` by passing labels, written after each step, so lost work is read again."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("comp"), F.least("a", "low").alias("to")), "labels")
    while True:
        # Least label among neighbours, then the label of that label.
        near = both.join(label.select(F.col("comp").alias("b"), F.col("to").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        new = label.join(near.withColumnRenamed("a", "comp"), "comp").select("comp", F.col("to").alias("old"), F.least("to", "other").alias("to"))
        hop = new.select(F.col("comp").alias("to"), F.col("to").alias("next"))
        new = materialize(new.join(hop, "to", "left").select("comp", "old", F.coalesce("next", "to").alias("to")), "labels")
        label = new.select("comp", "to")
        if new.filter("old != to").isEmpty():
            return label


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) with the smallest node of each connected component; nodes carry comp already,
    and edges lie between comps (a, b)."""
    edges = materialize(edges.select("a", "b").distinct(), "edges")
    n = edges.count()
    if not n:
        return nodes
    label = materialize(_united(edges), "labels") if n <= ONE_TASK_LINKS else _passed(edges)
    return materialize(nodes.join(label, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "components")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _toward_largest(members: DataFrame, comps: DataFrame, turn: int) -> DataFrame:
    """A pair for each node at most: with the leader of the largest other component that most of its buckets name."""
    here = members.join(comps, "node")
    draw = lambda c: F.xxhash64(c, F.lit(turn))
    parts = here.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", draw("node")).alias("lead"))
    largest = parts.groupBy("key").agg(F.max_by(F.struct("comp", "lead"), F.struct("n", draw("comp"))).alias("top"), F.count(F.lit(1)).alias("parts"))
    leads = materialize(largest.filter("parts > 1").select("key", F.col("top.comp").alias("lead_comp"), F.col("top.lead").alias("other")), "leads")
    votes = here.join(leads, "key").filter("comp != lead_comp").groupBy("node", "other").agg(F.count(F.lit(1)).alias("votes"))
    return _ordered(votes.groupBy("node").agg(F.max_by("other", F.struct("votes", draw("other"))).alias("other")))


def deep_signed(features: DataFrame) -> DataFrame:
    """node, keys of the longer signatures' bands, and a bit of each register: sketch, and plain where it differs."""

    def bits(sign: np.ndarray) -> np.ndarray:
        return np.packbits(pm.sketch_bits(sign), axis=1).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("h").offsets.to_numpy().astype(np.int64)
            counts = batch.column("times")
            for i, j in row_chunks(8 * (at - at[0]), CHUNK_BYTES // 4):
                h = batch.column("h").values.slice(at[i], at[j] - at[i]).to_numpy(zero_copy_only=False).view(np.uint64)
                text = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                times = np.concatenate([_row(counts, k) if counts[k].is_valid else np.ones(at[k + 1] - at[k], np.int32) for k in range(i, j)])
                sign = pm.signatures(text, h, pm.weight(times), j - i, DEEP_BANDS * DEEP_ROWS)
                plain = pm.plain_signatures(sign, text, h, times)
                sketch, flat = bits(sign), bits(plain)
                width = sketch.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").slice(i, j - i),
                        _listed(sign, plain, DEEP_BANDS, np.ones(j - i, bool)),
                        _lists(sketch.ravel(), np.arange(0, (j - i + 1) * width, width)),
                        pa.array([None if (x == y).all() else y for x, y in zip(sketch, flat, strict=True)], pa.list_(pa.int64())),
                    ],
                    ["node", "keys", "sketch", "plain"],
                )

    return features.select("node", "h", "times").mapInArrow(frugal(run), "node binary, keys array<long>, sketch array<long>, plain array<long>")


def _mixed(members: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets that hold several components (key, big: the largest of them, others: members of the rest),
    and the members (key, node, comp) of those buckets."""
    here = members.join(comps, "node")
    parts = here.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    keys = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("big"), (F.sum("n") - F.max("n")).alias("others"))
    keys = materialize(keys.filter("others > 0"), "mixed")
    return keys, materialize(here.join(keys.select("key"), "key").select("key", "node", "comp"), "members")


def _leaders(keys: DataFrame, here: DataFrame, turn: int) -> DataFrame:
    """About 2 ** turn members of each bucket that are not of its largest component, drawn by hash, and always one."""
    draw = F.xxhash64("node", F.lit(turn))
    rest = here.join(keys, "key").filter("comp != big")
    one = rest.groupBy("key").agg(F.max_by("node", draw).alias("node"))
    more = rest.filter(F.pmod(draw, F.greatest(F.lit(1), F.floor(F.col("others") / 2**turn))) == 0).select("key", "node")
    return one.unionByName(more).distinct()


def _may_link(threshold: float) -> Column:
    """Whether two sketches (sketch and plain, of a node and of its leader) allow the similarity."""
    n, p = DEEP_BANDS * DEEP_ROWS, (1 - threshold) / 2
    most = int(n * p + 4.5 * (n * p * (1 - p)) ** 0.5)

    def differ(x: Column, y: Column) -> Column:
        return sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(n // 64)), F.lit(0))

    weighted, plain = F.col("sketch"), F.coalesce("plain", "sketch")
    return (differ(weighted, F.col("lead_sketch")) <= most) | (differ(plain, F.coalesce("lead_plain", "lead_sketch")) <= most)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each (doc_id, th): class_id (smallest doc_id of its class), class_size, kept, repeats.

    ``kept`` holds for one (doc_id, th) of each class; ``repeats`` counts equal rows.
    """
    rows = materialize(signed(docs), "signatures")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    nodes = materialize(rows.groupBy("node").agg(F.min(least).alias("rep"), F.first("keys").alias("keys")), "nodes")
    exploded = nodes.select("node", F.explode("keys").alias("key"))
    shared = materialize(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared")
    members = materialize(exploded.join(_few(shared, BROADCAST_KEYS), "key"), "members")

    near = nodes.join(members.select("node").distinct(), "node")
    wanted = materialize(near.select("node", F.col("rep.doc_id").alias("id"), F.col("rep.th").alias("wanted_th")), "wanted")
    side = _few(wanted)
    source = docs.select("doc_id", text_hash().alias("th"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = source.join(side, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("wanted_th"))).select("node", "text")
    features = materialize(shingled(texts), "shingles")
    if features.count() > wanted.count():  # rows that repeat doc_id and text: one row of a node is enough
        features = materialize(features.dropDuplicates(["node"]), "shingles")

    comps = _few(materialize(wanted.select("node", F.col("node").alias("comp")), "components"))
    done: DataFrame | None = None

    def compared(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """Components after links among ``pairs`` that were not compared before."""
        nonlocal done
        pairs = materialize(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return comps
        done = pairs if done is None else done.unionByName(pairs)
        links = verified(pairs, features, threshold)
        a = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        b = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        return _few(components(comps, links.join(a, "a").join(b, "b").filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))

    for turn in range(ROUNDS):
        comps = compared(_toward_largest(members, comps, turn), comps)
        freed(docs.sparkSession)

    rest = materialize(_mixed(members, comps)[1].select("node").distinct(), "rest")
    deep = materialize(deep_signed(features.join(_few(rest), "node", "left_semi")), "deep")
    sketch = deep.select("node", "sketch", "plain")
    lead_sketch = deep.select(F.col("node").alias("lead"), F.col("sketch").alias("lead_sketch"), F.col("plain").alias("lead_plain"))
    exploded = deep.select("node", F.explode("keys").alias("key"))
    again = materialize(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared")
    live = materialize(exploded.join(_few(again, BROADCAST_KEYS), "key"), "members")
    turn = 0
    while True:
        keys, here = _mixed(live, comps)
        if keys.isEmpty():
            break
        lead = materialize(_leaders(keys, here, turn), "leaders")
        leading = lead.join(comps, "node").select("key", F.col("node").alias("lead"), F.col("comp").alias("lead_comp"))
        met = here.join(sketch, "node").join(leading.join(lead_sketch, "lead"), "key").filter((F.col("comp") != F.col("lead_comp")) & _may_link(threshold))
        comps = compared(_ordered(met.select("node", F.col("lead").alias("other"))), comps)
        live = here.select("key", "node").join(lead, ["key", "node"], "left_anti")
        freed(docs.sparkSession)
        turn += 1

    placed = rows.select("doc_id", "th", "node").join(comps, "node", "left").select("doc_id", "th", F.coalesce("comp", "node").alias("comp"))
    one = materialize(placed.groupBy("doc_id", "th").agg(F.first("comp").alias("comp"), F.count(F.lit(1)).alias("repeats")), "placed")
    # Written first: the join below then has an exchange of its own, whose hot classes Spark splits.
    size = materialize(one.groupBy("comp").agg(F.min(least).alias("rep"), F.sum("repeats").alias("size")).filter("size > 1"), "sizes")
    alone = F.col("rep").isNull()
    return one.join(size, "comp", "left").select(
        "doc_id",
        "th",
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"),
        F.when(alone, F.col("repeats")).otherwise(F.col("size")).alias("class_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("th") == F.col("rep.th")))).alias("kept"),
        "repeats",
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, its smallest doc_id."""
    tag = "_" * (1 + max(map(len, docs.columns)))  # no column of docs begins with it
    found = materialize(classes(docs, threshold), "classes")

    def rows_of(condition: str) -> DataFrame:
        side = materialize(found.filter(condition).select(F.col("doc_id").alias(f"{tag}id"), F.col("th").alias(f"{tag}th")), "named")
        return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side

    keyed = docs.withColumn(f"{tag}hash", text_hash())
    same = F.col("doc_id").eqNullSafe(F.col(f"{tag}id")) & (F.col(f"{tag}hash") == F.col(f"{tag}th"))
    left = keyed.join(rows_of("NOT kept"), same, "left_anti")
    if found.filter("kept AND repeats > 1").isEmpty():
        return left.drop(f"{tag}hash")
    again = rows_of("kept AND repeats > 1")
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", f"{tag}hash"])
    return left.join(again, same, "left_anti").unionByName(once).drop(f"{tag}hash")
