"""Media columns: payloads stored as lossless WebP, read back into pixel arrays and features.

A text's UTF-8 bytes, filled up with 255 to a positive multiple of 576, become a row of
WebP files of at most ``webp.TILE`` bytes each, one after the other.  Reading takes the
files apart again; features are computed from the pixels that were read.

Null and empty texts are one block of filling.  Equal texts give equal files.  Rows that
repeat are stored each; further columns are ignored; an empty table gives an empty result.
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

from weftline.llm import webp
from weftline.llm.common import frugal, prepare, row_chunks, text_buffer

#: Bytes of payload that are written or read in step.
STEP = 2 << 20


def filled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads one after the other, and their bounds."""
    n = np.diff(offsets)
    size = np.maximum(-(-n // webp.UNIT), 1) * webp.UNIT
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(at[-1], 255, np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], n)] = data
    return out, at


def tiles(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the tiles of all payloads, and the number of tiles of each."""
    size = np.diff(bounds)
    n = -(-size // webp.TILE)
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return np.append(bounds[of] + k * webp.TILE, bounds[-1]), n


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (before filling) and media (the files)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = webp.Writer()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in row_chunks(offsets, STEP):
                payload, at = filled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                bounds, n = tiles(at)
                files: list[bytes] = []
                for a, b in row_chunks(bounds, STEP):
                    files += writer.write(payload[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                ends = np.cumsum(n)
                media = [b"".join(files[e - k : e]) for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets[i : j + 1]), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def split(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + size])
        at += size
    return out


def loaded(reader: webp.Batch, media: list[bytes]) -> Iterator[np.ndarray]:
    """The sample array of each of the stored rows, about STEP bytes of files at a time."""
    i = 0
    while i < len(media):
        files, owner, size = [], [], 0
        j = i
        while j < len(media) and (j == i or size + len(media[j]) <= STEP):
            own = split(media[j])
            files += own
            owner.append(len(own))
            size += len(media[j])
            j += 1
        arrays: list[np.ndarray] = []
        for a in range(0, len(files), 4096):
            arrays += [webp.samples(p) for p in reader.decode(files[a : a + 4096])]
        at = 0
        for n in owner:
            yield arrays[at] if n == 1 else np.concatenate(arrays[at : at + n])
            at += n
        i = j


def feature(samples: np.ndarray) -> str:
    """Size, mean and spread of the samples, a 16-bin histogram (of 255) and a 64-bit average hash."""
    cells = np.add.reduceat(samples, np.arange(64) * len(samples) // 64, dtype=np.int64) / np.diff(np.append(np.arange(64) * len(samples) // 64, len(samples)))
    bits = int.from_bytes(np.packbits(cells > samples.mean(dtype=np.float64)).tobytes(), "big")
    bins = np.bincount(samples >> 4, minlength=16) * 255 // len(samples)
    return f"{len(samples)}:{samples.mean(dtype=np.float64):.4f}:{samples.std(dtype=np.float64):.4f}:{bins.astype(np.uint8).tobytes().hex()}:{bits:016x}"


def measured(rows: DataFrame) -> DataFrame:
    """Reads ``media`` back: digests and features of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = webp.Batch()
        for batch in batches:
            media = batch.column("media").to_pylist()
            found = []
            for m, s in zip(media, loaded(reader, media), strict=True):
                raw = s.tobytes()
                found.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(s)))
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", *NAMES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
