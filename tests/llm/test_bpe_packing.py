import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import bpe, packing
from weftline.llm.common import text_buffer

PATH = public_tokenizers.path("byte_bpe_50k.json")
REAL = Tokenizer.from_file(PATH)
PIECES = ["a", "e", "s", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "23", "é", "ß", "!", "...", "<|endoftext|>", "\xa0", "中", "½", "×", "“", "don't", "́", "😀", "%%%", "\x1c", "'VE", "'ve", "aaaa", "the", " th"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=40).map("".join), min_size=1, max_size=8))
def test_same_ids_as_the_library(texts):
    c = bpe.codec(PATH)
    data, offsets = text_buffer(pa.array(texts))
    ids, at = c.encode(data, offsets)
    for k, t in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        real = REAL.encode(t, add_special_tokens=False).ids
        assert own.tolist() == real
        assert c.decode(own).decode() == REAL.decode(real, skip_special_tokens=False)


def test_exact_merges_and_long_words():
    c = bpe.codec(PATH)
    words = [b"th" * 50, b"a", b" " * 300, b"thereintionhe" * 9]
    assert c.exact(words) == [REAL.encode(w.decode(), add_special_tokens=False).ids for w in words]
    long = ("x1y2 " * 700_000 + "zz" * 10) + "\n"
    data, offsets = text_buffer(pa.array([long, "tail"]))
    ids, at = c.encode(data, offsets)
    assert ids[at[0] : at[1]].tolist() == REAL.encode(long, add_special_tokens=False).ids and at[2] - at[1] == 1


def test_memory_of_words_is_bounded():
    c = bpe.Codec(PATH)
    c.CACHE_WORDS = 50
    rng = random.Random(1)
    for _ in range(5):
        t = " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(40))
        data, offsets = text_buffer(pa.array([t]))
        assert c.encode(data, offsets)[0].tolist() == REAL.encode(t, add_special_tokens=False).ids
        assert c.known <= 100


def test_a_clash_of_hashes_is_noticed(monkeypatch):
    c = bpe.Codec(PATH)
    monkeypatch.setattr(bpe, "hashes", lambda data, start, size: np.full(len(start), 7, np.uint64))
    t = "several different words"
    data, offsets = text_buffer(pa.array([t]))
    assert c.encode(data, offsets)[0].tolist() == REAL.encode(t, add_special_tokens=False).ids


def test_digests(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "x")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_tokens string")
    got = bpe.digests(docs).collect()
    assert len(got) == 5 and bpe.digests(docs.limit(0)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got if r["doc_id"] in (2, 3)} == {(0, empty, empty)}
    assert [r["decoded"] for r in bpe.tokens(docs).filter("doc_id = 1").collect()] == ["a b"] * 2


@pytest.mark.parametrize("window", [500, 10**9])
def test_pieces_tile_documents_and_sequences(spark, window):
    rng = random.Random(5)
    texts = ["", None, *("word " * rng.choice([1, 7, 40, 300, 2047, 2048, 5000]) for _ in range(60))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(3)
    rows = packing.pack(docs, window=window).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*REAL.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert zlib.crc32(ids[r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        padding += 2048 - at if at & (at - 1) else 0
    assert padding == 0


def test_column_generation_is_near_the_bound():
    rng = np.random.default_rng(2)
    demand = rng.integers(0, 60, 128).astype(float)
    plan = packing.patterns(demand, 128)
    met = sum(u * c for u, c in plan)
    assert (met >= demand - 1e-6).all() and all((np.arange(1, 129) * c).sum() <= 128 for _, c in plan)
    bound = (np.arange(1, 129) * demand).sum() / 128
    assert sum(u for u, _ in plan) <= max(bound, demand[64:].sum()) * 1.02 + 1


def test_knapsack_against_trial():
    value = np.array([0.2, 0.5, 0.55, 1.2])
    best, taken = packing.knapsack(value, 7)
    trial = max(a * 0.2 + b * 0.5 + c * 0.55 + d * 1.2 for a in range(8) for b in range(4) for c in range(3) for d in range(2) if a + 2 * b + 3 * c + 4 * d <= 7)
    assert best == pytest.approx(trial) and (taken * value).sum() == pytest.approx(trial)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).count() == 0


def whole_documents(plan, length):
    packer = packing.Packer(plan, int((length % packing.CAPACITY > 0).sum()), packing.CAPACITY, packing.UNIT)
    pieces = packer.window(np.arange(len(length)), length, True)
    own = np.bincount([p[0] for p in pieces], minlength=len(length))
    least = -(-length // packing.CAPACITY)
    return int((own == least).sum()), len({p[3] for p in pieces}), len(pieces)


def test_column_generation_leaves_documents_whole():
    rng = np.random.default_rng(5)
    length = np.maximum(1, rng.lognormal(6, 1, 5000)).astype(np.int64)
    size = np.bincount(-(-(length % packing.CAPACITY) // packing.UNIT), minlength=packing.CAPACITY // packing.UNIT + 1)[1:].astype(float)
    plan = packing.patterns(size, packing.CAPACITY // packing.UNIT)
    kept, sequences, pieces = whole_documents(plan, length)
    bare, bare_sequences, bare_pieces = whole_documents([], length)
    print("whole", kept, bare, "pieces", pieces, bare_pieces, "sequences", sequences, bare_sequences)
    assert sequences == bare_sequences and kept > 0.95 * len(length) and (len(length) - kept) < 0.5 * (len(length) - bare)


def test_characters_that_only_newer_tables_know():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    c = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    for cp in (0x378, 0x558, 0x88F, 0xE000, 0x10940, 0x11DE0, 0x313B0, 0x3D000, 0x3FFFF, 0x1F6DC):
        for t in (f"{chr(cp)}'s", f"a{chr(cp)}'s {chr(cp)}1 {chr(cp)}!", f"{chr(cp)}{chr(cp)} x"):
            data = np.frombuffer(t.encode(), np.uint8)
            assert c.encode(data, np.array([0, len(data)]))[0].tolist() == whole.encode(t, add_special_tokens=False).ids, ascii(t)
