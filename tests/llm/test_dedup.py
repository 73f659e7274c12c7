import hashlib
import itertools
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import exactdedup, linededup, neardup
from weftline.llm import probminhash as pm

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, n int, line_dedup string, keep_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)


EXACT = [(5, "a b"), (3, "ab"), (9, "a  b"), (7, "A b"), (1, None), (2, " \n\t"), (4, ""), (8, "a\xa0b"), (3, "ab"), (None, "zz"), (None, "q"), (11, "q")]


def exact_by_hand(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, k, i))
    out = []
    for norm, own in groups.items():
        keep = min(own)
        out += [(o[4], keep[4], len(own), norm) for o in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    # A weak digest stands for several texts, so whole bytes must tell them apart.
    digest = (lambda norm: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(norm), F.lit(2))), 2, "0"))) if weak else exactdedup.sha
    got = exactdedup.dedup(docs_of(spark, EXACT), digest=digest).collect()
    want = exact_by_hand(EXACT)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"]) for r in got], key=str) == sorted([w[:3] for w in want], key=str)
    assert sum(r["kept"] for r in got) == len({w[3] for w in want})
    if not weak:
        assert {bytes(r["digest"]).hex() for r in got} == {hashlib.sha256(w[3].encode()).hexdigest() for w in want}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_state_goes_on_across_calls(spark, tmp_path, weak):
    assert exactdedup.dedup(docs_of(spark, [])).count() == 0
    digest = (lambda norm: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(norm), F.lit(2))), 2, "0"))) if weak else exactdedup.sha
    state, seen = f"file://{tmp_path}/state", []
    for part in (EXACT[:5], EXACT[5:9], [], EXACT[9:]):
        got = exactdedup.dedup(docs_of(spark, part), state, digest).collect()
        seen += part
        want = {(w[0], w[3]): (w[1], w[2]) for w in exact_by_hand(seen)}
        norm = {i: re.sub(r"[\x20\x09-\x0D]+", "", t or "") for i, t in part if i is not None}
        assert len(got) == len(part)
        for r in got:
            if r["doc_id"] is not None:
                assert (r["keep_id"], r["group_size"]) == want[r["doc_id"], norm[r["doc_id"]]], r


def lines_by_hand(rows):
    first = {}
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            first.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= 10 and len(first[key(x)]) >= 2 and i != min(first[key(x)]))]
        out[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def test_lines(spark):
    rng = random.Random(4)
    pool = ["short", "a common line here", "  A Common Line HERE\t", "ÉCOLE DES LIGNES", "école des lignes", "École des Lignes", "unique", "", "K" * 10, "K" * 10, "exactly10c", "exact_9ch"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 8)))) for i in range(40)] + [(100, None), (101, ""), (102, "\n" * 5000 + "a common line here")]
    got = linededup.dedup(docs_of(spark, rows), result="found").select("doc_id", "found.*").collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got} == lines_by_hand(rows)
    assert linededup.dedup(docs_of(spark, [])).count() == 0
    again = [(1, "a common line here"), (1, "a common line here"), (None, "a common line here")]
    assert sorted((str(r["doc_id"]), r["kept_text"]) for r in linededup.dedup(docs_of(spark, again), result="found").select("doc_id", "found.kept_text").collect()) == [("1", "a common line here")] * 2 + [("None", "")]


def test_lines_with_text_ids_and_without_broadcast(spark, monkeypatch):
    rows = [("b", "a common line here\nown of b, and long"), ("a", "A COMMON line here"), (None, "a common line here\nshort"), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    want = {"b": "own of b, and long", "a": "A COMMON line here", None: "short", "c": ""}
    for most in (2_000_000, 0):
        monkeypatch.setattr(linededup, "MARKED_ROWS", most)
        assert {r["doc_id"]: r["line_dedup"]["kept_text"] for r in linededup.dedup(docs).collect()} == want


def shingled(t):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes_by_hand(rows):
    sets = [shingled(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b):
            top[max(root(i), root(j))] = min(root(i), root(j))
    for i in range(len(rows)):  # without words: equal but for white space
        for j in range(i):
            if not sets[i] and not sets[j] and "".join((rows[i][1] or "").split()) == "".join((rows[j][1] or "").split()):
                top[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) for i in range(len(rows))}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    base = [rng.choices(words, k=rng.randint(60, 150)) for _ in range(12)]
    rows = []
    for n in range(150):
        w = list(base[n % 12])
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((n, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "few words"), (1004, "Few, words!"), (1005, "w " * 20_000)]
    docs = docs_of(spark, rows)
    got = neardup.classes(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes_by_hand(rows)
    kept = neardup.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({v for v in classes_by_hand(rows).values()})
    assert kept.columns == docs.columns


def test_sketches_keep_short_pairs_at_the_threshold(spark):
    rng = random.Random(7)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]
    rows = []
    for i in range(400):
        w = words(9)
        rows += [(b"a%d" % i, " ".join(w)), (b"b%d" % i, " ".join(w[:8]))]  # 5 shingles, 4 of them
    deep = neardup.deep_signed(neardup.shingled(spark.createDataFrame(rows, "node binary, text string")))
    got = {bytes(r["node"]): r for r in deep.collect()}
    pairs = [(got[b"a%d" % i], got[b"b%d" % i]) for i in range(400)]
    n = neardup.DEEP_BANDS * neardup.DEEP_ROWS
    assert max(sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a["sketch"], b["sketch"], strict=True)) for a, b in pairs) <= n * 0.1 + 4.5 * (n * 0.09) ** 0.5
    assert sum(bool(set(a["keys"]) & set(b["keys"])) for a, b in pairs) >= 0.9 * 400  # at the threshold itself


def test_equal_shingles_repeated_differently(spark):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        w = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(120)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:40] * 30 + w))]
    want = classes_by_hand(rows)
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs_of(spark, rows)).collect()} == want
    assert sum(v != k for k, v in want.items()) == 40


def test_many_variants_of_one_text(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    base, rows = rng.choices(words, k=100), []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs_of(spark, rows)).collect()} == classes_by_hand(rows)


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables are not here")
def test_components_in_one_task_and_by_labels(spark, monkeypatch):
    rng = random.Random(8)
    name = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(400)]
    name[:3] = [bytes(16), b"\xff" * 16, b"\x80" + bytes(15)]  # digests are ordered by unsigned bytes
    pairs = [(i, i + 1) for i in range(60)] + [(0, i) for i in range(100, 160)] + [(rng.randrange(160, 400), rng.randrange(160, 400)) for _ in range(120)]
    pairs = [(name[a], name[b]) for a, b in pairs if a != b]
    top = {x: x for x in name}
    for _ in name:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    nodes = spark.createDataFrame([(x, x) for x in name], "node binary, comp binary")
    edges = spark.createDataFrame(pairs, "a binary, b binary")
    ran = []
    written = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, tag: ran.append(tag) or written(df, tag))
    for most, steps in ((len(pairs), 1), (0, 3)):
        monkeypatch.setattr(neardup, "ONE_TASK_LINKS", most)
        ran.clear()
        assert {bytes(r["node"]): bytes(r["comp"]) for r in neardup.components(nodes, edges).collect()} == top
        assert ran.count("labels") == 1 if steps == 1 else ran.count("labels") >= steps  # few links take one query, not one a step
    assert neardup.components(nodes, edges.limit(0)).filter("node != comp").isEmpty()


def test_recall_on_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    holders, sets = {}, [shingled(t) for _, t in rows]
    for n, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(n)
    shared = Counter()
    for own in holders.values():
        shared.update(itertools.combinations(own, 2))
    links = [(i, j) for (i, j), c in shared.items() if c >= 0.8 * (len(sets[i]) + len(sets[j]) - c)]
    of = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs_of(spark, rows)).collect()}
    found = sum(of[rows[i][0]] == of[rows[j][0]] for i, j in links)
    print("links", len(links), "found", found)
    assert len(links) > 50 and found >= 0.99 * len(links)


def test_copies_that_repeat_a_passage(spark):
    rng = random.Random(9)
    rows = []
    for i in range(8):
        w = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(160)]
        x = w[:50] * 400 + w[50:]
        for k in (60, 100, 140):  # each change takes five shingles
            x[-k // 2] = "changed"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(x))]
    want = classes_by_hand(rows)
    assert want == {i: i // 2 * 2 for i in range(16)}
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs_of(spark, rows)).collect()} == want


def test_repeated_rows_and_empty_tables(spark):
    docs = docs_of(spark, [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, "other words that stand alone here")])
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(docs).collect() if r["doc_id"]) == [(1, 1, 3), (2, 2, 1)]
    assert sorted(r["doc_id"] for r in neardup.keep_one(docs).collect()) == [1, 2]
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = {int(x): float(w) for x, w in zip(range(60), rng.uniform(1, 3, 60), strict=True)}, {int(x): float(w) for x, w in zip(range(20, 90), rng.uniform(1, 3, 70), strict=True)}
    exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    pack = lambda m: (np.array(sorted(m), np.uint64), np.array([m[k] for k in sorted(m)]))
    (ha, wa), (hb, wb) = pack(a), pack(b)
    _, ia, ib = np.intersect1d(ha, hb, return_indices=True)
    assert pm.probability_jaccard(wa, wb, ia, ib) == pytest.approx(exact)
    sign = pm.signatures(np.repeat([0, 1], [len(ha), len(hb)]), np.concatenate([ha, hb]), np.concatenate([wa, wb]), 2, 8192)
    assert abs((sign[0] == sign[1]).mean() - exact) < 0.03
