"""Toxicity from a lexicon, read through Levenshtein automata, and the context of each hit.

The lexicon is a short fixed list and terms learned from labels: whole words, and stems
that begin many different words.  A greedy cover picks terms that reach toxic texts
which no earlier term reaches, so words that merely share a copied toxic text are not
taken.  The terms form a trie.  Each distinct word's automaton (the states of its edit
distances) runs down that trie, and finds the terms it misspells.  A hit counts less
inside quotation marks or after words of reporting, more beside an address.  Weights are
smoothed log odds of the training texts.

Learning reads a sample of labelled rows of bounded expected size.  The lexicon ends where
no term reaches two more toxic texts of it.  Terms of four letters, stems, and words of
fewer than four letters are met without edits.  A text that is labelled both ways counts
as toxic.  Null and empty texts get the score of a text without hits; texts of any length
are read whole, a quotation ends at a line's end at the latest.  Without any label the
fixed list has its prior weight.  Rows that repeat are scored alike, ties among terms are
broken by name, an empty table gives an empty result, and further columns are kept or
ignored whatever they are called.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import frugal, materialize, prepare

THRESHOLD = 0.7
#: Expected labelled texts that the model learns from, at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 4500
STEM = range(4, 9)
WINDOW = 6
WORDS_KEPT = 150_000

# Terms known before any label is read.
SEED = "idiot moron imbecile stupid dumbass loser scum trash pathetic worthless disgusting vermin scumbag bastard asshole retard bitch whore slut cretin degenerate subhuman".split()
# Words that report another's speech, and words that address somebody.
REPORTS = set("said says say wrote writes called calls quote quoted quotes quoting word words term terms slur insult defined means meaning dit disait écrit mot sagte schrieb nannte wort dijo escribió llamó palabra".split())
ADDRESS = set("you your youre yourself u ur tu toi vous du dich dir ihr eres usted ustedes".split())
# Marks that open a quotation, and those that close it.
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“", "‹": "›"}

# Odd multipliers of a text's minima.
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233, 1181783497, 1500450271)

_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile("|".join(f"{re.escape(a)}[^{re.escape(a + b)}\\n]+{re.escape(b)}" for a, b in QUOTES.items()))


class Trie:
    """Terms by letters; a stem is a term that ends in ``*``."""

    def __init__(self, terms: list[str]) -> None:
        self.whole = frozenset(terms)
        self.stem_lengths = sorted({len(t) - 1 for t in terms if t.endswith("*")}, reverse=True)
        self._pieces(terms)
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in terms:
            if t.endswith("*"):  # stems are met by their first letters, without edits
                continue
            node = 0
            for c in t:
                at = self.next[node].get(c)
                if at is None:
                    at = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                node = at
            self.term[node] = t

    @staticmethod
    def reach(length: int) -> int:
        """Edits that a word of so many letters is forgiven."""
        return 0 if length < 5 else 1 if length < 9 else 2  # never less for a longer word

    def _pieces(self, terms: list[str]) -> None:
        """Parts of terms, one of which stands unharmed in any word within reach: of ``edits + 1`` parts,
        the first at the word's start, the last at its end, one between them near its place."""
        self.heads: set[tuple[str, int]] = set()
        self.tails: set[tuple[str, int]] = set()
        self.middles: set[tuple[str, int, int]] = set()
        for t in terms:
            k = self.reach(len(t))
            if t.endswith("*") or not k:
                continue
            cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
            for n in range(len(t) - k, len(t) + k + 1):
                self.heads.add((t[: cuts[1]], n))
                self.tails.add((t[cuts[k] :], n))
                for i in range(1, k):
                    for shift in range(-k, k + 1):
                        if cuts[i] + shift >= 0:
                            self.middles.add((t[cuts[i] : cuts[i + 1]], cuts[i] + shift, n))
        self.head_lengths = sorted({len(h) for h, _ in self.heads})
        self.tail_lengths = sorted({len(h) for h, _ in self.tails})
        self.middle_places = sorted({(len(m), at, n) for m, at, n in self.middles})
        self.lengths = {n for _, n in self.heads}
        self.middle_at: dict[int, list[tuple[int, int]]] = {}
        for size, at, n in self.middle_places:
            self.middle_at.setdefault(n, []).append((size, at))

    def _may_be_near(self, word: str) -> bool:
        n = len(word)
        if n not in self.lengths:
            return False
        for k in self.head_lengths:
            if (word[:k], n) in self.heads:
                return True
        for k in self.tail_lengths:
            if (word[-k:], n) in self.tails:
                return True
        return any((word[at : at + size], at, n) in self.middles for size, at in self.middle_at.get(n, ()))

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term, and its distance: the word itself or a stem first, else by least edits."""
        if word in self.whole:
            return word, 0
        for n in self.stem_lengths:
            if (stem := word[:n] + "*") in self.whole and len(word) > n:
                return stem, 0
        most = self.reach(len(word))
        if not most or not self._may_be_near(word):
            return None
        # The automaton of the word: state i, with the edits spent to have read i of its letters.
        found, least = None, most + 1
        stack = [(0, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            t = self.term[node]
            if t and row[-1] < least and row[-1] <= self.reach(len(t)):
                found, least = t, row[-1]
            for c, child in self.next[node].items():
                new = [row[0] + 1]
                for i, x in enumerate(word):
                    new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != c)))
                if min(new) <= min(most, least - 1):
                    stack.append((child, new))
        return (found, least) if found else None


def stems(word: str) -> Iterator[str]:
    yield word
    for n in STEM:
        if n < len(word):
            yield word[:n] + "*"


class Scorer:
    def __init__(self, weights: dict[str, float], misspelt: dict[str, float], bias: float, silent: float) -> None:
        self.weights, self.misspelt, self.bias, self.silent = weights, misspelt, bias, silent
        self.trie = Trie(sorted(weights))
        self.memory: dict[str, tuple[str, int] | None] = {}

    def hits(self, words: set[str]) -> dict[str, tuple[str, int]]:
        memory, found = self.memory, {}
        if len(memory) > WORDS_KEPT:
            memory.clear()
        for w in words:
            if w in memory:
                h = memory[w]
            elif len(w) < 4:
                continue
            else:
                h = memory[w] = self.trie.find(w)
            if h:
                found[w] = h
        return found

    def score(self, text: str) -> tuple[float, list[str]]:
        """The score, and the terms that were hit."""
        low = text.lower()
        found = self.hits(set(_WORD.findall(low)))
        if not found:
            return sigmoid(self.silent), []
        return self._in_context(low, found)

    def _in_context(self, low: str, found: dict[str, tuple[str, int]]) -> tuple[float, list[str]]:
        quoted = [m.span() for m in _QUOTED.finditer(low)]
        words = [(m.group(), m.start()) for m in _WORD.finditer(low)]
        best: dict[str, float] = {}
        q = 0
        for k, (w, at) in enumerate(words):
            if w not in found:
                continue
            term, edits = found[w]
            weight = self.weights[term] if not edits else self.misspelt.get(term, 0.0)
            while q < len(quoted) and quoted[q][1] <= at:
                q += 1
            around = {x for x, _ in words[max(0, k - WINDOW) : k + WINDOW + 1]}
            before = {x for x, _ in words[max(0, k - WINDOW) : k]}
            factor = 1.0
            if q < len(quoted) and quoted[q][0] <= at:
                factor *= 0.3
            if before & REPORTS:
                factor *= 0.5
            if around & ADDRESS:
                factor *= 1.3
            best[term] = max(best.get(term, -99.0), weight * factor)
        return sigmoid(max(self.silent, self.bias + sum(best.values()))), sorted(best)


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def cover(hits: list[set[str]], toxic: Counter, clean: Counter, clean_size: int) -> list[str]:
    """Terms chosen one by one for the toxic texts that they reach first."""
    where: dict[str, set[int]] = {}
    for i, own in enumerate(hits):
        for t in own:
            where.setdefault(t, set()).add(i)
    least = max(2, len(hits) // 400)
    chosen: list[str] = []
    gain = {t: len(s) for t, s in where.items()}
    while gain:
        # Among equals a whole word, then the longest stem.
        t = max(gain, key=lambda x: (gain[x] - 3 * clean[x] * len(hits) / max(clean_size, 1), toxic[x], not x.endswith("*"), len(x), x))
        if gain[t] < least:
            break
        chosen.append(t)
        for i in list(where[t]):
            for other in hits[i]:
                if other in gain:
                    gain[other] -= 1
            hits[i] = set()
        for other in [x for x, n in gain.items() if n < least]:
            del gain[other]
    # Terms that stand beside chosen ones, in too many toxic texts to do so by chance.
    often = max(5, len(hits) // 50)
    for t in sorted(where, key=lambda x: (-len(where[x]), x.endswith("*"), -len(x), x)):
        if len(where[t]) < often:
            break
        if t.endswith("*"):  # the longest stem that reaches nearly the same texts
            t = max((c for c in where if c.endswith("*") and c.startswith(t[:-1]) and len(where[c]) >= 0.97 * len(where[t])), key=lambda c: (len(c), c))
        bare = t.rstrip("*")
        told = any(bare.startswith(c[:-1]) if c.endswith("*") else c == t for c in chosen) or (t != bare and any(c.startswith(bare) for c in chosen))
        if not told and len(where[t]) * max(clean_size, 1) >= 20 * clean[t] * len(hits):
            chosen.append(t)
    return chosen


def copies(signs: list[list[int]]) -> list[int]:
    """A group number for each text: texts that share two neighbouring minima are copies."""
    top = list(range(len(signs)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    seen: dict[tuple, int] = {}
    for i, own in enumerate(signs):
        for k in range(0, len(own) - 1, 2):
            j = seen.setdefault((k, own[k], own[k + 1]), i)
            a, b = root(i), root(j)
            top[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(signs))]


def sample_rows(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Texts and labels of about ``toxic`` and ``clean`` rows, chosen by a hash of doc_id."""
    labels = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity sample"), "_id"), F.lit(1_000_003)) / F.lit(1_000_003)
    share = F.when(F.col("toxic") == 1, min(1.0, toxic / sizes.get(1, 1))).otherwise(min(1.0, clean / sizes.get(0, 1)))
    # The side that is broadcast has about toxic + clean rows at any size.
    chosen = F.broadcast(labels.filter(draw < share))
    joined = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("_id")).select("text", "toxic")
    return materialize(joined.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")


def learn(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Scorer:
    prepare(docs.sparkSession)
    sample = sample_rows(docs, labels, toxic, clean)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1: Counter = Counter()
        c0: Counter = Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {s for w in set(_WORD.findall(text.lower())) if len(w) >= 4 for s in stems(w)}
                (c1 if label else c0).update(own)
        keys = list(c1 | c0)
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([c1[k] for k in part], pa.int64()), pa.array([c0[k] for k in part], pa.int64())], ["term", "n1", "n0"])

    counted = sample.mapInArrow(frugal(features), "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # Far likelier in toxic texts: words and stems of the sample's toxic texts, so no more than those have.
    likely = counted.filter((F.col("n1") >= 2) & (F.col("n1") * max(n0, 1) >= 20 * F.col("n0") * max(n1, 1)))
    rows = likely.collect()
    ones, zeros = Counter({r["term"]: r["n1"] for r in rows}), Counter({r["term"]: r["n0"] for r in rows})
    names = set(ones)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, signs = [], []
            for t in batch.column("text").to_pylist():
                words = {w for w in set(_WORD.findall(t.lower())) if len(w) >= 4}
                own.append(sorted({s for w in words for s in stems(w)} & names))
                hashes = [zlib.crc32(w.encode()) for w in words]
                signs.append([min((h * a & 0xFFFFFFFF for h in hashes), default=-1) for a in MULTIPLIERS])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string())), pa.array(signs, pa.list_(pa.int64()))], ["terms", "signs"])

    found = sample.filter("toxic = 1").mapInArrow(frugal(present), "terms array<string>, signs array<long>").collect() if n1 else []
    together: dict[int, set[str]] = {}
    for r, g in zip(found, copies([r["signs"] for r in found]), strict=True):
        together.setdefault(g, set()).update(r["terms"])
    # Copies count once.
    n1, hits = len(together), list(together.values())
    ones = Counter(t for own in hits for t in own)
    terms = cover(hits, ones, zeros, n0)

    def odds(a: float, b: float) -> float:
        # Two clean texts more than were seen: a term of a few toxic texts proves little.
        return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 2) / (n0 + 4))

    prior = 4.5
    weights = {t: prior for t in SEED} | {t: odds(ones[t], zeros[t]) for t in terms}
    draft = Scorer(weights, {}, 0.0, 0.0)

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [draft.hits(set(_WORD.findall(t.lower()))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([sorted({f"{e > 0:d}{t}" for t, e in f.values()}) for f in found], pa.list_(pa.string()))], ["toxic", "terms"])

    used = sample.mapInArrow(frugal(use), "toxic int, terms array<string>")
    exact: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for r in used.select("toxic", F.explode("terms").alias("term")).groupBy("toxic", "term").count().collect():  # at most two rows for each term and label
        exact[r["toxic"]][r["term"]] += r["count"]
    none = {r["toxic"]: r["count"] for r in used.filter(F.size("terms") == 0).groupBy("toxic").count().collect()}
    for t in SEED:
        a, b = exact[1]["0" + t], exact[0]["0" + t]
        if t not in terms and a + b:
            weights[t] = (2 * prior + (a + b) * odds(a, b)) / (2 + a + b)
    # A misspelling counts for less, the less the more of them stand in clean texts.
    misspelt = {}
    for t, w in weights.items():
        a, b = exact[1]["1" + t], exact[0]["1" + t]
        guess = (0.7 if t in terms else 0.4) * w
        misspelt[t] = min(w, (2 * guess + (a + b) * odds(a, b)) / (2 + a + b))
    base = math.log((n1 + 1) / (n0 + 1)) if n1 + n0 else -2.0
    base = max(-3.0, min(0.0, base))
    return Scorer(weights, misspelt, base, min(-1.0, base + odds(none.get(1, 0), none.get(0, 0))) if n1 + n0 else -3.0)


def score(docs: DataFrame, scorer: Scorer, keep: list[str], result: tuple[str, str] = ("toxicity", "toxic_terms")) -> DataFrame:
    """The columns ``keep``, and toxicity and the terms found under the names ``result``."""
    body = "_" * (1 + max(map(len, keep), default=0))  # no column that is kept
    prepare(docs.sparkSession)
    state = (scorer.weights, scorer.misspelt, scorer.bias, scorer.silent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*state)
        for batch in batches:
            got = [own.score(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.string()))], [*keep, *result])

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias(body))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep))
    return rows.mapInArrow(frugal(run), ", ".join(x for x in (schema, f"`{result[0]}` double, `{result[1]}` array<string>") if x))
