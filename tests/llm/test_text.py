import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import htmltext, langid, licences, toxicity

EN = "the of and that with from this was are for have been other which their time people about would there".split()
DE = "der die und das nicht mit einer sich auf werden über können schön größe für wäre müssen straße haben".split()
FR = "le la les des une pour dans avec était être même très français où leur nous cette après élève garçon".split()


def text_of(rng, words, n=60):
    return " ".join(rng.choices(words, k=n))


def test_languages_and_mixtures(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, w), lang) for lang, w in (("en", EN), ("de", DE), ("fr", FR)) for i in range(40)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    cases = [(1, text_of(rng, DE), "x"), (2, text_of(rng, EN, 100) + "\n" + text_of(rng, FR, 60), "x"), (3, None, "x"), (4, "123 !!", "x"), (5, "", "x"), (6, text_of(rng, FR, 200_000), "x"), (7, "的", "x"), (1, text_of(rng, DE), "y")]
    docs = spark.createDataFrame(cases, "doc_id long, text string, lang_pred string")
    got = langid.predict(docs, model, ["doc_id"]).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8
    assert (by[1]["lang_pred"], by[6]["lang_pred"]) == ("de", "fr")
    assert by[2]["lang_pred"] == "en" and set(by[2]["lang_shares"]) == {"en", "fr"} and abs(by[2]["lang_score"] - 0.625) < 0.08
    assert [by[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and by[3]["lang_score"] == 0
    assert by[7]["lang_pred"] != "und"
    none = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict(docs, none, ["doc_id"]).collect()} == {"und"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automata_against_edit_distance():
    terms = [*toxicity.SEED, "clown", "lowei*", "disgustingly"]
    trie, rng = toxicity.Trie(terms), random.Random(2)
    for _ in range(4000):
        w = list(rng.choice(terms).rstrip("*"))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "e", "s", "1"])
        w = "".join(w)
        found = trie.find(w)
        whole = w in terms or any(w.startswith(t[:-1]) and len(w) >= len(t) for t in terms if t.endswith("*"))
        near = [d for t in terms if not t.endswith("*") and (d := distance(w, t)) <= min(trie.reach(len(w)), trie.reach(len(t)))]
        assert (found[1] if found else None) == (0 if whole else min(near) if near else None), w


def test_long_words_are_looked_up():
    term = "b" + "la" * 30
    scorer = toxicity.Scorer({term: 4.0, "lowei*": 3.0}, {term: 2.0}, 0.0, -3.0)
    assert scorer.score(f"this {term[:20]}x{term[21:]} there")[1] == [term] and scorer.score("lowei" + "z" * 80)[1] == ["lowei*"]


def scored_by_hand(scorer, text):
    """The score read word by word, without automata, memory or shortcuts."""
    low = (text or "").lower()
    inside, at = set(), 0
    for line in low.split("\n"):
        i = 0
        while i < len(line):
            close = toxicity.QUOTES.get(line[i])
            ends = [k for k in range(i + 1, len(line)) if close and line[k] in (line[i], close)]
            if ends and ends[0] > i + 1 and line[ends[0]] == close:
                inside |= set(range(at + i, at + ends[0] + 1))
                i = ends[0]
            i += 1
        at += len(line) + 1
    words = [(m.group(), m.start()) for m in re.finditer(r"[^\W_]+", low)]
    best = {}
    for k, (w, place) in enumerate(words):
        terms = scorer.weights
        if len(w) < 4:
            continue
        if w in terms:
            term, weight = w, terms[w]
        elif stems := [t for t in terms if t.endswith("*") and w.startswith(t[:-1]) and len(w) >= len(t)]:
            term = max(stems, key=len)
            weight = terms[term]
        else:
            reach = toxicity.Trie.reach
            near = [(d, t) for t in terms if not t.endswith("*") and abs(len(t) - len(w)) <= 2 and (d := distance(w, t)) <= min(reach(len(w)), reach(len(t)))]
            if not near:
                continue
            least = min(near)[0]
            tied = {t for d, t in near if d == least}
            term = next((t for t in [scorer.trie.find(w)[0]] if t in tied), None)
            assert term is not None
            weight = scorer.misspelt.get(term, 0.0)
        near_words = {x for x, _ in words[max(0, k - 6) : k + 7]}
        weight *= 0.3 if place in inside else 1.0
        weight *= 0.5 if {x for x, _ in words[max(0, k - 6) : k]} & toxicity.REPORTS else 1.0
        weight *= 1.3 if near_words & toxicity.ADDRESS else 1.0
        best[term] = max(best.get(term, -99.0), weight)
    z = max(scorer.silent, scorer.bias + sum(best.values())) if best else scorer.silent
    return 1 / (1 + 2.718281828459045 ** -max(-30.0, min(30.0, z)))


def test_scores_against_plain_reading():
    rng = random.Random(31)
    weights = {t: rng.uniform(1, 5) for t in toxicity.SEED} | {"zonk*": 3.0, "blarghyness": -1.0}
    scorer = toxicity.Scorer(weights, {t: w / 2 for t, w in weights.items()}, -1.5, -3.0)
    pool = [*EN, *toxicity.SEED, "idoit", "Morons", "zonkers", "you", "said", '"', "“", "”", "«", "»", "\n", "worthles", "xyz", "blarghynes", "pathetc"]
    for _ in range(600):
        text = " ".join(rng.choices(pool, k=rng.randint(0, 40)))
        assert scorer.score(text)[0] == pytest.approx(scored_by_hand(scorer, text)), text


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    plain = ["".join(rng.choices("abdeilmnorst", k=6)) for _ in range(800)]
    for i in range(300):
        bad = i % 5 == 0
        words = [*rng.choices(EN + plain, k=50), *(["blarghy", "zonkhead"] if bad else [])]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    cases = [(1, "the people blarghy time"), (2, "they have been other"), (3, None), (4, ""), (5, "this blrghy there"), (6, 'he wrote the word "blarghy" in the time'), (7, "of " * 100_000 + "zonkhead")]
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(spark.createDataFrame(cases, "doc_id long, text string"), scorer, ["doc_id"]).collect()}
    assert got[1] >= 0.7 and got[5] >= 0.5 and got[7] >= 0.7
    assert max(got[2], got[3], got[4]) < 0.2 and got[3] == got[4] and got[6] < got[1]
    long_quote = 'he wrote "' + "of " * 400 + 'blarghy" in the time'
    assert scorer.score(long_quote)[0] < got[1]
    bare = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert bare.score("you idiot")[0] > bare.score("hello there")[0]
    assert toxicity.score(docs.limit(0), scorer, ["doc_id"]).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(licences.UPPER if hasattr(licences, "UPPER") else "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licences_by_hand(text):
    w = WORD.findall((text or "").translate(LOWER))
    at = lambda p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = sorted(i for p in licences.BASE for i in at(p))
    base = ",".join(sorted(label for p, label in licences.BASE.items() if at(p)))
    every = ",".join(sorted(label for label, (p, _) in licences.ALL.items() if at(p)))
    return len(w), len(places), places[0] if places else None, places[-1] if places else None, base, every


def test_licences(spark):
    rng = random.Random(4)
    parts = ["CC BY", "cc-by", "CC BY-NC 4.0", "General Public License", "general  public\nlicense", "GENERAL PUBLIC", "all rights", "reserved", "All Rights Reserved.", "ccby", "xcc by", "éCC BY", "cc byK", "Licensed under the Apache License, Version 2.0.", "lorem", "K", "中文", "lesser general public license", "cc cc by by"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 12))), 1.0) for i in range(150)] + [(500, None, 0.0), (501, "", 0.0), (502, "w " * 50_000 + "cc by", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = licences.scan(docs)
    assert got.columns == ["doc_id", "text", "score", "licence_scan"]
    for r in got.collect():
        s = r["licence_scan"]
        assert tuple(s[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) == licences_by_hand(r["text"]), r["text"][:200]
        assert 0 <= s["score"] <= 1 and (s["score"] > 0) == bool(s["labels"])
    assert licences.scan(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>x";</script></head><body><nav><a href="/">Home page of the whole site</a></nav>
<div class="cookie-notice">We use cookies and much more of that kind of thing here.</div><div class="{c}"><h1>Title  of\n it</h1><p>First &amp; <b>bold</b> text that is long enough.<p>Second<br>line &eacute;&#233; of the article, long enough.
<ul><li>one<li>two</ul><form>send me</form></div><div class="comments"><p>I do not agree with a word of it, and here is why.</p></div><aside>other stories to read that are not this one</aside><footer>foot</footer>"""
WANT = "Title of it\n\nFirst & bold text that is long enough.\n\nSecond line éé of the article, long enough.\n\none\n\ntwo"


def test_html(spark):
    rows = [(i, f"https://h.example.com/{i}", PAGE.format(c=f"post-{i}")) for i in range(6)]
    odd = "<body><div class='post-9'><p>tiny</p></div><div class=x><p>" + "An advert without any name that is longer than the article. " * 4 + "</p></div>"
    rows += [(10, "http://h.example.com:80/x", odd), (11, None, None), (12, "nonsense", ""), (13, "http://solo.example.com", "just text &lt;here&gt;"), (14, "http://deep.example.com", "<div>" * 3000 + "deep text of the page that is long enough" + "</div>" * 3000), (0, "https://h.example.com/0", rows[0][2])]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    assert all(got[i] == WANT for i in range(6))
    assert got[10] == "tiny"  # the host's path wins over the page's own longest container
    assert (got[11], got[12], got[13]) == ("", "", "just text <here>") and got[14] == "deep text of the page that is long enough"
    assert htmltext.extract(pages.limit(0)).count() == 0


BODY = "<h1>A headline</h1><p>" + "The article goes on and on with many words. " * 6 + "</p>"
ARTICLE = "A headline\n\n" + ("The article goes on and on with many words. " * 6).strip()


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="home has-sidebar"><article>{BODY}</article></body>',
        f'<main class="content-sidebar-wrap">{BODY}</main>',
        f'<article class="post tags">{BODY}</article>',
        f'<html class="no-menu"><div>{BODY}</div></html>',
        f'<body id="comments-page"><div class="x">{BODY}</div></body>',
        f'<div class="page has-sidebar"><div class="text">{BODY}</div><div class="sidebar"><p>other things to read are here and there</p></div></div>',
        f'<article><header class="entry-header"><h1>A headline</h1></header>{BODY.split("</h1>")[1]}</article>',
        f'<div id="c"><h1>A headline</h1><div class="body">{BODY.split("</h1>")[1]}</div></div>',
        f'<div id="c"><div class="lead"><h1>A headline</h1></div><div class="body">{BODY.split("</h1>")[1]}</div></div>',
        f'<article>{BODY}</article><div id="comments"><article class="comment"><p>{"I do not agree with any of it. " * 40}</p></article></div>',
    ],
)
def test_names_do_not_lose_the_article(spark, page):
    pages = spark.createDataFrame([(1, "http://a.example", page)], "page_id long, url string, html string")
    assert htmltext.extract(pages).first()["text"] == ARTICLE


def test_lead_beside_the_body(spark):
    lead = "A lead of the article that says what it is about. " * 2
    page = f'<div id="c"><div class="lead"><p>{lead}</p></div><div class="body"><p>{"The rest of the article. " * 14}</p></div></div>'
    text = htmltext.extract(spark.createDataFrame([(1, None, page)], "page_id long, url string, html string")).first()["text"]
    assert text == lead.strip() + "\n\n" + ("The rest of the article. " * 14).strip()


def test_rare_template_of_a_large_host(spark):
    odd = "<div class='rare'><p>few words of a rare kind of page</p></div><div class=x><p>" + "An advert without any name that is longer than the article. " * 4 + "</p></div>"
    plain = "<div class='rare'><p>a page of the rare kind that has nothing beside it</p></div>"
    rows = [(i, f"https://h.example.com/{i}", PAGE.format(c="post")) for i in range(300)] + [(1000 + i, "https://h.example.com/r", plain) for i in range(3)] + [(2000, "https://h.example.com/odd", odd)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).filter("page_id = 2000").collect()}
    assert got[2000] == "few words of a rare kind of page"  # three votes of 303 are still more than its own


@pytest.mark.parametrize("url,host", [("https://u:p@A.example.com:8080/x?y", "a.example.com"), ("http://b.example.com#t", "b.example.com"), (None, ""), ("nonsense", "")])
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "url string").select(htmltext.host(F.col("url")).alias("h")).first()["h"] == host
