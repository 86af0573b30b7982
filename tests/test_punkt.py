"""Sentence boundaries: planted abbreviations, and every document against a plain implementation with dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from parley.operators import punkt
from parley.plans import topic_queries

SF = "/root/testdata/sf0.001"
OPEN, CLOSE = "\"'“”‘’«»([{", "\"'“”‘’«»)]},;:"


def core(tok):
    return tok.lstrip(OPEN).rstrip(CLOSE)


def dotted(c):
    return len(c) > 1 and c[-1] == "." and c[-2] != "."


def kind(c):
    t = (c[:-1] if dotted(c) else c).lower()
    return "##" if re.match(r"[-+]?[0-9][0-9.,:/-]*$", t) else t


def case(c):
    return "upper" if c[:1].isupper() and c[:1].isalpha() else "lower" if c[:1].islower() else None


def letters(t):
    return any(x.isalpha() for x in t)


def ratio(a, b, ab, n):
    if n * ab <= a * b:
        return 0.0
    log = lambda p: math.log(min(max(p, 1e-12), 1 - 1e-12))
    half = lambda k, m, p: k * log(p) + (m - k) * log(1 - p)
    p, p1, p2 = b / n, ab / a, (b - ab) / max(n - a, 1)
    return -2 * (half(ab, a, p) + half(b - ab, n - a, p) - (0 if a == ab else half(ab, a, p1)) - (0 if b == ab else half(b - ab, n - a, p2)))


class Plain:
    """The same model in memory, of texts of one language."""

    def __init__(self, texts):
        self.n, self.dots, self.lower, self.inside = Counter(), Counter(), Counter(), Counter()
        pairs = Counter()
        for text in texts:
            cs, end = [core(t) for t in (text or "").split()], True
            for i, c in enumerate(cs):
                k = kind(c)
                self.n[k] += 1
                self.dots[k] += dotted(c)
                self.lower[k] += case(c) == "lower"
                self.inside[k] += case(c) == "upper" and not end
                end = dotted(c) or c[-1:] in ("?", "!")
                if dotted(c) and i + 1 < len(cs):
                    pairs[k, kind(cs[i + 1])] += 1
        total, dots = sum(self.n.values()), sum(self.dots.values())
        self.abbr = {}
        for k, d in self.dots.items():
            if d and letters(k) and dots < total:
                bare, p, rest = len(k.replace(".", "")), dots / total, self.n[k] - d
                score = -2 * (d * math.log(p) + rest * math.log(1 - p) - d * math.log(0.99) - rest * math.log(0.01)) * math.exp(-bare) * (len(k) - bare + 1) * float(bare) ** -rest
                if score >= 0.3:
                    self.abbr[k] = score
        open_ = lambda k: k in self.abbr or k == "##" or (len(k) == 1 and k.isalpha())
        sure, ends = Counter(), 0
        for (k, m), c in pairs.items():
            if not open_(k):
                sure[m] += c
                ends += c
        self.starters = {m for m, c in sure.items() if letters(m) and ratio(ends, self.n[m], c, total) >= 30}
        self.together = {(k, m) for (k, m), c in pairs.items() if open_(k) and letters(m) and ratio(self.n[k], self.n[m], c, total) >= 7.88 and m not in self.starters}

    def split(self, text):
        toks, out, held = re.findall(r"\s*\S+", text or ""), [], ""
        cs = [core(t.strip()) for t in toks]
        for i, (t, c) in enumerate(zip(toks, cs)):
            held += t
            end = dotted(c) or c[-1:] in ("?", "!")
            if dotted(c) and i + 1 < len(cs):
                k, nxt = kind(c), cs[i + 1]
                m, up = kind(nxt), case(nxt) == "upper"
                start = up and self.lower[m] > 0 and self.inside[m] == 0
                if (k, m) in self.together:
                    end = False
                elif len(k) == 1 and k.isalpha():
                    end = start
                elif k == "##":
                    end = not (case(nxt) == "lower" or not any(x.isalnum() for x in nxt))
                elif k in self.abbr:
                    end = start or (up and m in self.starters)
            if end or i == len(toks) - 1:
                out.append(held.lstrip())
                held = ""
        return out


def test_planted_abbreviations(spark):
    """Words with a period inside sentences are learned as abbreviations, and don't split; words that only end sentences do."""
    rng = random.Random(4)
    nouns = "river table window garden market station letter winter engine corner planet mirror".split()
    verbs = "moves holds follows reaches covers leaves changes meets".split()

    def sentence():
        a, b = rng.choice(nouns), rng.choice(nouns)
        who = rng.choice(["The " + a, "Dr. Weber", "Mr. Tanaka", "Prof. Weber"])
        more = rng.choice(["", " approx. 30 times", ", e.g. every " + a, " at 5 p.m. on weekdays", " with J. Smith", " at Smith Inc. near the " + a, " (cf. the " + a + ")"])
        return f"{who} {rng.choice(verbs)} the {b}{more}{rng.choice('...?!')}"

    texts = [[sentence() for _ in range(rng.randint(1, 12))] for _ in range(400)]
    docs = spark.createDataFrame([(i, "en", " ".join(t)) for i, t in enumerate(texts)], "id int, lang string, text string")
    model = punkt.learn(docs)
    found = {r.type for r in model.abbreviations.collect()}
    assert {"dr", "mr", "prof", "approx", "e.g", "p.m", "cf"} <= found and not found & set(nouns)
    got = {}
    for r in punkt.sentences(docs, "id", model).collect():
        got.setdefault(r.id, {})[r.pos] = r.text
    right = sum([g[i] for i in range(len(g))] == texts[k] for k, g in got.items())
    assert right >= 0.98 * len(texts)
    # a model splits texts that it wasn't learned from
    new = spark.createDataFrame([(1, "en", "Prof. Weber holds the mirror.\n The engine moves."), (2, "xx", "Dr. A. Weber. And"), (3, "en", None), (4, "en", " ")], "id int, lang string, text string")
    assert {(r.id, r.pos, r.text) for r in punkt.sentences(new, "id", model).collect()} == {(1, 0, "Prof. Weber holds the mirror."), (1, 1, "The engine moves."), (2, 0, "Dr."), (2, 1, "A. Weber."), (2, 2, "And")}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()


def test_every_document(spark, documents):
    by = defaultdict(list)
    for r in documents:
        by[r.lang].append(r.text)
    models = {lang: Plain(texts) for lang, texts in by.items()}
    got = {(r.lang, r.type): r.score for r in topic_queries.punkt_abbreviations(spark, SF).collect()}
    want = {(lang, k): s for lang, m in models.items() for k, s in m.abbr.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    rows = defaultdict(dict)
    for r in topic_queries.punkt_sentences(spark, SF).collect():
        rows[r.doc_id][r.pos] = r.text
    for r in documents:
        assert [rows[r.doc_id][i] for i in range(len(rows[r.doc_id]))] == models[r.lang].split(r.text)


def test_languages_apart_and_odd_rows(spark):
    """Null and empty texts, a null language, repeated rows; each language has a model of its own."""
    rows = [(1, None, "Nr. 5 ist hier. Nr. 6 ist dort."), (2, None, None), (3, "de", ""), (4, "de", "Das ist Nr. Acht. Gut.")] + [(i, None, "Das Haus Nr. 7 steht. Nr. 8 auch nicht mehr.") for i in range(5, 40)]
    docs = spark.createDataFrame(rows, "id int, lang string, text string")
    model = punkt.learn(docs)
    assert ("nr", None) in {(r.type, r.lang) for r in model.abbreviations.collect()}
    got = defaultdict(list)
    for r in sorted(punkt.sentences(docs, "id", model).collect()):
        got[r.id].append(r.text)
    null = Plain([r[2] for r in rows if r[1] is None])
    assert got[1] == null.split(rows[0][2]) and 2 not in got and 3 not in got and got[4] == Plain(["", rows[3][2]]).split(rows[3][2])
    assert punkt.sentences(docs.limit(0), "id").count() == 0
