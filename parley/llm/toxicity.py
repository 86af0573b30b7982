"""Toxicity scores by weak supervision.

Many voters look at a text: lexicons mined from labelled rows, dealt into folds
by hash, fixed word lists and patterns, and voters for clean text.  A generative
label model estimates, by EM, how often each voter fires on toxic and on clean
text (its accuracy) and how far voters fire together beyond that (their
correlation, by which their weights are cut).  A logistic regression is then
trained on the model's posterior labels and scores every text.

What is fitted is fitted on a bounded sample of labelled rows: ``sample_rows``.
Scoring reads every whole text and needs no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._common import written

#: At most about so many labelled rows are fitted on, chosen by a hash of doc_id.
SAMPLE_ROWS = 20_000
#: A model is of a fixed size: the strongest so many mined lexicon entries and clean-leaning features (parameters of fit).
LEXICON, CLEAN = 4096, 512
FOLDS = 12
THRESHOLD = 0.7

_NOT_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Fixed word lists.
INSULTS = {b"idiot", b"stupid", b"moron", b"loser", b"trash", b"scum", b"pathetic", b"disgusting", b"worthless", b"clown", b"dumb", b"imbecile", b"jerk", b"fool", b"garbage", b"filthy", b"vermin"}
THREATS = {b"kill", b"die", b"hate", b"destroy", b"hurt", b"beat", b"shoot"}
#: Fixed patterns.
PATTERNS = {
    "second_person_insult": re.compile(rb"\byou(?:'re| are)?\s+(?:an?\s+|such\s+an?\s+|so\s+)?(?:idiot|stupid|moron|loser|trash|scum|pathetic|disgusting|worthless|clown|dumb)", re.I),
    "shouting": re.compile(rb"(?:\b[A-Z]{3,}\b[ ,!]*){4,}"),
    "exclaiming": re.compile(rb"!!+"),
    "masked_word": re.compile(rb"\b[a-z]\*{2,}[a-z]?\b", re.I),
}
PREFIXES = (4, 5, 6)


def features(raw: bytes) -> set[bytes]:
    """Distinct lower-case words of the UTF-8 text, and their first bytes, marked by length."""
    words = set(raw.decode("utf-8", "replace").lower().encode().translate(_NOT_LETTERS).split())
    out = set(words)
    for n in PREFIXES:
        tag = b"%d:" % n
        out.update(tag + w[:n] for w in words if len(w) > n)
    return out


@dataclass
class Model:
    """Weights by feature, of the patterns and the bias; voters' estimated accuracies and correlations for reports."""

    weights: dict[bytes, float] = field(default_factory=dict)
    patterns: list[float] = field(default_factory=lambda: [0.0] * len(PATTERNS))
    bias: float = -3.0
    voters: dict[str, tuple[float, float]] = field(default_factory=dict)
    correlations: np.ndarray | None = None

    def score(self, raw: bytes) -> float:
        z = self.bias
        get = self.weights.get
        words = set(raw.decode("utf-8", "replace").lower().encode().translate(_NOT_LETTERS).split())
        seen = set()
        for w in words:
            z += get(w, 0.0)
            for n, tag in _TAGS:
                if len(w) > n:
                    seen.add(tag + w[:n])
        for p in seen & self.weights.keys():
            z += self.weights[p]
        for weight, pattern in zip(self.patterns, PATTERNS.values()):
            if weight and pattern.search(raw):
                z += weight
        return 1 / (1 + float(np.exp(-max(-500.0, min(500.0, z)))))


_TAGS = [(n, b"%d:" % n) for n in PREFIXES]


def voter_names() -> list[str]:
    return [f"lexicon_{i}" for i in range(FOLDS)] + [f"prefix_{i}" for i in range(FOLDS)] + ["insults", "threats", *PATTERNS, "clean_no_entry", "clean_long_no_entry", "clean_words"]


def votes(raw: bytes, found: set[bytes], toxic: set[bytes], clean: set[bytes]) -> list[int]:
    """Which voters fire on a text; ``found``: its features."""
    out = [0] * (2 * FOLDS)
    hits = found & toxic
    for x in hits:
        out[zlib.crc32(x) % FOLDS + FOLDS * (b":" in x)] = 1
    words = found
    out += [int(bool(words & INSULTS)), int(bool(words & THREATS))]
    out += [int(bool(p.search(raw))) for p in PATTERNS.values()]
    none = not hits
    out += [int(none), int(none and len(found) > 100), int(none and len(found & clean) >= 3)]
    return out


def label_model(fired: np.ndarray, gold: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, each voter's rates of firing (clean, toxic), correlations of voters.

    ``fired``: rows by voters, 0 or 1.  ``gold``: 0 or 1, a voter like the others
    whose accuracy starts at 0.98 and from which EM starts.
    """
    votes_ = np.column_stack([fired, gold]).astype(float)
    p = np.clip(gold.astype(float), 0.02, 0.98)
    prior, theta, r = 0.1, None, np.eye(votes_.shape[1])
    for _ in range(rounds):
        prior = float(np.clip(p.mean(), 0.005, 0.995))
        q = np.stack([1 - p, p])
        theta = (q @ votes_ + 0.5) / (q.sum(1, keepdims=True) + 1)
        theta = np.clip(theta, 1e-4, 1 - 1e-4)
        # what voters share beyond the label
        rest = [votes_ - theta[y] for y in (0, 1)]
        cov = sum((rest[y] * q[y][:, None]).T @ rest[y] for y in (0, 1)) / max(len(p), 1)
        sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        r = np.clip(cov / np.outer(sd, sd), -1, 1)
        weight = 1 / (1 + np.clip(r - np.eye(len(r)), 0, None).sum(1))
        weight[-1] = 1
        on, off = np.log(theta[1] / theta[0]), np.log((1 - theta[1]) / (1 - theta[0]))
        z = np.log(prior / (1 - prior)) + votes_ @ (weight * on) + (1 - votes_) @ (weight * off)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p, theta, r


def _logistic(rows: list[np.ndarray], width: int, y: np.ndarray, l2: float = 0.02, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse binary rows and soft labels (Nesterov, whole batch)."""
    n = max(len(rows), 1)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.05
    w, b = np.zeros(width), np.log(base / (1 - base))
    vw, vb = w.copy(), b
    # rows are classes of unequal size: each class gets half of the weight
    cw = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1)) * n
    most = max(np.bincount(of, minlength=1).max() if len(of) else 1, 1)
    rate = 4.0 / (most + 1) / max(cw.max() / 2, 1) * 4
    for t in range(steps):
        z = np.bincount(of, vw[at], minlength=len(rows)) + vb
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cw / n
        gw, gb = np.bincount(at, e[of], minlength=width) + l2 * vw / n, e.sum()
        w2, b2 = vw - rate * gw, vb - rate * gb
        m = t / (t + 3)
        vw, vb = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, float(b)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of doc_id as text is 1 modulo 3 (a null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon: int = LEXICON, clean_words: int = CLEAN) -> Model:
    """The model of ``labels(doc_id, toxic)``, learned from rows that aren't held out.

    Null labels and labels without a document are ignored; of repeated labels the
    largest counts; equal texts count once.  Without any labelled row, all scores
    are low.  ``lexicon`` and ``clean_words`` bound the features of the model.
    """
    docs = docs.select("doc_id", "text")
    usable = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = usable.count()
    part = int(min(1.0, sample_rows / max(n, 1)) * 1_000_000)
    chosen = usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < part)
    rows = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select(F.col("text").cast("binary").alias("raw"), "toxic")  # about sample_rows rows at most
    rows = written(rows.groupBy("raw").agg(F.max("toxic").alias("toxic")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for raw, y in zip(batch.column(0), batch.column(1)):
                seen[int(y.as_py() > 0)].update(features(raw.as_py()))
        keys = [*(seen[0].keys() | seen[1].keys())]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["f", "pos", "neg"])

    size = {bool(r[0]): r[1] for r in rows.groupBy((F.col("toxic") > 0).alias("y")).count().collect()}
    p, q = size.get(True, 0), size.get(False, 0)
    if not p or not q:
        return Model()
    sums = rows.mapInArrow(count, "f binary, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (p + 1)) - F.log((F.col("neg") + 0.5) / (q + 1))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    ranked = sums.where("pos + neg >= 4").select("f", z.alias("z"), odds.alias("odds"))
    toxic = {bytes(r[0]) for r in ranked.where("z > 2.5 and odds > 1.5").orderBy(F.desc("z"), "f").limit(lexicon).collect()}
    clean = {bytes(r[0]) for r in ranked.where("z < -2.5").orderBy("z", "f").limit(clean_words).collect()}
    columns = {f: i for i, f in enumerate(sorted(toxic | clean))}
    held = docs.sparkSession.sparkContext.broadcast((toxic, clean, columns))  # LEXICON + CLEAN entries at most

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, columns = held.value
        for batch in batches:
            fired, own = [], []
            for raw in batch.column(0):
                raw = raw.as_py()
                found = features(raw)
                fired.append(votes(raw, found, toxic, clean))
                hits = [int(bool(x.search(raw))) for x in PATTERNS.values()]
                own.append(sorted(columns[f] for f in found & columns.keys()) + [len(columns) + i for i, h in enumerate(hits) if h])
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.list_(pa.int32())), pa.array(own, pa.list_(pa.int32())), batch.column(1)], ["fired", "own", "toxic"])

    got = rows.mapInArrow(vote, "fired array<int>, own array<int>, toxic int").toArrow()  # about sample_rows rows at most
    order = sorted(range(got.num_rows), key=lambda i: (got["own"][i].as_py(), got["toxic"][i].as_py()))
    fired = np.array(got["fired"].to_pylist(), dtype=np.int8)[order]
    own = [np.array(x, dtype=np.int64) for x in np.array(got["own"].to_pylist(), dtype=object)[order]]
    gold = (got["toxic"].to_numpy() > 0).astype(int)[order]
    posterior, theta, r = label_model(fired, gold)
    w, b = _logistic(own, len(columns) + len(PATTERNS), posterior)
    names = [*voter_names(), "label"]
    return Model({f: float(w[i]) for f, i in columns.items() if w[i]}, w[len(columns) :].tolist(), b, {n: (float(theta[0][i]), float(theta[1][i])) for i, n in enumerate(names)}, r)


def score(text: Column, model: Model, spark) -> Column:
    """Score of each text, 0 to 1; null counts as empty."""
    held = spark.sparkContext.broadcast((model.weights, model.patterns, model.bias))  # LEXICON + CLEAN entries at most

    @arrow_udf("double")
    def run(raw: pa.Array) -> pa.Array:
        of = Model(*held.value).score
        return pa.array([of(x.as_py()) for x in raw], pa.float64())

    return run(F.coalesce(text, F.lit("")).cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted added (own columns of these names are replaced).

    Every row of ``docs`` gets its result, repeated ones and those with a null
    or empty text too; a null doc_id is not held out unless its empty text is;
    texts are read whole; an empty table gives an empty result; other columns may
    have any names.
    """
    model = fit(docs, labels, sample_rows)
    out = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", score(F.col("text"), model, docs.sparkSession))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept, whatever their names; nothing is shuffled but the sample.

    A null or empty text is scored like any other; equal texts stay or go alike;
    an empty table gives an empty result.
    """
    return docs.where(score(F.col("text"), fit(docs, labels, sample_rows), docs.sparkSession) < threshold)
