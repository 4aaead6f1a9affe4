"""Toxicity by multiple-instance learning.

Labels exist for documents only. A document is a bag of sentences; each sentence has a logistic
score over its words and their beginnings and ends, so that inflected forms count with their stem, and the document's probability is the noisy-or of its sentences with a leak
for labels that no sentence explains. Training from document labels alone teaches the sentence
scores, which then tell the offending sentences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evitrace.llm.common import arrow_rows

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Bound of the training sample: labelled documents, and code points of each.
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 20_000
#: Code points of the beginnings and ends of a word that are features of their own.
AFFIXES = (3, 4, 5, 6)
#: Distinct words whose weights a worker remembers before it starts afresh.
REMEMBERED = 100_000
#: Score from which a document counts as toxic.
REJECT = 0.7


def sentences(text: str | None) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, distinct lower-case words) of every sentence with a word, in code points."""
    found = []
    for m in _SENTENCE.finditer(text or ""):
        words = tuple(set(_WORD.findall(m.group().lower())))
        if words:
            found.append((m.start(), m.end(), words))
    return found


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in AFFIXES if len(word) > k), *("*" + word[-k:] for k in AFFIXES if len(word) > k)]


def _surest(word: str, shares: dict[str, float]) -> str | None:
    return max((f for f in features(word) if f in shares), key=lambda f: (shares[f], -len(f), f), default=None)


@dataclass
class Model:
    """Weights, the sentences' bias, and the share of positive labels no sentence explains.

    ``shares`` has the toxic share each feature surely has; a word counts by its surest feature.
    """

    bias: float = -20.0
    leak: float = 0.0
    shares: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        total = self.known.get(word)
        if total is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            total = self.known[word] = self.weights.get(_surest(word, self.shares), 0.0)
        return total

    def sentence(self, words: tuple[str, ...]) -> float:
        z = sum(map(self.word, words))
        if not z:
            return 0.0  # no evidence: the leak covers it, so a text's length alone says nothing
        z += self.bias
        return 1 / (1 + exp(-max(min(z, 35.0), -35.0)))

    def document(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and (start, end, score) of its sentences from 0.5 on."""
        clean, found = log1p(-self.leak), []
        for start, end, words in sentences(text):
            p = self.sentence(words)
            clean += log1p(-p)
            if p >= 0.5:
                found.append((start, end, p))
        return min(max(1 - exp(clean), 0.0), 1.0), found


def _fresh(texts: list[str | None]) -> list[int]:
    """Texts of which at most half the sentences occur in an earlier one: copies teach once."""
    seen: set[int] = set()
    fresh = []
    for i, text in enumerate(texts):
        marks = {hash(s.strip()) for s in _SENTENCE.findall(text or "") if s.strip()}
        if 2 * len(marks & seen) <= len(marks):
            fresh.append(i)
        seen |= marks
    return fresh


def _vocabulary(bags: list[list[tuple[str, ...]]], y: np.ndarray, certain: float, least: float) -> dict[str, float]:
    """Features of whose documents at least the share ``least`` is toxic, by the lower end of
    Wilson's interval ``certain`` deviations wide. What marks a language or a topic stays out, so
    long texts do not gather a score from it.

    Features of toxic documents are counted first: few enough documents cannot suffice, and only
    what is left is looked for in the others.
    """
    square = certain**2
    enough = square * least / (1 - least)
    hit: dict[str, int] = {}
    for bag, toxic in zip(bags, y):
        if toxic:
            for f in {f for w in set().union(*bag) for f in features(w)}:
                hit[f] = hit.get(f, 0) + 1
    hit = {f: k for f, k in hit.items() if k > enough}
    missed = dict.fromkeys(hit, 0)
    known: dict[str, tuple[str, ...]] = {}
    for bag, toxic in zip(bags, y):
        if not toxic:
            met: set[str] = set()
            for w in set().union(*bag):
                if w not in known:
                    known[w] = tuple(f for f in features(w) if f in hit)
                met.update(known[w])
            for f in met:
                missed[f] += 1
    kept = {}
    for f, k in hit.items():
        n = k + missed[f]
        share = k / n
        low = (share + square / (2 * n) - certain * (share * (1 - share) / n + square / (4 * n * n)) ** 0.5) / (1 + square / n)
        if low > least:
            kept[f] = low
    return kept


def fit(texts: list[str | None], toxic: list[int], certain: float = 2.0, least: float = 0.65, rounds: int = 150,
        rate: float = 0.05, hold: float = 1e-4) -> Model:
    """Weights by full gradient steps (Adam) on the likelihood of the documents' labels.

    ``certain``, ``least``: see ``_vocabulary``; ``hold`` pulls the weights to where they start. Without
    labels of both kinds the model is the share of positive ones.
    """
    fresh = _fresh(texts)
    texts, y = [texts[i] for i in fresh], np.array([toxic[i] for i in fresh], float)
    if not len(y) or y.min() == y.max():
        return Model(leak=min(float(y.mean()), 0.999) if len(y) else 0.0)
    one: dict[str, str] = {}  # every word is held once
    bags = [[tuple(one.setdefault(w, w) for w in s[2]) for s in sentences(t)] for t in texts]
    shares = _vocabulary(bags, y, certain, least)
    place = {f: i for i, f in enumerate(sorted(shares))}
    best = {w: _surest(w, shares) for bag in bags for words in bag for w in words}
    told = [(d, [place[best[w]] for w in words if best[w]]) for d, bag in enumerate(bags) for words in bag]
    doc = np.array([d for d, x in told if x], np.int64)
    flat = [x for _, x in told if x]
    row = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    col = np.array([i for x in flat for i in x], np.int64)
    size = len(place)
    theta = np.zeros(size + 2)  # the weights, the bias, the leak as a logit
    # A word alone starts at its share, so one that always has company is not explained away.
    theta[size], theta[size + 1] = -8.0, -2.0
    sure = np.array([shares[f] for f in sorted(shares)])
    theta[:size] = np.log(sure / (1 - sure)) - theta[size]
    prior = theta.copy()
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = theta[size] + np.bincount(row, theta[col], len(flat))
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        leak = 1 / (1 + np.exp(-theta[size + 1]))
        clean = np.exp(np.bincount(doc, np.log1p(-p), len(y)) + np.log1p(-leak))
        pull = (1 - y) - y * clean / np.maximum(1 - clean, 1e-9)  # slope of the loss along -log(clean)
        by_sentence = p * pull[doc]
        slope = np.concatenate((np.bincount(col, by_sentence[row], size), [by_sentence.sum(), (leak * pull).sum()])) / len(y)
        slope += hold * (theta - prior)
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = {f: float(theta[i]) for f, i in place.items()}
    return Model(float(theta[size]), float(1 / (1 + np.exp(-theta[size + 1]))), shares, weights)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", toxic_col: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """A model from a bounded sample of labelled documents.

    ``learn`` (over ``id_col`` of ``labels``) says which rows may be learned from. The sample is the
    ``rows`` labelled ids with the smallest hashes whose texts have at most ``chars`` code points;
    an id labelled twice counts as toxic if any of its labels says so, an id with several texts
    takes the smallest. Null ids, labels and texts teach nothing.
    """
    given = labels.filter(F.col(id_col).isNotNull() & F.col(toxic_col).isin(0, 1))
    if learn is not None:
        given = given.filter(learn)
    chosen = given.groupBy(F.col(id_col).alias("_id")).agg(F.max(toxic_col).cast("int").alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(
        F.col("_text").isNotNull() & (F.length("_text") <= chars))
    # At most ``rows`` pairs of numbers are broadcast.
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    got = sample.orderBy("_id").collect()
    return fit([r["_text"] for r in got], [r["_toxic"] for r in got])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, its whole text's score, and the offending sentences (start, end, score).

    Null, empty and wordless texts get the leak alone. Repeated rows are scored each for itself; an
    empty table gives no rows; other columns are ignored whatever their names.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [model.document(t) for t in batch.column(1).to_pylist()]
        found = [[{"start": a, "end": b, "score": p} for a, b, p in s] for _, s in made]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([m[0] for m in made], pa.float64()), pa.array(found, spans)], ["_id", "score", "sentences"])

    made = arrow_rows(base, f"_id {kind}, score double, sentences array<struct<start: int, end: int, score: double>>", step)
    return made.withColumnRenamed("_id", id_col)


def reject(docs: DataFrame, model: Model, text_col: str = "text", limit: float = REJECT) -> DataFrame:
    """The rows whose texts score below ``limit``, with all their columns."""
    place = docs.columns.index(text_col)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([model.document(t)[0] < limit for t in batch.column(place).to_pylist()], pa.bool_()))

    return arrow_rows(docs, docs.schema, step)
