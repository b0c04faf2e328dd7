"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label.  A sentence's
score is logistic in its words and word stems, and 0 if it has none that the
model knows, so that a long clean text doesn't add up to a toxic one; the
document's score is their noisy-or, 1 - prod(1 - p).  The gradient of the documents' likelihood flows to
the sentences that explain it, so the fitted model also says where in a
document the offence stands.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import filter_texts, map_texts, materialise

#: Labelled rows of either class and characters that the fit reads at most; the
#: rows are those of the smallest hashes of doc_id among all labelled rows.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 14_000_000
#: Lengths of the word beginnings that are features besides the whole word.
STEMS = (4, 5, 6)
#: A feature needs so many labelled documents and standard errors of its log odds.
LEAST_DOCS, LEAST_Z = 4, 3.5
#: Evidence that every document of the fit has besides its sentences', so that a
#: toxic one without any known word is unlikely, not impossible.
LEAK = 1e-3
#: Score from which a document is called toxic.
THRESHOLD = 0.7

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGE = re.compile(r"^\W+|\W+$")


def features(word: str) -> list[str]:
    word = _EDGE.sub("", word)
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)] if word else []


def in_fold(doc_id: str = "doc_id"):
    """Rows that may be learned from; the others are held out.  A null doc_id isn't: it has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 != 1, F.lit(True))


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.memo: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def sentence(self, sentence: str) -> float:
        words = sentence.split()
        try:
            z = sum(map(self.memo.__getitem__, words))
        except KeyError:
            if len(self.memo) > 500_000:
                self.memo.clear()
            for w in words:
                if w not in self.memo:
                    self.memo[w] = self._weight(w)
            z = sum(map(self.memo.__getitem__, words))
        return z + self.bias if z else -math.inf

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences, and (start, end, score) of the offending
        ones: those that alone are likelier toxic than not."""
        left, found = 0.0, []
        lower = text.lower()
        same = len(lower) == len(text)
        for m in _SENTENCE.finditer(lower):
            z = self.sentence(m[0])
            if z == -math.inf:
                continue
            left -= z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
            if z > 0:
                found.append((m.start(), m.end(), 1 / (1 + math.exp(-z))) if same else (-1, -1, 1 / (1 + math.exp(-z))))
        if found and not same:  # lower-casing changed the length: take the sentences from the text itself
            spans = [m.span() for m in _SENTENCE.finditer(text)]
            hot = [self.sentence(text[a:b].lower()) for a, b in spans]
            found = [(a, b, 1 / (1 + math.exp(-z))) for (a, b), z in zip(spans, hot) if z > 0]
        return abs(math.expm1(left)), found


def fit(texts: list[str], labels: list[int], prior: float, rounds: int = 400) -> Model:
    """Maximum likelihood with a small ridge, by Adam over all sentences.
    ``prior`` is the share of toxic documents among all labelled ones; it weighs
    the two classes of the sample."""
    y = np.array(labels, dtype=bool)
    n_pos, n_neg = int(y.sum()), int((~y).sum())
    if not n_pos or not n_neg:
        return Model({}, -30.0)
    seen = (Counter(), Counter())
    for text, label in zip(texts, labels):
        seen[label].update({f for w in set(text.lower().replace(".", " ").split()) for f in features(w)})
    chosen = []
    for f, a in seen[1].items():
        b = seen[0].get(f, 0)
        if a >= LEAST_DOCS:
            odds = math.log((a + 0.5) / (n_pos - a + 0.5)) - math.log((b + 0.5) / (n_neg - b + 0.5))
            if odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > LEAST_Z:
                chosen.append(f)
    number = {f: i for i, f in enumerate(sorted(chosen))}
    rows, cols, owner, n = [], [], [], 0
    for d, text in enumerate(texts):
        for m in _SENTENCE.finditer(text.lower()):
            own = {number[f] for w in m[0].split() for f in features(w) if f in number}
            if own:
                rows += [n] * len(own)
                cols += own
                owner.append(d)
                n += 1
    rows_, cols_, owner_ = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), np.array(owner, dtype=np.int64)
    weight = np.where(y, prior / n_pos, (1 - prior) / n_neg)
    w, b = np.zeros(len(number) + 1), None
    w[-1] = -5.0
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(rows_, weights=w[cols_], minlength=n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        q = np.exp(np.minimum(np.bincount(owner_, weights=-np.logaddexp(0, z), minlength=len(y)), -LEAK))
        slope = np.where(y, -q / (1 - q), 1.0) * weight
        g = slope[owner_] * p
        grad = np.append(np.bincount(cols_, weights=g[rows_], minlength=len(number)), g.sum())
        grad[:-1] += 2e-5 * w[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    b = float(w[-1])
    return Model({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3}, b)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits a model to a bounded sample of the labelled rows outside the held-out
    fold; see SAMPLE_ROWS.  Labels that are null or belong to no row, and null
    texts, aren't used; of rows that share a doc_id the greatest text and label count;
    within the bound of characters a document that no longer fits is passed over.  Without labelled rows of both classes the model
    knows no word and calls nothing toxic."""
    own = labels.where(in_fold() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = docs.where("text is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("size"))
    known = own.join(size, "doc_id").where("toxic in (0, 1)").select("doc_id", "toxic", "size", F.xxhash64("doc_id").alias("h"))
    known = materialise(known, "toxicity-known")
    shares = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen: dict[int, int] = {}
    for label in (0, 1):  # a row count that is a parameter, without texts
        left = SAMPLE_CHARS // 2
        for r in known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(SAMPLE_ROWS).collect():
            if r.size <= left:
                left -= r.size
                chosen[r.doc_id] = label
    if not chosen:
        return Model({}, -30.0)
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k,) for k in sorted(chosen)], T.StructType([docs.schema["doc_id"]]))
    texts = docs.where("text is not null").join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")).collect()
    texts.sort(key=lambda r: r.doc_id)
    total = sum(shares.values())
    return fit([r.text for r in texts], [chosen[r.doc_id] for r in texts], shares.get(1, 0) / total)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
FIELDS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("offending", SPANS)])


def scorer(model: Model) -> Callable[[], Callable[[list[str]], dict[str, list]]]:
    weights, bias = model.weights, model.bias

    def make() -> Callable[[list[str]], dict[str, list]]:
        own = Model(weights, bias)

        def work(texts: list[str]) -> dict[str, list]:
            found = [own.score(t) for t in texts]
            return {
                "score": [s for s, _ in found],
                "offending": [[{"start": a, "end": b, "score": p} for a, b, p in f] for _, f in found],
                "clean": [s < THRESHOLD for s, _ in found],
            }

        return work

    return make


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and offending (start, end, score of sentences in code
    points) of every whole text, one output row a row.  Null and empty texts
    have no sentence and score 0; a null doc_id is kept; an empty table gives
    an empty one; no other column is an input."""
    return map_texts(docs, scorer(model), FIELDS)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text scores below THRESHOLD, all columns, equal rows and those
    of a null doc_id too.  Null and empty texts stay; whole texts of any length are
    scored; an empty table gives an empty one."""
    return filter_texts(docs, scorer(model), "clean")
