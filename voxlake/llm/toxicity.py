"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_udf, discard, give_back, hold, map_pandas, saved, table

#: Labelled documents that the model is fitted on at most, of each label (those of least hash).
FIT_DOCS = 2_500
#: A word, or its first letters, marks toxic tokens if it stands in so many toxic fitting documents ...
LEAST_DOCS = 4
#: ... and its smoothed odds there are so many times those elsewhere.
ODDS = 12.0
PREFIXES = (4, 5, 6)
#: Bounds of the fit, as it is on a sample: features of highest odds, windows of a document, windows in all.
FEATURES, OWN_WINDOWS, WINDOWS = 20_000, 4, 6_000
#: Tokens of a training window, steps.
WINDOW, STEPS = 32, 120
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7
CACHED_WORDS = 80_000

#: Largest evidence of a token, in nats: e to it is still far from the largest double.
MOST_EVIDENCE = 300.0

TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in PREFIXES if len(word) > n]


@dataclass
class Model:
    """A two-state chain: weight of each feature, bias and transitions for the toxic state."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0, 0.0]))

    def emission(self, word: str) -> float | None:
        """Evidence for the toxic state, without the bias; None for the plain words."""
        own = [w for f in features(word) if (w := self.weights.get(f)) is not None]
        return sum(own) if own else None

    def marginals(self, at: list[int], evidence: list[float], n: int) -> list[float]:
        """P(toxic) of the tokens `at`, whose evidence is given; all others of the n are plain.

        Forward-backward, exact: runs of plain tokens are powers of one matrix.
        """
        t, b = np.exp(self.trans), math.exp(self.bias)
        plain = t * np.array([1.0, b])

        def hop(steps: int) -> tuple:
            if steps not in self._hops:
                if len(self._hops) >= CACHED_WORDS:
                    self._hops.clear()
                m, square, left = np.eye(2), plain / plain.sum(), steps
                while left:  # squares are scaled to a sum of 1, so none vanishes
                    if left & 1:
                        m = m @ square
                        m /= m.sum()
                    square = square @ square
                    square, left = square / square.sum(), left >> 1
                self._hops[steps] = tuple(m.ravel())
            return self._hops[steps]

        (t00, t01), (t10, t11) = t.tolist()
        x, y, last, ahead = 1.0, 0.0, -1, []
        for i, e in zip(at, evidence, strict=True):
            if (gap := i - last - 1) > 0:
                a, c, d, f = hop(gap)
                x, y = x * a + y * d, x * c + y * f
            x, y = x * t00 + y * t10, (x * t01 + y * t11) * b * math.exp(min(e, MOST_EVIDENCE))
            s = x + y
            x, y, last = x / s, y / s, i
            ahead.append((x, y))
        x, y, nxt, out = 1.0, 1.0, n, []
        for i, e, (fx, fy) in zip(reversed(at), reversed(evidence), reversed(ahead), strict=True):
            if (gap := nxt - i - 1) > 0:
                a, c, d, f = hop(gap)
                x, y = a * x + c * y, d * x + f * y
            out.append(fy * y / (fx * x + fy * y))
            wy = b * math.exp(min(e, MOST_EVIDENCE)) * y
            x, y = t00 * x + t01 * wy, t10 * x + t11 * wy
            s = x + y
            x, y, nxt = x / s, y / s, i
        return out[::-1]

    def __post_init__(self):
        self._hops: dict[int, tuple] = {}

    def score(self, own: list[float], n: int) -> float:
        z = float(self.doc @ doc_features(own, n))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def doc_features(own: list[float], n: int) -> np.ndarray:
    total = sum(own)
    return np.array([1.0, math.log1p(total), max(own, default=0.0), min(1.0, 20 * total / max(n, 1))])


def _chain(x: np.ndarray, bias: float, trans: np.ndarray):
    """Marginals of each token, expected transitions and log-normaliser of windows x[N, T] of evidence."""
    n, length = x.shape
    emit = np.stack([np.zeros_like(x), x + bias], axis=2)
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, length):
        ahead[:, t] = emit[:, t] + np.logaddexp(ahead[:, t - 1, :1] + trans[0], ahead[:, t - 1, 1:] + trans[1])
    for t in range(length - 2, -1, -1):
        nxt = emit[:, t + 1] + back[:, t + 1]
        back[:, t] = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
    z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    p = np.exp(ahead + back - z[:, None, None])[:, :, 1]
    pair = ahead[:, :-1, :, None] + trans + (emit + back)[:, 1:, None, :] - z[:, None, None, None]
    return p, np.exp(pair).sum(axis=(0, 1)), z


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each feature in a batch, the clean and the toxic documents that hold it."""
    for batch in batches:
        count: list[Counter] = [Counter(), Counter()]
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            count[label].update({f for w in set(TOKEN.findall(text.lower())) for f in features(w)})
        both = list(count[0].keys() | count[1].keys())
        yield pd.DataFrame({"f": both, "clean": [count[0][f] for f in both], "toxic": [count[1][f] for f in both]})


def _windowed(index: dict[str, int], marks: set[str]):
    """Training windows of each document: places and numbers of their features, places of toxic tokens.

    A document without features gives one window, which is empty wherever it lies; one without words none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, label in zip(batch["doc_id"], batch["text"], batch["toxic"], strict=True):
                words = TOKEN.findall(text.lower())
                known = {w: own for w in set(words) if (own := [index[f] for f in features(w) if f in index])}
                hits = list(islice((i for i, w in enumerate(words) if w in known), OWN_WINDOWS))
                for number, i in enumerate(hits or [0] * bool(words)):
                    low = max(0, min(i - WINDOW // 2, len(words) - WINDOW))
                    near = [(t, w) for t, w in enumerate(words[low : low + WINDOW]) if w in known]
                    found = [(t, f) for t, w in near for f in known[w]]
                    gold = [t for t, w in near if label and any(f in marks for f in features(w))]
                    rows.append((doc, number, [t for t, _ in found], [f for _, f in found], gold))
            yield pd.DataFrame(rows, columns=["doc_id", "number", "at", "feature", "gold"])

    return run


def _described(model: Model):
    """`doc_features` of each document under a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = TOKEN.findall(text.lower())
                rows.append((doc, doc_features(tagged(model, words, cache)[1], len(words))))
            yield pd.DataFrame(rows, columns=["doc_id", "x"])

    return run


def fit(fitting: DataFrame) -> Model:
    """Fit on labelled documents (doc_id, text, toxic): token labels from word odds, chain by gradient, score by logistic regression.

    Tasks read the texts; the driver gets the strongest features, windows as numbers and four numbers a document.
    Without documents of both labels the model knows no words and scores all alike, low.
    """
    docs = sorted(tuple(r) for r in fitting.select("doc_id", "toxic").collect())
    y = np.array([label for _, label in docs])
    model = Model()
    if len(set(y.tolist())) < 2:
        return model
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    count = map_pandas(fitting.select("text", "toxic"), _counted, "f string, clean long, toxic long")
    count = count.groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= LEAST_DOCS)
    odds = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    # single letters and stems that clean documents share tell nothing; only strong marks are features
    strong = count.select("f", odds.alias("odds")).where(F.col("odds") >= ODDS / 2)
    strong = strong.orderBy(F.desc("odds"), "f").limit(FEATURES).collect()
    known = [r["f"] for r in strong]
    index = {f: i for i, f in enumerate(known)}
    marks = {r["f"] for r in strong if r["odds"] >= ODDS}
    id_type = fitting.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, number int, at array<int>, feature array<int>, gold array<int>"
    windows: dict = {}
    for r in map_pandas(fitting, _windowed(index, marks), schema).collect():
        windows.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    rows: list[tuple] = []
    for d in np.random.default_rng(0).permutation(len(docs)):
        rows += sorted(windows.get(docs[d][0], ()))
        if len(rows) >= WINDOWS:
            break
    n = len(rows)
    gold = np.zeros((n, WINDOW))
    at_row = np.repeat(np.arange(n), [len(at) for _, at, _, _ in rows])
    at_tok = np.array([t for _, at, _, _ in rows for t in at], int)
    at_feat = np.array([f for _, _, own, _ in rows for f in own], int)
    for r, (_, _, _, toxic) in enumerate(rows):
        gold[r, toxic] = 1
    del windows, rows
    w, bias, trans = np.zeros(len(known)), -3.0, np.zeros((2, 2))
    seen = np.zeros((2, 2))
    g = gold.astype(int)
    np.add.at(seen, (g[:, :-1].ravel(), g[:, 1:].ravel()), 1)
    m = [np.zeros(len(known) + 5) for _ in range(2)]
    for step in range(1, STEPS + 1):
        x = np.zeros((n, WINDOW))
        if len(at_feat):
            np.add.at(x, (at_row, at_tok), w[at_feat])
        p, pairs, _ = _chain(x, bias, trans)
        off = gold - p
        gw = np.bincount(at_feat, weights=off[at_row, at_tok], minlength=len(known)) if len(at_feat) else np.zeros(len(known))
        grad = np.concatenate([gw - 0.05 * w, [off.sum()], (seen - pairs).ravel()])
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        move = 0.2 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
        w, bias, trans = w + move[: len(known)], bias + move[len(known)], np.clip(trans + move[len(known) + 1 :].reshape(2, 2), -6, 6)
    model.weights = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}
    model.bias, model.trans = float(min(bias, -1.0)), trans
    own = dict(tuple(r) for r in map_pandas(fitting.select("doc_id", "text"), _described(model), f"doc_id {id_type}, x array<double>").collect())
    a, b = np.array([own[d] for d, _ in docs]), np.zeros(4)
    for _ in range(60):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        b = b + np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + 0.05 * np.eye(4), a.T @ (y - q) - 0.05 * b)
    model.doc = b
    return model


def tagged(model: Model, words: list[str], cache: dict | None = None) -> tuple[list[int], list[float]]:
    """Tokens that carry evidence, and their marginals."""
    cache = {} if cache is None else cache
    for w in set(words).difference(cache):
        if len(cache) >= CACHED_WORDS:
            cache.clear()
        cache[w] = model.emission(w)
    get = lambda w: cache[w] if w in cache else model.emission(w)
    found = [(i, e) for i, e in enumerate(map(get, words)) if e is not None]
    if not found:
        return [], []
    at, evidence = map(list, zip(*found, strict=True))
    return at, model.marginals(at, evidence, len(words))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on at most `fit_docs` labelled documents of each label, never on held-out ones.

    Held out: crc32 of doc_id as text, modulo 3, is 1. A document labelled twice
    counts as toxic if any label says so; null labels and ids are left out.
    """
    given = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = given.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    least = [given.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs) for x in (0, 1)]
    chosen = F.broadcast(least[0].unionByName(least[1]))  # 2 x fit_docs rows at most
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    got = got.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    fitting = saved(got, "fitting")
    model = fit(fitting)
    discard(fitting)
    give_back()
    return model


def _tagger(model: Model, with_spans: bool):
    cache: dict = {}

    def one(text: str) -> tuple[float, list]:
        low = text.lower()
        same = len(low) == len(text)  # else letters grow in lower case, and words are lower-cased one by one
        low = low if same else text
        found = TOKEN.findall(low) if same else [w.lower() for w in TOKEN.findall(text)]
        at, own = tagged(model, found, cache)
        score = model.score(own, len(found))
        marked = {i for i, p in zip(at, own, strict=True) if p >= 0.5} if with_spans else ()
        return score, [[m.start(), m.end()] for i, m in enumerate(TOKEN.finditer(low)) if i in marked] if marked else []

    def scores(texts: pd.Series) -> pd.Series:
        hold("toxicity", cache.clear)
        return pd.Series([one(t)[0] for t in texts], dtype=float)

    def spans(texts: pd.Series) -> pd.DataFrame:
        hold("toxicity", cache.clear)
        return pd.DataFrame([one(t) for t in texts], columns=["score", "spans"])

    return spans if with_spans else scores


def toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """Per document: doc_id, score (0 to 1), predicted (score >= THRESHOLD) and toxic spans [start, end).

    Whole texts are tagged; null and empty ones get the score of a text without
    evidence. Only doc_id and text of docs and doc_id and toxic of labels are
    read. Repeated rows each give a row, equal texts equal scores; a score that
    ties with the threshold is predicted toxic. A very long text costs its words,
    not their square. An empty table gives no rows; without labels all score alike, low.
    """
    tag = _tagger(train(docs, labels, fit_docs), True)
    text = F.coalesce("text", F.lit(""))
    found = column_udf(docs.sparkSession, tag, "score double, spans array<array<int>>", text)
    out = docs.select("doc_id", found.alias("_found")).select("doc_id", "_found.score", "_found.spans")
    return out.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def clean(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """`docs` without the documents predicted toxic; all columns as they are, nulls and repeats too."""
    score = _tagger(train(docs, labels, fit_docs), False)
    return docs.where(column_udf(docs.sparkSession, score, "double", F.coalesce("text", F.lit(""))) < THRESHOLD)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
