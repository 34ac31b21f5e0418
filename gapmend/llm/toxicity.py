"""Severity of toxic language by cumulative-link (proportional odds) regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapmend.llm.common import worker_cache
from gapmend.llm.labelled import held_out, labelled_sample

WORD = re.compile(r"\w+")
#: Lengths of word beginnings that are features beside the whole word.
PREFIXES = (3, 4, 5, 6, 7)
MEMO_WORDS = 1_000_000
#: Added to a document's words, so that very short texts don't get extreme densities.
SMOOTH = 20


def word_features(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]]


def text_features(text: str) -> tuple[Counter, int]:
    """Counts of features of a whole text and its number of words."""
    words = Counter(WORD.findall(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        for f in word_features(w):
            out[f] += n
    return out, sum(words.values())


def vocabulary(texts: list[str], positive: np.ndarray, size: int, least: int) -> list[str]:
    """The ``size`` features whose document frequencies tell the positive documents best (chi-square);
    only those of at least ``least`` positive documents."""
    dp: Counter = Counter()
    for t, y in zip(texts, positive):
        if y:
            dp.update(text_features(t)[0].keys())
    dp = Counter({f: n for f, n in dp.items() if n >= least})
    df = Counter(dp)
    for t, y in zip(texts, positive):
        if not y:
            df.update(f for f in text_features(t)[0] if f in dp)
    n, p = len(texts), int(positive.sum())

    def chi(f):
        a, b = dp[f], df[f] - dp[f]
        c, d = p - a, n - p - b
        under = (a + b) * (c + d) * (a + c) * (b + d)
        return n * (a * d - b * c) ** 2 / under if under else 0.0
    return sorted(df, key=lambda f: (-chi(f), f))[:size]


def design(texts: list[str], vocab: list[str]):
    """Rows, columns and values of the sparse matrix of feature densities in percent."""
    at = {f: j for j, f in enumerate(vocab)}
    r, c, v = [], [], []
    for i, t in enumerate(texts):
        fs, n = text_features(t)
        own = [(at[f], 100.0 * k / (n + SMOOTH)) for f, k in fs.items() if f in at]
        r.append(np.full(len(own), i))
        c.append(np.array([x[0] for x in own], np.int64))
        v.append(np.array([x[1] for x in own]))
    return np.concatenate(r).astype(np.int64), np.concatenate(c), np.concatenate(v)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(matrix, n: int, p: int, grade: np.ndarray, weight: np.ndarray, grades: int, ridge: float = 1e-4, steps: int = 400):
    """Weights shared by all thresholds, and increasing thresholds t: P(grade > k) = sigmoid(x w - t_k).

    Full-batch gradient steps with per-coordinate scaling (Adam) on the weighted mean likelihood with a ridge.
    Thresholds are t_0 and sums of exponentials, so they stay in order.
    """
    r, c, v = matrix
    w, raw = np.zeros(p), np.zeros(grades - 1)
    weight = weight / weight.sum()
    over = [min(max((weight * (grade > k)).sum(), 1e-4), 1 - 1e-4) for k in range(grades - 1)]
    start = [-np.log(q / (1 - q)) for q in over]
    raw[0] = start[0]
    for k in range(1, grades - 1):
        raw[k] = np.log(max(start[k] - start[k - 1], 1e-2))
    theta = np.concatenate([w, raw])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, raw = theta[:p], theta[p:]
        gaps = np.exp(raw[1:])
        t = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(r, weights=v * w[c], minlength=n) if len(r) else np.zeros(n)
        upper = np.ones((n, grades + 1))
        upper[:, grades] = 0.0
        upper[:, 1:grades] = sigmoid(eta[:, None] - t)
        each = np.maximum(upper[np.arange(n), grade] - upper[np.arange(n), grade + 1], 1e-12)
        slope = upper * (1 - upper)
        d_eta = weight * (slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / each
        d_t = np.zeros(grades - 1)
        for k in range(grades - 1):
            d_t[k] = -(weight * slope[:, k + 1] / each * ((grade == k + 1).astype(float) - (grade == k))).sum()
        g_raw = np.concatenate([[d_t.sum()], [d_t[k:].sum() * gaps[k - 1] for k in range(1, grades - 1)]])
        g_w = (np.bincount(c, weights=v * d_eta[r], minlength=p) if len(r) else np.zeros(p)) - ridge * w
        g = np.concatenate([g_w, g_raw])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta + 0.05 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-10)
    raw = theta[p:]
    return theta[:p], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def fit(sample, grades: int = 3, features: int = 4_000, least: int = 3) -> dict:
    """Model from (id, text, toxic 0/1, weight) rows.

    Grades above 0 follow from the labels: a first fit with one threshold scores the toxic
    documents, and quantiles of these scores part them into grades 1 .. grades - 1 of rising severity.
    The second fit shares its weights between all thresholds.
    """
    if len({r[2] for r in sample}) < 2:
        return {"weights": {}, "thresholds": [20.0 + k for k in range(grades - 1)]}
    texts = [r[1] for r in sample]
    toxic, weight = np.array([r[2] for r in sample]), np.array([r[3] for r in sample])
    vocab = vocabulary(texts, toxic, features, least)
    matrix = design(texts, vocab)
    n, p = len(sample), len(vocab)
    w, _ = fit_ordinal(matrix, n, p, toxic, weight, 2)
    eta = np.bincount(matrix[0], weights=matrix[2] * w[matrix[1]], minlength=n)
    cuts = np.quantile(eta[toxic == 1], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(toxic == 1, 1 + (eta[:, None] > cuts).sum(1), 0)
    w, t = fit_ordinal(matrix, n, p, grade, weight, grades)
    return {"weights": {f: float(x) for f, x in zip(vocab, w) if abs(x) > 1e-6}, "thresholds": t.tolist()}


def _scorer(model, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        weights, t = m["weights"], np.array(m["thresholds"])
        memo = worker_cache(f"toxicity:{key}")

        def missing(w):
            if len(memo) > MEMO_WORDS:
                memo.clear()
            got = memo[w] = sum(weights.get(f, 0.0) for f in word_features(w))
            return got

        def eta(text):
            ws = WORD.findall(text.lower())
            return 100.0 * sum([memo[w] if w in memo else missing(w) for w in ws]) / (len(ws) + SMOOTH)

        for batch in batches:
            e = np.array([eta(x.as_py() or "") for x in batch.column(1)])
            over = sigmoid(e[:, None] - t)
            probs = -np.diff(np.concatenate([np.ones((len(e), 1)), over, np.zeros((len(e), 1))], 1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(over.sum(1)), pa.array(probs.argmax(1).astype(np.int32)), pa.array(over[:, 0])],
                                             names=["doc_id", "severity", "grade", "p_toxic"])
    return run


def severity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", grades: int = 3, per_class: int = 2_500,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, severity, grade, p_toxic, toxic) of every row of ``docs``.

    ``severity`` is the expected grade, the sum of P(grade > k) over the thresholds, ``grade`` the
    likeliest one, ``toxic`` whether P(grade > 0) is at least 0.5. Features are densities of words and
    word beginnings over the whole lower-cased text. The model is fitted on the bounded sample of
    labelled_sample() (``per_class``). Null and empty texts have no features and get the base rate. Without labels
    of both classes nothing counts as toxic.
    """
    import uuid

    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(fit(labelled_sample(docs, labels, label_col, per_class, id_col, text_col), grades))  # at most 4,000 weights
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scorer(model, uuid.uuid4().hex), "doc_id bigint, severity double, grade int, p_toxic double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "grade", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))
