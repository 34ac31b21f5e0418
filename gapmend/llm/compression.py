"""Quality by compression: which of two zstandard dictionaries suits a text better."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapmend.llm.labelled import held_out, labelled_sample

#: Bytes of a piece: small enough for the dictionary to matter all along a long text.
PIECE = 1024
LEVEL = 3


def pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i:i + PIECE] for i in range(0, len(raw), PIECE)]


def difference(good, bad):
    """text -> (bad size - good size) / (bad size + good size) over all its pieces; 0 without bytes."""
    import zstandard as z

    pair = [z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            if d else z.ZstdCompressor(level=LEVEL, write_content_size=False) for d in (good, bad)]

    def value(text: str) -> float:
        parts = pieces(text)
        g, b = (sum(len(c.compress(p)) for p in parts) for c in pair)
        return (b - g) / (b + g) if parts else 0.0
    return value


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from sample pieces; too few pieces for the trainer serve as raw content."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method; x has a column of ones first."""
    b = np.zeros(x.shape[1])
    w = w / w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        pull = ridge * np.r_[0, b[1:]]
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-9, np.full(len(b) - 1, ridge)]), x.T @ (w * (y - p)) - pull)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def calibration_terms(d: np.ndarray) -> np.ndarray:
    """1 and the scaled difference."""
    return np.stack([np.ones_like(d), d / 0.05], 1)


def fit(sample, dict_bytes: int = 65_536, dict_samples: int = 8_000) -> dict:
    """Model from (id, text, label, weight) rows: two dictionaries from every other row of each
    class, and the calibration of the difference from the remaining rows."""
    for_dict, for_cal, seen = {0: [], 1: []}, [], {0: 0, 1: 0}
    for _, text, label, weight in sample:
        if seen[label] % 2 == 0:
            for_dict[label] += pieces(text)
        else:
            for_cal.append((text, label, weight))
        seen[label] += 1
    good, bad = (train_dictionary(for_dict[c][:dict_samples], dict_bytes) for c in (1, 0))
    value = difference(good, bad)
    if len({r[1] for r in for_cal}) < 2:
        share = sum(r[3] for r in sample if r[2]) / max(1e-9, sum(r[3] for r in sample)) if sample else 0.5
        share = min(max(share, 0.01), 0.99)
        return {"good": good, "bad": bad, "b": [float(np.log(share / (1 - share))), 0.0]}
    d = np.array([value(t) for t, _, _ in for_cal])
    b = logistic(calibration_terms(d), np.array([r[1] for r in for_cal], float), np.array([r[2] for r in for_cal]))
    return {"good": good, "bad": bad, "b": b.tolist()}


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        value = difference(m["good"], m["bad"])
        for batch in batches:
            d = np.array([value(t.as_py() or "") for t in batch.column(1)])
            score = 1 / (1 + np.exp(-np.clip(calibration_terms(d) @ np.array(m["b"]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d), pa.array(score)], names=["doc_id", "difference", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = 6_000,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, difference, score, predicted) of every row of ``docs``.

    The only input of a score is the whole text. It is cut into pieces of PIECE bytes, each is
    compressed with a dictionary from good and one from bad texts, and the normalised
    difference of the total sizes goes through a logistic calibration. The model is fitted on the bounded sample of
    labelled_sample() (``per_class``). Null and empty texts have difference 0. Without labels of
    both classes the score is the share of good labels.
    """
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(fit(labelled_sample(docs, labels, label_col, per_class, id_col, text_col)))  # two dictionaries of 64 KB
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scorer(model), "doc_id bigint, difference double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "difference", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
