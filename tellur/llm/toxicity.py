"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, their stems (first bytes), pairs of neighbours and pairs that skip one word, each hashed to 2**BITS
buckets and counted once a document. Per-coordinate learning rates and L1 sparsity leave few weights, which every task
gets; a document's score needs only the features with weights. The strength of L1 follows the root of the number of
training documents, within bounds, as sums of gradients do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tellur.llm.common import fit, kept, labelled, mix, read, scored, word_hashes

BITS, STEM = 20, 4
#: Labelled rows that the weights are fitted on, about, at most.
MOST = 12_000
#: A feature needs so many training documents to be learned.
LEAST_DOCS = 3
ALPHA, BETA, L2, EPOCHS = 1.0, 1.0, 0.0, 4


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram, skip-gram and stem, repeats included."""
    h, starts, stem = word_hashes(texts, (STEM,))
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    keys, owners = [h, stem], [of, of]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, np.uint64(0xD6E8FEB86659FD93)), (2, np.uint64(0xA0761D6478BD642F))):
            if len(h) > gap:
                inside = of[:-gap] == of[gap:]
                keys.append(mix(h[:-gap] * salt + h[gap:])[inside])
                owners.append(of[:-gap][inside])
    return np.concatenate(owners), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def l1(documents: int) -> float:
    return min(4.0, max(0.75, documents**0.5 / 30))


def train(frame: pd.DataFrame) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(bias, buckets, weights): one update for each document and epoch, in the frame's order."""
    if frame.y.nunique() < 2:
        return None
    keys = []
    for i in range(0, len(frame), 64):
        of, b = features(frame.text.iloc[i : i + 64].tolist())
        keys.append(np.unique(((of + i) << BITS) | b))
    keys = np.concatenate(keys)
    of, b = keys >> BITS, keys & ((1 << BITS) - 1)
    common = np.bincount(b, minlength=1 << BITS)[b] >= LEAST_DOCS
    of, b = of[common], b[common]
    cuts = np.searchsorted(of, np.arange(1, len(frame)))
    docs = [np.append(x, 1 << BITS) for x in np.split(b, cuts)]  # the last is the bias
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    w = np.zeros((1 << BITS) + 1)
    shrink = np.full((1 << BITS) + 1, l1(len(frame)))
    shrink[-1] = 0
    for _ in range(EPOCHS):
        for f, y in zip(docs, frame.y.to_numpy(), strict=True):
            p = 1 / (1 + np.exp(-np.clip(w[f].sum(), -35, 35)))
            g = p - y
            n2 = n[f] + g * g
            z[f] += g - (np.sqrt(n2) - np.sqrt(n[f])) / ALPHA * w[f]
            n[f] = n2
            zf = z[f]
            w[f] = np.where(np.abs(zf) <= shrink[f], 0, -(zf - np.sign(zf) * shrink[f]) / ((BETA + np.sqrt(n2)) / ALPHA + L2))
    used = np.flatnonzero(w[:-1])
    return float(w[-1]), used, w[used]


def score(model: tuple[float, np.ndarray, np.ndarray], texts: list[str]) -> np.ndarray:
    bias, used, weights = model
    dense = _dense(used.tobytes(), weights.tobytes())
    of, b = features(texts)
    x = dense[b]
    live = x != 0
    pairs = np.unique((of[live] << (BITS + 1)) | b[live])
    total = bias + np.bincount(pairs >> (BITS + 1), dense[pairs & ((1 << (BITS + 1)) - 1)], len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


_DENSE: dict[int, np.ndarray] = {}


def _dense(used: bytes, weights: bytes) -> np.ndarray:
    """The weights as an array over all buckets, made once in a worker."""
    key = hash((used, weights))
    if key not in _DENSE:
        _DENSE.clear()
        _DENSE[key] = np.zeros(1 << BITS)
        _DENSE[key][np.frombuffer(used, np.int64)] = np.frombuffer(weights)
    return _DENSE[key]


def model_of(docs: DataFrame, labels: DataFrame, most: int = MOST):
    return fit(labelled(docs, labels, "toxic", most), train)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`, fitted on `labels` (doc_id, toxic).

    Whole texts of any length are scored; the weights are fitted on about `most` rows and MOST_BYTES bytes at most. Null
    and empty texts have the score of a text without features. Rows with a null id are scored, not held out and
    never trained on; repeated rows score alike. Without labels of both kinds every score is 0.5. Other columns take no
    part. An empty table gives none.
    """
    return scored(docs, model_of(docs, labels, most), score, threshold)


def clean(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, that aren't predicted toxic: a score under the threshold.

    A row is judged by its own text, so null ids, repeated rows and ties change nothing; null and empty texts are judged
    as in `toxicity`. Without labels of both kinds no row goes. An empty table gives none.
    """
    return kept(docs, model_of(docs, labels, most), score, threshold, high=False)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all `documents`."""
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
