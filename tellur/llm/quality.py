"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is a vector of its hashed words and of measures of its
characters and words, which a learned layer encodes; a gated attention (the product of a tanh and a sigmoid branch)
weighs the passages, and a logistic layer scores the weighted sum. All weights are learned together from labels of
documents, of which few are gone through more often than many, so that about as many steps are made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tellur.llm.common import _CODES, _POWERS, fit, kept, labelled, mix, read, runs, scored

PASSAGE = 64
#: Labelled rows that the model is fitted on, about, at most.
MOST = 8_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 16, 8, 30, 64, 0.01, 1e-4

# Kinds of bytes: 0 other symbols, then these.
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".?", b"!", b",;:", b"$%&#*@", b"|", b"'\"()-"]
_KIND = np.zeros(256, np.int64)
for _i, _chars in enumerate(_KINDS, 1):
    _KIND[list(_chars)] = _i
_KIND[128:] = len(_KINDS) + 1
N_KINDS = len(_KINDS) + 2
#: Buckets of hashed words (lower-cased ASCII letters, other characters as they are) in a passage's vector, behind the measures.
BUCKETS = 128
N_MEASURES = N_KINDS + 7
N_FEATURES = N_MEASURES + BUCKETS
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of every passage, and where each text's passages begin. A text without words is one passage.

    A bucket holds the root of the share of the passage's words that are hashed to it.
    """
    raw = [(t or "").encode("utf-8", "replace") + b" " for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    kind = _KIND[buf]
    blank = (kind == 4) | (kind == 5)
    first = ~blank
    first[1:] &= blank[:-1]
    begin = np.flatnonzero(first)  # of words
    ends = np.cumsum([len(x) for x in raw])
    word_starts = np.concatenate([[0], np.searchsorted(begin, ends)])
    n_words = np.diff(word_starts)
    n_parts = np.maximum(1, -(-n_words // PASSAGE))
    part_starts = np.concatenate([[0], np.cumsum(n_parts)])
    rank = np.arange(len(begin)) - np.repeat(word_starts[:-1], n_words)
    part_of_word = np.repeat(part_starts[:-1], n_words) + rank // PASSAGE
    total = part_starts[-1]
    text_of_byte = np.repeat(np.arange(len(raw)), np.diff(np.concatenate([[0], ends])))
    word_of_byte = np.cumsum(first) - 1
    lead = word_of_byte < word_starts[text_of_byte]  # blanks before a text's first word
    part_of_byte = part_starts[text_of_byte]
    if len(begin):
        part_of_byte = np.where(lead, part_of_byte, part_of_word[np.maximum(word_of_byte, 0)])
    counts = np.bincount(part_of_byte * N_KINDS + kind, minlength=total * N_KINDS).reshape(total, N_KINDS).astype(float)
    size = counts.sum(axis=1, keepdims=True)
    out = np.zeros((total, N_FEATURES), np.float32)
    out[:, :N_KINDS] = np.sqrt(counts / np.maximum(1, size))
    words = np.bincount(part_of_word, minlength=total).astype(float) if len(begin) else np.zeros(total)
    out[:, N_KINDS] = np.log1p(words) / 4
    if len(begin):
        stop = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        length = (stop - begin).astype(float)
        per = np.maximum(1, words)
        mean = np.bincount(part_of_word, length, total) / per
        out[:, N_KINDS + 1] = np.log1p(mean)
        out[:, N_KINDS + 2] = np.sqrt(np.maximum(0, np.bincount(part_of_word, length**2, total) / per - mean**2)) / (1 + mean)
        letters = np.flatnonzero(~blank)
        place = (letters - np.repeat(begin, stop - begin)) & 63
        heads = np.concatenate([[0], np.cumsum(stop - begin)[:-1]])
        with np.errstate(over="ignore"):
            h = mix(np.add.reduceat(_CODES[buf[letters]] * _POWERS[place], heads))
            bucket = (mix(np.add.reduceat(_CODES[_LOWER[buf[letters]]] * _POWERS[place], heads)) % np.uint64(BUCKETS)).astype(np.int64)
        share = np.bincount(part_of_word * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / per[:, None]
        out[:, N_MEASURES:] = np.sqrt(share)
        key = np.sort((part_of_word.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        out[:, N_KINDS + 3] = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=total) / per
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (part_of_word[1:] == part_of_word[:-1])])
        out[:, N_KINDS + 4] = np.bincount(part_of_word[again], minlength=total) / per
        long = length > 24
        out[:, N_KINDS + 5] = np.bincount(part_of_word[long], minlength=total) / per
    out[:, N_KINDS + 6] = words == 0
    return out, part_starts


def forward(m: dict, x: np.ndarray, starts: np.ndarray) -> tuple:
    bag = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    xs = (x - m["mean"]) / m["std"]
    h = np.tanh(xs @ m["w1"] + m["b1"])
    t, g = np.tanh(h @ m["v"]), 1 / (1 + np.exp(-h @ m["u"]))
    e = (t * g) @ m["a"]
    e = np.exp(e - np.maximum.reduceat(e, starts[:-1])[bag])
    att = e / np.add.reduceat(e, starts[:-1])[bag]
    z = np.add.reduceat(att[:, None] * h, starts[:-1])
    s = z @ m["c"] + m["d"]
    return xs, bag, h, t, g, att, z, 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def gradients(m: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    xs, bag, h, t, g, att, z, p = forward(m, x, starts)
    ds = (p - y) / len(y)
    dz = np.outer(ds, m["c"])
    d_att = (dz[bag] * h).sum(axis=1)
    de = att * (d_att - np.add.reduceat(att * d_att, starts[:-1])[bag])
    dt, dg = np.outer(de, m["a"]) * g * (1 - t**2), np.outer(de, m["a"]) * t * g * (1 - g)
    dh = (att[:, None] * dz[bag] + dt @ m["v"].T + dg @ m["u"].T) * (1 - h**2)
    return {"w1": xs.T @ dh, "b1": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}


def train(frame: pd.DataFrame) -> dict | None:
    if frame.y.nunique() < 2:
        return None
    parts = [passages(run) for run in runs(frame.text)]  # in runs: measuring takes about a hundred bytes for each of text
    x, starts = np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s) for _, s in parts]))])
    y, rng = frame.y.to_numpy(float), np.random.default_rng(7)
    m = {"mean": x.mean(axis=0), "std": x.std(axis=0) + 1e-3}
    for k, shape in (("w1", (N_FEATURES, HIDDEN)), ("b1", (HIDDEN,)), ("v", (HIDDEN, GATE)), ("u", (HIDDEN, GATE)), ("a", (GATE,)), ("c", (HIDDEN,)), ("d", (1,))):
        m[k] = rng.normal(0, 1 / np.sqrt(shape[0]), shape) * (k not in ("b1", "d"))
    first, second, step = {}, {}, 0
    epochs = max(EPOCHS, 3_000 * BATCH // len(y))  # few documents: more rounds, so that as many steps are made
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            n = starts[own + 1] - starts[own]
            rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in own])
            step += 1
            for k, d in gradients(m, x[rows], np.concatenate([[0], np.cumsum(n)]), y[own]).items():
                d = d + DECAY * m[k]
                first[k] = 0.9 * first.get(k, 0) + 0.1 * d
                second[k] = 0.999 * second.get(k, 0) + 0.001 * d * d
                m[k] = m[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def score(model: dict, texts: list[str]) -> np.ndarray:
    return forward(model, *passages(texts))[-1]


def model_of(docs: DataFrame, labels: DataFrame, most: int = MOST):
    return fit(labelled(docs, labels, "quality", most), train)


def quality(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`, fitted on `labels` (doc_id, quality).

    Whole texts of any length are scored; the model is fitted on about `most` rows and MOST_BYTES bytes at most. Null and
    empty texts are one passage without words, marked as such. Rows with a null id are scored, not held out and
    never trained on; repeated rows score alike. Without labels of both kinds every score is 0.5. Other columns take no
    part. An empty table gives none.
    """
    return scored(docs, model_of(docs, labels, most), score, threshold)


def good(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, that are predicted good: a score of the threshold or more.

    A row is judged by its own text, so null ids, repeated rows and ties change nothing; null and empty texts are judged
    as in `quality`. Without labels of both kinds no row goes. An empty table gives none.
    """
    return kept(docs, model_of(docs, labels, most), score, threshold, high=True)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all `documents`."""
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
