"""Helpers that the corpus operators share: checkpoints, and words of many texts as numpy arrays."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellur.sources.durable import durable, shared_folder  # noqa: F401  for the operators

#: The word definition that the size and shingle contracts share: runs without space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: the CRC-32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# Bytes of words: ASCII letters and digits, and every byte of a character beyond ASCII.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all their bits (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


_POWERS = np.cumprod(np.full(64, _ODD, np.uint64))
_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def runs(texts: Iterable[str | None], most: int = 1 << 19) -> Iterator[list[str]]:
    """The texts in order, in runs of about `most` characters. None counts as empty."""
    run, n = [], 0
    for t in texts:
        run.append(t or "")
        n += len(run[-1])
        if n >= most:
            yield run
            run, n = [], 0
    if run:
        yield run


#: A key with so many rows and over a thousandth of all is joined in SALTS parts.
HOT_ROWS, SALTS = 10_000, 64


def joined(rows: DataFrame, classes: DataFrame, on: list[str], counts: DataFrame) -> DataFrame:
    """Inner join of written `rows` with one row of `classes` for each key; `counts` has the keys with the number of their rows as `times`.

    Rows of a hot key are dealt over SALTS parts and its class is sent to each, so no task gets more than a part of them.
    Hot keys are fewer than a thousand, so they are broadcast.
    """
    total = counts.agg(F.sum("times")).first()[0] or 0
    hot = durable(counts.where(F.col("times") > max(HOT_ROWS, total / 1000)).select(*on, F.lit(True).alias("_hot")))
    if not hot.count():
        return rows.join(classes, on)
    part = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")  # of a written table, so retries agree
    dealt = rows.withColumn("_part", part).join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.col("_part")).otherwise(0)).drop("_hot", "_part")
    sent = classes.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(sent, [*on, "_salt"]).drop("_salt")


#: Bytes of text that a model is fitted on, about, at most.
MOST_BYTES = 1 << 27


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, text, y): about `most` labelled training rows and `most_bytes` bytes of them at most, chosen by a hash of the id among rows that aren't held out.

    Labels other than 0 and 1 are left out; of several labels of a document the greatest counts. The chosen ids are
    bounded by `most`, so they are broadcast and no text is shuffled to find them. Rows that repeat an id are all taken.
    """
    y = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y")).where(~held_out(F.col("id")))
    if (n := y.count()) > most:
        y = y.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    rows = durable(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(y), "id"))
    found = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    share = min(most / max(1, found.n), most_bytes / max(1, found.bytes or 0))
    if share >= 0.9 and (found.bytes or 0) <= most_bytes:  # a choice by hash is about as many
        return rows
    return rows.where(F.pmod(F.xxhash64("id", F.lit(1), F.md5(F.coalesce("text", F.lit("")))), F.lit(1 << 20)) < int((1 << 20) * share))


def fit(rows: DataFrame, train) -> object:
    """What `train` makes of the bounded training rows (a pandas frame with id, text, y, sorted), in one task."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [*frames]
        if held and sum(map(len, held)):
            frame = pd.concat(held).sort_values(["id", "text"], ignore_index=True)
            frame = frame.iloc[np.argsort(mix(frame.id.to_numpy(np.int64).view(np.uint64)), kind="stable")].reset_index(drop=True)
            yield pd.DataFrame({"model": [pickle.dumps(train(frame))]})

    found = rows.repartition(1).mapInPandas(work, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def scored(docs: DataFrame, model: object, score, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row by `score(model, texts)`; without a model every score is 0.5."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [score(sent.value, run) if sent.value is not None else np.full(len(run), 0.5) for run in runs(x.as_py() for x in b.column(1))]
            s = np.concatenate(done) if done else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: object, score, threshold: float, high: bool, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose score is at least the threshold (`high`) or under it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [score(sent.value, run) for run in runs(x.as_py() for x in b.column(at))]
            s = np.concatenate(done) if done else np.empty(0)
            yield b.filter(pa.array((s >= threshold) == high, pa.bool_()))

    return docs if model is None else docs.mapInArrow(work, docs.schema)


def word_hashes(texts: list[str | None], stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the lower-cased words of some texts, in order, and where each text's words begin (one more at the end).

    For each of `stems`, the hashes of the words' first so many bytes follow. A word is a run of ASCII letters, digits
    and characters beyond ASCII.
    """
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in raw])
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = _WORD_BYTE[buf]
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.empty(0, np.uint64)
        return none, np.zeros(len(texts) + 1, np.int64), *(none for _ in stems)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=new[1:])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at)))
    place = (np.arange(len(at)) - np.repeat(first, length)) & 63
    with np.errstate(over="ignore"):
        codes = _CODES[buf[at]] * _POWERS[place]
        h = np.add.reduceat(codes, first)
        cut = [mix(np.add.reduceat(np.where(place < n, codes, np.uint64(0)), first) + np.uint64(n)) for n in stems]
    return mix(h), np.concatenate([[0], np.searchsorted(at[first], ends)]), *cut
