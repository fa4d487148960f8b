"""Benchmark decontamination by latent semantic retrieval.

Words of the benchmark are the terms; all passages of the corpus make a TF-IDF matrix over them. A randomised SVD, with
its products summed over all partitions, gives a latent space for that matrix. Windows of each document, as long as a
benchmark item and a little more, are compared with the items there by cosine. An exact look-up by each item's rarest
words adds every other window that can hold enough of an item, so no cosine decides what is found. Candidates must then
hold enough of the item's words, a long enough longest common subsequence with it, and the item's answer (its last sentence).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.llm.common import durable, read, runs, word_hashes

#: Words in a step between windows, and in a passage of the TF-IDF matrix.
STEP, PASSAGE = 8, 32
#: Rank of the factorisation, and how many of its leading directions, those of language and common words, are left out.
RANK, COMMON = 64, 16
#: Least cosine of a candidate, least shares of the item's words in the common subsequence, and of its answer's.
COSINE, LCS, ANSWER = 0.35, 0.7, 0.5
#: Of an item's rarest words, one for each that a copy may lack and so many more are looked up; a window needs so many of them.
RARE = 2
#: Bytes of benchmark text that one search holds, so 800,000 distinct words or so and 200 MB of their vectors at most; a larger benchmark is searched in parts.
MOST_BYTES = 4_000_000
#: Windows, and items, whose cosines are at hand at once.
AT_ONCE = 4_096
#: Sums that meet in one task when those of all partitions are added up.
FAN = 64


def answer_of(text: str) -> str:
    """The last sentence with a word."""
    parts = [x for x in re.split(r"[.?!]+", text or "") if re.search(r"\w", x)]
    return parts[-1] if parts else ""


class Items:
    """The benchmark's items as codes: 0 is any word that no item has, term i of the sorted hashes is i + 1."""

    def __init__(self, ids: list[int], texts: list[str]):
        h, starts = word_hashes(texts)
        ah, a_starts = word_hashes([answer_of(t) for t in texts])
        self.ids = np.array(ids, np.int64)
        self.terms = np.unique(h)
        code = lambda x: (np.searchsorted(self.terms, x) + 1).astype(np.int64)
        self.words = [code(h[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
        self.answers = [code(ah[a:b]) for a, b in zip(a_starts, a_starts[1:], strict=False)]

    def codes(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at + 1, 0).astype(np.uint32)


def places_of(a: np.ndarray) -> dict[int, int]:
    """For each value of a, the places where it occurs as the bits of one integer."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    return places


def lcs(a: np.ndarray, b: np.ndarray, places: dict[int, int] | None = None) -> int:
    """The length of the longest common subsequence, bit by bit of one integer for all of a (Crochemore et al., 2001)."""
    places = places_of(a) if places is None else places
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := places.get(x, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def sums_of(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row of `at` the sum of the table's rows that it names. A product with ones is several times as fast as numpy's own sum."""
    rows = np.take(table, at.ravel(), axis=0).reshape(*at.shape, table.shape[1])
    return np.matmul(np.ones((1, at.shape[1]), table.dtype), rows)[:, 0]


def sums_by(keys: np.ndarray, rows: np.ndarray, table: np.ndarray, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, for each the sum of the table's rows named by `rows` beside it); the table's last row is zeros.

    Rows of a key are filled up to a multiple of `width` by the last one, summed so many at a time, and then by key.
    """
    order = np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")
    keys, rows = keys[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(first, len(keys)))
    lots = -(-n // width)
    start = np.concatenate([[0], np.cumsum(lots)])
    at = np.full(start[-1] * width, len(table) - 1)
    at[np.repeat(start[:-1] * width - first, n) + np.arange(len(keys))] = rows
    return keys[first], np.add.reduceat(sums_of(table, at.reshape(-1, width)), start[:-1], dtype=np.float64)


def encode(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(id, codes): every document's words as codes, four bytes each."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for run in runs(x.as_py() for x in b.column(1)):
                h, starts = word_hashes(run)
                c = sent.value.codes(h)
                out += [c[i:j].tobytes() for i, j in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "codes"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(work, "id bigint, codes binary")


def _groups(batches: Iterator[pa.RecordBatch], least: int, more: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, codes of many documents, and where each begins; each is filled up by zeros to steps, and by `more` zeros."""
    ids, parts, n = [], [], 0
    for b in batches:
        for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            c = np.frombuffer(raw.as_py(), np.uint32)
            ids.append(i)
            parts.append(np.concatenate([c, np.zeros(-len(c) % PASSAGE + more, np.uint32)]))
            n += len(parts[-1])
            if n >= least:
                yield ids, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                ids, parts, n = [], [], 0
    if ids:
        yield ids, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def idf(encoded: DataFrame, n_terms: int) -> np.ndarray:
    """Log inverse passage frequency of each code, over all passages; the largest for code 0 and unseen terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, passages = np.zeros(n_terms + 1, np.int64), 0
        for _, codes, _ in _groups(batches, 1 << 18, 0):
            c = np.sort(codes.reshape(-1, PASSAGE), axis=1)
            seen += np.bincount(c[:, 0], minlength=n_terms + 1) + np.bincount(c[:, 1:][c[:, 1:] != c[:, :-1]], minlength=n_terms + 1)
            passages += len(c)
        seen[0] = passages
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["code", "n"])

    found = encoded.mapInArrow(work, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()  # a row for each benchmark term at most
    df = np.zeros(n_terms + 1)
    df[[r.code for r in found]] = [r.n for r in found]
    total = max(1.0, df[0])
    out = np.log((1 + total) / (1 + df))
    out[0] = math.log(1 + total)
    return np.maximum(out, 1e-3)


def latent(encoded: DataFrame, items: Items, weights: np.ndarray, rank: int, common: int, seed: int = 11) -> np.ndarray:
    """(codes x dimensions) right singular vectors of the TF-IDF matrix of all passages and items, without the `common` leading ones.

    The randomised range finder of Halko, Martinsson and Tropp with one power step: A'A times a random matrix, one sum
    for each partition, added up by slices of terms on the executors, FAN at a time. The space of few terms has fewer
    dimensions, and as large a share of them is left out.
    """
    n = len(weights)
    encoded = encoded.coalesce(max(1, 4 * encoded.sparkSession.sparkContext.defaultParallelism))  # sums for each core, not for each file
    probe = (np.random.default_rng(seed).normal(size=(n, rank)) * weights[:, None]).astype(np.float32)
    probe[0] = 0
    sent = encoded.sparkSession.sparkContext.broadcast(probe)
    slice_of = 512

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((n, rank))
        for _, codes, _ in _groups(frames, 1 << 17, 0):
            at = np.flatnonzero(codes)
            if not len(at):
                continue
            y = sums_of(sent.value, codes.reshape(-1, PASSAGE))
            terms, sums = sums_by(codes[at], at // PASSAGE, np.concatenate([y, np.zeros((1, rank), y.dtype)]))
            z[terms] += sums
        from pyspark import TaskContext

        rows = [(i, z[i : i + slice_of].tobytes()) for i in range(0, n, slice_of)]
        lane = pa.array([TaskContext.get().partitionId() // FAN] * len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lane, pa.array([r[1] for r in rows], pa.binary())], names=["at", "lane", "z"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(frame.z.iloc[0]) // 8)
        for x in frame.z:
            total += np.frombuffer(x)
        return pd.DataFrame({"at": frame["at"].iloc[:1], "lane": frame.lane.iloc[:1] // FAN, "z": [total.tobytes()]})

    schema = "at bigint, lane bigint, z binary"
    parts, lanes = encoded.mapInArrow(work, schema), encoded.rdd.getNumPartitions()
    while lanes > 1:
        parts, lanes = parts.groupBy("at", "lane").applyInPandas(add, schema), -(-lanes // FAN)
    z = np.zeros((n, rank))
    for r in parts.collect():  # the benchmark's terms x rank numbers
        z[r["at"] : r["at"] + slice_of] = np.frombuffer(r.z).reshape(-1, rank)
    for w in items.words:
        np.add.at(z, w, probe[w].sum(axis=0))
    left = np.linalg.svd(z * weights[:, None], full_matrices=False)[0]
    return left[:, common * left.shape[1] // rank :]


def rare_words(items: Items, weights: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts by code, items, how many of its words an item needs): the items that are looked up by each code.

    A common subsequence of `share` of an item lacks a bounded number of its words. Of any words of the item, that many and
    k more, the window holds k at least. The choice of the rarest ones only bounds the work.
    """
    codes, owners, needs = [], [], np.ones(len(items.words), np.int64)
    for i, w in enumerate(items.words):
        least = max(1, math.ceil(share * len(w) - 1e-9))
        needs[i] = min(RARE, least)
        chosen = np.unique(w[np.argsort(-weights[w], kind="stable")[: len(w) - least + needs[i]]])
        codes.append(chosen)
        owners.append(np.full(len(chosen), i))
    codes, owners = np.concatenate([*codes, np.empty(0, np.int64)]), np.concatenate([*owners, np.empty(0, np.int64)])
    order = np.argsort(codes, kind="stable")
    return np.searchsorted(codes[order], np.arange(len(weights) + 1)), owners[order], needs


def looked_up(codes: np.ndarray, rare: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(step, item) for each place of a word by which an item is looked up."""
    starts, owners, _ = rare
    n = np.diff(starts)[codes]
    at = np.flatnonzero(n)
    n = n[at]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at // STEP, n), owners[np.repeat(starts[codes[at]], n) + place]


def search(encoded: DataFrame, items: Items, weights: np.ndarray, basis: np.ndarray, cosine: float, share: float, answer: float) -> DataFrame:
    """(doc_id, item_id, cosine, lcs): the best window of each document and item that passes all checks.

    Candidates are windows of a cosine of `cosine` or more and those of the look-up, whose cosine may be less.
    """
    vectors = (basis * weights[:, None]).astype(np.float32)
    vectors[0] = 0
    longest = max(map(len, items.words), default=0)
    fill = (-(-longest // STEP) + 1) * STEP
    fill += -fill % PASSAGE
    sent = encoded.sparkSession.sparkContext.broadcast((vectors, items, rare_words(items, weights, share)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, own, rare = sent.value
        rank = v.shape[1]
        by_steps: dict[int, list[int]] = {}
        for i, w in enumerate(own.words):
            if len(w):
                by_steps.setdefault(-(-len(w) // STEP) + 1, []).append(i)
        aims = {m: np.array([v[own.words[i]].sum(axis=0) for i in at]) for m, at in by_steps.items()}
        aims = {m: x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True)) for m, x in aims.items()}
        column, length = np.zeros(len(own.words), np.int64), np.zeros(len(own.words), np.int64)  # of an item in its aims, and its steps
        for m, x in by_steps.items():
            column[x], length[x] = np.arange(len(x)), m
        # Which words an item has, as marks at the hashes of (item, code): a mark may be that of another pair, none is missing.
        bits = min(26, max(21, (128 * sum(map(len, own.words))).bit_length()))
        marks = np.zeros(1 << bits, bool)
        place = lambda t, w: ((t * len(v) + w).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        for i, w in enumerate(own.words):
            marks[place(i, w)] = True
        places, sizes = [places_of(w) for w in own.words], np.array([len(w) for w in own.words])
        for ids, codes, starts in _groups(batches, 1 << 16, fill):
            steps = codes.reshape(-1, STEP)
            total = np.zeros((len(steps) + 1, rank), np.float32)
            np.cumsum(sums_of(v, steps), axis=0, out=total[1:])
            doc = np.repeat(np.arange(len(ids)), np.diff(starts) // STEP)
            step, of = looked_up(codes, rare)
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for m, aim in aims.items():
                if len(steps) < m:
                    continue
                w = total[m:] - total[:-m]
                w /= np.maximum(1e-6, np.linalg.norm(w, axis=1, keepdims=True))
                mine = length[of] == m
                first = step[mine][:, None] - np.arange(m)  # the windows that a place is in
                keys = (first * len(aim) + column[of[mine]][:, None])[(first >= 0) & (first < len(w))]
                keys, times = np.unique(keys, return_counts=True)
                wanted = [keys[times >= rare[2][np.array(by_steps[m])[keys % len(aim)]]]]
                for i in range(0, len(w), AT_ONCE):
                    for j in range(0, len(aim), AT_ONCE):
                        at, which = np.nonzero(w[i : i + AT_ONCE] @ aim[j : j + AT_ONCE].T >= cosine)
                        wanted.append((at + i) * len(aim) + which + j)
                at, which = np.divmod(np.unique(np.concatenate(wanted)), len(aim))
                one = doc[at] == doc[at + m - 1]
                at, which = at[one], which[one]
                item = np.array(by_steps[m])[which]
                for i in range(0, len(at), AT_ONCE):
                    a, t = at[i : i + AT_ONCE], item[i : i + AT_ONCE]
                    words = codes[(a * STEP)[:, None] + np.arange(m * STEP)]
                    held = np.count_nonzero(marks[place(t[:, None], words)], axis=1)
                    need = share * sizes[t]
                    sims = (w[a] * aim[which[i : i + AT_ONCE]]).sum(axis=1)
                    for k in np.flatnonzero(held >= need - 1e-9):
                        target = own.words[t[k]]
                        n = lcs(target, words[k], places[t[k]])
                        if n < share * len(target) - 1e-9 or lcs(own.answers[t[k]], words[k]) < answer * len(own.answers[t[k]]) - 1e-9:
                            continue
                        key = (int(doc[a[k]]), int(t[k]))
                        best[key] = max(best.get(key, (0, 0.0)), (n, float(sims[k])))
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d, _ in best], pa.int64()), pa.array([own.ids[t] for _, t in best], pa.int64()), pa.array([c for _, c in best.values()], pa.float64()), pa.array([n / len(own.words[t]) for (_, t), (n, _) in best.items()], pa.float64())],
                    names=["doc_id", "item_id", "cosine", "lcs"],
                )

    return encoded.mapInArrow(work, "doc_id bigint, item_id bigint, cosine double, lcs double")


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = LCS, answer: float = ANSWER, rank: int = RANK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs) of each document row that holds a benchmark item; lcs is the share of the item's words.

    Null and empty texts hold none, and null or wordless items are in none. Repeated document rows are found each,
    repeated items count once for each row of theirs; null document ids are kept. Items and texts of any length are
    searched whole. Of several windows of a document that hold an item the one with the longest subsequence counts, then
    the greatest cosine. A benchmark of more than MOST_BYTES is searched in parts of about that size, so what is sent
    stays bounded; a cosine is that of the part's space, while the look-up makes the rows found the same in any parts.
    Other columns take no part. Without documents or items there are no rows.
    """
    asked = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / MOST_BYTES))
    out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, cosine double, lcs double")
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        items = Items([r.item_id for r in rows], [r.text for r in rows])
        if not len(items.terms):
            continue
        encoded = durable(encode(docs, items, id_col, text_col))
        weights = idf(encoded, len(items.terms))
        basis = latent(encoded, items, weights, rank, min(COMMON, rank // 4))
        found = search(encoded, items, weights, basis, cosine, share, answer)
        out = found if parts == 1 else out.unionByName(found)
    return out


def untouched(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item.

    Each row is judged by its own text, whose 64-bit hash names it here: one with a null id that holds an item goes, and a
    clean one that shares its id with one that goes stays. Texts that hold an item are one row each of what is joined,
    however often they are repeated. Null texts hold none.
    """
    name = F.xxhash64(F.col(text_col).cast("string"))
    found = leaks(docs.select(name.alias("doc_id"), F.col(text_col).cast("string").alias("text")), benchmark, **options)
    found = durable(found.select(F.col("doc_id").alias("_leak")).distinct())
    return docs.join(found, name == F.col("_leak"), "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, cosine, lcs of all `documents` against `benchmark`."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
