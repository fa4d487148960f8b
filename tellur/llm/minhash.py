"""MinHash near-duplicates by min-max hashing: both ends of every permutation, banded, each link held to the full sets.

A document is the set of its distinct n-word shingles. Each of HASHES permutations is evaluated once a shingle and gives
two values of the signature, its minimum and its maximum; both agree between two sets as often as the sets' similarity
says. Runs of BAND values are buckets. Equal sets are one node, so copies of any number meet nowhere again.

Buckets with the same members count once. First each node meets the least and the greatest node of its buckets, which
joins the bulk of each group by two pairs a node. Buckets that still hold nodes of different components are then gone
through in tiles: the nodes outside a bucket's largest component meet all of it, and a tile gives only the links that join
components within it. So no link between components is lost, no bucket is capped and none makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.llm.common import durable, joined, mix, read
from tellur.llm.graph import components

#: Permutations, values of a band, nodes of a bucket in a tile, and known words of a task.
HASHES, BAND, TILE, KNOWN = 120, 6, 512, 1 << 20
#: Nodes whose texts are found by a broadcast of their names; more are joined by a shuffle.
NAMES = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_TIMES, _PLUS = _SEEDS[:HASHES] | np.uint64(1), _SEEDS[HASHES:]


class Words(dict):
    """Hashes of words, each computed once; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int, known: Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: runs of n words with A-Z lower-cased, all words if there are fewer, none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    with np.errstate(over="ignore"):
        runs = h[: len(h) - k + 1] if k else h
        for i in range(1, k):
            runs = mix(runs) * _ODD + h[i : len(h) - k + 1 + i]
    return np.unique(mix(runs + np.uint64(k)))


def signature(h: np.ndarray) -> np.ndarray:
    """The least values under all permutations, then the greatest."""
    low, high = np.full(HASHES, 2**64 - 1, np.uint64), np.zeros(HASHES, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(h), 4096):
            x = h[i : i + 4096, None] * _TIMES + _PLUS
            np.minimum(low, x.min(axis=0), out=low)
            np.maximum(high, x.max(axis=0), out=high)
    return np.concatenate([low, high])


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit name for each run of BAND values, of its place and all its values."""
    runs = values[: len(values) // BAND * BAND].reshape(-1, BAND)
    out = np.arange(1, len(runs) + 1, dtype=np.uint64)
    for i in range(BAND):
        out = mix(out * _ODD + runs[:, i])
    return out.view(np.int64)


def described(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, d, bands): of each row the digest of its text, its number of shingles, the digest of their set (null without any) and its buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            size, name, own = [], [], []
            for x in b.column(1):
                h = shingle_set(x.as_py(), n, known)
                size.append(len(h))
                name.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                own.append(bands(signature(h)) if len(h) else np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own) if own else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(name, pa.binary()), lists], names=["id", "t", "n", "d", "bands"])

    return texts_of(docs, id_col, text_col).mapInArrow(work, "id bigint, t string, n bigint, d binary, bands array<bigint>")


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.md5(F.coalesce(text, F.lit(""))).alias("t"))


def sets_of(docs: DataFrame, nodes: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(node, s): the sorted shingle hashes of each node of `nodes` (node, rep: a row's id and digest of its text)."""
    asked = nodes.select("node", F.col("rep.id").alias("rid"), F.col("rep.t").alias("rt"))
    texts = texts_of(docs, id_col, text_col)
    asked = F.broadcast(asked) if nodes.count() <= NAMES else asked
    own = texts.join(asked, texts.id.eqNullSafe(asked.rid) & (texts.t == asked.rt)).select("node", "text").dropDuplicates(["node"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py(), n, known).tobytes() for x in b.column(1)], pa.binary())], names=["node", "s"])

    return own.mapInArrow(work, "node bigint, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The `pairs` (u, v) of nodes with 100 * shared shingles >= percent * all of both."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(same, "u bigint, v bigint")


def across(nodes: np.ndarray, labels: np.ndarray, minor: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of some nodes: each node that is `minor` meets all others of another component until they are joined."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    _, root = np.unique(labels, return_inverse=True)
    held, out = np.zeros(len(values) + 1, np.int64), []
    place = np.arange(len(nodes))
    for u in np.flatnonzero(minor):
        if (root == root[u]).all():
            break
        can = (root != root[u]) & (~minor | (place > u)) & (100 * np.minimum(sizes, sizes[u]) >= percent * np.maximum(sizes, sizes[u]))
        if not can.any():
            continue
        held[codes[starts[u] : starts[u + 1]]] = 1
        at = np.flatnonzero(can)
        both = np.array([held[codes[starts[v] : starts[v + 1]]].sum() for v in at])
        held[codes[starts[u] : starts[u + 1]]] = 0
        for v in at[100 * both >= percent * (sizes[at] + sizes[u] - both)]:
            if root[v] != root[u]:
                out.append((nodes[u], nodes[v]))
                root[root == root[v]] = root[u]
    return out


def between(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join different components within the buckets of `members` (b, node, m)."""
    said = durable(members.join(labels, "node", "left").select("b", "node", F.coalesce("label", "node").alias("label")))
    by_label = said.groupBy("b", "label").agg(F.count("*").alias("n"))
    wide = by_label.groupBy("b").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("times"), F.count("*").alias("labels")).where("labels > 1")
    wide = durable(wide.select("b", F.col("top.label").alias("main"), "times", F.ceil((F.col("times") - F.col("top.n")) / TILE).alias("k1"), F.ceil(F.col("top.n") / TILE).alias("k2")))
    rows = joined(said, wide.drop("times"), ["b"], wide)
    rows = rows.withColumn("minor", F.col("label") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("minor"), F.col("k1")).otherwise(F.col("k2")))
    # Tiles (p, q): parts of the minor nodes by each other (q < k1), and by parts of the largest component (q - k1).
    minor = F.transform(F.sequence(F.lit(0), F.col("k1") + F.col("k2") - 1), lambda i: F.when(i < F.col("k1"), F.struct(F.least(i, F.col("c")).alias("p"), F.greatest(i, F.col("c")).alias("q"))).otherwise(F.struct(F.col("c").alias("p"), i.alias("q"))))
    major = F.transform(F.sequence(F.lit(0), F.col("k1") - 1), lambda i: F.struct(i.alias("p"), (F.col("k1") + F.col("c")).alias("q")))
    kind = "array<struct<p:bigint,q:bigint>>"
    tiles = rows.withColumn("c", own).withColumn("tile", F.explode(F.when(F.col("minor"), minor.cast(kind)).otherwise(major.cast(kind))))
    # A bucket's only tile with its minor nodes takes the largest component in, if both are one part.
    tiles = tiles.select("b", "node", "label", "minor", F.col("tile.p").alias("p"), F.when((F.col("k1") == 1) & (F.col("k2") == 1), 0).otherwise(F.col("tile.q")).alias("q")).distinct()
    # Small tiles share a lot, so that a task gets some hundred nodes at once.
    lots = max(1, tiles.count() // TILE)
    tiles = tiles.withColumn("lot", F.pmod(F.xxhash64("b", "p", "q"), F.lit(lots)))

    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, x in group.groupby(["b", "p", "q"], sort=True):
            x = x.sort_values("node")
            out += across(x.node.to_numpy(), x.label.to_numpy(), x.minor.to_numpy(bool), [np.frombuffer(s, np.uint64) for s in x.s], percent)
        return pd.DataFrame(out, columns=["u", "v"])

    return tiles.join(sets, "node").groupBy("lot").applyInPandas(work, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, n: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component, kept) of each row: groups of rows whose sets of n-word shingles link by 100 * intersection >= percent * union.

    `component` is the smallest id that links reach, `kept` whether it is the row's own. A text of fewer than n words is
    one shingle; null and empty texts and texts without words have none, link with nothing and are components of their
    own. Equal sets link, so repeated rows and ties share a component; rows that repeat the smallest id are all kept. A
    null id is kept as a row and is smallest only where a component has no other (then `component` is null and `kept`
    true). Texts are taken whole, however long. Other columns, whatever their names, take no part. Empty input gives none.

    Sets are 64-bit hashes of shingles. A pair of similarity 0.8 shares no bucket, and is missed unless others join it,
    once in 190,000 times; pairs of 0.9 once in 1e13.
    """
    rows = durable(described(docs, n, id_col, text_col))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    reps = rows.where("d IS NOT NULL").groupBy("d").agg(F.min(first).alias("rep"), F.count("*").alias("times"), F.first("bands").alias("bands"))
    reps = durable(reps.withColumn("node", F.monotonically_increasing_id()))
    buckets = reps.select("node", F.explode("bands").alias("b"))
    groups = buckets.groupBy("b").agg(F.count("*").alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x")).where("m > 1")
    chosen = durable(groups.groupBy("m", "lo", "hi", "x").agg(F.min("b").alias("b")))
    members = durable(joined(buckets, chosen.select("b", "lo", "hi"), ["b"], chosen.select("b", F.col("m").alias("times"))))
    live = durable(members.groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    sets = durable(sets_of(docs, live.join(reps.select("node", "rep"), "node").select("node", "rep"), n, id_col, text_col))
    stars = live.select(F.col("node").alias("v"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("u")).where("u <> v")
    labels = components(confirmed(stars, sets, percent))
    more = between(members.select("b", "node"), labels, sets, percent)
    # What joins components are links of a smaller graph, whose nodes are their labels.
    name = labels.withColumnRenamed("label", "root")
    ends = more.join(name.withColumnsRenamed({"node": "u", "root": "a"}), "u", "left").join(name.withColumnsRenamed({"node": "v", "root": "z"}), "v", "left")
    merged = components(ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("z", "v").alias("v"))).select(F.col("node").alias("root"), "label")
    named = reps.select("d", "node", F.col("rep.id").alias("least"), "times").join(name, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = durable(named.join(merged, "root", "left").select("d", "least", "times", F.coalesce("label", "root").alias("root")))
    roots = durable(named.groupBy("root").agg(F.min("least").alias("component")))
    classes = durable(named.join(roots, "root").select("d", "component", "times"))
    found = joined(rows.where("d IS NOT NULL").select("id", "n", "d"), classes.select("d", "component"), ["d"], classes).select("id", "n", "component")
    alone = rows.where("d IS NULL").select("id", "n", F.col("id").alias("component"))
    return found.unionByName(alone).select("id", F.col("n").alias("n_shingles"), "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op13_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of all `documents`: two-word shingles, similarity 0.8."""
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.withColumnsRenamed({"id": "doc_id", "component": "component_id"})


ORACLE = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
t AS (SELECT n, len(s) AS size, unnest(s) AS x FROM s),
c AS (SELECT a.n AS u, b.n AS v, any_value(a.size + b.size) AS total, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.n < b.n AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size) GROUP BY a.n, b.n),
e AS (SELECT u, v FROM c WHERE 100 * shared >= 80 * (total - shared)),
z AS (SELECT u, v FROM e UNION SELECT v, u FROM e UNION SELECT n, n FROM s),
r AS (SELECT u, v FROM z UNION SELECT r.u, z.v FROM r JOIN z ON r.v = z.u),
m AS (SELECT r.u AS n, min(o.doc_id) AS component_id FROM r JOIN s o ON o.n = r.v GROUP BY r.u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN m USING (n)
"""
