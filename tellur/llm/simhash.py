"""SimHash near-duplicates by exact comparison of all fingerprints in tiles.

A fingerprint has a bit for each bit of the shingles' XXH64 values (for more than 64 bits: of the values under further
seeds), set where over half of the values have it. Equal fingerprints meet first, by a grouping that combines before its
shuffle, so a group of copies of any size is one row afterwards. The distinct fingerprints are dealt into chunks of one
population count each. Fingerprints within the radius differ in population count by the radius at most, so only chunks
with such counts meet; a task compares two chunks with numpy (exclusive-or and bit counts, of the pairs that agree in a
part of their bits if those are few, or else of all in tiles that fit the cache) and emits a spanning forest of the links
that it finds, never the pairs themselves. Components of the forests are those of the links.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.llm.common import durable, joined, read
from tellur.llm.graph import components

#: Most and fewest fingerprints in a chunk. Between the two a chunk has 1/64 of all, so that copies of a chunk sent to its partners grow with the input.
CHUNK_MOST, CHUNK_LEAST, CHUNKS = 65_536, 1_024, 64
#: Hashes in a sketch of a text's shingles.
SKETCH = 256


def shingles(text: str | None, n: int) -> list[bytes]:
    """Runs of n words of the text with A-Z lower-cased, joined by one space: all words if there are fewer, none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return [flat[a : b - 1] for a, b in zip([0, *ends], ends[n - 1 :], strict=False)]


def fingerprint(text: str | None, n: int, words: int = 1, distinct: bool = False) -> np.ndarray:
    """`words` 64-bit values; zeros for a text without words.

    With `distinct`, a shingle counts once however often it occurs, and a hash of the set of shingles follows.
    """
    out = np.zeros(words + distinct, np.uint64)
    if not (parts := shingles(text, n)):
        return out
    for k in range(words):
        h = np.fromiter((xxhash.xxh64_intdigest(x, 42 + k) for x in parts), np.uint64, len(parts))
        if distinct and k == 0:
            h, first = np.unique(h, return_index=True)
            parts = parts if len(h) == len(parts) else [parts[i] for i in first]
            out[words] = xxhash.xxh64_intdigest(h.tobytes())
        counts = np.zeros(64, np.int64)
        for i in range(0, len(h), 8192):
            counts += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, n: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False, name_col: str | None = None) -> DataFrame:
    """(id, f0, f1, ...): the signed 64-bit words of every row's fingerprint; with `distinct` the set's hash is the last, with `name_col` that column follows."""
    k = bits // 64 + distinct
    more = [name_col] if name_col else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), n, k - distinct, distinct) for t in b.column(1)], np.uint64).reshape(-1, k).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, i]) for i in range(k)), *b.columns[2:]], names=["id", *(f"f{i}" for i in range(k)), *more])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), *more).mapInArrow(work, "id bigint, " + ", ".join(f"f{i} bigint" for i in range(k)) + "".join(f", {x} string" for x in more))


def agreeing(a: np.ndarray, b: np.ndarray, radius: int, same: bool, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
    """Pairs of rows (positions in a, in b) that agree in a whole part of a word, about `most` at a time; a pair may come again for another part.

    Of k words, one differs in radius // k bits at most, so of that many parts and one more of it, one doesn't differ:
    every pair within the radius is among those given. None where these aren't much fewer than all pairs.
    """
    n, found = radius // a.shape[1] + 1, []
    for k in range(a.shape[1]):
        for i in range(n):
            low, high = 64 * i // n, 64 * (i + 1) // n
            x, y = ((f[:, k] >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1) for f in (a, b))
            r, c = (np.argsort(v, kind="stable") for v in (x, y))
            first, last = (np.searchsorted(y[c], x[r], side) for side in ("left", "right"))
            found.append((r, c, first, np.cumsum(last - first)))
    if 8 * sum(int(ends[-1]) for *_, ends in found if len(ends)) > len(a) * len(b):
        return None

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for r, c, first, ends in found:
            i = 0
            while i < len(r):
                done = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, done + most, "right")))
                times = np.diff(ends[i:j], prepend=done)
                at = np.arange(int(ends[j - 1]) - done) + np.repeat(first[i:j] - (ends[i:j] - times - done), times)
                p, q = np.repeat(r[i:j], times), c[at]
                yield (p[p < q], q[p < q]) if same else (p, q)
                i = j

    return pairs()


def all_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within `radius` bits (positions in a, in b), by a tile of all pairs at a time."""
    for i in range(0, len(a), 256):
        x = a[i : i + 256]
        for j in range(i if same else 0, len(b), 2048):
            y = b[j : j + 2048]
            bits = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for k in range(1, a.shape[1]):
                bits = bits + np.bitwise_count(x[:, None, k] ^ y[None, :, k])
            r, c = np.nonzero(bits <= radius)
            r, c = r + i, c + j
            yield (r[r < c], c[r < c]) if same else (r, c)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows within `radius` bits, as positions (in a, then b): b is None to compare a with itself.

    Compared are the pairs that agree in a part of their bits, where that leaves few, or else all.
    """
    same = b is None
    b = a if same else b
    off = 0 if same else len(a)
    parent = np.arange(len(a) + (0 if same else len(b)))
    pairs = agreeing(a, b, radius, same)
    for r, c in all_pairs(a, b, radius, same) if pairs is None else pairs:
        if pairs is not None:
            ok = np.bitwise_count(a[r] ^ b[c]).sum(axis=1) <= radius
            r, c = r[ok], c[ok]
        c = c + off
        while len(r):
            p, q = parent[r], parent[c]
            if not (far := p != q).any():
                break
            r, c, p, q = r[far], c[far], p[far], q[far]
            np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
            while (parent != (up := parent[parent])).any():
                parent = up
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return child, parent[child]


def nearest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a its nearest row of b within `radius` bits, and the reverse, as positions (in a, then b): b is None for a with itself."""
    same = b is None
    b = a if same else b
    ends = len(a), len(b)
    best = [np.full(n, radius + 1, np.int16) for n in ends]
    to = [np.zeros(n, np.int64) for n in ends]
    for i in range(0, len(a), 256):
        x = a[i : i + 256]
        for j in range(0, len(b), 2048):
            y = b[j : j + 2048]
            bits = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for k in range(1, a.shape[1]):
                bits += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
            if same and i < j + 2048 and j < i + 256:
                r = np.arange(max(i, j), min(i + len(x), j + len(y)))
                bits[r - i, r - j] = 255
            if bits.min() > radius:
                continue
            for side, (lo, at, axis) in enumerate(((i, bits, 1), (j, bits.T, 1))):
                least = at.min(axis=axis)
                rows = np.flatnonzero(least < best[side][lo : lo + len(at)])
                best[side][rows + lo] = least[rows]
                to[side][rows + lo] = at[rows].argmin(axis=1) + (j if side == 0 else i)
    u, v = (np.flatnonzero(x <= radius) for x in best)
    off = 0 if same else len(a)
    return (u, to[0][u]) if same else (np.concatenate([u, v + off]), np.concatenate([to[0][u] + off, to[1][v]]))


def sketch(text: str | None, n: int) -> tuple[int, bytes]:
    """How many distinct shingles there are, and the smallest SKETCH of their 32-bit hashes, filled up by the greatest value."""
    h = np.frombuffer(shingle_set(text, n), np.uint32)
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    out[: min(len(h), SKETCH)] = h[:SKETCH]
    return len(h), out.tobytes()


def apart(a: np.ndarray, b: np.ndarray | None, radius: int, roots: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within `radius` bits whose `roots` (of a, then b) differ and whose sketches allow a similarity of `least`.

    Positions in a, then b; b is None for a with itself. Two sketches that hold all shingles give the similarity itself;
    such pairs join their roots, and one pair for each join is enough. Otherwise the sketches estimate it from at least
    SKETCH hashes of the union, and pairs down to four standard deviations under `least` are given.
    """
    same, off = b is None, 0 if b is None else len(a)
    b = a if same else b
    _, codes = np.unique(sketches, return_inverse=True)
    codes = codes.reshape(sketches.shape)
    ends = np.minimum(sizes, SKETCH)
    whole = sizes <= SKETCH
    codes[np.arange(SKETCH) >= ends[:, None]] = (none := int(codes.max(initial=0)) + 1)
    last = np.where(whole, none - 1, codes[:, -1])
    floor = least - 4 * np.sqrt(least * (1 - least) / SKETCH)
    _, root = np.unique(roots, return_inverse=True)
    held = np.zeros(none + 1, bool)
    us, vs = [], []
    for i in range(0, len(a), 64):
        x = a[i : i + 64]
        bits = sum(np.bitwise_count(x[:, None, k] ^ b[None, :, k]) for k in range(a.shape[1]))
        for r in np.flatnonzero(bits.min(axis=1) <= radius):
            u = i + r
            c = np.flatnonzero(bits[r] <= radius)
            c = (c[c > u] if same else c) + off
            c = c[(root[c] != root[u]) & (least * np.maximum(sizes[c], sizes[u]) <= np.minimum(sizes[c], sizes[u]))]
            if not len(c):
                continue
            held[codes[u, : ends[u]]] = True
            both = held[codes[c]].sum(axis=1)
            held[codes[u, : ends[u]]] = False
            upto = np.minimum(last[c], last[u])
            either = np.searchsorted(codes[u, : ends[u]], upto, "right") + (codes[c] <= upto[:, None]).sum(axis=1) - both
            known = whole[c] & whole[u]
            ok = both >= np.where(known, least, floor) * either - 1e-9
            for v, sure in zip(c[ok], known[ok], strict=True):
                if root[v] != root[u]:
                    us.append(u)
                    vs.append(v)
                    if sure:
                        root[root == root[v]] = root[u]
    return np.array(us, np.int64), np.array(vs, np.int64)


def links(distinct: DataFrame, radius: int, bits: int = 64, pick=forest, lots: int = CHUNKS, most: int = CHUNK_MOST) -> DataFrame:
    """Edges (u, v) between the ids of a table (node, f0, f1, ...) of fingerprints, by `pick` for each two chunks.

    With `forest`, they span what links at `radius` bits. Columns `root`, `size` and `sketch` of the table, if there,
    follow for `pick`. A chunk holds `most` fingerprints whose population counts lie in one band, a third of the radius wide.
    """
    k = bits // 64
    words = [f"f{i}" for i in range(k)]
    marked = "sketch" in distinct.columns
    cols = ["node", *(["root", "size"] if marked else []), *words]
    band = max(1, radius // 3)
    reach, n_bands = (radius + band - 1) // band, bits // band + 1
    weight = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))
    distinct = distinct.withColumn("p", F.floor(weight / band).cast("int"))
    found = {r.p: r["count"] for r in distinct.groupBy("p").count().collect()}  # one row for each band: bits + 1 at most
    held = min(most, max(CHUNK_LEAST, math.ceil(sum(found.values()) / lots)))
    parts = [math.ceil(found.get(p, 0) / held) for p in range(n_bands)]
    chunks = (
        distinct.withColumn("c", F.pmod(F.xxhash64("node"), F.element_at(F.array(*(F.lit(max(1, x)) for x in parts)), F.col("p") + 1)).cast("int"))
        .groupBy("p", "c")
        .agg(F.collect_list(F.struct(*cols, *(["sketch"] if marked else []))).alias("rows"))
    )

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, c, rows in zip(frame.p, frame.c, frame.rows, strict=True):
                packed = np.array([[r[x] for x in cols] for r in rows], np.int64).tobytes()
                sketches = b"".join(r["sketch"] for r in rows) if marked else b""
                ahead = [(p, c, q, d) for q in range(p, min(n_bands - 1, p + reach) + 1) for d in range(c if q == p else 0, parts[q])]
                behind = [(q, d, p, c) for q in range(max(0, p - reach), p + 1) for d in range(c if q == p else parts[q])]
                keys = [(*x, 0) for x in ahead] + [(*x, 1) for x in behind]
                step = max(1, min(16, (1 << 25) // (len(packed) + len(sketches))))
                for i in range(0, len(keys), step):
                    out = pd.DataFrame(keys[i : i + step], columns=["p", "c", "q", "d", "side"])
                    yield out.assign(packed=[packed] * len(out), sketches=[sketches] * len(out))

    def match(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("side")
        rows = [np.frombuffer(x, np.int64).reshape(-1, len(cols)) for x in group.packed]
        f = [np.ascontiguousarray(x[:, -k:]).view(np.uint64) for x in rows]
        rows = np.concatenate(rows)
        more = (rows[:, 1], rows[:, 2], np.frombuffer(b"".join(group.sketches), np.uint32).reshape(len(rows), -1)) if marked else ()
        one, other = pick(f[0], f[1] if len(f) > 1 else None, radius, *more)
        return pd.DataFrame({"u": rows[one, 0], "v": rows[other, 0]})

    sent = chunks.mapInPandas(send, "p int, c int, q int, d int, side int, packed binary, sketches binary")
    return sent.groupBy("p", "c", "q", "d").applyInPandas(match, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, ..., component): one row for each row of `docs`, with the smallest id that links reach from it.

    Null and empty texts, and texts without words, have fingerprint zero, which links like any other. Repeated rows and
    ties share their fingerprint and component. A null id is kept and never the smallest unless a component has no other
    (then the component is null). Other columns of `docs`, whatever their names, take no part. An empty table gives none.
    """
    words = [f"f{i}" for i in range(bits // 64)]
    rows = durable(fingerprints(docs, n, bits, id_col, text_col))
    reps = rows.groupBy(*words).agg(F.min("id").alias("least"), F.count("*").alias("times"))
    # A fingerprint of one word names itself; longer ones get a 64-bit hash of theirs as the name.
    reps = durable(reps.withColumn("node", F.col("f0") if len(words) == 1 else F.xxhash64(*words)))
    labels = components(links(reps.select("node", *words), radius, bits))
    named = reps.join(labels, "node", "left").select(*words, "least", F.coalesce("label", "node").alias("root"))
    named = durable(named)
    roots = durable(named.groupBy("root").agg(F.min("least").alias("component")))
    classes = durable(named.join(roots, "root").select(*words, "component"))
    return joined(rows, classes, words, reps).select("id", *words, "component")


def shingle_set(text: str | None, n: int) -> bytes:
    """The distinct shingles' hashes, 32 bits each, sorted."""
    h = np.fromiter((xxhash.xxh32_intdigest(x) for x in shingles(text, n)), np.uint32)
    return np.unique(h).tobytes()


def alike(texts: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, least: float) -> DataFrame:
    """The `pairs` (u, v: nodes) whose texts have a similarity of `least` or more; `reps` gives a node's text as the row (id, digest)."""
    asked = durable(reps.select("node", "rep").join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py(), n) for x in b.column(1)], pa.binary())], names=["node", "s"])

    held = durable(text_of(texts, asked).mapInArrow(sets, "node bigint, s binary").dropDuplicates(["node"]))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(np.intersect1d(p, q, assume_unique=True)) if least * max(len(p), len(q)) <= min(len(p), len(q)) else 0
                ok.append(both >= least * (len(p) + len(q) - both) - 1e-9)
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(held.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(same, "u bigint, v bigint")


def text_of(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text) for each node of `asked` (node, rep: a row's id and digest); rows that repeat id and text give it each."""
    asked = asked.select("node", F.col("rep.id").alias("rep_id"), F.col("rep.digest").alias("rep_digest"))
    return texts.join(asked, texts.id.eqNullSafe(asked.rep_id) & (texts.digest == asked.rep_digest)).select("node", "text")


def families(docs: DataFrame, n: int, least: float, bits: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, digest, node) of each row of `docs`, (node, component, rep, times) of each set of shingles): the groups of `near_copies`.

    A row is named by its id and its text's digest, so rows that repeat an id or have none are told apart. `rep` is the
    row of its group that stands for it: the one with the smallest id, nulls last, then the smallest digest.
    """
    words = [f"f{i}" for i in range(bits // 64)]
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), digest.alias("digest"))
    k = len(words)
    rows = durable(fingerprints(texts, n, bits, "id", "text", True, "digest").select("id", "digest", *words, F.xxhash64(*words, f"f{k}").alias("node")))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    reps = durable(rows.groupBy("node", *words).agg(F.min(first).alias("rep"), F.count("*").alias("times")))
    pairs = links(reps.select("node", *words), radius, bits, nearest, 16).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = durable(pairs.where("u <> v").distinct())
    labels = components(alike(texts, reps, pairs, n, least))
    named = durable(reps.join(labels, "node", "left").select("node", *words, "rep", F.coalesce("label", "node").alias("root")))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [sketch(x.as_py(), n) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in made], pa.int64()), pa.array([x for _, x in made], pa.binary())], names=["node", "size", "sketch"])

    asked = durable(named.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node"))
    marks = text_of(texts, asked).mapInArrow(sketches, "node bigint, size bigint, sketch binary")
    marked = durable(asked.select("node", "root", *words).join(marks.dropDuplicates(["node"]), "node"))
    more = durable(links(marked, radius, bits, functools.partial(apart, least=least), 8, CHUNK_MOST // 8))
    found = alike(texts, reps, more, n, least)
    # The groups that further links join become one: their roots are the nodes of a smaller graph.
    group = named.select("node", "root")
    between = found.join(group.withColumnsRenamed({"node": "u", "root": "a"}), "u").join(group.withColumnsRenamed({"node": "v", "root": "b"}), "v")
    merged = components(between.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "root")
    named = durable(named.join(merged, "root", "left").select("node", "rep", F.coalesce("label", "root").alias("root")))
    roots = durable(named.groupBy("root").agg(F.min("rep").alias("rep")))
    classes = named.select("node", "root").join(roots, "root").join(reps.select("node", "times"), "node")
    return rows.select("id", "digest", "node"), durable(classes.select("node", F.col("rep.id").alias("component"), "rep", "times"))


def near_copies(docs: DataFrame, n: int = 5, least: float = 0.8, bits: int = 128, radius: int = 34, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): groups of rows whose n-word shingles have a Jaccard similarity of `least` or more, link by link.

    Fingerprints count each distinct shingle once, as the similarity does. Candidates are fingerprints within `radius` bits,
    equal ones too, and each candidate pair is held to the similarity of its shingles, by 32-bit hashes of them. First
    come, of each two chunks, every fingerprint's nearest in the other: they name all texts that have candidates, and join
    the bulk of each group by a few pairs for each text. Among the texts named, all pairs within `radius` bits that are
    left in different groups come next, sketches of their shingles at hand, so that no link within `radius` bits is lost
    and no group makes all its pairs; similar pairs beyond it are missed (the README says how many). Texts with one set of
    shingles are one text here. Rows that repeat an id with another text are rows of their own, as are those with a null
    id. Nulls, empty texts, ties and other columns as in `near_duplicates`; texts without words are copies of each other.
    """
    rows, classes = families(docs, n, least, bits, radius, id_col, text_col)
    return joined(rows.select("id", "node"), classes.drop("times"), ["node"], classes).select("id", "component")


def one_of_each(docs: DataFrame, n: int = 5, least: float = 0.8, bits: int = 128, radius: int = 34) -> DataFrame:
    """The rows of `docs`, all columns, that stand for their groups of near copies: the smallest id, nulls last; rows that repeat it with the same text stay once."""
    rows, classes = families(docs, n, least, bits, radius, "doc_id", "text")
    keep = classes.select("rep.id", "rep.digest").distinct()
    keep = durable(rows.join(keep.select(F.col("id").alias("kept_id"), F.col("digest").alias("kept")), rows.id.eqNullSafe(F.col("kept_id")) & (rows.digest == F.col("kept"))).groupBy("kept_id", "kept").agg(F.count("*").alias("times")))
    digest = F.md5(F.coalesce(docs.text.cast("string"), F.lit("")))
    chosen = docs.join(keep, docs.doc_id.cast("bigint").eqNullSafe(keep.kept_id) & (digest == keep.kept), "left_semi")
    if not keep.where("times > 1").limit(1).count():
        return chosen
    # Repeated rows are few or many: of each, the first met stays. Texts go by their digest, which is combined before the shuffle.
    names = chosen.columns
    once = chosen.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), chosen.doc_id.alias("i"), F.md5(F.coalesce(chosen.text.cast("string"), F.lit(""))).alias("d"))
    return once.dropDuplicates(["i", "d"]).select(*(F.col("doc")[c].alias(c) for c in names))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all `documents`: 3-word shingles, 64 bits, radius 3."""
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
