"""Hard negatives, whitening and min-max hashing against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tellur.llm import minhash, negatives, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, x int, n int, no int, component string, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], y, "a", 1, 2, 3, "b", 4) for i, x, y in rows], VECTORS).repartition(3)


def whole(x):
    return x is not None and all(v is not None and np.isfinite(v) for v in x)


def plain_negatives(rows, is_anchor, dim):
    vec = [(i, np.array([int(np.floor(256 * float(np.float32(v)))) for v in x] + [0] * (dim - len(x)), object), y) for i, x, y in rows if i is not None and y is not None and whole(x)]
    out = []
    for a, (i, x, y) in enumerate(vec):
        if not is_anchor(i):
            continue
        scores = sorted((-int(x @ z), j, w) for b, (j, z, w) in enumerate(vec) if b != a)
        for p, j, _ in [s for s in scores if s[2] == y][:5]:
            fit = [s for s in scores if s[2] != y and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(i, j, k + 1, m, -p, -s) for k, (s, m, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block, lot, step", [(4096, 512, 8), (16, 5, 2)])
def test_negatives(spark, monkeypatch, block, lot, step):
    """In one block and lot and in many, lengths far apart, so that lists are cut and thresholds lowered."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "LOT", lot)
    monkeypatch.setattr(negatives, "STEP", step)
    monkeypatch.setattr(negatives, "PARTS", 2)
    rng = np.random.default_rng(4)
    middle = rng.normal(size=7)
    rows = [(i, [float(np.float32(v)) for v in (middle + rng.normal(size=7)) * 10 ** rng.uniform(-1, 1)], int(rng.integers(0, 3)) if i % 3 else 1) for i in range(300)]
    rows += [(400 + i, rows[7][1], i % 3) for i in range(9)]  # ties
    rows += [(20, rows[3][1], 0), (20, rows[3][1], 2), (60, rows[9][1], 1), (40, [1.0, 2.0], 1)]  # repeated ids, a shorter vector
    rows += [(500, None, 0), (520, rows[4][1], None), (540, [1.0, None] * 3, 0), (560, [float("nan")] * 7, 1), (None, rows[4][1], 1), (580, [], 0), (600, [0.0] * 7, 9)]
    want = plain_negatives(rows, lambda i: i % 20 == 0, 7)
    assert len(want) > 200
    df = vectors(spark, rows)
    assert sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % 20 == 0).collect())) == want
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert negatives.hard_negatives(df, F.col("id") < -5).count() == 0


def test_lists_leave_out_what_no_threshold_needs():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(500, 32)) * 0.8 ** np.arange(32)
    q = rng.normal(size=(4, 32)) * 0.8 ** np.arange(32)
    join = negatives.Join(negatives.Index(m, np.arange(32)), q)
    scores = q @ m.T
    tops = np.sort(scores, axis=1)[:, -10]
    given = {(a, int(x)) for a, at in join.reach(np.arange(4), tops) for x in at}
    want = {(a, int(x)) for a in range(4) for x in np.flatnonzero(scores[a] >= tops[a])}
    assert want <= given and len(given) < 400 and join.cut.max() < 4  # the last lists are empty, few pairs are scored
    lower = {(a, int(x)) for a, at in join.reach(np.arange(4), tops * 0.5) for x in at}
    assert not lower & given and {(a, int(x)) for a in range(4) for x in np.flatnonzero(scores[a] >= tops[a] * 0.5)} <= lower | given


def plain_whitening(x, k=8):
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x], (c @ axes[:, :k]) / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LOT", 16)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=12) * 0.9 ** np.arange(12)], 0) for i in range(250)]
    rows += [(7, rows[3][1], 0), (None, rows[5][1], 0), (300, rows[9][1], None), (301, rows[1][1][:8], 0)]  # repeats, no id, no label, shorter
    df = vectors(spark, rows + [(302, None, 0), (303, [1.0, None], 0), (304, [float("inf")] * 12, 0), (305, [float("nan")] * 12, 0)])
    x = np.array([[int(np.floor(1024 * v)) + 100_000 for v in r[1] + [0.0] * (12 - len(r[1]))] for r in rows])
    n, deviation, whitened, explained = plain_whitening(x)
    got = whitening.whitening(df).toPandas()
    assert len(got) == 8 * len(rows) and (got.n == n).all() and got.id.isna().sum() == 8
    assert sorted(got[got.component == 1].deviation) == sorted(deviation)
    assert (got.identity_error < 1e-9).all() and got.identity_error.nunique() == 1
    for k in range(1, 9):
        own = got[got.component == k]
        assert np.allclose(own.explained, explained[k - 1], rtol=1e-9)
        by = own.dropna(subset="id").drop_duplicates("id", keep=False).set_index("id").whitened
        want = {r[0]: w for r, w in zip(rows, whitened[:, k - 1], strict=True)}
        a, b = np.array([by[i] for i in by.index]), np.array([want[i] for i in by.index])
        assert np.abs(a - b * np.sign(a @ b)).max() < 1e-8


def test_whitening_without_variance(spark):
    one = whitening.whitening(vectors(spark, [(1, [0.5, 0.25, -1.0], 0)] * 3)).toPandas()
    assert len(one) == 9 and one.whitened.isna().all() and one.identity_error.isna().all() and (one.explained == 0).all() and (one.deviation == 0).all()
    flat = whitening.whitening(vectors(spark, [(i, [i / 8, 1.0, i / 4], 0) for i in range(9)])).toPandas()
    assert flat[flat.component == 1].whitened.notna().all() and flat[flat.component > 1].whitened.isna().all() and flat.identity_error.max() < 1e-9
    assert whitening.whitening(vectors(spark, [(1, None, 0)])).count() == 0 and whitening.whitening(vectors(spark, []).limit(0)).count() == 0
    huge = whitening.whitening(vectors(spark, [(1, [3e38], 0), (2, [-3e38], 0)])).toPandas()
    assert len(huge) == 2 and huge.deviation.isna().all()


@pytest.mark.parametrize("shape", ["random", "equal", "diagonal", "low rank", "one"])
def test_spectra_by_rank_one_updates(shape):
    rng = np.random.default_rng(8)
    x = {
        "random": rng.integers(-500, 500, (300, 20)),
        "equal": np.repeat(rng.integers(-9, 9, (1, 20)), 50, axis=0),
        "diagonal": np.eye(10, dtype=int)[rng.integers(0, 10, 200)],
        "low rank": rng.integers(-5, 5, (200, 3)) @ rng.integers(-9, 9, (3, 20)),
        "one": rng.integers(-9, 9, (40, 1)),
    }[shape] + 100_000
    one, two = whitening.Spectrum(x.shape[1]), whitening.Spectrum(x.shape[1])
    for row in x[:30]:  # each vector by itself
        one.add(row[None])
    for i in range(30, len(x), 7):
        two.add(x[i : i + 7])
    one.combine(two)
    c = x - x.mean(axis=0)
    most = max(1.0, np.abs(c.T @ c).max())
    assert one.n == len(x) and one.sums == x.sum(axis=0).tolist()
    assert np.abs(one.u * one.d @ one.u.T - c.T @ c).max() < 1e-10 * most and np.abs(one.u.T @ one.u - np.eye(len(one.d))).max() < 1e-11


DOCS = "doc_id bigint, text string, lang string, id string, n int, d string, t int, component string, kept string, node int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1, "b", 2, "c", "d", 3) for i, t in rows], DOCS).repartition(3)


def plain_groups(rows, n=2, percent=80):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    label = [*range(len(rows))]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None]
        least = min(ids, default=None)
        out.append((i, len(sets[k]), least, i == least))
    return sorted(out, key=str)


def copies(rng):
    """Base texts with chains of copies, each of which changes some words more."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 150]))]
        for _ in range(rng.choice([1, 4, 25])):
            rows.append(" ".join(text))
            text = [rng.choice(words) if rng.random() < 0.04 else w for w in text]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("tile, hot", [(512, 10_000), (4, 2)])
def test_minhash(spark, monkeypatch, tile, hot):
    from tellur.llm import common

    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(2)
    rows = copies(rng)
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "Word"), (2004, "wORD"), (2005, "two words"), (2006, "TWO\x0bwords "), (2007, "Ünïcode ß"), (2008, "ünïcode ß")]
    rows += [rows[0], (rows[0][0], "another text by the same id"), (None, rows[1][1]), (None, "no id has this text"), (None, None), (3000, " ".join(f"v{i}" for i in range(30_000))), (3001, " ".join(f"v{i}" for i in range(100, 30_000)))]
    got = sorted(map(tuple, minhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == plain_groups(rows)
    assert minhash.near_duplicates(documents(spark, []).limit(0)).count() == 0
    assert minhash.near_duplicates(documents(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_minhash_shares_values_as_often_as_the_similarity_says():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(200):
        a, b = minhash.mix(rng.integers(0, 2**63, 300).astype(np.uint64)), minhash.mix(rng.integers(0, 2**63, 75).astype(np.uint64))
        one, other = a, np.concatenate([a[:225], b])  # 225 of 375
        agree.append((minhash.signature(one) == minhash.signature(other)).mean())
    assert abs(np.mean(agree) - 0.6) < 0.01


def test_minhash_of_the_given_table_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert sorted(map(tuple, minhash.op13_minhash(spark, folder).collect())) == sorted(con.execute(minhash.ORACLE).fetchall())
    assert sorted(map(tuple, negatives.op11_negatives(spark, folder).collect())) == sorted(con.execute(negatives.ORACLE).fetchall())
