"""The corpus operators against brute force on small tables, with nulls, empty texts, ties, repeats and clashing columns."""

import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tellur.llm import decontaminate, htmltext, licenses, mixing, quality, simhash, tokens, topk, toxicity, warc
from tellur.llm.common import word_hashes
from tellur.llm.graph import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score string, component string, y int"


def prose(rng, n):
    return " ".join(rng.choice("the of and then river stone walks green under seven quiet lamp over every morning field again north tower water".split()) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    texts += [texts[3], texts[3].upper(), texts[4] + " extra", "", None, " \t\n", "x", prose(rng, 5000), "Ünïcode ß 漢字 \x1c <|endoftext|> it's"]
    rows = [(i * 3 % 70, t, "en", f"s{i % 4}" if i % 9 else None, 1, "a", "b", "c", 7) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[3], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(got.get(x, x) == y for x, y in label.items())
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius, hot", [(3, 10_000), (14, 2)])
def test_simhash(docs, radius, hot, monkeypatch):
    from tellur.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = docs.select("doc_id", "text").collect()
    f = [plain_fingerprint(r.text) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (f[i] ^ f[j]).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    least = {k: min((r.doc_id for r, x in zip(rows, label, strict=True) if x == k and r.doc_id is not None), default=None) for k in label}
    want = sorted(((r.doc_id if r.doc_id is not None else -1), x, least[k]) for r, x, k in zip(rows, f, label, strict=True))
    got = sorted((r.id if r.id is not None else -1, r.f0 % 2**64, r.component) for r in simhash.near_duplicates(docs, radius=radius).collect())
    assert got == want


def test_nearest_and_forest_agree_with_all_pairs():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, (300, 2), dtype=np.uint64)
    b = np.concatenate([a[:50] ^ np.uint64(5), rng.integers(0, 2**63, (2500, 2), dtype=np.uint64)])
    d = np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2)
    u, v = simhash.nearest(a, b, 24)
    left = {x: y - 300 for x, y in zip(u, v, strict=True) if x < 300}
    assert left.keys() == set(np.flatnonzero(d.min(axis=1) <= 24)) and all(d[x, y] == d[x].min() for x, y in left.items())
    child, root = simhash.forest(a, b, 24)
    assert len(child) >= 50 and set(child) | set(root) <= set(range(len(a) + len(b)))


@pytest.mark.parametrize("words, radius", [(1, 0), (1, 3), (2, 3), (1, 40)])
def test_forest_of_few_pairs_joins_what_all_pairs_join(words, radius, monkeypatch):
    """Forests of pairs that agree in a part of their bits, against those of all pairs: planted links, one crowded part, an empty side."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**64, (700, words), dtype=np.uint64)
    a[200:300] &= np.uint64(0xFFFF0000FFFFFFFF)
    flips = [[sum(1 << int(i) for i in rng.choice(64, n, replace=False)) for n in (k % 5, *[0] * (words - 1))] for k in range(400)]
    b = np.concatenate([a[:400] ^ np.array(flips, np.uint64), rng.integers(0, 2**64, (900, words), dtype=np.uint64)])
    for one, other in ((a, b), (np.concatenate([a, b]), None), (a, b[:0]), (a[:0], None)):
        got = simhash.forest(one, other, radius)
        with monkeypatch.context() as m:
            m.setattr(simhash, "agreeing", lambda *_: None)
            want = simhash.forest(one, other, radius)
        assert all((x == y).all() for x, y in zip(got, want, strict=True)) and (len(got[0]) > 50) == (one is not a[:0] and len(one) > 0 and (other is None or len(other) > 0))
    pairs = simhash.agreeing(a, b, radius, False, 100)
    assert pairs is None if radius == 40 else max(len(p) for p, _ in pairs) < 1000


def test_forest_compares_few_pairs(monkeypatch):
    """Of 400 million pairs of two chunks, under a thousandth is compared, and every planted link is found."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 2**64, (2, 20_000, 1), dtype=np.uint64)
    b[:50] = a[:50] ^ np.uint64(1 << 63 | 1 << 20 | 1)
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(x.size) or count(x))
    child, root = simhash.forest(a, b, 3)
    assert {(x, y) for x, y in zip(root, child, strict=True)} >= {(i, 20_000 + i) for i in range(50)} and sum(compared) < 400_000


def test_near_copies_keep_one(spark):
    rng = random.Random(8)
    base = prose(rng, 400).split()
    near, far = base[:], [rng.choice(base) for _ in base]
    near[200] = "changed"
    rows = [(5, " ".join(base)), (2, " ".join(near)), (9, " ".join(far)), (2, " ".join(near)), (7, None), (6, ""), (None, "alone in the world today")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept_id", F.lit("x"))
    assert sorted(r.doc_id or -1 for r in simhash.one_of_each(df).collect()) == [-1, 2, 6, 9]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_near_copies_lose_no_link(spark):
    """Families of texts at similarities around 0.8, short and longer than a sketch, against all pairs."""
    rng = random.Random(12)
    texts = []
    for length, family in ((120, 40), (150, 40), (700, 25), (2000, 12)):
        words = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(family):
            own = list(rng.choice([words, words, texts[-1].split() if texts and len(texts[-1].split()) > 0.9 * length else words]))
            for _ in range(rng.randint(0, length // 30)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(own))
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert 10 < len(set(label)) < len(texts) - 20
    got = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_near_copies_with_repeats(spark):
    """Repeated lines don't hide copies, and one dominant shingle makes none of texts that differ otherwise."""
    rng = random.Random(14)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for length, times in ((100, 5), (100, 10), (100, 10), (300, 20), (300, 40)):
        words, line = new(length), new(6)
        texts += [" ".join(words + line), " ".join(words + line * times)]
    for _ in range(6):
        texts.append(" ".join(new(20) + ["again"] * 400))
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                label[i] = label[j]
    assert label == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8, *range(10, 16)]
    got = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_near_copies_of_repeated_and_null_ids(spark):
    """A row is an id with a text: ids 1 (T), 1 (U), 2 (near T), 3 (near U), and the same without ids."""
    rng = random.Random(31)
    t, u = ([f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(2))
    near = lambda x: " ".join([*x[:100], "changed", *x[101:]])
    rows = [(1, " ".join(t)), (1, " ".join(u)), (2, near(t)), (3, near(u)), (None, "quite alone in this world today"), (None, "another one alone in this world"), (1, " ".join(t)), (None, near(u))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit("x"))
    assert sorted((r.id or 0, r.component or 0) for r in simhash.near_copies(df).collect()) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(df).collect()) == sorted([(1, " ".join(t)), (1, " ".join(u)), (0, rows[4][1]), (0, rows[5][1])])


def test_near_copies_against_all_pairs_of_the_given_table(spark):
    """Groups of the documents of sf0.01, against all pairs of similarity 0.8 that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = [frozenset(simhash.shingles(r.text, 5)) for r in rows]
    holders = {}
    for i, x in enumerate(sets):
        for w in x:
            holders.setdefault(w, []).append(i)
    met = {}
    for own in holders.values():
        for i in own:
            for j in own:
                if i < j:
                    met[i, j] = met.get((i, j), 0) + 1
    label = {r.doc_id: r.doc_id for r in rows}
    pairs = [(rows[i].doc_id, rows[j].doc_id) for (i, j), both in met.items() if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    pairs += [(rows[i].doc_id, rows[j].doc_id) for i in range(len(sets)) for j in range(i) if not sets[i] and not sets[j]]
    again = True
    while again:
        again = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                again = True
    assert len(pairs) > 50
    assert {r.id: r.component for r in simhash.near_copies(docs).collect()} == label


def test_sketches_bound_what_is_emitted():
    """Rows of one root give no pair; known similar rows join their roots once."""
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in (1, 1, 1, 1)]
    f = np.array([simhash.fingerprint(t, 5, 2) for t in texts])
    marks = [simhash.sketch(t, 5) for t in texts]
    sizes, rows = np.array([n for n, _ in marks]), np.frombuffer(b"".join(x for _, x in marks), np.uint32).reshape(4, -1)
    assert len(simhash.apart(f, None, 34, np.array([5, 5, 5, 5]), sizes, rows, 0.8)[0]) == 0
    assert len(simhash.apart(f, None, 34, np.array([1, 2, 3, 4]), sizes, rows, 0.8)[0]) == 3
    assert len(simhash.apart(f[:2], f[2:], 34, np.array([1, 1, 2, 3]), sizes, rows, 0.8)[0]) == 2


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], 0) for i in range(120)]
    rows += [(200, rows[7][1], 0), (201, rows[7][1], 0), (50, None, 0), (202, [1.0, float("nan")] * 3, 0), (203, [1.0, None] * 3, 0), (None, [1.0] * 6, 0), (300, [1e17] * 6, 0), (250, [0.5, 0.25], 0)]
    rows += [(100, rows[3][1], 0), (100, rows[3][1], 1), (60, rows[9][1], 0)]  # rows that repeat an id are rows of their own
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int").repartition(3)
    vec = [(i, [int(np.floor(256 * float(np.float32(v)))) for v in x] + [0] * (6 - len(x))) for i, x, _ in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    want = []
    for n, (q, x) in enumerate(vec):
        if q % 50 == 0:
            s = sorted((-min(sum(a * b for a, b in zip(x, y, strict=True)), 2**63 - 1), i) for j, (i, y) in enumerate(vec) if j != n)[:5]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sum(r[0] == 100 for r in want) == 15
    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 50 == 0).collect())) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0 and topk.top_k(df, F.col("id") < -5).count() == 0


def test_topk_over_many_blocks(spark, monkeypatch):
    """Blocks, bands and lots of a few rows, lengths far apart, so that pruning takes effect."""
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "PARTS", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * 10 ** rng.uniform(-1, 1)]) for i in range(400)]
    x = np.array([[int(np.floor(256 * v)) for v in r[1]] for r in rows])
    want = []
    for q in range(0, 400, 20):
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-int(x[q] @ x[i]), i))[:5]
        want += [(q, k + 1, i, int(x[q] @ x[i])) for k, i in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0).collect())) == want


def test_tokens(docs):
    public = pytest.importorskip("public_tokenizers")
    rows = [r.text or "" for r in docs.select("text").collect()]
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public.path(file)
        got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, path, 100).collect())
        assert got == sorted((len(t.encode()), n, n > 100) for t, n in zip(rows, tokens.whole_counts(path, rows), strict=True))


def test_tokens_of_many_scripts():
    """Cyrillic, Chinese, Arabic, Hindi and pictures are counted by the table and the cache, and as the library does; so is any mixture."""
    import regex

    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    texts = tokens.plain(path)
    counter = tokens.Counter(path, tokens.frequent(path, texts), ["<|endoftext|>"], texts)
    rng = random.Random(1)
    pool = [chr(x) for x in [*range(32, 0x3000), *range(0x3040, 0xD7FF, 7), *range(0x1F300, 0x1FB20), 0x2F800]]
    some = ["Привет, мир", "漢字かな交じり文", "emoji 😀🎉 ok", "العربية ١٢٣", "हिन्दी में", "a\x1cb\x85c\u3000d"]
    assert all(regex.fullmatch(texts, t) for t in some)
    some += ["".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice(" ab1!\n'") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    assert counter.counts(some) == tokens.whole_counts(path, some) and len(counter.cache) > 1000


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<nav><a href=x>menu</a></nav><article><h1>T&amp;t</h1><p><b>One, two.<br><p>Three &#233;</article><footer>foot</footer>", "T&t One, two. Three é"),
        ("<body><header>Site</header><div class='sidebar'>side, side, side</div><div><p>A long text, with commas, and more.</p><p>Second.</p></div><div class=comments><p>nice, great, thanks</p></div></body>", "A long text, with commas, and more. Second."),
        ("<article><p>Text here</p><script>var a='</p>'</script><aside>ad</aside><form>mail</form></article>", "Text here"),
        ("<div>" * 3000 + "deep, text", "deep, text"),
        ("<div><section><p>" + "A long part, with commas. " * 9 + "</p></section><section><p>The end.</p></section></div>", "A long part, with commas. " * 9 + "The end."),
        ("<body><nav><a href=x>menu</a></nav><div id=c><div class=lead>Short lead.</div><div class=body><p>" + "Much text, here. " * 9 + "</p></div>Loose words <b>too</b>.</div></body>", "Short lead. " + "Much text, here. " * 9 + "Loose words too."),
        ("<main><article><p>An article, told.</p></article><section><p>And more.</p></section><div><a href=x>Read this</a> <a href=y>and that</a></div></main>", "An article, told. And more."),
        ("<body><form id=aspnetForm><input name=a><div><p>The text, in a form.</p><label>Its label</label></div><select><option>one</select></form></body>", "The text, in a form. Its label"),
        ("<article><p>Area <math><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup></math>, say.</p><form><label>Your mail</label><input></form></article>", "Area a=b2, say."),
        ("<article><p>Text, first.</p><section id='comment'><p>An editor's comment.</p></section><div class='social'><p>On social life.</p></div><div class='social-share'><p>Share!</p></div><div id=comments><p>nice</p></div></article>", "Text, first. An editor's comment. On social life."),
        ("<body><div>Site</div><div id=wrap><div id=text><p>" + "The text, at length. " * 9 + "</p></div></div><div><p>" + "Another column, as long. " * 9 + "</p></div><div>All rights reserved</div></body>", "The text, at length. " * 9 + "Another column, as long. " * 9),
    ],
)
def test_html(html, want):
    assert htmltext.main_text(html) == want.strip()


@pytest.mark.parametrize("name, gone", [("ad-hoc", 0), ("banner-image-caption", 0), ("menu-prices", 0), ("ad", 1), ("ad-slot", 1), ("cookieBanner", 1), ("post-body sidebar", 1), ("site_footer", 1), ("comments-list", 1), ("headerless", 0)])
def test_marks_are_whole_names(name, gone):
    assert htmltext.main_text(f"<article><p>Some text, here</p><p class='{name}'>and more, there</p></article>") == "Some text, here" + ("" if gone else " and more, there")


def test_html_is_linear():
    """A megabyte of nesting, stray end tags, open paragraphs and headers."""
    import time

    for page in ("<div>word, here " * 70_000, "<div>" * 100_000 + "</b></section>" * 50_000 + "x", "<p><b>word<br>" * 70_000, "<article>" + "<header>a " * 100_000, "<section><p>a, b</p>" * 50_000, "<!-- " * 200_000, "<a " * 300_000):
        began = time.time()
        htmltext.main_text(page)
        assert time.time() - began < 8, page[:40]  # under 2 s on an idle machine


def plain_scores(nodes):
    """Scores by walking each block's subtree and all its ancestors."""
    scores = {id(x): 0.0 for x in nodes}
    for x in nodes:
        text, linked, todo = [], 0, [(x, False)]
        while todo:
            at, link = todo.pop()
            for c in at.children:
                if isinstance(c, str):
                    text.append(c)
                    linked += len(" ".join(c.split())) * (link or at.tag == "a")
                elif c.tag in htmltext.INLINE:
                    todo.append((c, link or at.tag == "a"))
        size = sum(len(" ".join(t.split())) for t in text)
        if not size or x.tag in htmltext.INLINE:
            continue
        points = (1 + sum(t.count(",") for t in text) + min(size / 100, 3)) * (1 - linked / size)
        line = [x]
        while line[-1].parent:
            line.append(line[-1].parent)
        home = next((u for u in line if u.tag in ("article", "main")), None)
        if home:
            scores[id(home)] += points
        for level, up in enumerate(line[0 if x.tag in htmltext.HOLDS else 1 :][:5]):
            if up is not home:
                scores[id(up)] += points / 2**level
    return scores


def test_scores_agree_with_brute_force():
    rng = random.Random(17)
    tags = "div p section article main ul li b a span blockquote table tr td h2".split()
    for _ in range(60):
        page = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "some words, here ", "more text " * rng.randint(1, 20)]) for _ in range(120))
        b = htmltext.Builder()
        b.feed(page)
        b.close()
        nodes = htmltext._prune(b.open[0])
        htmltext.measure(nodes)
        want = plain_scores(nodes)
        assert all(abs(x.score - want[id(x)]) < 1e-9 for x in nodes)


def test_html_of_the_given_pages(spark):
    """Every page of sf0.01: the text between the article's tags, without them."""
    import html
    import re

    from tellur.llm import queries

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in queries.QUERIES["op4_html"](spark, "/root/testdata/sf0.01").collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"</?(?:p|h1|br|ul|li)[^>]*>", " ", re.sub(r"</?(?:b|a|i)[^>]*>", "", inner))).split()) and r.n_chars == len(r.text)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b</p>", "t"), (1, None, None, "t"), (None, "v", "", "t")], "page_id bigint, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in htmltext.extract(df).collect()) == [(0, "", 0), (1, "", 0), (1, "a b", 3)]


def test_warc_round_trip_and_salvage(spark, tmp_path):
    big = "<p>" + "é" * 700
    rows = [(1, "http://a/\r\nX: y", big), (7, "b", big), (3, None, big), (4, "d", "same"), (5, "e", "same"), (6, "f", None), (8, "g", "\r\n\r\nWARC/1.1\r\n"), (None, "n", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    warc.write(warc.plan(df), str(tmp_path / "w"), file_bytes=600)
    rows_back = warc.read_archives(spark, str(tmp_path / "w")).collect()
    got = {r.page_id: r for r in rows_back}
    assert len(rows_back) == len(rows) and not any(r.reason for r in rows_back)
    assert {k: r.refers_to for k, r in got.items()} == {1: 7, 3: 7, 7: None, 4: None, 5: None, 6: None, 8: None, None: None}
    assert bytes(got[8].payload) == rows[6][2].encode() and got[1].payload_bytes == 1403 and got[1].payload_digest == got[7].payload_digest


def test_warc_plans_agree_and_empty_tables(spark, tmp_path, monkeypatch):
    big = "<p>" + "x" * 1200
    rows = [(i % 7, "u", big if i % 3 else big + str(i % 5)) for i in range(40)] + [(None, None, big), (50, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"digest": F.lit(1), "largest": F.lit(2)})
    small = sorted(map(str, warc.plan(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.plan(df).select(*warc.plan(df).columns).collect())) == sorted(map(str, small)) and len(small) == len(rows)
    warc.write(warc.plan(df.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_a_flipped_byte_loses_one_record(spark, tmp_path):
    """Damage in files that the writer made: all records but one come back, and the gap is logged."""
    import glob
    import gzip

    rows = [(i, f"http://h/{i}", " ".join(f"w{(i * 31 + j) % 977}" for j in range(120))) for i in range(300)]
    warc.write(warc.plan(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)), str(tmp_path / "w"))
    (file,) = (f for f in glob.glob(f"{tmp_path}/w/part-*") if open(f, "rb").read(2))
    whole = open(file, "rb").read()
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == 300
    for share in (0.1, 0.5, 0.9):
        hurt = bytearray(whole)
        hurt[int(len(hurt) * share)] ^= 0x55
        found = list(warc.salvage(bytes(hurt)))
        pages = {r["page_id"] for r, _ in found if r}
        assert len(pages) == 299 and len([g for _, g in found if g]) == 1
    cut = list(warc.salvage(whole[: len(whole) // 2]))
    assert len([r for r, _ in cut if r]) > 140 and cut[-1][1]
    (tmp_path / "hurt.warc.gz").write_bytes(bytes(hurt))
    back = warc.read_archives(spark, str(tmp_path / "hurt.warc.gz")).collect()
    assert sum(r.reason is None for r in back) == 299 and [r.page_id for r in back if r.reason] == [None]


def test_salvage_is_linear():
    """Many false version lines and member heads: each byte is searched once."""
    import time

    for junk in (b"WARC/1.x ", b"\x1f\x8b\x08"):
        began = time.time()
        gaps = [g for _, g in warc.salvage(junk * 60_000 + one(1, b"x")) if g]
        assert [g[:2] for g in gaps] == [(0, len(junk) * 60_000)] and time.time() - began < 8


def one(page, body):
    import hashlib

    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}:x>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_salvage_of_damaged_archives():
    records = [one(i, f"body {i}".encode() * 20) for i in range(5)]
    pages = lambda data: [r["page_id"] for r, _ in warc.salvage(data) if r]
    gaps = lambda data: [g for _, g in warc.salvage(data) if g]
    plain = b"".join(records)
    assert pages(plain) == [0, 1, 2, 3, 4] and not gaps(plain)
    broken = records[0] + records[1].replace(b"body 1", b"bady 1", 1) + b"junk" + records[2] + records[3][:50] + records[4]
    assert pages(broken) == [0, 2, 4]
    assert [g[:2] for g in gaps(broken)] == [(len(records[0]), len(records[0] + records[1]) + 4), (len(broken) - len(records[4]) - 50, len(broken) - len(records[4]))]
    members = [warc.pack_member(r) for r in records]
    hurt = members[0] + members[1][:-20] + members[2] + b"\x1f\x8bnoise" + members[3]
    assert {0, 2, 3} <= set(pages(hurt)) and gaps(hurt)
    assert pages(warc.pack_member(plain)) == [0, 1, 2, 3, 4]
    assert pages(b"") == [] and gaps(b"only junk")[0][:2] == (0, 9)


def test_mixing_by_hand(docs):
    rows = docs.select("text", "source").collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len((r.text or "").encode().split())
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, live = {}, 1.5 * sum(size.values()), set(size)
    while live:
        level = left / sum(weight[s] for s in live)
        full = {s for s in live if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: level * weight[s] for s in live}
        left -= sum(2 * size[s] for s in full)
        live = live - full if full else set()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size and r.source_size == size[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(2, 0.02 * target[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_rows_keep_their_own_size(spark):
    rows = [(None, "a b c d", "s", 7, 8), (None, "x", "s", 7, 8), (3, "p q", "t", 7, 8), (3, "p q r s t", "t", 7, 8), (4, None, None, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, Size int, _size int")
    got = mixing.mixed(df, share=2.0).collect()
    assert sorted((r.text, r.size, r.taken, r.source_size) for r in got) == [("a b c d", 4, 8, 5), ("p q", 2, 4, 7), ("p q r s t", 5, 10, 7), ("x", 1, 2, 5)]
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "__Size", "_size", "size", "source_size", "target", "taken"}
    assert mixing.mixed(df.limit(0)).count() == 0


def labelled_docs(spark, kind):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = prose(rng, rng.randint(30, 200))
        if kind == "toxic" and bad:
            text += " you utter " + rng.choice(["dolt", "dunce"]) + " go"
        if kind == "quality" and not bad:
            text = text.upper() + "!! $$$ ###"
        rows.append((i, text, None, "s", 1, "a", "b", "c", 7))
        labels.append((i, int(bad), int(bad)))
    rows += [(1000, "", None, None, None, None, None, None, None), (1001, None, None, None, None, None, None, None, None), (None, "x", None, None, None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (1, None, None), (5000, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("kind, score", [("quality", quality.quality), ("toxic", toxicity.toxicity)])
def test_classifiers_on_held_out_rows(spark, kind, score):
    docs, labels = labelled_docs(spark, kind)
    got = score(docs, labels)
    right = got.join(labels, "doc_id").where("held_out").select((F.col("predicted") == F.col(kind)).cast("int").alias("ok")).toPandas().ok
    assert len(right) > 40 and right.mean() > 0.95
    rows = got.collect()
    assert len(rows) == 404 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}
    assert score(docs.limit(0), labels).count() == 0


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(7, quality.N_FEATURES)), np.array([0, 3, 7]), np.array([1.0, 0.0])
    h, g = quality.HIDDEN, quality.GATE
    m = {"mean": 0, "std": 1, "w1": rng.normal(size=(quality.N_FEATURES, h)) / 5, "b1": rng.normal(size=h), "v": rng.normal(size=(h, g)), "u": rng.normal(size=(h, g)), "a": rng.normal(size=g), "c": rng.normal(size=h), "d": np.zeros(1)}

    def loss():
        p = quality.forward(m, x, starts)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, d in quality.gradients(m, x, starts, y).items():
        at = (0,) * d.ndim
        m[k][at] += 1e-6
        up = loss()
        m[k][at] -= 2e-6
        assert d[at] == pytest.approx((up - loss()) / 2e-6, abs=1e-6)
        m[k][at] += 1e-6


def plain_passages(text):
    """The vector of each passage by loops over words and characters."""
    words = [w for w in quality_words(text) if w]
    groups = [words[i : i + quality.PASSAGE] for i in range(0, len(words), quality.PASSAGE)] or [[]]
    out = []
    for g in groups:
        length = [len(w) for w in g]
        x = np.zeros(quality.N_FEATURES)
        n, at = max(1, len(g)), quality.N_KINDS
        x[at] = np.log1p(len(g)) / 4
        if words:
            mean = sum(length) / n
            x[at + 1] = np.log1p(mean)
            x[at + 2] = np.sqrt(max(0, sum(v * v for v in length) / n - mean**2)) / (1 + mean)
            x[at + 3] = len(set(g)) / n
            x[at + 4] = sum(a == b for a, b in zip(g, g[1:], strict=False)) / n
            x[at + 5] = sum(v > 24 for v in length) / n
        x[at + 6] = not g
        for w in g:
            w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
            h = 0
            for i, c in enumerate(w):
                h = (h + int(quality._CODES[c]) * int(quality._POWERS[i & 63])) % 2**64
            x[quality.N_MEASURES + int(quality.mix(np.array([h], np.uint64))[0] % np.uint64(quality.BUCKETS))] += 1 / n
        x[quality.N_MEASURES :] = np.sqrt(x[quality.N_MEASURES :])
        out.append(x)
    return np.array(out)


def quality_words(text):
    import re

    return re.split(rb"[ \t\r\v\f\n]+", (text or "").encode("utf-8", "replace"))


def test_passages_agree_with_plain_loops():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Word", "word", "x" * 30, "a,b", "é1", "!!", "stone"]) for _ in range(rng.choice([0, 1, 5, 64, 65, 200]))) for _ in range(12)] + ["", None, "  lead\n\nand trail  "]
    x, starts = quality.passages(texts)
    want = [plain_passages(t) for t in texts]
    assert list(np.diff(starts)) == [len(w) for w in want]
    at = [i for i in range(quality.N_FEATURES) if i >= quality.N_KINDS]
    assert np.allclose(x[:, at], np.concatenate(want)[:, at], atol=1e-6)
    kinds = x[:, : quality.N_KINDS] ** 2  # shares of the kinds of bytes, blanks before and between words included
    assert np.allclose(kinds.sum(axis=1), 1, atol=1e-6)
    assert kinds[starts[-2], quality._KIND[ord("\n")]] == pytest.approx(2 / 20) and kinds[starts[-2], quality._KIND[ord("a")]] == pytest.approx(12 / 20)


def test_scores_of_quality_agree_with_plain_loops(spark):
    """Every row's score by loops over passages, from the model that the operator fits."""
    import math

    docs, labels = labelled_docs(spark, "quality")
    m = quality.model_of(docs, labels)
    rows = sorted(((r.doc_id or -1, r.text) for r in docs.collect()), key=str)
    got = sorted((r.doc_id or -1, r.score) for r in quality.quality(docs, labels).collect())
    want = []
    for i, text in rows:
        hs, es = [], []
        for x in quality.passages([text])[0]:
            h = [math.tanh(sum((x[j] - m["mean"][j]) / m["std"][j] * m["w1"][j, k] for j in range(len(x))) + m["b1"][k]) for k in range(quality.HIDDEN)]
            e = 0.0
            for g in range(quality.GATE):
                t, u = (sum(h[k] * m[w][k, g] for k in range(quality.HIDDEN)) for w in "vu")
                e += math.tanh(t) / (1 + math.exp(-u)) * m["a"][g]
            hs.append(h)
            es.append(math.exp(e))
        z = [sum(e * h[k] for e, h in zip(es, hs, strict=True)) / sum(es) for k in range(quality.HIDDEN)]
        s = sum(a * b for a, b in zip(z, m["c"], strict=True)) + float(m["d"][0])
        want.append((i, 1 / (1 + math.exp(-max(-35, min(35, s))))))
    assert [a for a, _ in got] == [a for a, _ in sorted(want)] and all(abs(a - b) < 1e-5 for (_, a), (_, b) in zip(got, sorted(want), strict=True))


def plain_features(text):
    """Buckets of one text's words, stems, neighbours and skips, by loops."""
    import re

    words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode("utf-8", "replace"))
    h = [int(word_hashes([w.decode()])[0][0]) for w in words]
    stems = [int(word_hashes([w.decode()], (toxicity.STEM,))[2][0]) for w in words]
    pairs = [(0xD6E8FEB86659FD93 * a + b) % 2**64 for a, b in zip(h, h[1:], strict=False)] + [(0xA0761D6478BD642F * a + b) % 2**64 for a, b in zip(h, h[2:], strict=False)]
    mixed = [int(x) for x in toxicity.mix(np.array(pairs, np.uint64))] if pairs else []
    return {x >> (64 - toxicity.BITS) for x in [*h, *stems, *mixed]}


def test_toxicity_agrees_with_a_plain_loop(spark):
    """FTRL-proximal by dictionaries, one coordinate after the other, and every row's score from its weights."""
    import math

    docs, labels = labelled_docs(spark, "toxic")
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    import zlib

    own = sorted((i, t) for i, t in rows if i in y and zlib.crc32(str(i).encode()) % 5)
    ids = np.array([i for i, _ in own], np.int64)
    own = [own[i] for i in np.argsort(toxicity.mix(ids.view(np.uint64)), kind="stable")]
    sets = [plain_features(t) for _, t in own]
    seen = {}
    for s in sets:
        for f in s:
            seen[f] = seen.get(f, 0) + 1
    z, n, strength = {}, {}, toxicity.l1(len(own))

    def weight(f):
        if f not in z or abs(z[f]) <= (least := 0 if f == "bias" else strength):
            return 0.0
        return -(z[f] - math.copysign(least, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for (i, _), s in zip(own, sets, strict=True):
            live = [f for f in s if seen[f] >= toxicity.LEAST_DOCS] + ["bias"]
            w = {f: weight(f) for f in live}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for f in live:
                z[f] = z.get(f, 0) + g - (math.sqrt(n.get(f, 0) + g * g) - math.sqrt(n.get(f, 0))) / toxicity.ALPHA * w[f]
                n[f] = n.get(f, 0) + g * g
    want = sorted((i or -1, 1 / (1 + math.exp(-weight("bias") - sum(weight(f) for f in plain_features(t))))) for i, t in rows)
    got = sorted((r.doc_id or -1, r.score) for r in toxicity.toxicity(docs, labels).collect())
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(got, want, strict=True))


def test_training_rows_are_bounded(spark):
    from tellur.llm.common import labelled

    docs, labels = labelled_docs(spark, "toxic")
    whole = labelled(docs, labels, "toxic", 10_000)
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0]
    fewer = labelled(docs, labels, "toxic", 10_000, most_bytes=size // 3)
    assert whole.count() > 300 and 0.15 * size < fewer.agg(F.sum(F.octet_length("text"))).first()[0] < 0.5 * size
    assert 50 < labelled(docs, labels, "toxic", 100).count() < 150


def test_licenses(spark):
    text = licenses.TEMPLATES["MIT/text"]
    gpl = "#! /bin/sh\n# " + licenses.TEMPLATES["GPL-3.0/header"].replace("modify it", "modify\n# it").replace(". ", ".\n#\n# ")
    rows = [
        (1, "a b c\nThis project is Released under the MIT License.\nend"),
        (2, "x\n\nCopyright (c) 1999 Someone\n\n" + text.replace(", ", ",\n") + "\n\ny"),
        (3, None),
        (4, ""),
        (5, "the mit of the cats under license"),
        (None, "LICENSED under CC BY-NC 4.0!"),
        (1, "a b c\nThis project is Released under the MIT License.\nend"),
        (6, gpl),
        (7, "we say: " + licenses.TEMPLATES["BSD-3-Clause/text"].replace("copyright holder", "Some Company", 1) + " and more, all in one long line " * 50),
        (8, "word"),
        (9, "under the terms of the License " * 400),
        (10, "Released under the MIT License. " * 300 + "Licensed under CC BY 4.0."),
        (11, f"Part one. {text} Part two: x {text.replace('copies', 'things', 1)}"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"w": F.lit(1), "b": F.lit(1), "k": F.lit(1)})).collect()
    found = sorted((r.doc_id or 0, r.license, r.start, r.n_words) for r in got)
    assert found == [
        (0, "CC-BY-NC-4.0/notice", 0, 7),
        (1, "MIT/notice", 6, 5),
        (1, "MIT/notice", 6, 5),
        (2, "MIT/text", 5, len(licenses.words_of(text))),
        (6, "GPL-3.0/header", 2, len(licenses.words_of(licenses.TEMPLATES["GPL-3.0/header"]))),
        (7, "BSD-3-Clause/text", 2, len(licenses.words_of(licenses.TEMPLATES["BSD-3-Clause/text"]))),
        (10, "CC-BY-4.0/notice", 1500, 6),
        *((10, "MIT/notice", 5 * i, 5) for i in range(300)),
        (11, "MIT/text", 2, n := len(licenses.words_of(text))),
        (11, "MIT/text", n + 5, n),
    ]
    assert licenses.scan(spark.createDataFrame(rows[:0], "doc_id bigint, text string")).count() == 0


def test_licenses_agree_with_sql(spark, tmp_path):
    """Altered, cut and merged templates among prose, scanned with the pruning and by the SQL without."""
    import duckdb

    rng = random.Random(23)
    names = list(licenses.TEMPLATES)
    rows = [(0, None), (1, ""), (2, "the"), (2, "the license")]
    for i in range(150):
        words = prose(rng, rng.randint(0, 40)).split()
        for name in rng.sample(names, rng.randint(0, 3)):
            own = licenses.TEMPLATES[name].split()
            for at in rng.sample(range(len(own)), int(len(own) * rng.choice([0, 0.03, 0.08, 0.15]))):
                own[at] = rng.choice(["", "changed", own[at].upper()])
            words += own[: rng.choice([None, None, len(own) * 9 // 10])] + prose(rng, rng.randint(0, 10)).split()
        rows.append((i, rng.choice([" ", "\n", "\n\n", " * "]).join(words)))
    for i in range(150, 180):  # notices that follow each other, whole, altered and cut
        own = licenses.TEMPLATES[rng.choice(names)].split()
        words = []
        for _ in range(rng.randint(2, 5)):
            copy = [w if rng.random() > 0.03 else "changed" for w in own]
            words += copy[rng.choice([0, 0, len(own) // 10]) :] + prose(rng, rng.choice([0, 0, 3])).split()
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    documents = docs.toPandas()  # noqa: F841  DuckDB reads it by name
    want = sorted(duckdb.sql(licenses.ORACLE).fetchall(), key=str)
    assert sorted(map(tuple, licenses.scan(docs).collect()), key=str) == want and len(want) > 120


def test_licenses_in_a_long_text(spark):
    """600 KB of licence texts in one row: every one is found, in time that grows with the text."""
    text = licenses.TEMPLATES["MIT/text"]
    docs = spark.createDataFrame([(1, f"{text} " * 600)], "doc_id bigint, text string")
    start = time.monotonic()
    got = sorted(r.start for r in licenses.scan(docs).collect())
    assert got == [i * len(licenses.words_of(text)) for i in range(600)]
    assert time.monotonic() - start < 30


def test_licenses_by_whole_texts(spark, tmp_path):
    """Templates of a folder, of thousands of words each: a copy with changed words is found where it stands, windows are those of a plain loop."""
    rng = random.Random(31)
    for name in ("long", "longer"):
        (tmp_path / "texts").mkdir(exist_ok=True)
        (tmp_path / "texts" / name).write_text(" ".join(f"word{rng.randrange(900)}" for _ in range(3000 if name == "long" else 6000)))
    own = licenses.texts_in(spark, str(tmp_path / "texts"))
    assert sorted(own) == ["long", "longer"]
    copy = [w if rng.random() > 0.02 else "changed" for w in own["long"].split()]
    rows = [(1, " ".join(["before", "it", *copy, "after", "it", *copy])), (2, own["longer"]), (3, " ".join(copy[:1000]))]
    got = sorted(licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), own).collect())
    words = licenses.words_of(own["long"])
    assert [(r.doc_id, r.license, r.n_words) for r in got] == [(1, "long", len(words)), (1, "long", len(words)), (2, "longer", len(licenses.words_of(own["longer"])))]
    whole, n = licenses.words_of(rows[0][1]), len(words)
    want = set(licenses.bigrams_of(words))

    def dice(s):
        x = set(licenses.bigrams_of(whole[s : s + n]))
        return 2 * len(x & want) / (len(x) + len(want))

    for r in got[:2]:
        near = {s: dice(s) for s in range(max(0, r.start - 40), r.start + 40) if " ".join(whole[s : s + 2]) in want}
        assert r.start == min(near, key=lambda s: (-near[s], s)) and r.dice == round(near[r.start], 6)
    with pytest.raises(ValueError, match="bytes"):
        licenses.texts_in(spark, str(tmp_path / "texts"), 100)


def test_lcs():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(np.array(a), np.array(b)) == t[-1][-1]


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 20) + f" item{i} alpha{i} beta{i}. Answer gamma{i} delta{i}.") for i in range(4)] + [(9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    near = items[1][1].replace("item1", "other")
    rows = [(1, prose(rng, 100) + " " + items[0][1] + " " + prose(rng, 50)), (2, near.upper()), (3, prose(rng, 300)), (4, None), (5, ""), (None, items[2][1]), (2, near.upper()), (2, "a clean text by the same id"), (None, "no id and no item")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit(5))
    assert sorted((r.doc_id or 0, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [(0, 2), (1, 0), (2, 1), (2, 1)]
    assert sorted(r.doc_id or 0 for r in decontaminate.untouched(docs, bench).collect()) == [0, 2, 3, 4, 5]
    assert "no id and no item" in {r.text for r in decontaminate.untouched(docs, bench).collect()}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_leaks_agree_with_all_windows(spark, monkeypatch):
    """Whole, altered and cut passages of short and long items, against every window of every document; in one part and in several."""
    rng = random.Random(27)
    new = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    texts = []
    for i, n in enumerate((1, 2, 5, 9, 16, 30, 70, 70, 12)):
        words = new(n) + [f"only{i}"] * (n > 5)
        texts.append(" ".join(words[: n // 2]) + ". " + " ".join(words[n // 2 :]) + ".")
    bench = spark.createDataFrame([*((i, t) for i, t in enumerate(texts)), (3, texts[4])], "item_id bigint, text string")
    rows = []
    for _ in range(120):
        words = new(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            copy = rng.choice(texts).replace(".", "").split()
            for at in rng.sample(range(len(copy)), int(len(copy) * rng.choice([0, 0.1, 0.25, 0.32, 0.5]))):
                copy[at] = rng.choice(new(3))
            words += copy + new(rng.randint(0, 20))
        rows.append((len(rows), " ".join(words)))
    items = decontaminate.Items(*zip(*((r.item_id, r.text) for r in bench.collect()), strict=True))
    want, step = set(), decontaminate.STEP
    for i, text in rows:
        c = np.concatenate([items.codes(word_hashes([text])[0]), np.zeros(200, np.uint32)])
        for item, target, end in zip(items.ids, items.words, items.answers, strict=True):
            m = (-(-len(target) // step) + 1) * step
            for at in range(0, len(text.split()), step):
                if decontaminate.lcs(target, c[at : at + m]) >= 0.7 * len(target) - 1e-9 and decontaminate.lcs(end, c[at : at + m]) >= 0.5 * len(end) - 1e-9:
                    want.add((i, int(item)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = lambda: {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert found() == want and len(want) > 100
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 300)
    assert found() == want
    some = docs.where("doc_id % 3 = 0")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(some, bench).collect()} == {(a, b) for a, b in want if a % 3 == 0}


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", "sf0.1"])
def test_leaks_find_every_copy_and_paraphrase(spark, table):
    """Every item word for word, with 5 words put in, and with a quarter of its words replaced, each inside a document, beside the whole table."""
    rng = random.Random(21)
    folder = f"/root/testdata/{table}"
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    hosts = [r.text.split() for r in docs.where("length(text) > 600").orderBy("doc_id").limit(200).collect()]
    other = lambda: rng.choice(rng.choice(hosts))
    rows, want = [], {0: set(), 1: set(), 2: set()}
    for item in bench.orderBy("item_id").collect():
        for kind in want:
            words = item.text.split()
            for _ in range(5 if kind == 1 else 0):
                words.insert(rng.randrange(len(words)), other())
            for at in rng.sample(range(len(words)), len(words) // 4 if kind == 2 else 0):
                words[at] = other()
            own = decontaminate.Items([0], [item.text])
            n, answer = len(own.words[0]), len(own.answers[0])
            # As much of the copy as a window holds at any offset.
            held = own.codes(word_hashes([" ".join(words)])[0])[: -(-n // decontaminate.STEP) * decontaminate.STEP + 1]
            if decontaminate.lcs(own.words[0], held) >= 0.7 * n and decontaminate.lcs(own.answers[0], held) >= 0.5 * answer:
                want[kind].add((-1 - len(rows), item.item_id))
            host = rng.choice(hosts)
            at = rng.randrange(len(host))
            rows.append((-1 - len(rows), " ".join(host[:at] + words + host[at:])))
    assert all(len(x) > 0.7 * len(rows) / 3 for x in want.values())
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs.union(spark.createDataFrame(rows, docs.schema)), bench).collect()}
    assert [len(x - got) for x in want.values()] == [0, 0, 0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near-dedup", "decontamination", "mixing"]
    """Planted junk, toxic texts, copies, near copies and leaks go; clean documents stay."""
    rng = random.Random(4)
    rows, labels, junk, toxic = [], [], set(), set()
    for i in range(900):
        words = [f"{rng.choice('bcdfghklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['a', 'en', 'ing', 'or'])}" for _ in range(rng.randint(40, 200))]
        text = " ".join(words)
        if i % 5 == 1:
            junk.add(i)
            text = text.upper() + " $$$ ### !!! " * 20
        if i % 5 == 2:
            toxic.add(i)
            text += " you utter " + rng.choice(["dolt", "dunce"]) + " go"
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, int(i not in junk), int(i in toxic)))
    clean = [i for i in range(900) if i not in junk | toxic]
    item = " ".join(f"quiz{i}" for i in range(24)) + ". Answer is nine."
    leaks = set(clean[10:20])
    for i in leaks:
        rows[i][1] += " " + item
    copies, near = {}, {}
    for k, i in enumerate(clean[30:50]):
        copies[2000 + k], words = i, rows[i][1].split()
        near[3000 + k] = i
        words[len(words) // 2] = "changed"
        rows += [[2000 + k, rows[i][1], "en", "s1", 1], [3000 + k, " ".join(words), "en", "s2", 1]]
    # A leak without an id, and a clean text by the id of a leak.
    rows += [[None, " ".join(f"hidden{i}" for i in range(60)) + " " + item, None, None, None], [clean[10], rows[clean[60]][1] + " " + rows[clean[61]][1], "en", "s1", 1]]
    rows += [[None, " ".join(f"lonely{i}" for i in range(30)), None, None, None], [4000, None, None, None, None], [4001, "", None, "s1", 0]]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, folder = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    ids, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        assert name == "mixing" or docs.columns == columns
        ids.append({r.doc_id for r in docs.collect()})
        texts = {r.text for r in docs.collect() if r.text}
        assert name != "decontamination" or not any("hidden1" in t or item in t for t in texts)
    good, mild, single, pure, mixed = ids
    assert len(good & junk) <= 5 and len(good - junk) >= 700 and None in good
    assert len(mild & toxic) <= 5 and len(good - toxic - mild) <= 5
    assert not single & (copies.keys() | near.keys()) and {i for i in copies.values() if i in mild} <= single
    assert single == mild - copies.keys() - near.keys() - ({4001} if 4000 in mild else set())
    assert pure - {clean[10]} == single - leaks and leaks & single and clean[10] in pure
    whole = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole.keys() == mixed and mixed <= pure and all(r.taken > 0 for r in whole.values())
