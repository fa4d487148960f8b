"""Token counts by a two-tier lookup on the map side, without a shuffle.

The tokenizer encodes pre-tokens one by one, so a text's count is the sum over its pre-tokens. Tier one is a table of
pre-token lengths that every task gets: the entries of the tokenizer's own vocabulary, the frequent pre-tokens of its
training text, so the table is as large as the vocabulary at most and doesn't grow with the corpus. Tier two is a bounded
cache in the worker: pre-tokens that the table misses are encoded together, once, by the library itself. Which characters
the pattern splits as the library does is found out from the library, for the scripts in use, when a job begins; texts with
any other character, or with a special token's string, go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellur.llm.common import read

#: The published pre-token pattern of byte-level BPE (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache; it starts anew when full.
CACHE = 500_000


@lru_cache(maxsize=2)
def _load(path: str, kind: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part; the library's threads would contend with them
    if kind == "sentencepiece":
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _kind(path: str) -> str:
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def whole_counts(path: str, texts: list[str]) -> list[int]:
    """Counts by the library alone."""
    t = _load(path, _kind(path))
    if _kind(path) == "sentencepiece":
        return [len(x) for x in t.encode(texts, num_threads=1)]
    return [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def plain(path: str) -> str:
    """A pattern of texts whose characters the tokenizer's own splitter treats as PRE_TOKEN does.

    What a character does to a split follows from its kind (letter, number, space or other), which shows beside one of
    each kind: so each character stands in a line of such neighbours, and its line's splits are compared. Versions of
    Unicode differ in the kinds of some.
    """
    splitter, find = _load(path, "tokenizers").pre_tokenizer, regex.compile(PRE_TOKEN).finditer
    codes = [*range(0xD800), *range(0xE000, 0x10000), *range(0x1F000, 0x1FB00)]  # without surrogates; of other planes, pictures
    odd, width = set(), 12
    for i in range(0, len(codes), 4096):
        part = codes[i : i + 4096]
        text = "".join(f"a{c}a1{c}1!{c}! {c} " for c in map(chr, part))
        mine, theirs = ({m.span() for m in find(text)}, {x for _, x in splitter.pre_tokenize_str(text)})
        odd |= {part[(place - 1) // width] if place else part[0] for span in mine ^ theirs for place in span}
        odd |= {part[min(len(part) - 1, place // width)] for span in mine ^ theirs for place in span}
    good = [x for x in codes if x not in odd]
    runs, start = [], None
    for x, after in zip(good, [*good[1:], None], strict=True):
        start = x if start is None else start
        if after != x + 1:
            runs.append(f"{regex.escape(chr(start))}-{regex.escape(chr(x))}")
            start = None
    return f"[{''.join(runs)}]*"


def frequent(path: str, texts: str) -> dict[str, int]:
    """Lengths in tokens of the vocabulary's entries that are one pre-token, as text of the pattern `texts`."""
    t, fits = _load(path, "tokenizers"), regex.compile(texts).fullmatch
    decode = {v: k for k, v in _byte_letters().items()}
    words = []
    for entry in t.get_vocab(with_added_tokens=False):
        raw = bytes(decode[c] for c in entry) if all(c in decode for c in entry) else b"\xff"
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if regex.fullmatch(PRE_TOKEN, text) and fits(text):
            words.append(text)
    return dict(zip(words, whole_counts(path, words), strict=True))


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes byte b as the b-th printable Latin-1 character, or as the next one from 256 on if b isn't printable."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts of texts in one worker."""

    def __init__(self, path: str, table: dict[str, int] | None, specials: list[str], texts: str = ""):
        self.path, self.table, self.cache = path, table, {}
        self.find = regex.compile(PRE_TOKEN).findall
        self.plain = regex.compile(texts).fullmatch
        self.specials = specials

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        whole = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.table is None or any(s in t for s in self.specials) or not self.plain(t):
                whole.append(i)
            else:
                out[i] = self._count(t)
        for i in range(0, len(whole), 64):
            for j, n in zip(whole[i : i + 64], whole_counts(self.path, [texts[j] for j in whole[i : i + 64]]), strict=True):
                out[j] = n
        return out

    def _count(self, text: str) -> int:
        parts = self.find(text)
        # One look-up for each pre-token: set.difference with two tables would walk the whole cache for every text.
        if missed := {p for p in set(parts) if p not in self.table and p not in self.cache}:
            if len(self.cache) + len(missed) > CACHE:
                self.cache = {}
                missed = {p for p in set(parts) if p not in self.table}
            missed = list(missed)
            self.cache.update(zip(missed, whole_counts(self.path, missed), strict=True))
        both = [self.table.get(p) or self.cache[p] for p in parts]
        return sum(both)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, by the tokenizer file at `path` (present on every machine).

    Null and empty texts have no bytes and no tokens. Ids are kept as they are, null or repeated; other columns take no
    part. An empty table gives none. Texts of any length are counted whole. A tokenizer whose pre-tokens aren't those of
    byte-level BPE (sentencepiece among them) counts every text by its library.
    """
    import json

    spec = {} if _kind(path) == "sentencepiece" else json.loads(_load(path, "tokenizers").to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain_bpe = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    fits = plain(path) if plain_bpe else ""
    table = frequent(path, fits) if plain_bpe else None
    specials = [x["content"] for x in spec.get("added_tokens", [])]
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, sent.value, specials, fits)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = counter.counts(texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(work, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op3_tokens(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of all `documents` by byte_bpe_50k.json."""
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
