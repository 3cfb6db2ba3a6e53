"""Token counts without a shuffle: a broadcast table of frequent pre-token lengths, then a bounded cache in each worker.

A text is cut at special-token strings, then into pre-tokens; its count is the sum of the pre-tokens' lengths.
The broadcast table only warms the caches, so it may come from a bounded sample and never changes a result.
Texts with characters outside a few settled Unicode blocks are encoded whole by the library.
Null and empty texts have no bytes and no tokens; repeated rows, ties and extra columns pass through unchanged.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern that byte-level BPE vocabularies of this kind state.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class no Unicode version disputes (Latin, and the common letters of Greek, Cyrillic, kana, Han and Hangul);
#: a text with any other goes to the library whole.
UNSETTLED = "[^\\t-\\r\\x20-\\x7e\\xa0-\u024f\u2010-\u2027\u20ac\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0401\u0410-\u044f\u0451\u3001\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
CACHE_ENTRIES = 1 << 19
LONGEST_CACHED = 48
SAMPLE_DOCS = 2000
FREQUENT = 1 << 16


class TokenCounter:
    """Counts tokens of texts in one worker."""

    def __init__(self, spec: str, frequent: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        parsed = json.loads(spec)
        if (parsed.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or parsed.get("normalizer") or parsed["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE files without a normalizer or prefix space are supported")
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        added = sorted((t["content"] for t in parsed.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(PRE_TOKEN).findall
        self.unsettled = regex.compile(UNSETTLED).search
        self.frequent = frequent
        counter = self

        class Cache(dict):
            def __missing__(self, piece: str) -> int:
                n = counter.whole(piece)
                if len(piece) <= LONGEST_CACHED:
                    if len(self) >= CACHE_ENTRIES:
                        self.clear()
                        self.update(counter.frequent)
                    self[piece] = n
                return n

        self.cache = Cache(frequent)

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.unsettled(text):
            return self.whole(text)
        look = self.cache.__getitem__
        if self.special is None or not self.special.search(text):
            return sum(map(look, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(look, self.split(p))) for p in parts)


def frequent_lengths(docs: DataFrame, text_col: str, spec: str, sample_docs: int = SAMPLE_DOCS, keep: int = FREQUENT) -> dict[str, int]:
    """Token counts of the commonest pre-tokens of about sample_docs documents; at most keep entries of 48 characters."""
    n = docs.count()
    if not n:
        return {}
    share = min(1.0, sample_docs / n)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        split, seen = regex.compile(PRE_TOKEN).findall, Counter()
        for b in batches:
            for t in b["__text"]:
                if isinstance(t, str):
                    seen.update(split(t))
        top = [(p, c) for p, c in seen.most_common(keep) if len(p) <= LONGEST_CACHED]
        yield pd.DataFrame(top, columns=["piece", "n"]).astype({"piece": object, "n": "int64"})

    sample = docs.select(F.col(text_col).alias("__text")).sample(fraction=share, seed=11)
    rows = sample.mapInPandas(tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(keep).collect()
    counter = TokenCounter(spec, {})
    return {r.piece: counter.whole(r.piece) for r in rows}


def with_token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a long column of token counts.  The tokenizer file is read on the driver and broadcast, with the frequent table."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, frequent_lengths(docs, text_col, spec)))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(*shared.value)
        for texts in batches:
            yield pd.Series([counter.count(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return docs.withColumn(out, count(F.col(text_col)))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    counted = with_token_counts(slim, tokenizer_path, "__text")
    return counted.select("doc_id", F.octet_length(F.coalesce("__text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
