"""Language identification: scripts narrow the candidates, word scores feed a Viterbi pass with a switching penalty.

A model holds, per language, log probabilities of hashed character trigrams of lower-cased words, and the languages seen
in each script.  A word is scored by its trigrams for the candidates of its script only.  The best path through the
words, where a change of language costs a fixed penalty, labels spans; the language with most words wins.  Words in a
script that no language was seen in have no label and are in no span.
The score is absolute: the share of the text (in bytes of its words) that has a label, times how likely its trigrams are
in the languages they are labelled with, as a geometric mean and relative to the training texts (1 at most).  Mixing
learned languages does not lower it, and a text of a few letters has a high one whatever it holds.
Null texts and texts without a word with a label are `und` with score 0 and no spans.  An empty training set makes every
text `und`.  Repeated rows get equal results; texts are read whole.  Of languages that score alike the first by name wins.
An empty table gives no rows.  Only the id, text and language columns are read, so others may have any name.  Words are
runs of letters, so a combining mark parts a word in two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, release, small_batches

#: First and last code points of the letters of scripts.
SCRIPTS = (
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x531, 0x58F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ("other",)
BUCKETS = 1 << 15
#: Bound of the training sample, in rows per language.
TRAIN_ROWS = 1500
SWITCH = 6.0
#: Trigrams of the usual likelihood that every score starts from, so that a word or two alone say little.
FEW = 20
CACHE_WORDS = 150_000
RESULT = "lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"


def script_of(letter: str) -> int:
    c = ord(letter)
    for name, low, high in SCRIPTS:
        if low <= c <= high:
            return NAMES.index(name)
    return len(NAMES) - 1


def trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of the words, each between two spaces, and where each word's begin."""
    coded = [f" {w} ".encode("utf-8", "replace") for w in words]
    data = np.frombuffer(b"".join(coded) + b"  ", dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    key = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    key = ((key * np.uint32(2654435761)) >> np.uint32(17)) & np.uint32(BUCKETS - 1)
    ends = np.cumsum(sizes)
    keep = np.ones(len(key), dtype=bool)
    keep[ends - 1] = False  # trigrams that reach into the next word
    keep[ends - 2] = False
    keep[ends[-1] :] = False
    return key[keep], np.concatenate(([0], np.cumsum(sizes - 2)[:-1]))


def letter_runs(text: str) -> list[str]:
    import regex

    return regex.findall(r"\p{L}+", text.lower())


class Model:
    """langs; log probabilities (BUCKETS x langs); which languages a script admits (scripts x langs); mean log probability of a training trigram by language."""

    def __init__(self, langs: list[str], logp: np.ndarray, admits: np.ndarray, usual: np.ndarray):
        self.langs, self.logp, self.admits, self.usual = langs, logp.astype(np.float32), admits, usual


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows_per_lang: int = TRAIN_ROWS) -> Model:
    """A model from a sample of about rows_per_lang documents of each language, chosen by a hash of the id."""
    known = docs.select(F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"), F.col(id_col).alias("__id")).filter("__lang is not null and __text is not null")
    counts = {r["__lang"]: r["n"] for r in known.groupBy("__lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0), dtype=bool), np.zeros(0))
    roll = F.pmod(F.xxhash64(F.col("__id"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows_per_lang / counts[k])))])
    sample = known.filter(roll < shares[F.col("__lang")]).select("__lang", "__text")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, scripts = {}, {}
        for b in batches:
            for lang, text in zip(b["__lang"], b["__text"], strict=True):
                if words := letter_runs(text):
                    keys, _ = trigram_buckets(words)
                    seen[lang] = seen.get(lang, 0) + np.bincount(keys, minlength=BUCKETS)
                    found = scripts.setdefault(lang, np.zeros(len(NAMES), dtype=np.int64))
                    found += np.bincount([script_of(w[0]) for w in words], minlength=len(NAMES))
        for lang, row in seen.items():
            at = np.flatnonzero(row)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype("int32"), "n": row[at].astype("int64")})
            yield pd.DataFrame({"lang": lang, "bucket": (-1 - np.arange(len(NAMES))).astype("int32"), "n": scripts[lang]})

    rows = sample.mapInPandas(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counted = np.zeros((BUCKETS, len(langs)))
    scripts = np.zeros((len(NAMES), len(langs)))
    for k, lang in enumerate(langs):
        own = rows[rows.lang == lang]
        grams, found = own[own.bucket >= 0], own[own.bucket < 0]
        counted[grams.bucket, k] = grams.n
        scripts[-1 - found.bucket, k] = found.n
    logp = np.log((counted + 0.5) / (counted.sum(0) + 0.5 * BUCKETS))
    usual = (counted * logp).sum(0) / np.maximum(1, counted.sum(0))
    return Model(langs, logp, scripts >= np.maximum(1, 0.01 * scripts.sum(0)), usual)


def best_path(scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Label of each word: Viterbi over all documents at once, word by word, the longest documents first."""
    count = scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    first, size = starts[order], sizes[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")
    came = np.empty((len(ids), count), dtype=np.uint16)
    every = np.arange(count)
    best = np.zeros((len(size), count), dtype=np.float32)
    for t in range(longest):
        k = alive[t]
        at = first[:k] + t
        now = scores[ids[at]]
        if t:
            before = best[:k]
            top = before.argmax(1)
            jump = before[np.arange(k), top][:, None] - switch
            came[at] = np.where(before >= jump, every, top[:, None])
            now = np.maximum(before, jump) + now
        best[:k] = now
    label = best.argmax(1)
    path = np.empty(len(ids), dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        path[at] = label[:k]
        if t:
            label[:k] = came[at, label[:k]]
    return path


class Labeller:
    """Predicts languages in one worker; word scores are cached up to a bound."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.clear()

    def clear(self) -> None:
        new: list[str] = []
        self.new = new

        class Ids(dict):
            def __missing__(self, word: str) -> int:
                n = self[word] = len(self)
                new.append(word)
                return n

        self.ids, self.rows = Ids(), np.zeros((0, len(self.model.langs)), dtype=np.float32)
        self.fits, self.lengths, self.known = self.rows, np.zeros(0), np.zeros(0, dtype=bool)

    def score_new(self) -> None:
        if not self.new:
            return
        keys, begins = trigram_buckets(self.new)
        sums = np.add.reduceat(self.model.logp[keys], begins, axis=0)
        lengths = np.diff(np.append(begins, len(keys)))
        self.fits = np.concatenate((self.fits, (sums - lengths[:, None] * self.model.usual).astype(np.float32)))
        self.lengths = np.concatenate((self.lengths, lengths))
        sums -= sums.max(1, keepdims=True)
        allowed = self.model.admits[[script_of(w[0]) for w in self.new]]
        sums = np.where(allowed.any(1)[:, None], np.where(allowed, np.maximum(sums, -20), -25), 0)
        self.rows = np.concatenate((self.rows, sums.astype(np.float32)))
        self.known = np.concatenate((self.known, allowed.any(1)))
        self.new.clear()

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        langs = self.model.langs
        if not langs:
            return [("und", 0.0, []) for _ in texts]
        if len(self.ids) > CACHE_WORDS:
            self.clear()
        look = self.ids.__getitem__
        per_doc = [np.fromiter(map(look, letter_runs(t)), dtype=np.int32) if isinstance(t, str) else np.zeros(0, np.int32) for t in texts]
        self.score_new()
        sizes = np.array([len(x) for x in per_doc], dtype=np.int64)
        ids = np.concatenate(per_doc) if len(per_doc) else np.zeros(0, np.int32)
        starts = np.cumsum(sizes) - sizes
        path = best_path(self.rows, ids, starts, sizes, self.switch)
        out = []
        for x, at, n in zip(per_doc, starts, sizes, strict=True):
            known = self.known[x]
            if not known.any():
                out.append(("und", 0.0, []))
                continue
            own = np.where(known, path[at : at + n], -1)
            mine, labels = x[known], own[known]
            size = self.lengths[mine].sum()
            fit = self.fits[mine, labels].sum(dtype=np.float64) / (size + FEW)
            score = float(size / self.lengths[x].sum() * np.exp(min(0.0, fit)))
            k = int(np.bincount(labels, minlength=len(langs)).argmax())
            cuts = np.flatnonzero(np.diff(own)) + 1
            spans = [{"first": int(a), "last": int(b) - 1, "lang": langs[own[a]]} for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [n])), strict=True) if own[a] >= 0]
            out.append((langs[k], score, spans))
        return out


#: Texts labelled at once, in characters.
AT_ONCE = 1_000_000


def language(model: Model, text: Column, docs: DataFrame) -> Column:
    """Struct of lang_pred, score and spans (first and last word, counting runs of letters, and the language)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp, model.admits, model.usual))

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(Model(*shared.value))
        for texts in batches:
            rows, part, size = [], [], 0
            for t in texts:
                part.append(t if isinstance(t, str) else None)
                size += len(part[-1] or "")
                if size >= AT_ONCE:
                    rows += labeller.label(part)
                    part, size = [], 0
            rows += labeller.label(part) if part else []
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])
        del labeller
        release()

    return predict(text)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that a model may learn from: crc32 of the id modulo 3 is not 1."""
    return docs.filter(crc_mod(F.col(id_col), 3) != 1)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans for every row; learned from the training rows of docs."""
    model = train(training_rows(docs, id_col), lang_col, text_col, id_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return slim.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        language(model, F.col("__text"), docs).alias("__p"),
    ).select("doc_id", "held_out", "__p.lang_pred", "__p.score", F.size("__p.spans").cast("long").alias("n_spans"))
