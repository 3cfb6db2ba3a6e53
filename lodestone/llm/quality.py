"""Quality classifier: histogram gradient-boosted trees over document statistics, scored by vectorised traversal.

Statistics come from bytes, words and lines of the whole text.  Trees are complete and of one depth, so a forest is two
arrays (feature and threshold per inner node) and one of leaf values; rows walk all trees by index arithmetic.
Null and empty texts have the statistics of an empty document and are scored like any other.  Without labels, or with
one kind of label only, every score is the share of label 1 (0.5 without labels).  Repeated labels count as often as
they occur; rows with a null label are left out.  An empty table gives no rows.  Of splits of equal gain the first
statistic's lowest cut is taken, and rows are ordered before fitting, so the forest does not depend on their order.  Texts
of any length are read whole, one at a time; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, crc_mod, small_batches

STATISTICS = (
    "log_bytes", "letters", "upper", "digits", "spaces", "high_bytes", "symbols", "marks", "bars", "stops",
    "word_length", "log_words", "distinct", "same_as_last", "commonest", "line_words", "repeated_lines", "ended_words", "capital_words", "entropy",
)
#: Bound of the training sample, in rows.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 80, 4, 0.15, 64, 20, 1.0


def _class_of_bytes() -> np.ndarray:
    """Byte to class: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 high, 6 symbol, 7 mark, 8 bar, 9 stop."""
    kinds = np.zeros(256, dtype=np.int64)
    for k, members in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, (*range(9, 14), 32)), (5, range(128, 256)), (6, b"#*$%&<>@^~=+_\\{}[]"), (7, b"!?"), (8, b"|"), (9, b".,;:")):
        kinds[list(members)] = k
    return kinds


BYTE_CLASS = _class_of_bytes()


def statistics(text: str | None) -> list[float]:
    """One row of STATISTICS."""
    data = (text or "").encode("utf-8", "replace")
    n = max(1, len(data))
    bytes_ = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    share = np.bincount(BYTE_CLASS, weights=bytes_, minlength=10) / n
    seen = bytes_[bytes_ > 0] / n
    words = data.split()
    w = max(1, len(words))
    counts: dict[bytes, int] = {}
    same = 0
    if words:
        codes: dict[bytes, int] = {}
        ids = np.fromiter((codes.setdefault(x, len(codes)) for x in words), dtype=np.int64, count=len(words))
        counts = codes
        same = int((ids[1:] == ids[:-1]).sum())
        commonest = int(np.bincount(ids).max())
    else:
        commonest = 0
    lines = [x for x in data.split(b"\n") if x.strip()]
    ended = sum(map(data.count, (b". ", b", ", b".\n")))
    capitals = sum(1 for x in words if 65 <= x[0] <= 90)
    return [
        np.log1p(len(data)), share[1] + share[2], share[2], share[3], share[4], share[5], share[6], share[7], share[8], share[9],
        len(data) / w, np.log1p(len(words)), len(counts) / w, same / w, commonest / w, w / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), ended / w, capitals / w, float(-(seen * np.log2(seen)).sum()) if len(seen) else 0.0,
    ]


class Forest:
    """feature and threshold: trees x (2^depth - 1); value: trees x 2^depth; base: log odds to start from."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(self.feature.shape[1] + 1).bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosting with logistic loss; splits come from gradient histograms over quantile bins."""
    inner = 2**DEPTH - 1
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return none
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        none.base = base
        return none
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], axis=1)
    n, width = x.shape
    features, thresholds, values = [], [], []
    total = np.full(n, base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            at = node - first
            gain, chosen, cut = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
            for f in range(width):
                cell = at * BINS + binned[:, f]
                g = np.bincount(cell, weights=grad, minlength=count * BINS).reshape(count, BINS).cumsum(1)
                h = np.bincount(cell, weights=hess, minlength=count * BINS).reshape(count, BINS).cumsum(1)
                c = np.bincount(cell, minlength=count * BINS).reshape(count, BINS).cumsum(1)
                gl, hl, gr, hr = g[:, :-1], h[:, :-1], g[:, -1:] - g[:, :-1], h[:, -1:] - h[:, :-1]
                better = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                better[(c[:, :-1] < LEAST) | (c[:, -1:] - c[:, :-1] < LEAST)] = 0
                best = better.argmax(1)
                found = better[np.arange(count), best]
                win = found > gain + 1e-9
                gain[win], chosen[win], cut[win] = found[win], f, best[win]
            for k in np.flatnonzero(chosen >= 0):
                if cut[k] < len(edges[chosen[k]]):
                    feature[first + k], threshold[first + k] = chosen[k], edges[chosen[k]][cut[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, weights=grad, minlength=inner + 1) / (np.bincount(leaf, weights=hess, minlength=inner + 1) + RIDGE)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(np.stack(features), np.stack(thresholds), np.stack(values), base)


def table_of(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t if isinstance(t, str) else None) for t in texts], dtype=np.float64).reshape(len(texts), len(STATISTICS))


def statistics_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(table_of(texts)), dtype=object)

    return of(text)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """A forest from about `rows` labelled documents, chosen by a hash of the id; only their texts are read by Python."""
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).filter("__id is not null and __y is not null")
    n = marked.count()
    roll = F.pmod(F.xxhash64(F.col("__id"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, rows / max(1, n))
    sample = bounded(marked.filter(roll < share), 2 * rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(roll < share).join(sample, "__id")
    data = texts.select("__id", "__y", statistics_of(F.col("__text")).alias("__x")).toPandas()
    if not len(data):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x, y, ids = np.array(data["__x"].tolist()), data["__y"].to_numpy(), data["__id"].to_numpy()
    order = np.lexsort((*x.T, y, ids))  # the same forest however the rows arrive
    return fit(x[order], y[order])


def quality_score(forest: Forest, text: Column, docs: DataFrame) -> Column:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((forest.feature, forest.threshold, forest.value, forest.base))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Forest(*shared.value)
        for texts in batches:
            yield pd.Series(own.score(table_of(texts)), dtype="float64")

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learned from labels whose id has crc32 modulo 5 other than 0."""
    forest = train(docs, labels.filter(crc_mod(F.col(id_col), 5) != 0), id_col, text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    scored = slim.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), quality_score(forest, F.col("__text"), docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
