"""Benchmark decontamination: windows of normalised words against a broadcast hash set, verified, spans or documents removed.

Normalised words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z.  An item gives every window of 13
words, or itself whole if shorter.  A document's windows of the lengths that occur are hashed in place and joined with the
hashes of item windows; a hit counts only if its words equal the window's.  Item windows are broadcast up to a checked
number; beyond it places and hashes alone are shuffled, and the words of texts with a candidate brought back.
Null texts have no words and no hits.  A null item id is left out of the list of items but its windows hit.  Repeated
rows get equal results: hits are found per id and text and joined back by both; a window that several items hold counts
for each.  An empty benchmark leaves all texts as they are, an empty table gives no rows.  Texts are read whole; only the
id and text columns are read for hits, and clean() keeps columns of any name.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_runs, packed, saved, unpacked

#: Fixed value: what a normalised word may hold.
NO_TOKEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
NO_ANY_CASE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
ANY_CASE = f"[^{NO_ANY_CASE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 13
BROADCAST_WINDOWS = 500_000
BROADCAST_DOCS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{NO_TOKEN}]+"), "")


def n_tokens(text: Column) -> Column:
    return count_runs(text, f"^{NO_ANY_CASE}", NO_ANY_CASE)


def key(text: Column) -> tuple[Column, Column]:
    """Two hashes and so 128 bits that stand for a text beside its id."""
    return F.xxhash64(text, F.lit(1)).alias("__k1"), F.xxhash64(F.lit(2), text).alias("__k2")


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """__hash, __len, __gram, __items: distinct windows with the ids of their items."""
    words = benchmark.select(F.col(item_col).cast("string").alias("__item"), tokens(F.col(text_col)).alias("__w")).withColumn("__len", F.least(F.size("__w"), F.lit(window))).filter("__len > 0")
    starts = words.withColumn("__at", F.explode(F.sequence(F.lit(1), F.size("__w") - F.col("__len") + 1)))
    grams = starts.select("__item", "__len", F.slice("__w", F.col("__at"), F.col("__len")).alias("__slice"))
    hashed = grams.select("__item", "__len", F.xxhash64(F.transform("__slice", lambda w: F.xxhash64(w)), F.col("__len")).alias("__hash"), F.array_join("__slice", " ").alias("__gram"))
    return hashed.groupBy("__hash", "__len", "__gram").agg(F.collect_set("__item").alias("__items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int = WINDOW) -> DataFrame:
    """__id, __k1, __k2 -> __spans (first word from 0 and length, sorted), __items: only documents with hits, each once."""
    grams = saved(item_windows(benchmark, item_col, item_text_col, window), "grams")
    lengths = sorted(r[0] for r in grams.select("__len").distinct().collect())  # at most `window` values
    if not lengths:
        lengths = [window]
    small = grams.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    text = F.col(text_col)
    words = docs.select(F.col(id_col).alias("__id"), *key(text), tokens(text).alias("__w"))
    words = words.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    n = F.size("__h")  # read more than once, so that the optimizer leaves the hashes a column and no lambda hashes words anew
    hashes = [_hashes_of(n, k) for k in lengths]
    # outer, since an inner explode makes the optimizer filter on its array, and so compute it, a second time below
    rows = words.select("__id", "__k1", "__k2", "__w", F.concat(*hashes).alias("__all")).select("__id", "__k1", "__k2", "__w", F.posexplode_outer("__all").alias("__pos", "__hash"))

    def begins(size: Column) -> Column:
        """Where the windows of the length __len begin among all of a text of so many words."""
        ahead, out = F.lit(0), F.lit(0)
        for k in lengths:
            out = F.when(F.col("__len") == k, ahead).otherwise(out)
            ahead = ahead + F.greatest(size - k + 1, F.lit(0))
        return out

    whole = F.array_join(F.slice("__w", F.col("__at") + 1, F.col("__len")), " ") == F.col("__gram")
    if small:
        hits = rows.join(F.broadcast(grams), "__hash").withColumn("__at", F.col("__pos") - begins(F.size("__w"))).filter(whole)
    else:  # windows are shuffled without their words; those of texts with a candidate are brought back to verify it
        lean = rows.select("__id", "__k1", "__k2", F.size("__w").alias("__n"), "__pos", "__hash")
        met = saved(lean.join(grams.select("__hash", "__len").distinct(), "__hash").select("__id", "__k1", "__k2", "__hash", "__len", (F.col("__pos") - begins(F.col("__n"))).alias("__at")), "met")
        keys = met.select("__id", "__k1", "__k2").distinct().withColumnsRenamed({"__id": "__rid", "__k1": "__r1", "__k2": "__r2"})
        match = (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")) & F.col("__id").eqNullSafe(F.col("__rid"))
        texts = words.select("__id", "__k1", "__k2", "__w").join(keys, match, "left_semi").groupBy("__id", "__k1", "__k2").agg(F.first("__w").alias("__w"))
        texts = texts.withColumnsRenamed({"__id": "__rid", "__k1": "__r1", "__k2": "__r2"})
        hits = met.join(grams, ["__hash", "__len"]).join(texts, match).filter(whole)
    found = hits.groupBy("__id", "__k1", "__k2").agg(F.collect_set(F.struct(F.col("__at").alias("at"), F.col("__len").alias("len"))).alias("__spans"), F.collect_set("__items").alias("__sets"))
    return found.select("__id", "__k1", "__k2", F.sort_array("__spans").alias("__spans"), F.array_sort(F.array_distinct(F.flatten("__sets"))).alias("__items"))


def _hashes_of(n: Column, k: int) -> Column:
    windows = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.slice(F.col("__h"), i, F.lit(k)), F.lit(k)))
    return F.when(n >= k, windows).otherwise(F.array().cast("array<bigint>"))


def words_hit(spans: Column) -> Column:
    """How many words sorted (at, len) spans cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, s: Column) -> Column:
        end = F.greatest(a["end"], s["at"] + s["len"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], s["at"])).cast("long").alias("n"))

    return F.aggregate(spans, start, step, lambda a: a["n"])


def _joined(left: DataFrame, found: DataFrame, broadcast: bool = False) -> DataFrame:
    right = found.withColumnsRenamed({"__id": "__rid", "__k1": "__r1", "__k2": "__r2"})
    match = (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")) & F.col("__id").eqNullSafe(F.col("__rid"))
    return left.join(F.broadcast(right) if broadcast else right, match, "left").drop("__rid", "__r1", "__r2")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    found = find_hits(docs, benchmark, id_col, text_col, item_col, item_text_col)
    text = F.col(text_col)
    all_ = docs.select(F.col(id_col).alias("__id"), *key(text), n_tokens(text).alias("n_words"))
    out = _joined(all_, found).withColumn("n_hit", F.coalesce(words_hit(F.col("__spans")), F.lit(0).cast("long")))
    items = F.coalesce(F.col("__items"), F.array().cast("array<string>"))
    return out.select(
        F.col("__id").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words in spans and what stands between them."""
    words = F.regexp_extract_all(text, F.lit(ANY_CASE), F.lit(0))
    gaps = F.split(text, ANY_CASE)
    inside = lambda i: F.exists(spans, lambda s: (i >= s["at"]) & (i < s["at"] + s["len"]))
    kept = F.transform(words, lambda w, i: F.when(inside(i), F.lit("")).otherwise(w))
    # a gap goes if words on both sides go
    between = F.transform(gaps, lambda g, i: F.when((i > 0) & inside(i - 1) & inside(i), F.lit("")).otherwise(g))
    return F.array_join(F.flatten(F.zip_with(between, F.concat(kept, F.array(F.lit(""))), lambda g, w: F.array(g, w))), "")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, and without the hit spans of the others; columns as they were."""
    found = saved(find_hits(docs, benchmark, id_col, text_col, item_col, item_text_col), "hits")
    small = found.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    text = F.col(text_col)
    out = _joined(packed(docs, text.alias("__t"), F.col(id_col).alias("__id"), *key(text)), found.drop("__items"), small)
    n_hit = F.coalesce(words_hit(F.col("__spans")), F.lit(0).cast("long"))
    out = out.filter((n_hit == 0) | (20 * n_hit < n_tokens(F.col("__t"))))
    new = F.when(F.col("__spans").isNull(), F.col("__t")).otherwise(without_spans(F.col("__t"), F.col("__spans")))
    return unpacked(out, docs.columns, **{text_col: new})
