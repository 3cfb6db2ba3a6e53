"""Quality rules: base counts, then the Jensen-Shannon distance of a document's histograms to language references.

Two histograms per document, characters by class and words by a short list of common words with one bin for all other
words, are compared with the summed histograms of each language; the nearest language counts.  Documents under a minimum
of words are not judged by distance, nor are those with most of their letters outside the Latin script, for which there
are no references.  A text in Latin script with few or no common words is far from every reference, so long texts in its
languages that are not listed are rejected.
References are sums over all documents of the listed languages that pass the base rules and are no far outliers from
the sums with outliers.
Null text counts as empty (0 words: base_failed).  Repeated rows get equal rows; of references at one distance any may be
the nearest, as only the distance counts.  Without any reference nothing is rejected by distance.  An empty table gives no
rows.  Only the id, text and language columns are read, so others may have any name.  DataFrame operations only; texts are
read whole, and a row needs memory in proportion to its text.  Words and windows of one text are compared by 64-bit
hashes: in a text of a million words two that differ are taken for equal with a chance of about 1 in 40 million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, saved, words_of

#: Common words of four languages.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with"),
    "fr": ("le", "la", "les", "et", "des", "un", "une", "du", "est", "dans"),
    "de": ("der", "die", "und", "das", "den", "von", "mit", "nicht", "ein", "ist"),
    "es": ("el", "los", "que", "y", "las", "por", "con", "para", "del", "se"),
}
WORDS = tuple(w for words in COMMON.values() for w in words)
#: Classes of characters, each as the body of a regular expression's set.
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{N}", r"\x20\x09-\x0D", r".,;:'\x22()-", r"#*$%&|<>")
MIN_WORDS = 50
#: Share of letters in scripts without references from which a text is not judged by distance.
FOREIGN = 0.5
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MAX_ROUGH_DISTANCE = 0.27, 0.22, 0.4
WINDOW = 5


def repeated_words(docs: DataFrame, words: str, out: str, width: int = WINDOW) -> DataFrame:
    """Adds out: how many words lie in windows of `width` words that occur twice or more in their text."""
    hashed = docs.withColumn("__h", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("__h")
    windows = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(F.col("__h"), i + k) for k in range(width)]))
    df = hashed.withColumn("__win", F.when(n >= width, windows).otherwise(F.array().cast("array<bigint>"))).drop("__h")
    twice = F.size(F.array_distinct("__win")) < F.size("__win")
    df = df.withColumn("__sorted", F.when(twice, F.sort_array(F.transform("__win", lambda x, i: F.struct(x.alias("h"), i.alias("at")))))).drop("__win")
    beside = lambda x, i: (F.get(F.col("__sorted"), i - 1)["h"].eqNullSafe(x["h"])) | (F.get(F.col("__sorted"), i + 1)["h"].eqNullSafe(x["h"]))
    df = df.withColumn("__at", F.sort_array(F.transform(F.filter("__sorted", beside), lambda x: x["at"]))).drop("__sorted")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct((p + width).alias("end"), (a["n"] + F.least(F.lit(width), p + width - a["end"])).cast("long").alias("n"))
    return df.withColumn(out, F.coalesce(F.aggregate("__at", start, step, lambda a: a["n"]), F.lit(0).cast("long"))).drop("__at")


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """Base counts and both histograms of every row, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("__lang"), words_of(F.col(text_col)).alias("__words"))
    left = lambda pattern: F.length(F.regexp_replace("__text", pattern, "")).cast("long")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    listed = F.transform(F.filter("__words", lambda w: F.lower(w).isin(*WORDS)), lambda w: F.lower(w))
    df = df.select(
        "doc_id", "__lang", "__words", "__text", F.length("__text").cast("long").alias("__chars"), F.size("__words").cast("long").alias("n_words"), left(GAP).alias("word_chars"), left(r"[^#*$%&|<>]+").alias("n_symbols"),
        lines.alias("__lines"), listed.alias("__listed"), F.array(*[left(f"[^{c}]+") for c in CLASSES]).alias("__seen"),
    )
    # a letter of another script has a byte more than a character at least: where there are too few such bytes, none is looked for
    cased = F.col("__seen")[0] + F.col("__seen")[1]
    counted = left(r"[^\p{L}]+|\p{IsLatin}+") > FOREIGN * left(r"\P{L}+")
    foreign = F.when(F.octet_length("__text") - F.col("__chars") > FOREIGN * cased, counted).otherwise(F.lit(False))
    df = df.select(*[c for c in df.columns if c != "__text"], foreign.alias("__foreign"))
    df = repeated_words(df, "__words", "n_repeat_words")
    rest = F.col("__chars") - F.aggregate("__seen", F.lit(0).cast("long"), lambda a, x: a + x)
    each = F.array(*[(F.size("__listed") - F.size(F.array_remove("__listed", w))).cast("long") for w in WORDS])
    return df.select(
        "doc_id", "__lang", "__foreign", "n_words", "word_chars", "n_symbols", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.concat("__seen", F.array(rest)).alias("__classes"), F.concat(each, F.array((F.size("__words") - F.size("__listed")).cast("long"))).alias("__common"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def normalised(histogram: str) -> Column:
    """Shares of a histogram's bins; null if it is empty.  A column of its own, so that no lambda computes the total anew."""
    n = F.col(f"{histogram}_n")
    return F.when(n > 0, F.transform(histogram, lambda x: x / n))


def distance(shares: Column, reference: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of shares to a reference; null for null shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    both = F.zip_with(shares, F.array(*map(F.lit, reference)), lambda x, q: part(x, (x + q) / 2) + part(q, (x + q) / 2))
    return F.when(shares.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2)))


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Language to its normalised class and word histograms; at most one entry for each language of COMMON."""
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, n in (("__classes", len(CLASSES) + 1), ("__common", len(WORDS) + 1)) for i in range(n)]
    found = rows.filter(F.col("__lang").isin(*COMMON) & ~base_failed()).groupBy("__lang").agg(*sums).collect()
    out = {}
    for r in found:
        classes, common = [r[f"__classes{i}"] for i in range(len(CLASSES) + 1)], [r[f"__common{i}"] for i in range(len(WORDS) + 1)]
        if sum(classes) and sum(common):
            out[r["__lang"]] = [x / sum(classes) for x in classes], [x / sum(common) for x in common]
    return out


def nearest(shares: str, known: dict[str, tuple[list[float], list[float]]], at: int) -> Column:
    """Distance to the nearest language; null if there is none."""
    all_ = [distance(F.col(shares), known[k][at]) for k in sorted(known)]
    return F.least(*all_) if len(all_) > 1 else all_[0] if all_ else F.lit(None).cast("double")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """doc_id, base counts, base_failed, kept and the two distances for every row."""
    rows = saved(measured(docs, id_col, text_col, lang_col), "rules")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    df = rows.withColumn("base_failed", base_failed()).withColumn("__classes_n", total("__classes")).withColumn("__common_n", total("__common"))
    df = df.withColumn("__class_shares", normalised("__classes")).withColumn("__word_shares", normalised("__common"))
    rough = references(df)
    # junk that passes the base rules would draw the references towards itself, so far outliers are left out of the final ones
    known = references(df.filter(nearest("__class_shares", rough, 0) <= MAX_ROUGH_DISTANCE)) or rough
    df = df.withColumn("class_distance", nearest("__class_shares", known, 0)).withColumn("word_distance", nearest("__word_shares", known, 1))
    far = (F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE)
    kept = ~F.col("base_failed") & ((F.col("n_words") < MIN_WORDS) | F.col("__foreign") | ~F.coalesce(far, F.lit(False)))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "class_distance", "word_distance")
