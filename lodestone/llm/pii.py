"""Personal data: fixed patterns as seeds, then contextual patterns bootstrapped from them.

Base kinds (email, ip, card, phone) are found by regular expressions that scan in linear time.  For the method, every
base span is an occurrence and trusted, a seed.  Other occurrences are tokens with a digit or in quotes, and runs of two
to seven groups of digits, that touch no base span; long random strings (OPAQUE) are trusted in part from the start.

An occurrence gives up to four lexical patterns: the two words before it; the word before it and its shape (letters and
digits by class, or the length of a hexadecimal string); the words on both sides; and what stands before its value inside
its token, as in key=value.  Patterns and instances (distinct entities, whole, whatever separates their groups) form a
bipartite graph.  For a few rounds a pattern scores by the mean trust of its instances, and an instance takes the score of
its best pattern of enough support, so that patterns can be supported by instances which others discovered.  Patterns of
high score and support whose words, over all texts, mostly stand where an identifier does, mark unseen ones (kind id).

Positions count code points, ends exclusive.  Null and empty texts have no spans.  Repeated rows get equal results: found
spans are joined back by id and text, and copies of a text count once in the graph.  Ties in start are ordered by kind as
listed.  Work is linear in the number of spans of a text but for a factor of the chunk size; texts are read whole.  An
empty table gives no rows; only the id and text columns are read, so others may have any name.  Tables in the shared
folder hold hashes of entities and of words, no text.  DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, packed, saved, unpacked

KINDS = ("email", "ip", "card", "phone", "id")
#: The base patterns, with possessive repeats and a start only where a match can start, so that a scan is linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]*[\x20().0-9-][0-9]"
#: Between spaces: groups of digits joined by spaces or hyphens, the first perhaps after a few letters; or else a token with a digit, or with eight characters in quotes.
_GROUP = r"[0-9]++(?:-[0-9]++)*+"
_GROUPS = rf"[^\p{{L}}\p{{N}}\x20\x09-\x0D+]*+\+?(?:\p{{L}}{{1,4}}+-?)?{_GROUP}(?:\x20{_GROUP}){{1,6}}(?!\x20[0-9])[^\p{{L}}\p{{N}}\x20\x09-\x0D]*+(?![^\x20\x09-\x0D])"
_QUOTED = r"(?=[^\x22'\x20\x09-\x0D]*+[\x22'][^\x22'\x20\x09-\x0D]{8})"
CANDIDATE = rf"(?<![^\x20\x09-\x0D])(?:{_GROUPS}|(?:(?=[^0-9\x20\x09-\x0D]*+[0-9])|{_QUOTED})[^\x20\x09-\x0D]++)"
#: What may stand before the value inside a token, and strings that hardly are words: random ones and UUIDs.
KEY = r"^(\p{L}[\p{L}\p{N}_.-]{1,30}[=:][\x22']?)(?!/)(?=[\p{L}\p{N}+]).{4}"
RANDOM = r"^(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9+/]{20,}={0,2}$"
UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: How far a context is looked for, in characters; no more than NEAR matches of one pattern lie within it or hold its words.
REACH, NEAR = 80, 20
MIN_CHARS, MIN_DIGITS, MIN_QUOTED = 6, 4, 8
#: Trust of a random string; rounds; least score and support (sum of trust) of a pattern; least share of its words' places that hold an identifier.
OPAQUE, ROUNDS, CONFIDENT, SUPPORT, SPECIFIC = 0.85, 3, 0.6, 2.5, 0.5
BROADCAST_ROWS = 100_000
SPAN = "struct<start:int,rank:int,end:int>"
CHUNK = 256
_INTS = "array<int>"


def held(made: Column, *arrays: str) -> Column:
    """made, which reads arrays inside a lambda.

    The condition, always true, reads them a second time: so the optimizer leaves each a column of its own, and does not
    put what makes it in its place, to be computed anew for every element.
    """
    return F.when(reduce(lambda x, y: x & y, [F.size(a) >= 0 for a in arrays]), made)


def scan(values: str, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of a column of array of int what op, which is associative, makes of zero and all elements before it.

    In chunks, so that the growing array is not copied for every element.
    """
    parts = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / CHUNK).cast("int")), lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))

    def all_before(array: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast(_INTS).alias("all"))
        return F.aggregate(array, first, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    starts = all_before(F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), op)), F.lit(zero))
    return held(F.flatten(F.zip_with(parts, starts, all_before)), values)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def placed(text: Column, pattern: str, possible: Column) -> tuple[Column, Column]:
    """Matches of a pattern and the gaps before each (and after the last); empty where not possible."""
    none = F.array().cast("array<string>")
    return F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(possible, F.split(text, pattern)).otherwise(none)


def with_matches(df: DataFrame, kinds: list[str]) -> DataFrame:
    """For matches __x_m and gaps __x_g of each kind x: adds __x_s, where each match starts in code points, and __x_e.

    __x_e holds for each match the text since the start of the one before, or the end of that text.
    """

    def end(found: Column, gaps: Column) -> Column:
        return F.transform(found, lambda m, i: F.substr(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), F.lit(-REACH), F.lit(REACH)))

    size = lambda k: F.transform(f"__{k}_m", lambda m, i: F.length(m) + F.length(F.get(f"__{k}_g", i)))
    start = lambda k: F.transform(scan(f"__{k}_l", 0, _sum), lambda at, i: at + F.length(F.get(f"__{k}_g", i)))
    df = df.select("*", *[held(size(k), f"__{k}_m", f"__{k}_g").alias(f"__{k}_l") for k in kinds])
    made = [c for k in kinds for c in (held(start(k), f"__{k}_l", f"__{k}_g").alias(f"__{k}_s"), held(end(F.col(f"__{k}_m"), F.col(f"__{k}_g")), f"__{k}_m", f"__{k}_g").alias(f"__{k}_e"))]
    return df.select("*", *made).drop(*[f"__{k}_l" for k in kinds])


def words_before(ends: Column, i: Column) -> Column:
    """Up to two words before match i in lower case, without punctuation that is joined to the match."""
    before = F.substr(F.array_join(F.slice(ends, F.greatest(F.lit(1), i - (NEAR - 2)), F.least(F.lit(NEAR), i + 1)), ""), F.lit(-REACH), F.lit(REACH))
    found = F.lower(F.regexp_extract(F.regexp_replace(before, r"[^\p{L}\p{N}\s]+$", ""), r"((?:\S+\s+)?\S+)\s*$", 1))
    return F.array_remove(F.split(found, r"\s+"), "")


def word_after(gaps: Column, i: Column) -> Column:
    """The word that begins in the gap after match i, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.substr(F.get(gaps, i + 1), F.lit(1), F.lit(REACH)), r"^\S*\s+(\S+)(?=\s)", 1))


def whole(match: Column) -> Column:
    """An entity without what separates its groups."""
    return F.lower(F.regexp_replace(match, r"[\x20().-]", ""))


def shape(core: Column) -> Column:
    hexed = core.rlike("^[0-9A-Fa-f]{16,}$")
    return F.when(hexed, F.concat(F.lit("hex"), F.length(core).cast("string"))).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(core, "[0-9]", "9"), r"\p{Lu}", "A"), r"\p{Ll}", "a"))


def patterns(before: Column, after: Column, core: Column, key: Column) -> Column:
    """Structs of an occurrence's patterns: hash of the pattern, hash of its words, and of the word right before (0: none needed)."""
    near, far = F.element_at(before, -1), F.get(before, F.size(before) - 2)
    word = F.xxhash64(near)

    def of(possible: Column, pattern: Column, words: Column, last: Column) -> Column:
        return F.when(possible, F.struct(pattern.alias("pattern"), words.alias("words"), last.alias("last")))

    none, any_ = F.lit(0).cast("long"), F.size(before) > 0
    made = F.array(
        of(F.size(before) > 1, two_words(far, near), two_words(far, near), word),
        of(any_, F.xxhash64(F.lit("shape"), near, shape(core)), one_word(near), word),
        of(any_ & (after != ""), around(near, after), around(near, after), word),
        of(key != "", F.xxhash64(F.lit("key"), F.lower(key)), none, none),
    )
    return F.filter(made, lambda x: x.isNotNull())


def two_words(far: Column, near: Column) -> Column:
    return F.xxhash64(F.lit("two"), far, near)


def one_word(near: Column) -> Column:
    return F.xxhash64(F.lit("one"), near)


def around(near: Column, after: Column) -> Column:
    return F.xxhash64(F.lit("around"), near, after)


def luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))

    def value(i: Column) -> Column:
        d = F.substr(digits, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


OCC = "struct<start:int,end:int,core:bigint,trust:double,seed:boolean,patterns:array<struct<pattern:bigint,words:bigint,last:bigint>>>"


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds __base: base spans sorted by start, then kind; and __seeds: those that do not begin within another, as occurrences.

    Each step is a projection, so that nothing is found twice.
    """
    t = F.col(text)
    digit = t.rlike("[0-9]")
    able = {"email": F.contains(t, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(t, F.lit("+"))}
    names = docs.columns
    both = {k: placed(t, p, F.coalesce(able[k], F.lit(False))) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))}
    df = docs.select(*names, *[c.alias(f"__{k}_{s}") for k, pair in both.items() for s, c in zip("mg", pair, strict=True)])
    df = with_matches(df, list(both))

    def spans(kind: str, rank: int) -> Column:
        full = F.transform(F.arrays_zip(f"__{kind}_m", f"__{kind}_s"), lambda x, i: F.struct(x[f"__{kind}_s"].alias("start"), x[f"__{kind}_m"].alias("m"), i.alias("i")))
        core = whole if kind in ("card", "phone") else F.lower
        made = F.transform(
            F.filter(full, lambda x: _valid(kind, x["m"])),
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["m"])).alias("end"), F.xxhash64(core(x["m"])).alias("core"),
                patterns(words_before(F.col(f"__{kind}_e"), x["i"]), word_after(F.col(f"__{kind}_g"), x["i"]), x["m"], F.lit("")).alias("patterns"),
            ),
        )
        return held(made, f"__{kind}_e", f"__{kind}_g")

    df = df.select(*names, F.array_sort(F.concat(*[spans(k, i) for i, k in enumerate(KINDS[:4])])).alias("__spans"))
    df = df.select(*names, "__spans", F.transform("__spans", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))).alias("__base"))
    df = df.select(*names, "__spans", "__base", F.transform("__base", lambda x: x["end"]).alias("__ends"))
    df = df.select(*names, "__spans", "__base", scan("__ends", 0, _most).alias("__before"))
    first = F.transform(F.filter(F.arrays_zip("__spans", "__before"), lambda z: (z["__spans"]["start"] >= z["__before"]) & (F.size(z["__spans"]["patterns"]) > 0)), lambda z: z["__spans"])
    seeds = F.transform(first, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["core"].alias("core"), F.lit(1.0).alias("trust"), F.lit(True).alias("seed"), x["patterns"].alias("patterns")))
    return df.select(*names, "__base", seeds.cast(f"array<{OCC}>").alias("__seeds"))


def with_occurrences(docs: DataFrame, text: str) -> DataFrame:
    """Adds __occ in place of __seeds: seeds, and what else may be an identifier, trimmed of punctuation."""
    names = [c for c in docs.columns if c != "__seeds"]
    t = F.col(text)
    found, gaps = placed(t, CANDIDATE, F.coalesce(t.rlike("[0-9\x22']"), F.lit(False)))
    df = with_matches(docs.select(*names, "__seeds", found.alias("__new_m"), gaps.alias("__new_g")), ["new"]).withColumnsRenamed({f"__new_{c}": f"__{c}" for c in "mgse"})
    ahead = r"^[^\p{L}\p{N}+]+"
    # without punctuation around it, then without the key before its value
    trimmed = F.transform(
        F.arrays_zip("__m", "__s"),
        lambda x, i: F.struct(
            (x["__s"] + F.length(x["__m"]) - F.length(F.regexp_replace(x["__m"], ahead, ""))).alias("start"), F.regexp_replace(F.regexp_replace(x["__m"], ahead, ""), r"[^\p{L}\p{N}]+$", "").alias("core"),
            x["__m"].rlike("[\x22']").alias("quoted"), i.alias("i"),
        ),
    )
    keyed = F.transform("__t1", lambda x: F.struct(x.alias("x"), F.regexp_extract(x["core"], KEY, 1).alias("key")))
    valued = F.transform("__t2", lambda y: F.struct((y["x"]["start"] + F.length(y["key"])).alias("start"), F.substr(y["x"]["core"], F.length(y["key"]) + 1).alias("core"), y["key"].alias("key"), y["x"]["quoted"].alias("quoted"), y["x"]["i"].alias("i")))
    digits = lambda x: F.length(F.regexp_replace(x["core"], "[^0-9]", ""))
    long = F.filter("__t3", lambda x: (F.length(x["core"]) >= MIN_CHARS) & (digits(x) >= MIN_DIGITS) | x["quoted"] & (F.length(x["core"]) >= MIN_QUOTED))
    for name, made in (("__t1", trimmed), ("__t2", keyed), ("__t3", valued)):
        df = df.withColumn(name, made)
    df = df.select(*names, "__seeds", "__e", "__g", long.alias("__long"))
    # candidates among base spans by start: apart from them are those after the ends of all before and before the next start
    kind = df.schema["__long"].dataType.elementType.simpleString()
    mark = lambda start, kind_, end, x: F.struct(start.alias("start"), F.lit(kind_).alias("kind"), end.alias("end"), x.alias("x"))
    ends = F.concat(
        F.transform("__base", lambda b: mark(b["start"], 0, b["end"], F.lit(None).cast(kind))), F.transform("__long", lambda x: mark(x["start"], 1, x["start"] + F.length(x["core"]), x))
    )
    most = (1 << 31) - 1
    df = df.select("*", F.array_sort(ends).alias("__all"))
    df = df.select("*", F.transform("__all", lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(0)).alias("__past"), F.reverse(F.transform("__all", lambda x: F.when(x["kind"] == 0, x["start"]).otherwise(most))).alias("__ahead"))
    df = df.select("*", scan("__past", 0, _most).alias("__low"), F.reverse(scan("__ahead", most, _least)).alias("__high"))
    apart = F.filter(F.arrays_zip("__all", "__low", "__high"), lambda z: (z["__all"]["kind"] == 1) & (z["__low"] <= z["__all"]["start"]) & (z["__high"] >= z["__all"]["end"]))
    df = df.select(*names, "__seeds", "__e", "__g", F.transform(apart, lambda z: z["__all"]["x"]).alias("__apart"))
    new = F.transform(
        "__apart",
        lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.length(x["core"])).alias("end"), F.xxhash64(whole(x["core"])).alias("core"), F.when(x["core"].rlike(RANDOM) | x["core"].rlike(UUID), OPAQUE).otherwise(0.0).alias("trust"),
            F.lit(False).alias("seed"), patterns(words_before(F.col("__e"), x["i"]), word_after(F.col("__g"), x["i"]), x["core"], x["key"]).alias("patterns"),
        ),
    )
    new = held(new, "__e", "__g")
    return df.select(*names, F.concat("__seeds", F.filter(new, lambda x: F.size(x["patterns"]) > 0).cast(f"array<{OCC}>")).alias("__occ"))


def scored_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, score, support.  edges: pattern, core, trust (of the entity alone); pairs of a pattern and a core count once.

    score is the sum of the trust of a pattern's instances over their number plus one, support the sum.  After each round
    but the last, an instance takes the score of its best pattern of enough support, if that is more than its own trust.
    """
    pairs = saved(edges.groupBy("pattern", "core").agg(F.max("trust").alias("trust")), "pairs")
    trusted, done = pairs, []
    for r in range(rounds):
        scores = trusted.groupBy("pattern").agg((F.sum("trust") / (F.count("*") + 1)).alias("score"), F.sum("trust").alias("support"))
        if r + 1 < rounds:
            best = saved(pairs.join(saved(scores.filter(F.col("support") >= SUPPORT).select("pattern", "score"), "scores"), "pattern").groupBy("core").agg(F.max("score").alias("best")), "best")
            trusted = saved(pairs.join(best, "core", "left").select("pattern", "core", F.greatest("trust", F.coalesce("best", F.lit(0.0))).alias("trust")), "trust")
            done.append(trusted)
    out = saved(scores, "scores")
    discard(pairs, *done)
    return out


def places(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """words, n: how often the words of wanted patterns (words, last) stand in all texts.  Only places of a last word are looked at."""
    last = bounded(wanted.select(F.col("last").alias("h")).distinct(), BROADCAST_ROWS)
    texts = docs.select(F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), "").alias("w"))
    at = texts.select("w", F.posexplode_outer(F.transform("w", lambda w: F.xxhash64(w))).alias("i", "h")).join(last, "h", "left_semi")
    near, far, after = F.get("w", F.col("i")), F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 2)
    made = F.array(one_word(near), F.when(far.isNotNull(), two_words(far, near)), F.when(after.isNotNull(), around(near, after)))
    each = at.select(F.explode_outer(made).alias("words")).join(bounded(wanted.select("words").distinct(), BROADCAST_ROWS), "words", "left_semi")
    return each.groupBy("words").agg(F.count("*").alias("n"))


def confident_patterns(occurrences: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """One column, pattern.  occurrences: core, trust, patterns."""
    each = occurrences.select("core", "trust", F.explode("patterns").alias("p")).select("core", "trust", "p.*")
    scores = scored_patterns(each.select("pattern", "core", "trust"))
    good = scores.filter((F.col("score") >= CONFIDENT) & (F.col("support") >= SUPPORT)).select("pattern")
    found = saved(each.join(bounded(good, BROADCAST_ROWS), "pattern", "left_semi").groupBy("pattern", "words", "last").agg(F.lit(1).alias("one")), "found")
    wanted = found.filter("last <> 0")
    if not wanted.limit(1).count():
        return found.select("pattern")
    held = each.join(bounded(wanted.select("words").distinct(), BROADCAST_ROWS), "words", "left_semi").select("words", "core").groupBy("words").agg(F.count("*").alias("held"))
    share = saved(places(docs, text_col, wanted).join(held, "words").filter(F.col("held") >= SPECIFIC * F.col("n")).select("words"), "specific")
    out = saved(wanted.join(bounded(share, BROADCAST_ROWS), "words", "left_semi").select("pattern").union(found.filter("last = 0").select("pattern")), "patterns")
    discard(scores, found, share)
    return out


def found_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __k1, __k2, __base, __all for every row: base spans, and those with what patterns discovered."""
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text, F.lit(1)).alias("__k1"), F.xxhash64(F.lit(2), text).alias("__k2"), text.alias("__t"))
    rows = saved(with_occurrences(with_base(slim, "__t"), "__t").drop("__t"), "pii")
    each = rows.filter(F.size("__occ") > 0).select("__id", "__k1", "__k2", F.explode("__occ").alias("o")).select("__id", "__k1", "__k2", "o.*")
    good = bounded(confident_patterns(each.select("core", "trust", "patterns"), slim, "__t"), BROADCAST_ROWS)
    new = each.filter("not seed").withColumn("pattern", F.explode("patterns.pattern")).join(good, "pattern", "left_semi")
    span = F.struct(F.col("start"), F.lit(KINDS.index("id")).alias("rank"), F.col("end"))
    new = new.groupBy("__id", "__k1", "__k2").agg(F.collect_set(span).alias("__new")).withColumnsRenamed({"__id": "__rid", "__k1": "__r1", "__k2": "__r2"})
    match = (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")) & F.col("__id").eqNullSafe(F.col("__rid"))
    out = rows.drop("__occ").join(new, match, "left")
    return out.select("__id", "__k1", "__k2", "__base", F.when(F.col("__new").isNull(), F.col("__base")).otherwise(F.array_sort(F.concat("__base", "__new"))).alias("__all"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_private (all kinds) for every row of docs."""
    df = found_spans(docs, id_col, text_col)
    count = lambda rank: F.size(F.filter("__all", lambda s: s["rank"] == rank)).cast("long")
    return df.select(
        F.col("__id").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(listed(F.col("__base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("__all")).alias("spans"), count(4).alias("n_id"), F.size("__all").cast("long").alias("n_private"),
    )


def with_masked(df: DataFrame, text: str, spans: str, out: str) -> DataFrame:
    """Adds out: the text with each of its sorted spans replaced by its kind in angle brackets; null where spans is null.

    Overlapping spans become one, named by the first.  A chunk of spans cuts its own part of the text, so that no cut has
    to count all characters before it.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    df = df.select("*", F.transform(spans, lambda s: s["end"]).alias("__ends"))
    df = df.select("*", scan("__ends", 0, _most).alias("__before"))
    cuts = F.zip_with(spans, "__before", lambda s, b: F.struct(b.alias("from"), s["start"].alias("to"), s["rank"].alias("rank")))
    df = df.select("*", F.filter(cuts, lambda x: x["to"] >= x["from"]).alias("__cuts"))
    chunks = F.transform(F.sequence(F.lit(0), ((F.size("__cuts") - 1) / CHUNK).cast("int")), lambda k: F.slice("__cuts", k * CHUNK + 1, F.lit(CHUNK)))
    df = df.select("*", held(chunks, "__cuts").alias("__chunks"))
    cut = lambda t, a, b: F.substr(t, a + 1, b - a)

    def own(part: Column) -> Column:
        at = part[0]["from"]
        return F.struct(cut(F.col(text), at, F.element_at(part, -1)["to"]).alias("t"), F.transform(part, lambda x: F.struct((x["from"] - at).alias("from"), (x["to"] - at).alias("to"), x["rank"].alias("rank"))).alias("cuts"))

    df = df.select("*", F.transform("__chunks", own).alias("__own"))
    filled = F.transform("__own", lambda o: F.array_join(F.transform(o["cuts"], lambda x: F.concat(cut(o["t"], x["from"], x["to"]), F.element_at(names, x["rank"] + 1))), ""))
    made = F.concat(F.array_join(filled, ""), F.substr(F.col(text), F.array_max("__ends") + 1))
    return df.select("*", made.alias(out)).drop("__ends", "__before", "__cuts", "__chunks", "__own")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """docs with every span masked in the text; rows and columns as they were."""
    names = docs.columns
    spans = found_spans(docs, id_col, text_col).filter(F.size("__all") > 0).groupBy("__id", "__k1", "__k2").agg(F.first("__all").alias("__all"))
    spans = bounded(saved(spans, "spans").withColumnsRenamed({"__id": "__rid", "__k1": "__r1", "__k2": "__r2"}), broadcast_rows)
    text = F.col(text_col)
    keyed = packed(docs, text.alias("__t"), F.col(id_col).alias("__id"), F.xxhash64(text, F.lit(1)).alias("__k1"), F.xxhash64(F.lit(2), text).alias("__k2"))
    match = (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")) & F.col("__id").eqNullSafe(F.col("__rid"))
    out = with_masked(keyed.join(spans, match, "left"), "__t", "__all", "__masked")
    return unpacked(out, names, **{text_col: F.coalesce("__masked", "__t")})
