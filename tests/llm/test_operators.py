"""Operators against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import base64
import gzip
import hashlib
import html as H
import json
import math
import random
import re
import time
import unicodedata
from binascii import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, langid, mixing, pii, quality, rules, similar, tokens, warc
from lodestone.llm import html as pages_html
from lodestone.llm import shingles as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary="alpha beta gamma delta the of and to in is that for it with we you they".split()):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(n))


def documents(seed=5, n=60):
    rng = random.Random(seed)
    rows = [
        (1, None, "en", "b", 0),
        (2, "", "en", "b", 0),
        (3, " \t\n ", None, None, 3),
        (4, "one two", "en", None, 7),
        (5, "One  TWO", "en", "a", 8),
        (6, "mail a.b@c.example.org, 1.2.3.4 and +1 (017) 555-7713 or 4111 1111 1111 1111.", "en", "a", 1),
        (None, "words of a row without an id " * 4, "en", "c", 1),
        (7, "x" * 3_000 + " " + "é€😀 " * 2000, "fr", "c", 1),
        (8, "a\nb\na\n\n \nb\nÀ Ça #$% | <>&", "fr", "a", 1),
    ]
    base = [prose(rng, rng.randint(3, 120)) for _ in range(n)]
    for i, t in enumerate(base):
        rows.append((100 + i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None]), len(t)))
        if i % 4 == 0:
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            rows.append((300 + i, " ".join(words), "en", "a", 1))
        if i % 7 == 0:
            rows.append((400 + i, t.upper(), "en", "b", 1))
    return rows + rows[-2:] + rows[:1]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    for name in ("n_words", "score", "text_2", "__text", "__id", "__row", "kept", "size"):
        df = df.withColumn(name, F.lit("other"))
    return df.repartition(3).persist()


def empty(docs):
    return docs.limit(0)


def same(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(rows, key=repr)


# 1


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_rules(docs):
    out = rules.judge(docs)
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), [(r[0], *base_counts(r[1])) for r in documents()])
    assert out.filter("base_failed and kept").count() == 0
    assert rules.judge(empty(docs)).count() == 0


def test_rules_reject_junk_and_keep_prose(spark):
    rng = random.Random(1)
    clean = [(i, prose(rng, 150), "en", "a", 1) for i in range(30)]
    junk = [(100 + i, " ".join("#%$ " + w.upper() + "!!" for w in prose(rng, 150).split()), "en", "a", 1) for i in range(3)]
    kept = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert sum(kept[i] for i in range(30)) >= 28 and not any(kept[100 + i] for i in range(3))


def test_rules_reject_long_texts_without_common_words(spark):
    rng = random.Random(2)
    clean = [(i, prose(rng, 150), "en", "a", 1) for i in range(30)]
    made_up = ["".join(rng.choice("aeiourstlnmdk") for _ in range(rng.randint(3, 8))) + "x" for _ in range(500)]
    lists = [(100 + i, prose(rng, 150, made_up), "en", "a", 1) for i in range(3)] + [(200, prose(rng, 40, made_up), "en", "a", 1)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(clean + lists, SCHEMA)).collect()}
    assert not any(got[100 + i].base_failed or got[100 + i].kept for i in range(3)) and got[200].kept
    assert all(got[100 + i].word_distance > rules.MAX_WORD_DISTANCE for i in range(3))
    assert sum(got[i].kept for i in range(30)) >= 28


def js(p, q):
    total = 0.0
    for a, b in zip(p, q, strict=True):
        for x in (a, b):
            if x:
                total += x * math.log2(2 * x / (a + b)) / 2
    return math.sqrt(max(0.0, total))


def histograms(text):
    """Characters by class and words by common word, the last bin for all others."""
    kinds = [lambda c: unicodedata.category(c) == "Ll", lambda c: unicodedata.category(c) == "Lu", lambda c: unicodedata.category(c)[0] == "N", lambda c: c in " \t\n\v\f\r", lambda c: c in ".,;:'\"()-", lambda c: c in "#*$%&|<>"]
    classes = [sum(map(k, text)) for k in kinds]
    words = [w.lower() for w in WORD.findall(text)]
    common = [words.count(w) for w in rules.WORDS]
    return [*classes, len(text) - sum(classes)], [*common, len(words) - sum(common)]


def test_rules_against_brute_force(spark):
    rng = random.Random(3)
    tongues = {k: [*v, *("".join(rng.choice("abcdeéilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(12))] for k, v in rules.COMMON.items()}
    rows = [(i, prose(rng, rng.randint(20, 160), tongues[k]), k, "a", 1) for i, k in enumerate([*tongues] * 12)]
    rows += [(100 + i, " ".join("".join(rng.choice("bcdfghjkpqvwxz") for _ in range(6)) for _ in range(60)), "en", "a", 1) for i in range(3)]
    rows += [(200 + i, " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(120)), lang, "a", 1) for i, (letters, lang) in enumerate([("абвгдежзик", "ru"), ("的一是不了人我在", None), ("αβγδεζηθικ", "en")])]
    rows += [(300, "%$# " * 80, "en", "a", 1), (301, None, "en", "a", 0), (302, " ".join(rows[0][1].split()[:5] * 20), "en", "a", 1)]
    read = [(d, base_counts(t), lang, *histograms(t or "")) for d, t, lang, _, _ in rows]
    norm = lambda h: [x / sum(h) for x in h] if sum(h) else None
    near = lambda h, known, at: min((js(norm(h), k[at]) for k in known.values()), default=None) if sum(h) else None

    def references(some):
        out = {}
        for k in rules.COMMON:
            own = [r for r in some if r[2] == k and not r[1][5]]
            if own:
                out[k] = tuple(norm([sum(x) for x in zip(*(r[at] for r in own), strict=True)]) for at in (3, 4))
        return out

    rough = references(read)
    known = references([r for r in read if sum(r[3]) and near(r[3], rough, 0) <= rules.MAX_ROUGH_DISTANCE]) or rough
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = set()
    for d, base, _, classes, common in read:
        a, b = near(classes, known, 0), near(common, known, 1)
        assert (got[d].class_distance, got[d].word_distance) == (pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9))
        far = a is not None and (a > rules.MAX_CLASS_DISTANCE or b > rules.MAX_WORD_DISTANCE)
        if not base[5] and (base[0] < rules.MIN_WORDS or d in (200, 201, 202) or not far):
            kept.add(d)
    assert {d for d, r in got.items() if r.kept} == kept
    assert {200, 201, 202} <= kept and not kept & {*range(100, 103), 300, 301, 302} and len(kept & set(range(48))) >= 46


def test_repeats_are_counted_once_each(spark):
    t = "a b c d e f a b c d e f g " + "z " * 12
    got = rules.judge(spark.createDataFrame([(1, t, "en", "a", 1)], SCHEMA)).first()
    assert got.n_repeat_words == base_counts(t)[4]


# 2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<header><h1>Site</h1></header><!-- ad --><div class="ad">Buy &amp; sell</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p><b>First  para&shy;graph
 with <a href=x>a link</a>.<br><p>Second &lt;b&gt;.</p><ul><li>Item.</li></ul><form><input><label>Name</label></form><div class="comments"><p>Nice one!</p></div></article>
<aside><p>Other things to read</p></aside><footer>&copy; Someone</footer></body></html>"""


def test_html(spark):
    assert pages_html.main_text(PAGE) == "Head & line\n\nFirst para\xadgraph with a link.\n\nSecond <b>.\n\nItem."
    assert [pages_html.main_text(x) for x in (None, "", "<p>", "plain words", "<div><p>a</p><p>b</p></div>")] == ["", "", "", "plain words", "a\n\nb"]
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = pages_html.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    same(out.select("page_id", "n_chars"), [(1, len(pages_html.main_text(PAGE))), (2, 0), (2, 0)])
    assert pages_html.extract(df.limit(0)).count() == 0


def test_html_head_ends_without_its_end_tag():
    head = "<html><head><meta charset=utf-8><title>T</title><script>x</script>"
    for rest in ("<body><p>Some text.</p></body></html>", "<p>Some text.</p>", "Some <b>text.</b>", "<b>Some</b> text."):
        assert pages_html.main_text(head + rest) == pages_html.main_text(head + "</head>" + rest) == "Some text."


def words(n, seed=1):
    return prose(random.Random(seed), n)


def test_html_furniture_by_class_and_by_text():
    long, more = words(60), words(50, 2)
    assert pages_html.main_text(f'<article><div class="article-header"><h1>Title</h1></div><p>{long}</p></article>') == f"Title\n\n{long}"
    assert pages_html.main_text(f'<body><div class="content-sidebar-wrap"><h1>T</h1><p>{long}</p><p>{more}</p></div></body>') == f"T\n\n{long}\n\n{more}"
    assert pages_html.main_text(f"<body><form><h1>T</h1><p>{long}</p><p>ok</p></form></body>") == f"T\n\n{long}\n\nok"
    assert pages_html.main_text(f'<article><p>{long}</p><section class="related-work"><h2>R</h2><p>{more}</p></section></article>') == f"{long}\n\nR\n\n{more}"
    assert pages_html.main_text(f'<body class="has-sidebar"><div class="main has-sidebar"><p>{long}</p></div><div class="sidebar"><p>{words(20)}</p></div></body>') == long
    assert pages_html.main_text(f'<body><h1>T</h1><p>{long}</p><div id="comments"><p>{words(30)}</p></div></body>') == f"T\n\n{long}"
    assert pages_html.main_text("<article><p>Short.</p></article><footer>&copy; Someone, somewhere, of a long name of many words</footer>") == "Short."


def test_html_clusters_select_where_there_is_no_article(monkeypatch):
    long, more = words(60), words(50, 2)
    page = f"<body><div>Home</div><div>About us</div><div><a href=/>Log in</a></div><div><h1>Head</h1><p>{long}</p><p>ok</p><p>{more}</p></div><div>2020</div></body>"
    assert pages_html.main_text(page) == f"Head\n\n{long}\n\nok\n\n{more}"
    spread = f"<body><div><p>{long}</p></div><div><p>Between them.</p></div><div><p>{more}</p></div><div><ul><li><a href=/>x</a></li><li><a href=/>y</a></li></ul></div></body>"
    assert pages_html.main_text(spread) == f"{long}\n\nBetween them.\n\n{more}"
    # what stands close to running text is smoothed into it
    close = f"<body><div><b>{words(3)}</b></div><section><p>{long}</p></section><section><p>{more}</p></section><section><p>{long}</p></section><div>z</div><div>z</div><div>z</div><div>z</div></body>"
    smooth = pages_html.main_text(close)
    monkeypatch.setattr(pages_html, "smoothed", lambda ratios: ratios)
    assert smooth.startswith(words(3)) and pages_html.main_text(close) == smooth.partition("\n\n")[2]


def test_html_marks_against_brute_force():
    rng = random.Random(6)
    for _ in range(50):
        lines = [(0, "x" * rng.randint(1, 400), rng.randint(0, 6), 0, False, False) for _ in range(rng.randint(1, 30))]
        ratio = [len(x[1]) / max(1, x[2]) for x in lines]
        n = len(ratio)
        smooth = []
        for i in range(n):
            near = [(math.exp(-((k - i) ** 2) / 2), ratio[k]) for k in range(n) if abs(k - i) <= 2]
            smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        assert pages_html.smoothed(ratio) == pytest.approx(smooth)
        mean = sum(smooth) / n
        limit = min(mean, math.sqrt(sum((r - mean) ** 2 for r in smooth) / n))
        for mark, r in zip(pages_html.marked(lines), smooth, strict=True):
            assert mark == (r >= limit) or abs(r - limit) < 1e-6 * limit


def test_html_of_any_depth():
    began = time.monotonic()
    assert len(pages_html.main_text("<div>x" * 100_000).split("\n\n")) == 100_000
    assert pages_html.main_text("<p>a" + "</b></i>" * 100_000) == "a"
    assert time.monotonic() - began < 20


def test_html_keeps_every_short_paragraph():
    rng = random.Random(2)
    for _ in range(20):
        blocks = [prose(rng, rng.choice([1, 2, 40, 90])) + " &amp; é" for _ in range(rng.randint(1, 12))]
        page = "<html><body><nav><a href=/>x</a></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article><footer>f</footer></body></html>"
        assert pages_html.main_text(page) == "\n\n".join(H.unescape(b) for b in blocks)


# 3


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/ b\n", "<p>é</p>", 1), (1, None, "<p>é</p>", 1), (2, "u", None, 1), (5, "u", "", 1), (4, "u", "a\r\n\r\nWARC/1.0\r\n\r\n", 1), (1, None, "<p>é</p>", 1), (None, "n", "<p>é</p>", 1), (9, "u", "z" * 200_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int").repartition(3)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        revisit = i != first[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    same(warc.round_trip(df), want)
    assert warc.round_trip(df.limit(0)).count() == 0
    path = warc.write_warc(df, f"{tmp_path}/w", 10)
    full = warc.read_warc(spark, path)
    assert {r.payload for r in full.filter("page_id = 4").collect()} == {rows[4][2]}
    assert full.filter("record_type = 'revisit'").count() == 0 and full.count() == len(rows)
    assert [r.payload for r in warc.read_warc(spark, path, {"record_type": ["response"], "page_id": [5]}).collect()] == [""]
    pushed = warc.read_warc(spark, path, pushdown=True).filter("page_id = 3")
    assert [r.page_id for r in pushed.collect()] == [3]
    assert warc.read_warc(spark, path, payload=False).filter("page_id = 9").first().payload_bytes == 200_000


class Counting:
    """A file that counts the bytes read."""

    def __init__(self, raw):
        self.raw, self.at, self.bytes = raw, 0, 0

    def size(self):
        return len(self.raw)

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.raw[self.at : self.at + n]
        self.at += len(out)
        self.bytes += len(out)
        return out


def record(kind, page, block, more=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Type: application/http; msgtype=response\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_warc_skips_unwanted_payloads():
    http = lambda body, more="": f"HTTP/1.1 200 OK\r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body
    raw = b"".join(record("response", i, http(bytes([65 + i]) * 100_000)) + record("revisit", 100 + i, http(b""), "WARC-Refers-To:\r\n <urn:page:1>\r\n") for i in range(20))
    for where, most, ids in (({"record_type": ["revisit"]}, 0.05, [100 + i for i in range(20)]), ({"page_id": [3]}, 0.1, [3]), ({}, 1.1, [x for i in range(20) for x in (i, 100 + i)])):
        f = Counting(raw)
        rows = list(warc.WarcReader({"path": "x", "where": json.dumps(where)})._records(f))
        assert [r[0] for r in rows] == ids and f.bytes <= most * len(raw)
    assert rows[1][5] == 1 and rows[0][6] == "A" * 100_000
    long = record("response", 7, http(b"abc", "X: " + "y" * 9000 + "\r\n"))
    assert next(warc.WarcReader({"path": "x", "payload": "false"})._records(Counting(long)))[3] == 3


def test_warc_of_other_writers(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    records = [info, record("response", 1, b"HTTP/1.1 200 OK\r\n\r\n" + b"\xff\xfe" + b"z" * 300_000), record("response", 2, b"HTTP/1.1 200 OK\r\n\r\nshort")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    got = warc.read_warc(spark, str(tmp_path))
    same(got.select("page_id", "record_id", "payload_bytes"), [(None, "<urn:uuid:1>", 5), (1, "<urn:page:1>", 300_002), (2, "<urn:page:2>", 5)] * 2)
    assert {r.payload for r in warc.read_warc(spark, str(tmp_path), {"page_id": [2]}).collect()} == {"short"}
    assert {r.payload[:2] for r in got.filter("page_id = 1").collect()} == {"\ufffd\ufffd"}


# 4


def test_tokens(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    letters = [chr(i) for i in range(0x250)] + list("€  …　क😀́") + ["<|endoftext|>", " ", "\n\n", "'s", "12"] * 20
    other = [chr(c) for a, b in ((0x386, 0x3CF), (0x400, 0x460), (0x3000, 0x3100), (0x4E00, 0x4E40), (0x9F90, 0x9FB0), (0xAC00, 0xAC20), (0xD790, 0xD7B0)) for c in range(a, b)] + list(" ,1a") * 20
    texts = [r[1] for r in documents()] + ["".join(rng.choice(other) for _ in range(rng.randint(1, 30))) for _ in range(800)] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["a" * 5000, " " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("other"))
    want = []
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    same(tokens.token_counts(df, P.path("byte_bpe_50k.json")), want)
    assert tokens.token_counts(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


# 5

TONGUES = {"en": "the of and that with have this from they which".split(), "de": "der die und nicht mit sich auch werden über schon".split(), "el": "και του της από είναι στην για δεν που θα".split()}


def test_language(spark, docs):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lang = rng.choice(list(TONGUES))
        rows.append((i, prose(rng, rng.randint(5, 60), TONGUES[lang]), lang, "s", 1))
    rows += [(1000, None, "en", "s", 1), (1001, "12 !!", "de", "s", 1), (1002, prose(rng, 30, TONGUES["en"]) + " " + prose(rng, 40, TONGUES["de"]), None, "s", 1), (1002, "", None, "s", 1)]
    out = langid.identify(spark.createDataFrame(rows, SCHEMA))
    got = out.collect()
    truth = {r[0]: r[2] for r in rows[:300]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 30
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001)} == {("und", 0.0)}
    mixed = [r for r in got if r.doc_id == 1002 and r.lang_pred != "und"]
    assert mixed[0].lang_pred == "de" and mixed[0].n_spans == 2
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(empty(docs)).count() == 0
    assert langid.identify(docs).count() == docs.count()


def test_viterbi_against_one_by_one():
    import numpy as np

    rng = np.random.default_rng(1)
    scores = rng.normal(size=(30, 3)).astype(np.float32) * 3
    sizes = np.array([5, 0, 9, 1])
    ids = rng.integers(0, 30, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    path = langid.best_path(scores, ids, starts, sizes, 2.0)

    def value(labels, at):
        return sum(scores[w, k] for w, k in zip(at, labels, strict=True)) - 2.0 * sum(a != b for a, b in zip(labels[1:], labels, strict=False))

    from itertools import product

    for s, n in zip(starts, sizes, strict=True):
        if 0 < n < 8:
            at = ids[s : s + n]
            assert abs(value(path[s : s + n], at) - max(value(x, at) for x in product(range(3), repeat=int(n)))) < 1e-4


# 6


def base_spans(text):
    text = text or ""
    out = []

    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    for rank, (kind, pattern) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def private_texts():
    rng = random.Random(8)
    parts = ["a.b@c.org", "x@y", "é@a.b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "12345678901234567890", "+1 (017) 555-7713", "+44 20 7946 0958", "+1", "word", "é", "😀", "\n", "-", ".", "@", "0255.1.1.1", "a@b.c%d@e.f", "1 2 3"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 14))) for _ in range(300)]


def test_private_base(spark, docs):
    rows = [(i, t) for i, t in enumerate(private_texts())] + [(r[0], r[1]) for r in documents()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("__t", F.lit(1)).repartition(3)
    out = pii.report(df)
    want = []
    for i, t in rows:
        spans = base_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        want.append((i, *(sum(s[3] == k for s in spans) for k in ("email", "ip", "card", "phone")), hashlib.sha256(text.encode()).hexdigest()))
    same(out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), want)
    for r in out.collect():
        assert r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_id == len(r.spans.split(",")) - (not r.spans)
    assert pii.report(df.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please write to contact address user{i}@mail.example.org today") for i in range(6)] + [(50, "their contact address AB-12345-X was lost"), (51, "the number 2024-11 AB-12345-X stays")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = rows[6][1].index("AB-")
    assert got[50].spans == f"id:{start}:{start + 10}" and got[51].n_id == 0
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == "please write to contact address <EMAIL> today" and clean[50] == "their contact address <ID> was lost" and clean[51] == rows[7][1]


def test_whole_entities_are_seeds(spark):
    phones = [(i, f"you may ring us on +1 555 010 44{i:02d} at night") for i in range(5)]
    emails = [(10 + i, f"send mail to {w}@mail.example.org now") for i, w in enumerate(["anna", "bert", "carl", "dora"])]
    new = [(20, "ring us on 123 45 6789, please"), (21, "send mail to 98-7654-X 5 times"), (22, "a page of 123 45 6789 words"), (23, "ring us on 4-5 6")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(phones + emails + new, "doc_id long, text string")).collect()}
    assert got[20] == "id:11:22" and got[21] == "id:13:22" and got[22] == "" and got[23] == ""
    assert got[0].startswith("phone:") and got[10].startswith("email:") and "," not in got[0] + got[10]


def test_context_holds_an_identifier_before(spark):
    rows = [(i, f"key k-100200 user{i}@mail.example.org") for i in range(5)] + [(9, "their key k-100200 ZX-445566 is lost"), (10, "n " * 300 + "1 2 3 k-100200 ZX-445567")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9] == "id:19:28" and got[10] == ""


def test_pattern_graph_against_brute_force(spark):
    rng = random.Random(17)
    edges = {(rng.randrange(8), rng.randrange(40)) for _ in range(110)}
    own = {c: rng.choice([0.0, 0.0, pii.OPAQUE, 1.0]) for _, c in edges}
    rows = [(p, c, own[c]) for p, c in edges]
    trust = dict(own)
    for r in range(pii.ROUNDS):
        of = lambda p: [trust[c] for q, c in edges if q == p]
        scores = {p: (sum(of(p)) / (len(of(p)) + 1), sum(of(p))) for p in {p for p, _ in edges}}
        if r + 1 < pii.ROUNDS:
            trust = {c: max([own[c], *(scores[p][0] for p, d in edges if d == c and scores[p][1] >= pii.SUPPORT)]) for c in own}
    got = {r.pattern: (r.score, r.support) for r in pii.scored_patterns(spark.createDataFrame(rows + rows[:9], "pattern long, core long, trust double")).collect()}
    assert got == {p: (pytest.approx(a), pytest.approx(b)) for p, (a, b) in scores.items()}


def test_keys_and_random_strings(spark):
    rng = random.Random(18)
    secret = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'{rng.choice("the of and to".split())} text with token = "{secret(40)}" in it and {i} words') for i in range(8)]
    rows += [(20, 'another token = "abc-12-99887" stays short'), (21, f"commit {secret(40)} of the tree"), (22, "no token here, token of thanks 123456"), (23, 'a token = "onlyletters" too')]
    rows += [(30 + i, f"uid:{secret(32)} logged in") for i in range(5)] + [(40, "uid:7788-9900 logged in"), (41, "room:7788-9900 is free")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:8] + [rows[8], rows[11]]:
        a = t.index('"') + 1
        assert got[i] == f"id:{a}:{t.index(chr(34), a)}"
    assert got[21] == got[22] == got[41] == "" and got[40] == "id:4:13" and got[31] == "id:4:36"


def test_a_text_of_many_spans(spark):
    n = 3000
    t = " ".join(f"u{i}@m.example.org é 12-{i}-9988" for i in range(n))
    df = spark.createDataFrame([(1, t), (2, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert got[1].n_email == n and got[1].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean == {1: " ".join(f"<EMAIL> é 12-{i}-9988" for i in range(n)), 2: "nothing"}


def test_masked_texts_hold_nothing_private(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        assert not base_spans(r.text)


# 7


def groups(rows):
    sets = []
    for _, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def chained(seed=9):
    """Chains of texts that differ by a few words each, copies, and a passage that all others share."""
    rng = random.Random(seed)
    shared = [f"s{i}" for i in range(60)]
    rows, i = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(4, 150))]
        for _ in range(rng.randint(1, 6)):
            rows.append((i, " ".join(words)))
            i += 1
            words = list(words)
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                words.append("more")
    for k in range(40):
        rows.append((i + k, " ".join([*shared, *(f"u{k}x{j}" for j in range(rng.randint(5, 40)))])))
    return rows + rows[:3]


@pytest.mark.parametrize("seed", [9, 10])
def test_similar(spark, seed, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 8)
    monkeypatch.setattr(similar, "FREQUENT", 4)
    monkeypatch.setattr(similar, "SUBTILE", 10)
    monkeypatch.setattr(similar, "AT_ONCE", 3000)
    rows = chained(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("other")).repartition(5)
    same(similar.report(df), groups(rows))


def test_similar_on_documents(docs, monkeypatch):
    rows = [(r[0], r[1]) for r in documents()]
    same(similar.report(docs), groups(rows))
    assert similar.report(empty(docs)).count() == 0
    kept = similar.deduplicated(docs)
    assert kept.columns == docs.columns
    want = [d for d, n, _ in groups(rows) if not n] + list({c: c for _, n, c in groups(rows) if n})
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_one_row_of_each_group_stays(spark):
    t = prose(random.Random(4), 40)
    near, other = t + " more", prose(random.Random(5), 40)
    rows = [(5, t), (5, t), (7, t.upper()), (3, near), (3, other), (None, t), (8, "!"), (None, "?"), (None, "?"), (9, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__k1", F.lit(1)).withColumn("root", F.lit(2)).repartition(3)
    same(similar.deduplicated(df).select("doc_id", "text"), [(3, near), (3, other), (8, "!"), (None, "?"), (9, None), (9, None)])
    same(similar.report(df), groups(rows))


def test_walk_gives_the_groups_of_all_pairs():
    rng = np.random.default_rng(3)
    for two_sided in (False, True):
        for _ in range(30):
            n, side, near = rng.integers(20, 30, 25), rng.integers(0, 2, 25), np.triu(rng.random((25, 25)) < 0.06, 1)
            near |= near.T
            near &= 100 * np.minimum(n, n[:, None]) >= 80 * np.maximum(n, n[:, None])
            if two_sided:
                near &= side != side[:, None]
            got = similar.walk(n, side, two_sided, lambda i, others, near=near: near[i, others], 80)
            label = np.arange(25)
            for _ in range(25):
                label = np.where(near, label, 99).min(1, initial=99).clip(max=label)
            assert sorted(map(sorted, got)) == [np.flatnonzero(label == k).tolist() for k in range(25) if (label == k).sum() > 1]


def test_shingles_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "A b", prose(rng, 4000), "x" * 5000, prose(rng, 7) + "\v\f" + prose(rng, 30)]
    whole = S.shingle_sets(texts)
    monkeypatch.setattr(S, "PIECE", 1000)
    for a, b in zip(whole, S.shingle_sets(texts), strict=True):
        assert a.tolist() == b.tolist()
    assert [len(x) for x in whole[:3]] == [0, 0, 1]
    a, b = whole[3], whole[3][50:]
    some = [a, b, a[::2], np.sort(S.mix(a))]
    maps = S.Bitmaps(np.array([len(x) for x in some]), [S.bitmap(x) for x in some])
    for i, j in ((0, 1), (1, 0), (0, 3), (0, 2)):
        exact = S.shared(some[i], some[j])
        assert exact == len(np.intersect1d(some[i], some[j])) <= maps.most_shared(i, np.array([j]))[0]
    assert S.shared(a, b) == len(b) and maps.most_shared(0, np.array([3]))[0] < 0.5 * len(a)


# 8


def fill(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, held = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        level = (total - sum(2 * sizes[s] for s in held)) / max(1e-300, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in held else level * weight[s] for s in order}
        held |= over
        if len(held) == len(order):
            return {s: 2.0 * sizes[s] for s in order}


def test_mixing(docs):
    rows = documents()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    targets = fill(sizes)
    out = mixing.with_taken(docs).collect()
    taken, largest = {}, {}
    for r in out:
        assert r["__source_size"] == sizes[r["__source"]] and r["__target"] == pytest.approx(targets[r["__source"]])
        assert r["__taken"] in (0, r["__size"], 2 * r["__size"])
        taken[r["__source"]] = taken.get(r["__source"], 0) + r["__taken"]
        largest[r["__source"]] = max(largest.get(r["__source"], 0), r["__size"])
    for s, n in taken.items():
        assert abs(n - targets[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(docs.repartition(5))
    same(again, [tuple(r) for r in mixing.mix(docs).collect()])
    assert sorted((r.doc_id, r.size) for r in again.collect() if r.doc_id is not None) == sorted((r[0], len(WORD.findall(r[1] or ""))) for r in rows if r[0] is not None)
    assert mixing.mix(empty(docs)).count() == 0


def test_mixing_takes_in_the_order_of_the_keys(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COARSE", 8)
    monkeypatch.setattr(mixing, "FINE", 4)
    rng = random.Random(19)
    rows = [(i, prose(rng, rng.randint(1, 60)) + rng.choice(["", " ### !!"]), None, rng.choice("abcd"), 1) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    keys = {r.doc_id: r.key for r in df.select("doc_id", mixing.draw(F.col("doc_id"), F.col("text"), mixing.quality_weight(F.col("text"))).alias("key")).collect()}
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    for s in "abcd":
        own = sorted((keys[r[0]], len(WORD.findall(r[1])), r[0]) for r in rows if r[3] == s)
        total, target = sum(n for _, n, _ in own), got[own[0][2]].target
        epochs, rest, ahead = int(target // total), target - (target // total) * total, 0
        for _, n, d in own:
            assert got[d].taken == n * (epochs + (rest > 0 and ahead + n / 2 <= rest))
            ahead += n


def test_whole_columns_of_clashing_names(spark):
    """Columns named as those that the operators use inside change nothing."""
    rows = [(r[0], r[1], r[2], r[3]) for r in documents()]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame([(1, "the of and to in is that for it with we you they the of")], "item_id long, text string")
    crowded = plain
    for c in ("__h", "__win", "__k1", "__k2", "__t", "__w", "__all", "__spans", "__key", "__range", "__target", "__base", "__occ", "__p", "__words", "n_hit", "taken", "target", "component"):
        crowded = crowded.withColumn(c, F.lit("other"))
    for f in (rules.judge, langid.identify, pii.report, mixing.mix, lambda d: decontaminate.report(d, items), similar.report):
        assert sorted(map(repr, f(crowded).collect())) == sorted(map(repr, f(plain).collect()))
    for f in (similar.deduplicated, pii.redact, lambda d: decontaminate.clean(d, items)):
        assert f(crowded).columns == crowded.columns and f(crowded).count() == f(plain).count()


# 9


def tokens_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(rows, items):
    windows = {}
    for i, t in items:
        w = tokens_of(t)
        k = min(13, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = tokens_of(t), set(), set()
        for k in range(1, 14):
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), sum(i is not None for i in found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark, docs, monkeypatch):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.choice([2, 12, 13, 14, 40]), [f"q{k}" for k in range(60)])) for i in range(25)] + [(99, None), (98, "!!"), (None, prose(rng, 20, ["null", "item", "é"])), (3, items_text := "Repeated ITEM of É words " * 4)]
    rows = [(r[0], r[1]) for r in documents()]
    for i in range(60):
        rows.append((1000 + i, prose(rng, rng.randint(0, 300)) + " " + rng.choice([t for _, t in items if t]).upper() + "-" + prose(rng, 5)))
    rows += [(2000, items_text), (2000, items_text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_hit", F.lit("other")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(rows, items)
    same(decontaminate.report(df, bench), want)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 10)
    same(decontaminate.report(df, bench), want)
    monkeypatch.undo()
    assert not decontaminate.report(df, bench.limit(0)).filter("contaminated or n_hit > 0").count()
    assert decontaminate.report(df.limit(0), bench).count() == 0
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(w[0] for w in want if not w[5] and w[0] is not None)
    clean_ids = {w[0] for w in want if not w[2] and w[0] is not None}
    texts = {r[0]: r[1] for r in rows}
    for r in left.collect():
        if r.doc_id in clean_ids:
            assert r.text == texts[r.doc_id]
    spans_of_long = [w for w in contamination([(r.doc_id, r.text) for r in left.collect()], [x for x in items if len(tokens_of(x[1])) >= 12]) if w[2]]
    assert not spans_of_long


# 10


def test_quality(spark, docs):
    rng = random.Random(13)
    rows, marks = [], []
    for i in range(500):
        good = rng.random() < 0.7
        t = prose(rng, rng.randint(20, 90))
        rows.append((i, t if good else " ".join(w + rng.choice(["%%%", "***", "###"]) for w in t.split()), "en", "s", 1))
        marks.append((i, int(good), 0))
    rows += [(900, None, None, None, None), (901, "", None, None, 0), (901, "", None, None, 0)]
    marks += [(900, None, 0), (None, 1, 0), (5, marks[5][1], 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("text", F.lit("other"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = quality.classify(df, labels).collect()
    truth = dict((m[0], m[1]) for m in marks)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 40
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(docs), labels).count() == 0
    ones = quality.classify(df, labels.filter("quality = 1")).collect()
    assert {r.predicted for r in ones} == {1}


def test_forest_walk_is_the_recursive_one():
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = quality.fit(x, y)

    def walk(row):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
