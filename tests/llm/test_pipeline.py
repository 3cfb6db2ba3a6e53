"""run() against the stages' brute-force versions, on rows with copies, benchmark passages and personal data."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import langid

from .test_operators import SCHEMA, TONGUES, base_spans, contamination, groups, prose, tokens_of


def corpus():
    rng = random.Random(21)
    items = [(i, " ".join(f"bench{i}x{k}" for k in range(30))) for i in range(4)]
    rows = []
    for i in range(80):
        t = prose(rng, rng.randint(30, 90)) + f" unique{i} marker{i} here{i}"
        rows.append((i, t, "en", f"s{i % 4}", 1))
        if i % 5 == 0:
            rows.append((500 + i, t, "en", "s1", 1))
        if i % 9 == 0:
            rows.append((600 + i, t + " " + items[i % 4][1], "en", "s2", 1))
        if i % 11 == 0:
            rows.append((700 + i, prose(rng, 60) + f" write to user{i}@mail.example.org or +1 (017) 555-7713", "en", "s3", 1))
    rows += [(900, None, "en", "s0", 0), (901, "12 34 !!", None, None, 0), (902, "", "en", "s0", 0)]
    return rows, items


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("__id", F.lit("extra"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [(r[0], r[1]) for r in rows if r[0] < 900]
    left = [(d, t) for (d, t), (_, _, c) in zip(left, groups(left), strict=True) if d == c]
    bad = {w[0] for w in contamination(left, items) if w[5]}
    left = [(d, t) for d, t in left if d not in bad]
    assert bad and set(out) <= {d for d, _ in left}
    taken = sum(r.taken for r in out.values())
    assert abs(taken - 1.5 * sum(len(t.split()) for _, t in left)) < 0.1 * taken

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "mix"]
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage.write.parquet(f"{tmp_path}/{name}")
        stage = f(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path))
        assert sorted(stage.columns) == sorted(docs.columns)
    final = stage.collect()
    assert {r.doc_id for r in final} == {d for d, _ in left}
    assert not any(base_spans(r.text) for r in final)
    assert not any(tok.startswith("bench") for r in final for tok in tokens_of(r.text))
    assert langid.training_rows(docs).count() > 0


def test_language_stage_rejects_what_no_language_fits(spark):
    rng = random.Random(22)
    tongues = {"en": TONGUES["en"], "de": TONGUES["de"], "fr": "les des une est dans pour qui pas sur avec".split(), "es": "los del las por con una para como pero sus".split()}
    rows = [(i, prose(rng, 60, tongues[lang]), lang, "s", 1) for i, lang in enumerate(["en", "de", "fr", "es"] * 30)]
    mixed = [prose(rng, n, tongues[lang]) for n, lang in ((39, "en"), (35, "de"), (26, "fr"))]
    gibberish = ["".join(rng.choice("bcdfgjkmpqvwxyz") for _ in range(7)) for _ in range(80)]
    rows += [(500, " ".join(mixed), None, "s", 1), (501, prose(rng, 60, TONGUES["el"]), None, "s", 1), (502, prose(rng, 80, gibberish), None, "s", 1), (503, "שלום לכולם and", None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept >= set(range(120)) | {500} and not kept & {501, 502}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert (got[501].lang_pred, got[501].score, got[501].n_spans) == ("und", 0.0, 0)
    assert got[500].n_spans == 3 and got[500].score > 0.8 and got[503].lang_pred == "en" and got[503].n_spans == 1 and got[503].score < 0.5


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
