"""Each stage on a small corpus with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(8)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    base = docs.where("doc_id < 40").collect()
    passage = " ".join(rng.choice(base)["text"].split()[:3] + [f"planted{rng.randrange(10**6)}" for _ in range(70)])
    more = [(900_001, base[1]["text"] + " " + passage, "en", "src1", 0), (900_002, base[2]["text"] + " " + passage, "en", "src2", 0), (900_003, base[3]["text"][:400] + " " + item, "en", "src3", 0)]
    now = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stage(spark, now, SF).cache()
        if k < 4:
            assert now.columns == docs.columns
            assert now.count() <= before.count()
        if name == "near_duplicates":
            assert now.count() == now.select("doc_id").distinct().count()
        if name == "passages":
            held = {r["doc_id"] for r in now.collect() if passage.split()[10] in (r["text"] or "")}
            came = {r["doc_id"] for r in before.collect() if passage.split()[10] in (r["text"] or "")}
            assert len(came) > 0 and held == {min(came)}
        if name == "decontamination":
            assert 900_003 not in {r["doc_id"] for r in now.select("doc_id").collect()}
    assert now.count() >= before.count() and now.select("doc_id").distinct().count() == before.count()


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c, d = (" ".join(f"w{rng.randrange(3000)}" for _ in range(300)) for _ in range(4))
    near = a.replace(a.split()[150], "changed", 1)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, d), (4, d + " x"), (5, near), (6, b), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert [x for x in got if x[0] != 4] == sorted([(0, a), (0, a), (1, a), (2, b), (3, c)])
    assert len([x for x in got if x[0] == 4]) == 1


def test_columns_of_any_name_and_repeated_ids(spark):
    """Names that the stages use themselves, ids with several texts, null, empty and very long texts."""
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000))
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "quite another text with its own words"), (None, None), (2, None), (3, ""), (4, long), (5, passage + " tail of five"), (6, passage + " tail of six and more words"), (None, passage + " no id")]
    names = ["fp", "root", "text_", "doc_", "mark_", "gone_", "spans_", "row", "own", "found", "score", "id_"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *range(len(names))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality":
            continue
        before, now = now, stage(spark, now, SF).cache()
        got = [(r["doc_id"], r["text"]) for r in now.collect()]
        if name != "mixing":
            assert now.columns == docs.columns
            assert all([r[n] for n in names] == list(range(len(names))) for r in now.collect())
        if name == "near_duplicates":
            assert sorted(got, key=repr) == sorted(rows[:1] + rows[2:4] + rows[4:5] + rows[6:], key=repr) or sorted(got, key=repr) == sorted(rows[:1] + rows[2:5] + rows[6:], key=repr)
        if name == "passages":
            assert sum("p" + passage.split()[40][1:] in (t or "").split() for _, t in got) == 1
            assert (4, long) in got
    assert {r["doc_id"] for r in now.collect()} >= {1, 4, 5}
