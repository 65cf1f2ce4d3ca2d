"""Operators over documents against brute force, accuracy on held-out rows, and unusual rows."""

import random
import re
import time
import zlib

import pytest
import xxhash
from conftest import same_as_duckdb
from pyspark.sql import functions as F

from sealwright.llm import decontaminate, langid, maintext, mixing, quality, simhash, tokencount
from sealwright.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(None, "some text here", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, "  \t\n", "xx", "b"), (4, "word " * 40000, "en", "b"), (5, "same words again and again", "fr", None), (5, "same words again and again", "fr", None), (6, "1234 5678", "en", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    clash = ["score", "found", "epoch", "block", "place", "n_tokens", "block_rank", "fp", "component_id", "held_out"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, name):
    assert same_as_duckdb(spark, QUERIES[name], ORACLES[name])


def direct_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), 42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_all_pairs(spark, docs):
    rows = docs.where("doc_id < 300").select("doc_id", "text").collect()
    fp = {r["doc_id"]: direct_fingerprint(r["text"]) for r in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs.where("doc_id < 300")).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def test_simhash_random_fingerprints(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(400):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(4)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    link = {x: x for x in fps}

    def at(x):
        while link[x] != x:
            x = link[x]
        return x

    for r in simhash.links(df).collect():
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        assert find(a) == find(b)
        x, y = at(a), at(b)
        link[max(x, y)] = min(x, y)
    assert {x: at(x) for x in fps} == {x: find(x) for x in fps}


def test_simhash_unusual_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.quality(docs, flipped).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got.collect()}


def test_quality_unusual_rows(spark, odd):
    labels = spark.createDataFrame([(2, 1), (4, 0), (None, 1), (99, 0), (6, None)], "doc_id long, quality int")
    got = quality.quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(odd.limit(0), labels).count() == 0


def test_languages_on_held_out_rows(docs, odd):
    rows = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.97
    got = langid.languages(odd).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} >= {1, 2, 3, 6}
    assert langid.languages(odd.limit(0)).count() == 0
    nothing = langid.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_token_counts_equal_direct_encoding(docs, odd):
    few = docs.where("doc_id < 120").select("doc_id", "text")
    want = {r["doc_id"]: len(tokencount._encoding(tokencount.TOKENIZER).encode_ordinary(r["text"])) for r in few.collect()}
    for size in (1 << 20, 1000, 2):
        got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(few, block_bytes=size).collect()}
        assert got == want
    got = tokencount.token_counts(odd).collect()
    assert len(got) == len(ODD) and all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (1, 2))
    assert tokencount.token_counts(odd.limit(0)).count() == 0


def test_decontamination_of_unusual_rows(spark, odd):
    items = spark.createDataFrame([(1, "Same, WORDS again"), (2, None), (3, "..."), (None, "some text")], "item_id long, text string")
    got = decontaminate.contamination(odd, items).collect()
    assert len(got) == len(ODD)
    five = [r for r in got if r["doc_id"] == 5]
    assert [(r["n_words"], r["n_hit"], r["contaminated"], r["items"]) for r in five] == [(5, 3, True, ["1"])] * 2
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(odd.limit(0), items).count() == 0
    blocks = decontaminate.scan(odd, items, block_bytes=8)[0].select("doc_id", "found_.n_hit").collect()
    assert sorted(map(str, blocks)) == sorted(str(r) for r in decontaminate.contamination(odd, items).select("doc_id", "n_hit").collect())
    assert decontaminate.decontaminated(odd, items).columns == odd.columns


def test_mixing_meets_its_target(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(5, 40), "big" if i % 10 else f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, size = {}, {}
    for i, t, s in rows:
        size[i] = len(t.split())
        total[s] = total.get(s, 0) + size[i]
    out = mixing.mix(df, max_repetition=3.0, block_tokens=500).collect()
    taken = {}
    for r in out:
        taken[r["source"]] = taken.get(r["source"], 0) + r["n_tokens"]
        assert r["n_tokens"] == size[r["doc_id"]]
    assert {r["doc_id"] for r in out} == set(size)
    assert max(taken[s] / total[s] for s in total) == pytest.approx(3, rel=0.1)
    assert len({(r["doc_id"], r["epoch"]) for r in out}) == len(out)
    solved = mixing.mixture(spark.createDataFrame(list(total.items()), "source string, total long"), max_repetition=3.0)
    for s in total:
        assert taken[s] == pytest.approx(min(solved.scale * total[s] ** solved.exponent, 3 * total[s]), abs=40)


def test_mixing_entropy_and_limits(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, total long")
    assert mixing.mixture(totals, target_entropy=0.9).entropy == pytest.approx(0.9, abs=1e-6)
    assert mixing.mixture(totals, target_entropy=5.0).exponent == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.mixture(totals, budget=10_000, max_repetition=2.0)


def test_mixing_of_unusual_rows(odd):
    out = mixing.mix(odd)
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in ODD}
    assert set(odd.columns) < set(out.columns)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_main_text_layouts():
    pages = [maintext.blocks(maintext._spelled(x)) for x in maintext.LAYOUTS]
    right = [(b.text.startswith("content"), k) for p in pages for b, k in zip(p, maintext.tree().predict(maintext.features(p)))]
    assert sum(a == b for a, b in right) / len(right) >= 0.97


def text_of(html):
    page = maintext.blocks(html)
    keep = maintext.tree().predict(maintext.features(page)) if page else []
    return "\n\n".join(b.text for b, k in zip(page, keep) if k)


def test_main_text_of_pages():
    html = (
        "<!doctype html><html class='has-sidebar'><head><title>T</title><style>p{}</style></head><body class=with-menu><div id='cookieNotice'><p>We use cookies</p></div>"
        "<header><h2>Site</h2><nav><a href='/'>Home</a></nav></header><main><article><h1>A &amp; B</h1><p>First <b>bo</b>ld\n paragraph&nbsp;of text, with <a href=x>a link</a>.</p>"
        "<script>var a = '<p>no</p>'</script><!-- <p>no</p> --><p>Short.</p><aside>Also read this</aside><ul><li>one</li><li>two</li></ul><div class='ad-slot'>Buy now</div><form>Name <input></form></article></main>"
        "<section class='comments'><p>I liked this a lot, it was a very good article with many words in it.</p></section><footer>&copy; 2020</footer></body></html>"
    )
    assert text_of(html) == "A & B\n\nFirst bold paragraph of text, with a link.\n\nShort.\n\none\n\ntwo"
    assert text_of("") == "" and text_of("<article><p>unclosed <b>tag <a href='x") == "unclosed tag <a href='x" and text_of("<script>never closed <p>x</p>") == ""


def test_main_text_equals_the_article(spark):
    import html as H

    rows = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in rows.collect()}
    for r in maintext.extracted(rows).collect():
        article = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(H.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_main_text_unusual_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>" + "word " * 50000), (2, "u", "plain text without tags at all here")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = maintext.extracted(df).collect()
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0] and max(r["n_chars"] for r in got) == 249_999
    assert maintext.extracted(df.limit(0)).count() == 0


LONG = "This is a paragraph of the article that goes on for quite a few words, so that it is clearly text."


def test_main_text_of_difficult_pages():
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul>"
    assert text_of(f"<div class='layout-sidebar'>{menu}<div><h1>A title here</h1><p>{LONG}</p><p>{LONG}</p></div></div>") == f"A title here\n\n{LONG}\n\n{LONG}"
    assert text_of(f"<article><h1>T</h1><p>{LONG}</p><ul><li class=ad>Buy<li>one thing<li>two things</ul></article>") == f"T\n\n{LONG}\n\none thing\n\ntwo things"
    assert text_of(f"<article><header class='entry-header'><h1>The title</h1></header><p>{LONG}</p></article>") == f"The title\n\n{LONG}"
    assert text_of(f"<article><p>{LONG} <math><mi>x</mi></math> is <svg/>known.</p><p>After <svg><text>no</text></svg>it.</p><object>Fallback</object></article>") == f"{LONG} x is known.\n\nAfter it.\n\nFallback"
    assert text_of(f"<div>{menu}</div><div><h1>A title</h1><p>{LONG}</p><p>{LONG}</p><p>No.</p></div><div>Copyright 2020</div>").endswith(f"{LONG}\n\nNo.")
    assert text_of(f"<article><p title=\"a > b\">{LONG}</p><p>It's 3 < 4, isn't it</p></article>") == f"{LONG}\n\nIt's 3 < 4, isn't it"


@pytest.mark.parametrize("piece", ["<a ", "<p class='ad", "<a x=\">\" ", "<li class=ad>", "<div class=ad>", "<!-", "<a x='y=\">", "&amp", "<ul><li>"])
def test_main_text_takes_linear_time(piece):
    import time

    page = piece * (1_000_000 // len(piece)) + "y=\""
    began = time.process_time()
    text_of(page)
    assert time.process_time() - began < 8


def test_language_pieces_give_the_same_grams(monkeypatch):
    import numpy as np

    rng = random.Random(1)
    # the lower case of a sigma depends on its word, so these cuts lie at blanks
    for chars, sizes in (("abcé ΣΟΣ 12\n.,x", (64, 300)), ("abcÉ x12\n.,Z", (1, 7, 64))):
        text = "".join(rng.choice(chars) for _ in range(3000))
        monkeypatch.setattr(langid, "PIECE", 1 << 20)
        whole = np.sort(np.concatenate(list(langid.text_grams(text))))
        assert (whole == np.sort(langid.grams(langid.letters(text)))).all()
        for size in sizes:
            monkeypatch.setattr(langid, "PIECE", size)
            assert (np.sort(np.concatenate(list(langid.text_grams(text)))) == whole).all()


def test_language_filters_equal_exact_sets():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)) for _ in range(3)]
    sets[2] = np.union1d(sets[2], sets[0][:20_000])
    f = langid.Filters(["a", "b", "c"])
    for k, x in enumerate(sets):
        f.put(k, x)
    f.close()
    asked = np.concatenate((sets[0][:25_000], rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)))
    mask = None
    for slot in f._at(asked):
        mask = f.slots[0][slot] if mask is None else mask & f.slots[0][slot]
    for k, x in enumerate(sets):
        bit, held = (mask >> k) & 1 == 1, np.isin(asked, x)
        assert bit[held].all()  # no false negative
        assert abs(bit[~held].mean() - f.false[k]) < 0.005


def test_a_language_of_few_ids_in_many_rows_is_learned(spark):
    few = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:7]
    rows = [(i, f"qqz xqw zzq wqx qzx {k} xwq", "xx") for i in few for k in range(400)] + [(1000 + i, f"der hund und die katze laufen weit {i}", "de") for i in range(3000)]
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {(r["lang"], r["lang_pred"]) for r in got.join(spark.createDataFrame(rows, "doc_id long, text string, lang string").select("doc_id", "lang").distinct(), "doc_id").select("lang", "lang_pred").distinct().collect()} == {("xx", "xx"), ("de", "de")}


def test_trained_filters_hold_all_ngrams_of_many_languages(spark):
    import numpy as np

    rows = [(i, " ".join(chr(0x4E00 + 100 * lang + (i * 7 + k) % 90) * 3 for k in range(5)), f"l{lang:03}") for lang in range(70) for i in range(lang * 5, lang * 5 + 5)]
    f = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert f.langs == [f"l{k:03}" for k in range(70)] and len(f.slots) == 2
    for i, text, lang in rows:
        k = f.langs.index(lang)
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for hashes in langid.text_grams(text):
                assert all(((f.slots[k // 64][at] >> np.uint64(k % 64)) & np.uint64(1)).all() for at in f._at(hashes))
            assert f.predict(text)[0] == lang


def test_one_labelled_id_in_many_rows_is_one_document(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, f"word{i} some text of {i} here") for i in ids] + [(ids[0], f"other {k}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    got = quality.quality(docs, labels)
    assert got.count() == docs.count()


def test_hidden_containers_take_linear_time():
    html = "<div hidden><article>" * 47_000
    began = time.time()
    maintext.blocks(html)
    assert time.time() - began < 4


def test_places_of_one_id_differ(spark):
    rows = [(1, "a b c", "s"), (1, "a b c d e", "s"), (2, "x", "s")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len({r["place"] for r in got}) == len(got) == 3


def test_attention_gradients_equal_differences():
    import numpy as np

    rng = np.random.default_rng(3)
    model = quality.Attention(5)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 4, 7)]
    f, first = np.concatenate(bags), np.array([0, 1, 5])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        # a plain version of the model, bag by bag
        total = 0.0
        for bag, label, weight in zip(bags, y, w):
            h = [np.tanh(x @ model.p["W"] + model.p["c"]) for x in bag]
            e = np.exp([(np.tanh(x @ model.p["A"]) / (1 + np.exp(-(x @ model.p["B"])))) @ model.p["v"] for x in h])
            z = sum(a * x for a, x in zip(e / e.sum(), h)) @ model.p["w"] + model.p["b"]
            p = 1 / (1 + np.exp(-z))
            total -= weight * (label * np.log(p) + (1 - label) * np.log(1 - p))
        return total / w.sum()

    got = model.step(f, first, y, w)
    for name, grad in got.items():
        flat = np.atleast_1d(model.p[name])
        for at in [tuple(rng.integers(0, n) for n in flat.shape) for _ in range(4)]:
            was, ends = flat.copy(), []
            for step in (1e-6, -1e-6):
                moved = was.copy()
                moved[at] += step
                model.p[name] = moved if np.ndim(grad) else moved[0]
                ends.append(loss())
            model.p[name] = was if np.ndim(grad) else was[0]
            assert np.atleast_1d(grad)[at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-3, abs=1e-7)


def test_mixing_equals_a_direct_search(spark):
    import math

    rng = random.Random(8)
    for limit in (1.2, 2.0, 5.0):
        totals = [rng.randint(1, 10**6) for _ in range(12)]
        got = mixing.mixture(spark.createDataFrame([(str(i), t) for i, t in enumerate(totals)], "source string, total long"), max_repetition=limit)

        def weights(a):
            powers = [t**a for t in totals]
            budget = max(t / p for t, p in zip(totals, powers)) * sum(powers)  # every source once in full
            return [budget * p / sum(powers) for p in powers]

        # the flattest mixture on a fine grid that reads no source too often
        grid = next(a for a in (k / 20_000 for k in range(20_001)) if max(w / t for w, t in zip(weights(a), totals)) <= limit * (1 + 1e-9))
        assert got.exponent == pytest.approx(grid, abs=1.1e-4)
        shares = [w / sum(weights(got.exponent)) for w in weights(got.exponent)]
        assert got.entropy == pytest.approx(-sum(x * math.log(x) for x in shares), abs=1e-9)


def test_both_ways_give_the_same_rows(spark, docs, monkeypatch):
    """What is looked up depends on sizes, the result does not."""
    few = docs.where("doc_id < 400").select("doc_id", "source", "text")
    want = sorted(map(tuple, simhash.near_duplicates(few.repartition(3)).collect()))
    mixed = sorted(map(str, mixing.mix(few).drop("text").collect()))
    monkeypatch.setattr(simhash, "FEW_PIECES", 0)
    assert sorted(map(tuple, simhash.near_duplicates(few.repartition(3)).collect())) == want
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    again = sorted(map(str, mixing.mix(few).drop("text").collect()))
    assert again == mixed
