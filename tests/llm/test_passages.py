import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealwright.llm import passages as P


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def planted(rng):
    docs, want = {}, []
    for i in range(60):
        docs[i] = words(rng, rng.randint(60, 400))
    for k in range(8):  # exact passages of 51 to 130 words in three documents each
        passage = words(rng, rng.randint(51, 130))
        for i in rng.sample(range(50), 3):
            at = rng.randrange(len(docs[i]))
            docs[i][at:at] = passage
            want.append((i, " ".join(passage)))
    return docs, want


def frame(spark, docs, n=3):
    return spark.createDataFrame([(i, " ".join(w) if isinstance(w, list) else w) for i, w in docs.items()], "doc_id long, text string").repartition(n)


def brute(docs, t=46):
    """Tokens that lie in a run of t tokens that another document has too."""
    grams = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, w in docs.items()}
    seen = {}
    for i, g in grams.items():
        for k in range(len(g) - t + 1):
            seen.setdefault(tuple(g[k : k + t]), set()).add(i)
    out = {i: set() for i in docs}
    for i, g in grams.items():
        for k in range(len(g) - t + 1):
            if len(seen[tuple(g[k : k + t])]) > 1:
                out[i].update(range(k, k + t + 4))
    return out


def test_windows_equal_a_direct_search():
    rng = np.random.default_rng(3)
    for t in (3, 8, 46):
        v = rng.integers(1, 60, 300).astype(np.uint64)
        v[[0, 90, 91, 299]] = 0
        got = set(zip(*(x.tolist() for x in P.compact_windows(v, t))))
        want = set()
        for c in np.flatnonzero(v):
            left = right = 0
            while v[c - left - 1] > v[c]:
                left += 1
            while v[c + right + 1] >= v[c]:
                right += 1
            left, right = min(left, 2 * t - 2), min(right, 2 * t - 2)
            if left + right + 1 >= t:
                want.add((int(c), left, right))
        assert got == want


def test_exact_passages_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(1)
    docs, _ = planted(rng)
    want = brute(docs)
    got = {i: set() for i in docs}
    for r in P.repeated_passages(frame(spark, docs)).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    for i in docs:
        assert want[i] <= got[i]
        assert bool(want[i]) == bool(got[i])
        assert len(got[i]) <= len(want[i]) * 1.3


def test_near_passages(spark):
    rng = random.Random(2)
    docs, pairs = {}, 0
    for k in range(40):
        passage = words(rng, 90)
        other = list(passage)
        other[rng.randrange(30, 60)] = "changed"
        docs[2 * k], docs[2 * k + 1] = words(rng, 80) + passage + words(rng, 70), words(rng, 40) + other + words(rng, 90)
    groups = {r["doc_id"]: r["class_id"] for r in P.repeated_passages(frame(spark, docs)).collect()}
    pairs = sum(groups.get(2 * k) == groups.get(2 * k + 1) == 2 * k for k in range(40))
    assert pairs >= 38


def test_large_group_of_one_passage(spark):
    rng = random.Random(4)
    passage = words(rng, 70)
    docs = {i: words(rng, 60) + passage + words(rng, 60) for i in range(200)} | {i: words(rng, 200) for i in range(200, 230)}
    rows = P.repeated_passages(frame(spark, docs)).collect()
    assert {r["doc_id"] for r in rows} == set(range(200)) and {r["class_id"] for r in rows} == {0}
    assert [r["doc_id"] for r in rows if r["kept"]] == [0]


def test_cutting(spark):
    rng = random.Random(6)
    passage = words(rng, 80)
    docs = {1: words(rng, 30) + passage + words(rng, 30), 2: ["Before,"] + passage + ["after."], 3: passage, 4: words(rng, 90)}
    docs[5] = list(docs[4])
    texts = {i: " ".join(w) for i, w in docs.items()} | {6: "", 7: "too short to matter"}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(8, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in P.without_repeats(df).collect()}
    assert out[1]["text"] == texts[1] and out[4]["text"] == texts[4] and out[6]["text"] == "" and out[7]["text"] == texts[7] and out[8]["text"] is None
    assert out[2]["text"] == "Before, after." and out[2]["n_chars"] == 14
    assert 3 not in out and 5 not in out
    assert list(out[1].asDict()) == df.columns


def test_unusual_rows(spark):
    text = " ".join(f"x{i}" for i in range(80))
    rows = [(None, text, 1), (1, None, 2), (2, "", 3), (3, "a b c", 4), (4, text, 5), (4, text, 5), (4, text + " other words here", 6), (5, "la " * 500, 7), (6, "la " * 300, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("cut", F.lit(1)).withColumn("rep", F.lit("r"))
    got = P.repeated_passages(df).collect()
    assert {r["doc_id"] for r in got} == {None, 4, 5, 6}
    assert P.without_repeats(df).columns == df.columns and P.without_repeats(df).count() > 0
    assert P.repeated_passages(df.limit(0)).count() == 0 and P.without_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1 << 21])
def test_very_long_text(spark, n):
    rng = np.random.default_rng(0)
    long = " ".join(np.char.add("v", rng.integers(0, 1 << 30, n // 4).astype(str)))
    piece = " ".join(long.split()[100_000:100_100])
    got = P.repeated_passages(spark.createDataFrame([(1, long), (2, "start " + piece + " end")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got) == [(1, 100_000, 100_100), (2, 1, 101)]


def hot_anchor(rng, n, core_size=15, t=46):
    """Contexts of one anchor: a common core, other continuations, and near copies that differ beside the core on both sides."""
    core = rng.integers(1, 1 << 16, 4 * t - 3)
    ctx = np.where(abs(np.arange(4 * t - 3) - (2 * t - 2)) <= core_size // 2, core, rng.integers(1, 1 << 16, (n, 4 * t - 3)))
    for k in range(0, n // 2, 2):
        ctx[n // 2 + k // 2] = ctx[k]
        ctx[n // 2 + k // 2, [2 * t - 13, 2 * t - 10, 2 * t + 6, 2 * t + 9]] = rng.integers(1, 1 << 16, 4)
    return ctx[rng.permutation(n)].astype(np.uint16)


def all_pairs(ctx, t=46):
    n = len(ctx)
    g = P.Group(ctx, np.full(n, 2 * t - 2), np.full(n, 2 * t - 2), t, 0.8)
    for d in range(1, n):
        g.compare(np.arange(n - d), np.arange(d, n))
    return g.root


def test_large_anchor_equals_all_pairs():
    for seed in range(3):
        ctx = hot_anchor(np.random.default_rng(seed), 600)
        want = all_pairs(ctx)
        g = P.Group(ctx, np.full(600, 90), np.full(600, 90), 46, 0.8)
        g.link(np.zeros(600, np.int64))
        assert len(np.unique(want)) == 450
        assert g.root.tolist() == want.tolist()


def test_large_anchor_over_several_batches(spark, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 40)
    ctx = hot_anchor(np.random.default_rng(9), 400)
    want = all_pairs(ctx)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rows = spark.createDataFrame([(8, i, 90, 90, i, i, bytearray(x.tobytes())) for i, x in enumerate(ctx)], "key long, content long, l short, r short, first_doc long, first long, ctx binary")
    got = {r["content"]: r["comp"] for r in P._linked(rows, 46, 0.8).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [got.get(i, i) for i in range(400)] == want.tolist()


def test_rows_without_an_id_or_of_one_id_are_judged_by_their_own_text(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join(words(rng, 80)) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, c + " " + a), (2, d), (4, a), (4, b + " own"), (4, " ".join(words(rng, 60)) + " " + d), (5, None), (None, None)]
    got = {(r["doc_id"], r["text"]) for r in P.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, a), (2, d), (5, None), (None, None)} <= got
    assert (None, a) not in got and (4, a) not in got
    assert (None, c + " ") in got and (4, rows[7][1][: -len(d)]) in got
    assert (4, b + " own") in got  # the smaller id keeps b


def test_common_continuation_of_near_copies_survives(spark):
    rng = random.Random(21)
    docs = {}
    for k in range(30):
        p, q, r = words(rng, 55), words(rng, 120), words(rng, 120)
        docs[3 * k], docs[3 * k + 1], docs[3 * k + 2] = p + r, p + q, p + q
    out = {r["doc_id"]: r["text"] for r in P.without_repeats(frame(spark, docs)).collect()}
    for k in range(30):
        q = docs[3 * k + 1][55:]
        left = out[3 * k + 1].split()
        # the ends of a near match may take a few words
        assert left[-100:] == q[-100:]


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def edited(rng, passage):
    """A copy with one or two runs of words replaced, inserted, deleted or swapped, of similarity 0.8 to 1."""
    while True:
        out = list(passage)
        for _ in range(rng.randint(1, 2)):
            n, at = rng.randint(1, 6), rng.randrange(5, len(out) - 12)
            kind = rng.randrange(4)
            if kind == 0:
                out[at : at + n] = words(rng, n)
            elif kind == 1:
                out[at:at] = words(rng, n)
            elif kind == 2:
                del out[at : at + n]
            else:
                out[at], out[at + 1] = out[at + 1], out[at]
        if len(out) >= 50 and 0.8 <= jaccard(passage, out) < 1:
            return out


def test_near_passages_of_any_edit_are_found(spark):
    rng = random.Random(77)
    docs, share = {}, []
    for k in range(300):
        passage = words(rng, rng.randint(50, 140))
        other = edited(rng, passage)
        share.append(jaccard(passage, other))
        docs[2 * k], docs[2 * k + 1] = words(rng, 60) + passage + words(rng, 60), words(rng, 40) + other + words(rng, 70)
    groups = {r["doc_id"]: r["class_id"] for r in P.repeated_passages(frame(spark, docs)).collect()}
    found = [groups.get(2 * k) == groups.get(2 * k + 1) == 2 * k for k in range(300)]
    assert sum(found) >= 0.97 * 300
    low = [f for f, j in zip(found, share) if j < 0.84]
    assert len(low) > 30 and sum(low) >= 0.9 * len(low)
    assert not any(groups.get(i, i) != i - i % 2 for i in docs)


@pytest.mark.parametrize("n", [800, 5000])
def test_near_copies_in_a_large_anchor(n):
    """Pairs that differ from each other beside the anchor, by replaced and inserted tokens."""
    rng = np.random.default_rng(n)
    t, width = 46, 181
    core = rng.integers(1, 1 << 16, 21)
    rows = []
    for _ in range(n // 2):
        x = rng.integers(1, 1 << 16, width)
        x[80:101] = core
        y = x.copy()
        if len(rows) % 4:
            y[103:107] = rng.integers(1, 1 << 16, 4)
        else:  # three more tokens after the core
            y = np.concatenate((x[:102], rng.integers(1, 1 << 16, 5), x[104:]))[:width]
        y[:60] = rng.integers(1, 1 << 16, 60)
        rows += [x, y]
    order = rng.permutation(n)
    g = P.Group(np.array(rows)[order].astype(np.uint16), np.full(n, 90), np.full(n, 90), t, 0.8)
    g.link(np.zeros(n, np.int64))
    at = np.argsort(order)
    assert (g.root[at[::2]] == g.root[at[1::2]]).all()
    assert len(np.unique(g.root)) == n // 2
    cut = g.cut_hi >= g.cut_lo
    assert cut.sum() == n // 2 and (cut[at[::2]] != cut[at[1::2]]).all()


def test_every_passage_stays_somewhere(spark):
    rng = random.Random(31)
    docs = {}
    for k in range(40):
        base = words(rng, rng.randint(60, 150))
        for j in range(4):
            docs[4 * k + j] = words(rng, rng.randint(0, 60)) + (base if j % 2 else edited(rng, base)) + words(rng, rng.randint(0, 60))
    out = {r["doc_id"]: r["text"].split() for r in P.without_repeats(frame(spark, docs)).collect()}
    left = {w for x in out.values() for k in range(len(x) - 2) for w in [tuple(x[k : k + 3])]}
    total = gone = 0
    for i, w in docs.items():
        for k in range(len(w) - 2):
            total += 1
            gone += tuple(w[k : k + 3]) not in left
    # only the edited words of a near copy go
    assert gone <= 0.05 * total
    assert sum(map(len, out.values())) < 0.8 * sum(map(len, docs.values()))


def test_word_count_equals_word_spans(monkeypatch):
    from sealwright.llm import wordhash

    monkeypatch.setattr(wordhash, "SEGMENT", 7)
    rng = random.Random(4)
    for _ in range(200):
        data = "".join(rng.choice("ab \n\t\u00e9") for _ in range(rng.randrange(40))).encode()
        assert wordhash.word_count(data) == len(wordhash.word_spans(data)[0]) == len(data.split())
