"""A projection of identities that goes on from a prior one, and its closure, against the record-by-record reading."""

import random

import pytest
from pyspark.sql import functions as F

from sealwright.operators import identity

TRANSITION = "ord int, kind string, surviving string, retired array<string>, original string, continuing string, new array<string>, predecessor string, successor string, predecessor_retires boolean, subject string"


class Refused(Exception):
    pass


def folded(transitions, prior=None):
    """One transition after the other: (resolutions, splits, retired)."""
    to, splits, gone = dict(prior[0]), {k: list(v) for k, v in prior[1].items()}, set(prior[2])

    def assign(a, b):
        if to.get(a, b) != b:
            raise Refused
        to[a] = b

    for t in transitions:
        if t["kind"] == "merge":
            if t["surviving"] in t["retired"]:
                raise Refused
            for x in t["retired"]:
                assign(x, t["surviving"])
                gone.add(x)
        elif t["kind"] == "split":
            if splits.get(t["original"], sorted(t["new"])) != sorted(t["new"]) or t["original"] in t["new"]:
                raise Refused
            splits[t["original"]] = sorted(t["new"])
            if t["continuing"] not in (None, t["original"]):
                assign(t["original"], t["continuing"])
            if t["continuing"] != t["original"]:
                gone.add(t["original"])
        elif t["kind"] == "succession":
            if t["predecessor"] == t["successor"]:
                raise Refused
            if t["predecessor_retires"]:
                assign(t["predecessor"], t["successor"])
                gone.add(t["predecessor"])
        else:
            gone.add(t["subject"])
    ends = {}
    for a in to:
        seen, b = {a}, to[a]
        while b in to:
            if b in seen:
                raise Refused
            seen.add(b)
            b = to[b]
        ends[a] = b
    return ends, {o: sorted({ends.get(c, c) for c in cs}) for o, cs in splits.items()}, gone


def random_transitions(rng, n, names):
    out = []
    for k in range(n):
        a, b, c, d = rng.sample(names, 4)
        t = dict.fromkeys([x.split()[0] for x in TRANSITION.split(", ")]) | {"ord": k}
        kind = rng.choice(["merge", "split", "succession", "retirement"])
        t |= {"kind": kind}
        if kind == "merge":
            t |= {"surviving": a, "retired": [b, c][: rng.randrange(1, 3)]}
        elif kind == "split":
            t |= {"original": a, "new": [b, c], "continuing": rng.choice([None, a, b, c])}
        elif kind == "succession":
            t |= {"predecessor": a, "successor": b, "predecessor_retires": rng.random() < 0.8}
        else:
            t |= {"subject": d}
        out.append(t)
    return out


def frames(spark, prior):
    return (
        spark.createDataFrame(list(prior[0].items()), "src string, root string"),
        spark.createDataFrame([(o, c) for o, cs in prior[1].items() for c in cs], "original string, child string"),
        spark.createDataFrame([(x,) for x in prior[2]], "subject string"),
    )


@pytest.mark.parametrize("seed", range(4))
def test_extension_equals_the_ordered_reading(spark, seed):
    rng = random.Random(seed)
    accepted = refused = 0
    while accepted < 2 or refused < 1:
        names = [f"s{k}" for k in range(rng.choice([16, 60, 60]))]
        old, new = random_transitions(rng, 10, names), random_transitions(rng, 7, names)
        try:
            prior = folded(old, ({}, {}, set()))
        except Refused:
            continue
        r, b, g = frames(spark, prior)
        t = spark.createDataFrame([tuple(x.values()) for x in new], TRANSITION)
        try:
            want = folded(new, prior)
        except Refused:
            want = None
        if (want is None and refused) or (want and accepted >= 2):
            continue
        faults = identity.extension_violations(r, b, t).collect()
        assert bool(faults) == (want is None), (faults, new, prior)
        if want is None:
            refused += 1
            continue
        accepted += 1
        moved = identity.moves(r, t)
        assert {x["src"]: x["root"] for x in identity.extended_resolutions(r, moved).collect()} == want[0]
        branches: dict = {}
        for x in identity.extended_branches(r, b, moved, t).collect():
            branches.setdefault(x["original"], []).append(x["child"])
        assert {o: sorted(c) for o, c in branches.items()} == want[1]
        assert {x[0] for x in identity.extended_retired(g, t).collect()} == want[2]


def test_cycle_through_a_prior_resolution(spark):
    prior = frames(spark, ({"a": "b"}, {"x": ["y", "z"]}, {"a"}))
    t = spark.createDataFrame([(0, "succession", None, None, None, None, None, "b", "a", True, None), (1, "succession", None, None, None, None, None, "a", "c", True, None), (2, "split", None, None, "x", None, ["y"], None, None, None, None)], TRANSITION)
    got = {tuple(r) for r in identity.extension_violations(prior[0], prior[1], t).collect()}
    # a is given b before and c now; b goes to a, which stands at b
    assert got == {("a", 7, "two_resolutions"), ("b", 8, "cycle"), ("x", 6, "other_split")}


def test_projection_violations(spark):
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    historical, current = df([(x,) for x in "abcdefghijk"], "id string"), df([(x,) for x in "mnopij"], "id string")
    resolved = df([("a", "m"), ("b", None), ("z", "m"), ("c", "q"), ("i", "m"), ("d", "m"), ("e", "e"), ("f", "n")], "src string, root string")
    retired = df([(x,) for x in "abzcifejy"], "subject string")
    branches = df([("f", "m"), ("f", "n"), ("a", "n"), ("g", None), ("h", "h"), ("k", "m"), ("k", "m"), ("w", "m")], "original string, child string")
    got = {tuple(r) for r in identity.projection_violations(resolved, branches, retired, historical, current).collect()}
    assert got == {
        ("b", 1, "cycle"), ("z", 2, "not_historical"), ("c", 3, "target_not_current"), ("e", 3, "target_not_current"), ("i", 4, "source_current"), ("d", 5, "source_not_retired"), ("e", 6, "self"), ("z", 7, "retired_not_historical"), ("y", 7, "retired_not_historical"),
        ("i", 8, "retired_current"), ("j", 8, "retired_current"), ("w", 9, "original_not_historical"), ("g", 10, "no_children"), ("h", 11, "child_is_original"), ("k", 12, "repeated_child"), ("h", 13, "child_not_current"), ("a", 14, "continuation"),
    }
    clean = identity.projection_violations(df([("a", "m")], "src string, root string"), df([("a", "m"), ("a", "n")], "original string, child string"), df([("a",)], "subject string"), historical, current)
    assert clean.count() == 0


def test_live_parent(spark):
    keys = spark.createDataFrame([("k", "me", None)], "key_digest string, key_reference string, key_identity_digest string")
    matches = spark.createDataFrame([("k", "live", "p1", "other"), ("k", "live", "p2", "other"), ("k", "live", None, "other"), ("k", "merged_lineage", None, "other")], "key_digest string, kind string, parent_id string, target_reference string")
    for c in ("repository", "pull_request_number", "head_sha", "candidate_reference", "candidate_digest", "target_identity_digest"):
        matches = matches.withColumn(c, F.lit(None).cast("string"))
    who = {"kind": "detached", "candidate_reference": "c", "candidate_digest": "d"}
    assert [tuple(r) for r in identity.conflicts(keys, matches, who, "p1").collect()] == [("k", 2, False)]
    assert [tuple(r) for r in identity.conflict_violations(keys, matches, who, "p1").collect()] == [("k", 5, "other_parent")]
    assert identity.conflict_violations(keys, matches.where("parent_id is null"), who, None).count() == 0
    assert [r["n_matches"] for r in identity.conflicts(keys, matches, who).collect()] == [4]
