"""Identity resolution, conflicts and typed references as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealwright.functions.values import DIGEST, IDENTIFIER
from sealwright.session import written


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(src, root, steps) of a resolution map (src, dst), by pointer jumping; root is null on or behind a cycle.

    Each round doubles the distance jumped, so depth costs its logarithm.
    """
    now = edges.select("src", F.col("dst").alias("to"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open"))
    now = written(now, "identity")
    left = now.count()
    for _ in range(rounds):
        there = now.select(F.col("src").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("open").alias("there_open"))
        moved = now.where("open").join(there, "to", "left").select("src", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("there_open", F.lit(False)).alias("open"))
        now = written(moved.unionByName(now.where("not open")), "identity")
        still = now.where("open").count()
        if still == 0 or still == left:
            break
        left = still
    return now.select("src", F.when(~F.col("open"), F.col("to")).alias("root"), F.when(~F.col("open"), F.col("steps")).alias("steps"))


def ambiguous(edges: DataFrame) -> DataFrame:
    """Sources that resolve to more than one subject."""
    return edges.groupBy("src").agg(F.countDistinct("dst").alias("n")).where("n > 1").select("src")


def closure_violations(resolved: DataFrame, historical: DataFrame, current: DataFrame) -> DataFrame:
    """(src, check_ordinal, code): a source must be historical, its root current, and there must be no cycle."""
    cyclic = resolved.where("root is null").select("src", F.lit(1).alias("check_ordinal"), F.lit("cycle").alias("code"))
    unknown = resolved.join(historical.select(F.col("id").alias("src")), "src", "left_anti").select("src", F.lit(2), F.lit("not_historical"))
    stale = resolved.where("root is not null").join(current.select(F.col("id").alias("root")), "root", "left_anti").select("src", F.lit(3), F.lit("not_current"))
    return cyclic.union(unknown).union(stale)


#: Says that matches carry no live parent.
UNREAD = object()


def conflict_verdict(candidate: dict, live_parent: str | None | object = UNREAD) -> Column:
    """hold, hold_changed, skip or an error for one match (columns kind, repository, pull_request_number, head_sha, candidate_reference,
    candidate_digest, target_reference, target_identity_digest) joined to its key (key_reference, key_identity_digest).

    `candidate` has kind and, by kind, repository, pull_request_number, head_sha, or candidate_reference, candidate_digest. With `live_parent`, a digest or null, the
    column parent_id of a live match must be the same: it was read at another published state otherwise.
    """
    kind = F.col("kind")
    own = kind.isin("live", "merged_lineage") & (F.col("target_reference") == F.col("key_reference"))
    changed = F.col("key_identity_digest").isNotNull() & ~F.col("target_identity_digest").eqNullSafe(F.col("key_identity_digest"))
    rules: list[tuple[Column, str]] = [(F.col("key_reference").isNull(), "error_unknown_key")]
    if live_parent is not UNREAD:
        rules.append(((kind == "live") & ~F.col("parent_id").eqNullSafe(F.lit(live_parent)), "error_other_parent"))
    if candidate["kind"] == "pull_request":
        same = F.col("repository") == candidate["repository"]
        number = F.col("pull_request_number")
        mine = number == candidate["pull_request_number"]
        opened = (kind == "open_pull_request") & same
        rules += [(opened & mine & (F.col("head_sha") != candidate["head_sha"]), "error_other_head"), (opened & mine, "skip"), (opened & (number > candidate["pull_request_number"]), "skip"), ((kind == "pending_submission") & same & mine, "skip")]
    else:
        mine = (kind == "pending_submission") & (F.col("candidate_reference") == candidate["candidate_reference"])
        rules += [(mine & (F.col("candidate_digest") != candidate["candidate_digest"]), "error_other_candidate"), (mine, "skip")]
    rules += [(own & changed, "hold_changed"), (own, "skip")]
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for test, verdict in rules[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), verdict)
    return out.otherwise("hold")


def conflicts(keys: DataFrame, matches: DataFrame, candidate: dict, live_parent: str | None | object = UNREAD) -> DataFrame:
    """(key_digest, n_matches, identity_changed) of the keys with a held match. keys: key_digest, key_reference, key_identity_digest."""
    judged = matches.join(keys, "key_digest", "left").withColumn("verdict", conflict_verdict(candidate, live_parent))
    held = judged.where(F.col("verdict").isin("hold", "hold_changed"))
    return held.groupBy("key_digest").agg(F.count("*").alias("n_matches"), F.bool_or(F.col("verdict") == "hold_changed").alias("identity_changed"))


def conflict_violations(keys: DataFrame, matches: DataFrame, candidate: dict, live_parent: str | None | object = UNREAD) -> DataFrame:
    """(key_digest, check_ordinal, code): keys given twice, and matches that contradict the candidate, belong to no key or were read at another live parent.

    `conflicts` is meaningful only where this is empty.
    """
    twice = keys.groupBy("key_digest").agg(F.count("*").alias("n")).where("n > 1").select("key_digest", F.lit(1).alias("check_ordinal"), F.lit("repeated_key").alias("code"))
    judged = matches.join(keys, "key_digest", "left").withColumn("code", conflict_verdict(candidate, live_parent)).where(F.col("code").startswith("error_"))
    ordinal = F.when(F.col("code") == "error_unknown_key", 2).when(F.col("code") == "error_other_head", 3).when(F.col("code") == "error_other_parent", 5).otherwise(4)
    return twice.union(judged.select("key_digest", ordinal.alias("check_ordinal"), F.substring("code", 7, 99).alias("code")).distinct())


def _identity_rules() -> list[tuple[str, Column]]:
    return [("instance_id", F.col("instance_id").rlike(IDENTIFIER)), ("kind", F.col("kind").rlike(IDENTIFIER)), ("id", F.col("id").rlike(IDENTIFIER) | F.col("id").rlike(DIGEST))]


def _broken(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules]))


def reference_issues(visibilities: list[str]) -> Column:
    """The broken rules of a reference (columns as in `resolved_references`), whatever it points at; `visibilities` are the known scopes."""
    allowed, exact = F.col("allowed_visibility"), F.col("mode") == "exact_revision"
    return _broken(
        [
            *_identity_rules(),
            ("semantics", F.col("required").isNotNull() & F.col("same_subject").isNotNull()),
            ("visibility", (F.size(allowed) > 0) & (F.size(F.array_distinct(allowed)) == F.size(allowed)) & F.forall(allowed, lambda v: v.isin(*visibilities))),
            ("binding", (F.col("mode") == "current") | (exact & F.col("revision_digest").rlike(DIGEST))),
        ]
    )


def current_record_issues() -> Column:
    """The broken rules of a current record: instance_id, kind, id, subject_id, revision (a digest)."""
    return _broken([*_identity_rules(), ("subject_id", F.col("subject_id").rlike(IDENTIFIER)), ("revision", F.col("revision").rlike(DIGEST))])


def resolved_references(references: DataFrame, targets: DataFrame) -> DataFrame:
    """`references` with status, by the first rule that fails.

    references: source_instance, source_subject, instance_id, kind, id, mode, revision_digest, required, allowed_visibility, same_subject.
    targets: instance_id, kind, id, subject_id, revision, visibility; one row each.
    """
    t = targets.select("instance_id", "kind", "id", "subject_id", "revision", "visibility", F.lit(True).alias("found"))
    out = references.join(t, ["instance_id", "kind", "id"], "left")
    status = (
        F.when(F.col("instance_id") != F.col("source_instance"), "other_instance")
        .when(F.col("found").isNull() & F.col("required"), "missing_required")
        .when(F.col("found").isNull(), "missing_optional")
        .when(~F.array_contains("allowed_visibility", F.col("visibility")), "visibility")
        .when(F.col("same_subject") & (F.col("subject_id") != F.col("source_subject")), "other_subject")
        .when((F.col("mode") == "exact_revision") & ~F.col("revision").eqNullSafe(F.col("revision_digest")), "revision")
        .otherwise("resolved")
    )
    return out.withColumn("status", status).drop("found")


def to_revalidate(references: DataFrame, changed: DataFrame) -> DataFrame:
    """References whose target is among `changed` (instance_id, kind, id, current_revision; null: gone) and must be resolved again."""
    joined = references.join(changed, ["instance_id", "kind", "id"])
    missing = F.col("prior_status") == "missing_optional"
    return joined.where((missing & F.col("current_revision").isNotNull()) | (~missing & ((F.col("mode") == "current") | ~F.col("current_revision").eqNullSafe(F.col("revision_digest")))))


def dependency_key(spark: SparkSession) -> Column:
    """Digest of a target's identity (ASCII identifiers)."""
    from sealwright.functions.values import json_string, sha256

    return sha256(F.concat(F.lit('{"id":'), json_string(F.col("id"), True), F.lit(',"instanceId":'), json_string(F.col("instance_id"), True), F.lit(',"kind":'), json_string(F.col("kind"), True), F.lit("}")))


def transition_edges(transitions: DataFrame) -> DataFrame:
    """(src, dst) of merges, of splits that go on as one of their new subjects, and of successions.

    transitions: ord, kind, surviving, retired (array), original, continuing, new (array), predecessor, successor, predecessor_retires, subject.
    """
    merged = transitions.where("kind = 'merge'").select(F.explode("retired").alias("src"), F.col("surviving").alias("dst"))
    went_on = transitions.where("kind = 'split' and continuing is not null and continuing <> original").select(F.col("original").alias("src"), F.col("continuing").alias("dst"))
    succeeded = transitions.where("kind = 'succession' and predecessor_retires").select(F.col("predecessor").alias("src"), F.col("successor").alias("dst"))
    return merged.union(went_on).union(succeeded)


def resolutions(transitions: DataFrame) -> DataFrame:
    """(src, root, steps) after all transitions: as sets, since the end of a chain does not depend on the order in which its links were made.

    `transition_violations` gives what an ordered reading would refuse, second resolutions and cycles among it.
    """
    return closure(transition_edges(transitions).groupBy("src").agg(F.min("dst").alias("dst")))


def split_branches(transitions: DataFrame) -> DataFrame:
    """(original, child): the new subjects of each split, resolved to their present identity."""
    parts = transitions.where("kind = 'split'").select("original", F.explode("new").alias("child")).distinct()
    now = resolutions(transitions).where("root is not null").select(F.col("src").alias("child"), "root")
    return parts.join(now, "child", "left").select("original", F.coalesce("root", "child").alias("child")).distinct()


def retired_subjects(transitions: DataFrame) -> DataFrame:
    """(subject): retired, merged away, succeeded, or split without going on under its own name."""
    gone = transitions.where("kind = 'retirement'").select("subject")
    split = transitions.where("kind = 'split' and (continuing is null or continuing <> original)").select(F.col("original").alias("subject"))
    return gone.union(split).union(transition_edges(transitions).select("src")).distinct()


def transition_violations(transitions: DataFrame) -> DataFrame:
    """(subject, check_ordinal, code) of everything that a reading of the transitions in order refuses.

    1 not_distinct: an empty or repeating list of merged or new subjects. 2 self_merge, 3 self_split, 4 self_succession. 5 not_new: a split goes on as a
    subject that is neither its original nor new. 6 other_split: two splits of one subject differ. 7 two_resolutions. 8 cycle, on it or behind it. 9 grammar of a subject's name.
    """
    t = transitions
    same = lambda c: F.coalesce(F.size(F.array_distinct(c)) != F.size(c), F.lit(True)) | (F.size(c) < 1)

    def of(rows: DataFrame, subject: str, ordinal: int, code: str) -> DataFrame:
        return rows.select(F.col(subject).alias("subject"), F.lit(ordinal).alias("check_ordinal"), F.lit(code).alias("code"))

    splits = t.where("kind = 'split'")
    other = splits.groupBy("original").agg(F.countDistinct(F.array_sort("new")).alias("n")).where("n > 1")
    out = of(t.where("kind = 'merge'").where(same(F.col("retired"))), "surviving", 1, "not_distinct")
    out = out.union(of(splits.where(same(F.col("new"))), "original", 1, "not_distinct"))
    out = out.union(of(t.where("kind = 'merge' and array_contains(retired, surviving)"), "surviving", 2, "self_merge"))
    out = out.union(of(splits.where("array_contains(new, original)"), "original", 3, "self_split"))
    out = out.union(of(t.where("kind = 'succession' and predecessor = successor"), "predecessor", 4, "self_succession"))
    out = out.union(of(splits.where("continuing <> original and not coalesce(array_contains(new, continuing), false)"), "original", 5, "not_new"))
    out = out.union(of(other, "original", 6, "other_split"))
    out = out.union(of(ambiguous(transition_edges(t)), "src", 7, "two_resolutions"))
    lists = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("retired", "new")])
    named = t.select(F.explode(F.array_compact(F.concat(F.array("surviving", "original", "continuing", "predecessor", "successor", "subject"), lists))).alias("s"))
    out = out.union(of(named.where(~F.col("s").rlike(IDENTIFIER)), "s", 9, "grammar"))
    return out.union(of(resolutions(t).where("root is null"), "src", 8, "cycle")).distinct()


# -- a projection of identities that goes on from a prior one -----------------------------------------------------------


def _last(subjects: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """`subjects` with `column` replaced by its root among `moves` (src, root), where it has one."""
    return subjects.join(moves.select(F.col("src").alias(column), "root"), column, "left").withColumn(column, F.coalesce("root", column)).drop("root")


def moves(prior: DataFrame, transitions: DataFrame) -> DataFrame:
    """(src, root) of the new edges alone, on top of the flat resolutions `prior` (src, root); root is null on or behind a cycle. Written.

    A new edge's target is first taken to where it stands now. After that no target is a source of `prior`, so the rounds of the closure run over the new
    edges, however large `prior` is; it is looked up once.
    """
    edges = transition_edges(transitions).groupBy("src").agg(F.min("dst").alias("dst"))
    return written(closure(_last(edges, "dst", prior)).select("src", "root"), "identity-moves")


def extended_resolutions(prior: DataFrame, moved: DataFrame) -> DataFrame:
    """(src, root) of all subjects that resolve: prior ones whose root has moved on, and the new ones (`moved`, as `moves` gives them).

    Each prior row is looked up by its root in the new edges; those with another root stay as they are.
    """
    ahead = prior.join(moved.select(F.col("src").alias("root"), F.col("root").alias("next"), F.lit(True).alias("hit")), "root", "left")
    went = ahead.select("src", F.when(F.col("hit"), F.col("next")).otherwise(F.col("root")).alias("root"))
    return went.unionByName(moved.join(prior.select("src"), "src", "left_anti"))


def extended_branches(prior: DataFrame, prior_branches: DataFrame, moved: DataFrame, transitions: DataFrame) -> DataFrame:
    """(original, child) of all splits, children at their present identity. `prior_branches` has those of the prior projection."""
    new = transitions.where("kind = 'split'").select("original", F.explode("new").alias("child")).distinct()
    solid = moved.where("root is not null")
    return _last(prior_branches.select("original", "child").unionByName(_last(new, "child", prior)), "child", solid).select("original", "child").distinct()


def extended_retired(prior_retired: DataFrame, transitions: DataFrame) -> DataFrame:
    """(subject): retired before or by the transitions."""
    return prior_retired.select("subject").union(retired_subjects(transitions)).distinct()


def extension_violations(prior: DataFrame, prior_branches: DataFrame, transitions: DataFrame) -> DataFrame:
    """(subject, check_ordinal, code): what `transition_violations` gives of the transitions alone, and what they contradict in the prior projection.

    7 two_resolutions: a prior source gets another target. 8 cycle, through prior resolutions too. 6 other_split: a prior split gets other children.
    """
    own = transition_violations(transitions)
    edges = transition_edges(transitions).distinct()
    twice = edges.join(prior, "src").where("dst <> root").select(F.col("src").alias("subject"), F.lit(7).alias("check_ordinal"), F.lit("two_resolutions").alias("code"))
    cycle = moves(prior, transitions).where("root is null").select(F.col("src").alias("subject"), F.lit(8).alias("check_ordinal"), F.lit("cycle").alias("code"))
    was = prior_branches.groupBy("original").agg(F.array_sort(F.collect_set("child")).alias("was"))
    new = transitions.where("kind = 'split'").select("original", F.array_sort("new").alias("new"))
    other = new.join(was, "original").where("not new <=> was").select(F.col("original").alias("subject"), F.lit(6).alias("check_ordinal"), F.lit("other_split").alias("code"))
    return own.union(twice).union(cycle).union(other).distinct()


def projection_violations(resolved: DataFrame, branches: DataFrame, retired: DataFrame, historical: DataFrame, current: DataFrame) -> DataFrame:
    """(subject, check_ordinal, code) of a projection that is not closed over history and the current subjects (each `id`, without repeats).

    Of resolutions (src, root): 1 cycle, 2 not_historical, 3 target_not_current, 4 source_current, 5 source_not_retired, 6 self. Of retired subjects: 7 retired_not_historical,
    8 retired_current. Of splits (original, child): 9 original_not_historical, 10 no_children (a null child and no other), 11 child_is_original, 12 repeated_child, 13 child_not_current,
    14 continuation: the original resolves to none of its children. Every rule is a semi or anti join on a subject.
    """

    def of(rows: DataFrame, subject: str, ordinal: int, code: str) -> DataFrame:
        return rows.select(F.col(subject).alias("subject"), F.lit(ordinal).alias("check_ordinal"), F.lit(code).alias("code"))

    def known(rows: DataFrame, column: str, among: DataFrame, how: str) -> DataFrame:
        return rows.join(among.select(F.col(among.columns[0]).alias(column)), column, how)

    ended = resolved.where("root is not null")
    children = branches.where("child is not null")
    whole = branches.groupBy("original").agg(F.count("child").alias("n"), F.countDistinct("child").alias("d"))
    held = children.select("original", F.col("child").alias("root")).distinct()
    went = ended.select(F.col("src").alias("original"), "root").join(branches.select("original").distinct(), "original", "left_semi")
    gone = retired.select("subject").distinct()
    parts = [
        of(resolved.where("root is null"), "src", 1, "cycle"),
        of(known(resolved, "src", historical, "left_anti"), "src", 2, "not_historical"),
        of(known(ended, "root", current, "left_anti"), "src", 3, "target_not_current"),
        of(known(resolved, "src", current, "left_semi"), "src", 4, "source_current"),
        of(known(resolved, "src", gone, "left_anti"), "src", 5, "source_not_retired"),
        of(ended.where("src = root"), "src", 6, "self"),
        of(known(gone, "subject", historical, "left_anti"), "subject", 7, "retired_not_historical"),
        of(known(gone, "subject", current, "left_semi"), "subject", 8, "retired_current"),
        of(known(whole, "original", historical, "left_anti"), "original", 9, "original_not_historical"),
        of(whole.where("n = 0"), "original", 10, "no_children"),
        of(children.where("child = original"), "original", 11, "child_is_original"),
        of(whole.where("n > d"), "original", 12, "repeated_child"),
        of(known(children, "child", current, "left_anti"), "original", 13, "child_not_current"),
        of(went.join(held, ["original", "root"], "left_anti"), "original", 14, "continuation"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()
