"""Mixing sources to target weights, in DataFrame operations only.

Source shares of tokens are raised to an exponent in [0, 1] and normalised (1 keeps the natural mixture, 0 makes
sources equal). The exponent is bisected until the entropy meets a target, or no source is read more often
than a repetition limit. The weights are then realised under a token budget: every source is split into blocks
of about `block_tokens`, each epoch is another permutation of the blocks and of the rows in them, whole
blocks are taken while they fit a source's share of the budget, and the last block is cut within.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

#: Most sources whose totals are brought to the driver; above it every bisection step is an aggregation.
MOST_SOURCES = 100_000
STEPS = 60


@dataclass
class Mixture:
    exponent: float
    entropy: float
    budget: float
    scale: float  # tokens of source s in the mixture: scale * total_s ** exponent


def token_count(text: Column) -> Column:
    """Words, as an SQL expression: the unit of the budget where no other count is given."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def _figures(totals: DataFrame):
    """exponent -> (log of the sum of powers, entropy); and the number of sources, largest and smallest log total."""
    logs = totals.where("total > 0").select(F.log("total").alias("x"))
    n, top, low = logs.agg(F.count("*"), F.max("x"), F.min("x")).first()
    if n and n <= MOST_SOURCES:
        rows = sorted(r["x"] for r in logs.collect())

        def at(a: float) -> tuple[float, float]:
            m = a * top
            s = math.fsum(math.exp(a * x - m) for x in rows)
            mean = math.fsum(math.exp(a * x - m) * a * x for x in rows) / s
            return m + math.log(s), m + math.log(s) - mean
    else:

        def at(a: float) -> tuple[float, float]:
            e = F.exp(F.lit(a) * F.col("x") - F.lit(a * top))
            s, k = logs.agg(F.sum(e), F.sum(e * F.lit(a) * F.col("x"))).first()
            return a * top + math.log(s), a * top + math.log(s) - k / s

    return at, n, top, low


def mixture(totals: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repetition: float | None = None) -> Mixture:
    """Solve for the exponent over `totals` (source, total).

    Without a budget, the budget is the smallest at which every source is read once in full. The exponent is the
    largest that reaches `target_entropy` (in nats; the even mixture if it is out of reach), then raised as far as
    `max_repetition` needs. A fixed budget above `max_repetition` times all tokens cannot be met: ValueError.
    """
    at, n, top, low = _figures(totals)
    if not n:
        return Mixture(1.0, 0.0, 0.0, 0.0)

    def budget_log(a: float) -> float:
        # the source with the largest total has the smallest weight for its size
        return math.log(budget) if budget else at(a)[0] + (1 - a) * top

    def repetition(a: float) -> float:
        return math.exp(budget_log(a) - at(a)[0] + (a - 1) * low)

    def bisect(good_at_one, lo: float = 0.0) -> float:
        """The smallest exponent in [lo, 1] for which the condition holds, given that it holds at 1."""
        if good_at_one(lo):
            return lo
        hi = 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if good_at_one(mid) else (mid, hi)
        return hi

    a = 0.0 if max_repetition is not None and target_entropy is None else 1.0
    if target_entropy is not None and at(1.0)[1] < target_entropy:
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if at(mid)[1] >= target_entropy else (lo, mid)
        a = lo
    if max_repetition is not None:
        if repetition(1.0) > max_repetition * (1 + 1e-9):
            raise ValueError("the budget exceeds the repetition limit for any mixture")
        a = bisect(lambda x: repetition(x) <= max_repetition * (1 + 1e-9), a)
    return Mixture(a, at(a)[1], math.exp(budget_log(a)), math.exp(budget_log(a) - at(a)[0]))


def mix(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    budget: int | None = None,
    target_entropy: float | None = None,
    max_repetition: float | None = 2.0,
    block_tokens: int = 50_000,
    seed: int = 0,
) -> DataFrame:
    """`docs`, each row once for each epoch in which it is read, with the columns epoch, block, place and n_tokens.

    (source, epoch, block_rank, place) orders the mixture of a source. Within a source the rows taken have just under its share of the
    budget: whole blocks in permuted order, then rows of the next block while they fit. A null source is a source of its own. Rows without
    tokens (null or empty text) belong to no share; they are kept once, in epoch 0. Repeated rows are rows. Clashing
    column names get a trailing underscore. Without any tokens, every row comes once. An empty table gives no rows.
    """
    new = {}
    for c in ("epoch", "block", "block_rank", "place", "n_tokens"):
        new[c] = c
        while new[c] in docs.columns:
            new[c] += "_"
    s, src, key = F.lit(str(seed)), F.col(source_col).cast("string"), F.col(id_col).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), src.alias("s"), F.coalesce(key, F.sha2(F.col(text_col).cast("string"), 256), F.lit("")).alias("k"), (token_count(F.col(text_col).cast("string")) if tokens is None else tokens).alias("n"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    light = materialize(rows.select("s", "k", "n"), "mixing-counts")
    totals = light.groupBy("s").agg(F.sum("n").alias("total"))
    solved = mixture(totals, budget, target_entropy, max_repetition)
    share = totals.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens))).withColumn(
        "want", F.when(F.col("total") > 0, F.lit(solved.scale) * F.pow("total", F.lit(solved.exponent))).otherwise(0.0)
    )
    share = share.withColumn("want", F.when(F.abs(F.col("want") - F.col("total")) <= F.greatest(F.lit(0.5), F.col("total") * 1e-9), F.col("total").cast("double")).otherwise(F.col("want")))
    share = share.withColumn("epochs", F.greatest(F.lit(1), F.ceil(F.col("want") / F.greatest("total", F.lit(1))))).select(F.col("s").alias("of"), "total", "blocks", "want", "epochs")
    if totals.count() <= MOST_SOURCES:
        share = F.broadcast(share)

    def placed(df: DataFrame) -> DataFrame:
        return df.join(share, F.col("s").eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod(F.xxhash64(s, "k"), F.col("blocks")))

    blocks = placed(light).groupBy("s", "block").agg(F.sum("n").alias("size"), F.first("want").alias("want"), F.first("epochs").alias("epochs"), F.first("total").alias("total"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("rank_key", F.xxhash64(s, "epoch", "s", "block"))
    # a window over the blocks of one epoch: one row for each `block_tokens` tokens of a source
    in_epoch = Window.partitionBy("s", "epoch").orderBy("rank_key", "block")
    blocks = blocks.withColumn("before", F.col("epoch") * F.col("total") + F.sum("size").over(in_epoch) - F.col("size")).withColumn("rank", F.row_number().over(in_epoch))
    blocks = blocks.withColumn("room", F.col("want") - F.col("before"))
    taken = blocks.where("room > 0 or epoch = 0").select(F.col("s").alias("of"), F.col("block").alias("part"), "epoch", "rank", "room", "size")
    laid = placed(rows).drop("total", "blocks", "want", "epochs")
    out = laid.join(taken, F.col("s").eqNullSafe(F.col("of")) & (F.col("block") == F.col("part"))).drop("of", "part")
    # rows of one id lie apart by their texts
    out = out.withColumn("order", F.xxhash64(s, "epoch", "k", "h"))
    # whole blocks pass; only the rows of a cut block are ordered and summed, and a block is bounded
    whole = out.where("size <= room").withColumn("sum", F.lit(0).cast("long"))
    cut = out.where("size > room").withColumn("sum", F.sum("n").over(Window.partitionBy("s", "block", "epoch").orderBy("order", "k").rowsBetween(Window.unboundedPreceding, 0)))
    kept = whole.unionByName(cut.where("sum <= room or epoch = 0 and n = 0")).where("n > 0 or epoch = 0")
    return kept.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns],
        F.col("epoch").cast("int").alias(new["epoch"]),
        F.col("block").cast("long").alias(new["block"]),
        F.col("rank").cast("int").alias(new["block_rank"]),
        F.col("order").alias(new["place"]),
        F.col("n").alias(new["n_tokens"]),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "epoch", "block", "block_rank", "place", "n_tokens")
