"""Mixing of sources by temperature, in Spark's own functions.

Source weights are the token shares raised to one exponent and normalised. The
exponent is the smallest one (that is, the flattest mixture) at which the
weights' entropy is at most the target and no source is repeated more often
than allowed; it is bisected on multiples of 2^-25, five halvings in one job.

A source's tokens are realised as whole epochs and one part of an epoch. In the
part, documents come in the order of a hash of their id; that order is cut into
blocks of about ``block_docs`` documents, whole blocks are taken while they fit
in the budget, and only the block in which the budget ends is looked into. So
the cut is one number per source, and texts never cross a shuffle.

Defined results: a null source is a source; tokens are words; null and blank
texts have none; a source without tokens has no weight, and its documents are
used once if every document is to be used, else never; repeated rows have equal
places and are all in or all out; if even exponent 1 exceeds the limits, it is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codequarry.llm.shared import free_name, shared_folder, written

BITS, BITS_PER_JOB = 25, 5
_WORD = r"[^\x20\x09-\x0D]+"
_KEYS = 1 << 40


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def place(id: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in the permutation of an epoch: 40 bits of a hash."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("bigint")


def exponent(totals: DataFrame, budget: float | None, balance: float, max_repeats: float) -> float:
    """Smallest exponent within the limits. ``totals`` has one row per source with ``tokens`` above 0."""
    whole = totals.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not whole.n:
        return 1.0
    shares = totals.select((F.col("tokens") / whole.t).alias("p"), "tokens")
    low, step = 0, 1 << BITS
    while step > 1:
        step >>= min(BITS_PER_JOB, step.bit_length() - 1)
        points = F.transform(F.sequence(F.lit(0), F.lit(1 << BITS_PER_JOB)), lambda i: (low + i * step) / F.lit(float(1 << BITS)))
        raised = shares.select("p", F.posexplode(points).alias("at", "a")).withColumn("r", F.pow("p", "a"))
        # H = ln S - sum(r ln r) / S with r = p^a and S = sum(r); repeats of a source are r / p in proportion.
        sums = raised.groupBy("at", "a").agg(
            F.sum("r").alias("s"), F.sum(F.col("r") * F.log("r")).alias("rl"),
            F.max(F.col("r") / F.col("p")).alias("most"), F.min(F.col("r") / F.col("p")).alias("least"),
        )
        entropy = F.log("s") - F.col("rl") / F.col("s")
        repeats = F.col("most") / (F.col("least") if budget is None else F.col("s") * (whole.t / budget))
        good = (entropy <= balance * F.log(F.lit(float(whole.n)))) & (repeats <= max_repeats)
        first = sums.where(good).agg(F.min("at").alias("at")).first().at
        if first == 0:
            return low / (1 << BITS)
        low += ((1 << BITS_PER_JOB) if first is None else first) * step - step
        low = min(low, (1 << BITS) - step)
    return (low + 1) / (1 << BITS)


def plan(
    docs: DataFrame, source: str = "source", id: str = "doc_id", text: str = "text", budget_share: float | None = 1.0,
    balance: float = 0.95, max_repeats: float = 4.0, seed: int = 17, block_docs: int = 4096,
) -> DataFrame:
    """One row per source: tokens, weight, whole epochs, and where its part of an epoch ends.

    ``budget_share`` is the budget over the tokens of all documents; None stands for
    the smallest budget that uses every document at least once. ``balance`` is the
    target entropy over that of equal weights.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = docs.select(F.col(source).alias("source"), F.col(id).alias("id"), n_words(F.col(text)).alias("tokens"))
    totals = written(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), folder, "totals")
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = None if budget_share is None else budget_share * all_tokens
    power = exponent(totals.where(F.col("tokens") > 0), budget, balance, max_repeats)
    share = F.col("tokens") / F.lit(float(max(all_tokens, 1)))
    flat = totals.withColumn("r", F.when(F.col("tokens") > 0, F.pow(share, F.lit(power))).otherwise(0.0))
    scale = flat.agg(F.sum("r").alias("s"), F.max(F.when(F.col("r") > 0, F.col("tokens") / F.col("r"))).alias("once")).first()
    weight = F.col("r") / F.lit(scale.s or 1.0)
    goal = F.floor(F.col("r") * F.lit(float(scale.once or 0.0)) if budget is None else weight * F.lit(float(budget)))
    if budget is None:
        goal = F.greatest(goal, F.col("tokens"))
    goals = flat.select(
        "source", "tokens", "docs", weight.alias("weight"), goal.cast("bigint").alias("goal"),
    ).select(
        "*", F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens"))).otherwise(int(budget is None))
        .cast("bigint").alias("whole"),
    ).select(
        "*", F.when(F.col("tokens") > 0, F.col("goal") - F.col("whole") * F.col("tokens")).otherwise(0).alias("rest"),
        F.ceil(F.col("docs") / block_docs).cast("bigint").alias("blocks"),
    )
    goals = written(goals, folder, "goals")
    placed = (
        rows.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
        .select("g.source", "whole", "rest", "blocks", "d.tokens", place(F.col("id"), F.col("whole"), seed).alias("place"))
        .withColumn("block", F.floor(F.col("place") * F.col("blocks") / F.lit(_KEYS)).cast("bigint"))
    )
    sums = placed.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("block"))
    # The first block that no longer fits, and what of the budget is left for it.
    crossing = written(
        sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        .groupBy("source").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")), "block").alias("c"))
        .select("source", "c.block", "c.left"), folder, "crossing",
    )
    inside = placed.alias("p").join(
        crossing.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.block") == F.col("c.block"))
    ).select("c.source", "c.left", "p.tokens", "p.place")
    taken = F.sum("tokens").over(Window.partitionBy("source").orderBy("place"))
    last = inside.withColumn("taken", taken).where(F.col("taken") <= F.col("left")).groupBy("source").agg(F.max("place").alias("last"))
    on_source = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    return written(
        goals.alias("g").join(crossing.alias("c"), on_source("g", "c"), "left").join(last.alias("l"), on_source("g", "l"), "left")
        .select(
            "g.source", "g.tokens", "weight", "whole", "goal", "blocks",
            # Places below the crossing block, or up to the last one that fits in it.
            F.coalesce(F.col("c.block"), F.col("blocks")).alias("cut_block"),
            F.coalesce(F.col("last"), F.lit(-1)).alias("cut_place"),
        ), folder, "plan",
    )


def with_copies(
    docs: DataFrame, name: str = "copy", source: str = "source", id: str = "doc_id", text: str = "text", seed: int = 17, **limits,
) -> DataFrame:
    """``docs`` repeated by the mixture, with a struct ``name``: epoch, place in its permutation, tokens, weight."""
    sources = plan(docs, source, id, text, seed=seed, **limits)
    keys = {f: free_name(docs.columns, f"plan_{f}") for f in ("source", "weight", "whole", "blocks", "cut_block", "cut_place")}
    joined = docs.join(
        sources.select(*(F.col(f).alias(k) for f, k in keys.items())), F.col(source).eqNullSafe(F.col(keys["source"]))
    )
    whole, at = F.col(keys["whole"]), place(F.col(id), F.col(keys["whole"]), seed)
    block = F.floor(at * F.col(keys["blocks"]) / F.lit(_KEYS))
    cut = F.col(keys["cut_block"])
    part = (block < cut) | ((block == cut) & (at <= F.col(keys["cut_place"])))
    epochs = whole + F.when(part, 1).otherwise(0)
    epoch = free_name(docs.columns, "epoch")
    return (
        joined.withColumn(epoch, F.explode(F.when(epochs > 0, F.sequence(F.lit(0).cast("bigint"), epochs - 1))))
        .withColumn(name, F.struct(
            F.col(epoch).alias("epoch"), place(F.col(id), F.col(epoch), seed).alias("place"),
            n_words(F.col(text)).alias("n_tokens"), F.col(keys["weight"]).alias("weight")))
        .select(*docs.columns, name)
    )


def mixed(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` repeated by the mixture, without further columns."""
    name = free_name(docs.columns, "copy")
    return with_copies(docs, name, **limits).drop(name)


def mixture(docs: DataFrame, **limits) -> DataFrame:
    """One row per copy: doc_id, source, epoch, place, n_tokens, weight. Order by epoch and place to train."""
    return with_copies(docs.select("doc_id", "source", "text"), "copy", **limits).select(
        "doc_id", "source", "copy.epoch", "copy.place", "copy.n_tokens", "copy.weight")
