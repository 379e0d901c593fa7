"""Mixing sources to target weights: bounded iterative proportional fitting, then calibrated sampling.

Documents fall into cells (source, language, topic) with a token total each. The weights of cells
are raked in turn to the target share of each source, language and topic. A cell cannot give more
than all its tokens: the share it cannot take goes to the uncut cells of its level at once, so
that the marginals are those of the sample and not of weights that are cut later. A document of cell c is
kept with its weight's part of the cell, decided by a hash of its id.

Without repeats a level gives at most its own tokens, so targets limit the sample's size: it is the largest at
which all of them can be met, and at most KEEP_SHARE of all tokens. A caller's `keep_share` fixes the size
instead; a level whose target is more than it holds at that size is then kept whole, and the rest of its share
goes to the others in proportion. All of it is aggregation over cells, which are pre-aggregated before any
shuffle; nothing is collected but the least ratio of own to target share and the largest error of a marginal.

A null source, language or topic is a level of its own. Null or empty texts count as one token, so that
they can be sampled. Repeated rows share their id's decision. An empty table gives an empty
result. Columns of the input are kept; internal names are prefixed so that none clash.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DIMENSIONS = ("source", "lang", "topic")
#: A marginal's target share is proportional to its token total to this power: 1 keeps the mix, 0 evens it out.
TEMPER = 0.7
#: Raking ends when each level is this near its target, as a part of it, or after ROUNDS rounds; the error is taken every CHECK rounds.
TOLERANCE, ROUNDS, CHECK = 2e-3, 12, 3
KEEP_SHARE = 0.8
#: If marginals are not met, samples smaller by SHRINK are tried, and as the last of TRIES the largest at which no raked cell is cut.
SHRINK, TRIES = 0.7, 3
SEED = 11
_PRE = "__rake_"


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of the text."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(F.lower(t), F.lit("licens")), "licence")
        .when(F.length(t) < 400, "note")
        .when(F.length(t) >= 20000, "long")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    return F.greatest(F.size(F.split(F.trim(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+")), F.lit(1)).cast("double")


def tempered(cells: DataFrame, dimension: str, temper: float = TEMPER) -> DataFrame:
    """Target share of each level: its token total to the power `temper`, over the sum of these."""
    level = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(temper)).alias("want"))
    total = level.agg(F.sum("want").alias("all_want"))
    return level.crossJoin(F.broadcast(total)).select(dimension, (F.col("want") / F.col("all_want")).alias("share"))  # one row


def _factor(group: str, want: Column | str, bound: str, *ties: str) -> Column:
    """The factor f at which sum(min(bound, f * weight)) over a group is `want`.

    That sum is the least of T + f * Y over all ways to cut the first cells by bound / weight, T being
    their bounds and Y the other cells' weights: f is the largest of (want - T) / Y.
    """
    near = F.coalesce(F.col(bound) / F.when(F.col("weight") > 0, F.col("weight")), F.lit(float("inf")))
    part = Window.partitionBy(group)
    before = part.orderBy(near, *ties).rowsBetween(Window.unboundedPreceding, -1)
    onward = part.orderBy(near.desc(), *[F.desc(t) for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
    cut, free = F.coalesce(F.sum(bound).over(before), F.lit(0.0)), F.sum("weight").over(onward)
    want = F.col(want) if isinstance(want, str) else want
    return (want - cut) / F.when(free > 0, free)


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, size: float | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: shares that fit every target marginal.

    targets: for each dimension (level, share). A level without a target keeps its weight; one
    with a target but no cell can't be met, and the others are scaled to it by the next marginal.
    No weight exceeds the cell's share of a sample of `size` of all tokens, if that is given.
    """
    return raked(cells, targets, rounds, size)[0]


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, size: float | None = None) -> tuple[DataFrame, float]:
    """What rake returns, and the worst error as last taken."""
    error = float("inf")
    total = cells.agg(F.sum("tokens").alias("all_tokens"))
    own = F.col("tokens") / F.col("all_tokens")
    bound = F.lit(float("inf")) if size is None else own / F.lit(size)
    now = cells.crossJoin(F.broadcast(total)).withColumns({"weight": own, "bound": bound}).drop("all_tokens")
    for d, want in targets.items():
        want = want.select(F.col(d).alias("level"), F.col("share").alias(f"want_{d}"))
        now = now.join(F.broadcast(want), now[d].eqNullSafe(want["level"]), "left").drop("level")
    for r in range(rounds):
        for d in targets:
            now = now.withColumn("f", _factor(d, f"want_{d}", "bound", *DIMENSIONS))
            now = now.withColumn("weight", F.col("weight") * F.coalesce(F.max("f").over(Window.partitionBy(d)), F.lit(1.0))).drop("f")
        now = materialize(now, "rake")
        if r % CHECK == CHECK - 1 or r == rounds - 1:
            error = worst_error(now.withColumn("weight", F.least("weight", "bound")), targets)
            if error <= TOLERANCE:
                break
    return now.select(*cells.columns, F.least("weight", "bound").alias("weight")), error


def shares_of(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """(dimension, level, own, share): own and target share of each level that has cells; one without a target wants its own share."""
    total = cells.agg(F.sum("tokens").alias("all_tokens"))
    out = None
    for d, want in targets.items():
        level = cells.groupBy(F.col(d).alias("level")).agg(F.sum("tokens").alias("tokens")).crossJoin(F.broadcast(total))
        want = want.select(F.col(d).alias("wanted"), F.col("share").alias("raw"))
        own = F.col("tokens") / F.col("all_tokens")
        found = level.join(want, level["level"].eqNullSafe(want["wanted"]), "left").select(F.lit(d).alias("dimension"), "level", own.alias("own"), F.coalesce("raw", own).alias("raw"))
        out = found if out is None else out.unionByName(found)
    share = F.col("raw") / F.sum("raw").over(Window.partitionBy("dimension"))
    return out.select("dimension", "level", "own", share.alias("share"))


def worst_error(fitted: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest error of a level's weight, as a part of its target. fitted: cells with weight and, for each dimension d of targets, want_d.

    All dimensions are summed in one aggregation: the driver plans it for each try again and again.
    """
    dims = list(targets)
    levels = fitted.groupingSets([[F.col(d)] for d in dims], *dims)
    sums = levels.agg(F.sum("weight").alias("have"), *[F.grouping(d).alias(f"not_{d}") for d in dims], *[F.max(f"want_{d}").alias(f"want_{d}") for d in dims])
    want = F.coalesce(*[F.when(F.col(f"not_{d}") == 0, F.col(f"want_{d}")) for d in dims])
    return sums.agg(F.max(F.abs(F.col("have") / F.when(want > 0, want) - 1))).first()[0] or 0.0


def calibrated(docs: DataFrame, keep_share: float | None = None, temper: float = TEMPER, seed: int = SEED, topic: Column | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """docs (doc_id, text, source, lang, ...) with __rake_topic, __rake_p (the probability of its cell) and __rake_kept.

    targets: (level, share) by dimension, with columns named as the dimension and `share`; a dimension without any has tempered ones.
    """
    topic = topic_of(F.col("text")) if topic is None else topic
    named = {f"{_PRE}source": F.col("source"), f"{_PRE}lang": F.col("lang"), f"{_PRE}topic": topic}
    tagged = docs.withColumns(named)
    cells = tagged.groupBy(*named).agg(F.sum(tokens_of(F.col("text"))).alias("tokens"))
    cells = materialize(cells.toDF(*DIMENSIONS, "tokens"), "cells")
    wanted = {d: (targets or {}).get(d) or tempered(cells, d, temper) for d in DIMENSIONS}
    shares = materialize(shares_of(cells, wanted), "shares")
    limit = shares.agg(F.min(F.col("own") / F.when(F.col("share") > 0, F.col("share")))).first()[0]
    size = keep_share or min(KEEP_SHARE, limit or 1.0)
    for n in range(TRIES):
        if n == TRIES - 1:  # weights without bounds tell a size at which none is needed
            free = rake(cells, fits).crossJoin(F.broadcast(cells.agg(F.sum("tokens").alias("all_tokens"))))
            size = min(size, free.agg(F.min(F.col("tokens") / F.col("all_tokens") / F.when(F.col("weight") > 0, F.col("weight")))).first()[0] or size)
        room = shares.withColumns({"weight": F.col("share"), "bound": F.col("own") / F.lit(size)}).withColumn("f", _factor("dimension", F.lit(1.0), "bound", "level"))
        room = materialize(room.withColumn("share", F.least("bound", F.col("share") * F.max("f").over(Window.partitionBy("dimension")))), "shares")
        fits = {d: room.where(F.col("dimension") == d).select(F.col("level").alias(d), "share") for d in DIMENSIONS}
        fitted, error = raked(cells, fits, size=size)
        if error <= TOLERANCE or keep_share:
            break
        size *= SHRINK if n < TRIES - 2 else 1
    if error > TOLERANCE:
        warnings.warn(f"raking: a level misses its target by {error:.3f} of it; no sample of {size:.3f} of the tokens met them all", stacklevel=2)
    rate = fitted.crossJoin(F.broadcast(cells.agg(F.sum("tokens").alias("all_tokens"))))
    rate = rate.select(*[F.col(d).alias(f"{_PRE}c_{d}") for d in DIMENSIONS], F.least(F.lit(1.0), F.lit(size) * F.col("all_tokens") * F.col("weight") / F.col("tokens")).alias(f"{_PRE}p"))
    match = [F.col(f"{_PRE}{d}").eqNullSafe(F.col(f"{_PRE}c_{d}")) for d in DIMENSIONS]
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    joined = tagged.join(rate, match[0] & match[1] & match[2]).withColumn(f"{_PRE}kept", draw < F.col(f"{_PRE}p"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], f"{_PRE}topic", f"{_PRE}p", f"{_PRE}kept")


def rake_and_sample(docs: DataFrame, keep_share: float | None = None, temper: float = TEMPER, seed: int = SEED, topic: Column | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled rows of docs (doc_id, text, source, lang, ...), all columns as they were."""
    return calibrated(docs, keep_share, temper, seed, topic, targets).where(f"{_PRE}kept").select(*[F.col(f"`{c}`") for c in docs.columns])
