"""Group-relative and paired rewards, on long rows (pair, side, i, reward).

Draws of the other sides never meet one by one: the mean of the lesser of a
reward and each of theirs follows from how many of them are not above it and
what these sum to, which two running sums in the order of the rewards give.  A
pair costs n log n of its draws.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbering import numbered
from tessera.functions.numeric import finite, ratio


def utility(a: Column, b: Column, eta: float) -> Column:
    """The mean of two rewards, drawn towards the lesser one by ``eta``."""
    return (1 - eta) * (a + b) / 2 + eta * F.least(a, b)


def leave_one_out(rows: DataFrame, group: Sequence[str], reward: str, out: str = "advantage") -> DataFrame:
    """Reward less the mean of the others of its group; null in a group of one."""
    w = Window.partitionBy(*group)
    others = F.try_divide(F.sum(reward).over(w) - F.col(reward), (F.count(reward).over(w) - 1).cast("double"))
    return rows.withColumn(out, F.col(reward) - others)


def standardised(rows: DataFrame, group: Sequence[str], reward: str, out: str = "advantage", epsilon: float = 1e-8) -> DataFrame:
    """Reward as a z-score of its group, by the population's deviation."""
    w = Window.partitionBy(*group)
    return rows.withColumn(out, (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + epsilon))


def _unit(value: float, name: str) -> None:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} must lie between 0 and 1")


def conditional_utilities(rows: DataFrame, eta: float, pair: str = "pair", side: str = "side", i: str = "i", reward: str = "reward") -> DataFrame:
    """(pair, side, i, reward, q): q is the mean utility of a draw with every draw of the other sides.

    Draws without a draw of another side are left out.  ``eta`` lies between 0 and 1.
    """
    _unit(eta, "eta")
    whole, own = Window.partitionBy(pair), Window.partitionBy(pair, side)
    upto = lambda w: w.orderBy(reward).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    others = lambda f: f(whole) - f(own)
    n, total = others(lambda w: F.count(reward).over(w)), others(lambda w: F.sum(reward).over(w))
    below, sum_below = others(lambda w: F.count(reward).over(upto(w))), others(lambda w: F.sum(reward).over(upto(w)))
    out = rows.where(F.col(reward).isNotNull()).select(pair, side, i, reward, n.alias("_n"), total.alias("_total"), below.alias("_below"), sum_below.alias("_sum"))
    lesser = F.col("_sum") + F.col(reward) * (F.col("_n") - F.col("_below"))
    q = (1 - eta) * (F.col(reward) + F.col("_total") / F.col("_n")) / 2 + eta * lesser / F.col("_n")
    return out.where("_n > 0").select(pair, side, i, reward, q.alias("q"))


def paired_advantages(rows: DataFrame, eta: float, pair: str = "pair", side: str = "side", i: str = "i", reward: str = "reward") -> DataFrame:
    """(pair, side, i, reward, q, advantage): twice q less the mean q of the side's others.

    With eta 0 this is the leave-one-out advantage of the reward itself.
    """
    q = conditional_utilities(rows, eta, pair, side, i, reward)
    return leave_one_out(q, [pair, side], "q", "_a").select(pair, side, i, reward, "q", (2 * F.col("_a")).alias("advantage"))


def joint_utility(rows: DataFrame, eta: float, pair: str = "pair", side: str = "side", reward: str = "reward") -> DataFrame:
    """(pair, joint_utility, draws, operations) over all combinations of the two sides of a pair."""
    q = conditional_utilities(rows.withColumn("_i", F.lit(0)), eta, pair, side, "_i", reward)
    first = F.col(side) == F.min(side).over(Window.partitionBy(pair))
    per = q.withColumn("_first", first).groupBy(pair).agg(F.avg(F.when(F.col("_first"), F.col("q"))).alias("joint_utility"), F.count("*").alias("draws"), (F.count_if("_first") * F.count_if(~F.col("_first"))).alias("operations"))
    return per.select(pair, "joint_utility", "operations", "draws")


def unequal_sides(rows: DataFrame, pair: str = "pair", side: str = "side") -> DataFrame:
    """(pair, sides, least, most): pairs that paired advantages are not defined for: not two sides, or not equally many draws, two at least."""
    per = rows.groupBy(pair, side).agg(F.count("*").alias("_n")).groupBy(pair).agg(F.count("*").alias("sides"), F.min("_n").alias("least"), F.max("_n").alias("most"))
    return per.where("sides <> 2 OR least <> most OR least < 2")


def clipped(ratio: Column, advantage: Column, epsilon: float = 0.2) -> Column:
    """The lesser of the ratio's and the clipped ratio's product with the advantage."""
    if not 0 < epsilon < 1:
        raise ValueError("epsilon must lie between 0 and 1")
    return F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - epsilon)), F.lit(1 + epsilon)) * advantage)


def token_loss(new: Column, old: Column, reference: Column, advantage: Column, epsilon: float = 0.2, beta: float = 0.04) -> Column:
    """The loss of one policy token: clipped surrogate and the sampled divergence from the reference."""
    if beta < 0:
        raise ValueError("beta must not be negative")
    d = reference - new
    return -clipped(F.exp(new - old), advantage, epsilon) + beta * (F.expm1(d) - d)


def token_fault(new: Column, old: Column, reference: Column, most: float = 60.0) -> Column:
    """Why a policy token has no loss: not_finite (null included), or unstable where a log ratio is beyond ``most``; null for a sound one."""
    sound = finite(new) & finite(old) & finite(reference)
    return F.when(~F.coalesce(sound, F.lit(False)), "not_finite").when((F.abs(new - old) > most) | (F.abs(reference - new) > most), "unstable")


def loss_faults(tokens: DataFrame, episode: str, mask: str, fault: Column) -> DataFrame:
    """(episode, fault, tokens): episodes whose loss is to be refused, with how many of their policy tokens say so.

    ``empty_mask`` is an episode without a policy token, ``mask`` one with a mask other than 0 and 1.
    """
    per = tokens.select(episode, F.when(~F.coalesce(F.col(mask).isin(0, 1), F.lit(False)), "mask").when(F.col(mask) == 1, fault).alias("fault"), (F.coalesce(F.col(mask), F.lit(0)) == 1).alias("_on"))
    bad = per.where("fault IS NOT NULL").groupBy(episode, "fault").agg(F.count("*").alias("tokens"))
    none = per.groupBy(episode).agg(F.bool_or("_on").alias("_any")).where("NOT _any").select(episode, F.lit("empty_mask").alias("fault"), F.lit(0).cast("long").alias("tokens"))
    return bad.unionByName(none)


def episode_loss(tokens: DataFrame, episode: str, mask: str, loss: Column) -> DataFrame:
    """(episodes, loss): the mean over masked tokens of an episode, then over all episodes, those without a loss included."""
    each = tokens.groupBy(episode).agg(F.avg(F.when(F.col(mask) == 1, loss)).alias("_loss"))
    return each.agg(F.count("*").alias("episodes"), ratio(F.sum("_loss"), F.count("*")).alias("loss"))


#: Rows of a series that are averaged by one task.
STRETCH = 100_000


def trailing_mean(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int = 25, out: str = "trailing_mean", stretch: int = STRETCH) -> DataFrame:
    """The mean of the last ``n`` values of a series, by arm; null values do not count.

    Rows are numbered in the order of arms and steps, without one task for all
    of an arm, and cut into stretches, each of which gets the n - 1 rows before
    it besides.
    """
    stretch = max(stretch, n)
    placed = numbered(rows, *by, *order, name="_place")
    cut = F.floor(F.col("_place") / stretch)
    before = F.explode(F.when((F.col("_place") % stretch) > stretch - n, F.array(cut, cut + 1)).otherwise(F.array(cut)))
    mean = F.avg(value).over(Window.partitionBy("_cut", *by).orderBy("_place").rowsBetween(-(n - 1), 0))
    return placed.withColumn("_cut", before).withColumn(out, mean).where(F.col("_cut") == cut).drop("_cut", "_place")


def flat_groups(rows: DataFrame, group: Sequence[str], reward: str) -> DataFrame:
    """(flat_groups, groups): groups whose rewards are all equal."""
    return rows.groupBy(*group).agg((F.min(reward) == F.max(reward)).alias("_flat")).agg(F.count_if("_flat").alias("flat_groups"), F.count("*").alias("groups"))
