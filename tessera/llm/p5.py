"""Problem 5: percentiles of measured values by experiment and wavelength."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.staging import Stage
from tessera.llm.quantiles import day_runs, keep_runs, kept_runs, select
from tessera.session import table

KEYS = ("experiment_id", "wavelength_nm")
PERCENTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_runs(table(spark, sf_dir, "measurements"), KEYS, "value", "row_id", "recorded_at")


def _wide(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS, "n", "rank_error").agg(*(F.max(F.when(F.col("p") == p, F.round("value", 6))).alias(name) for name, p in PERCENTILES.items()))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and other percentiles of each group, with the bound on the error of their ranks."""
    return _wide(select(_runs(spark, sf_dir), KEYS, list(PERCENTILES.values())))


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out of kept results: days before the middle one are written by one job, the others by a second, and a third combines them."""
    rows = table(spark, sf_dir, "measurements")
    middle = F.lit(rows.agg(F.expr("to_date(timestamp_micros(div(unix_micros(min(recorded_at)) + unix_micros(max(recorded_at)), 2)))")).first()[0])
    late = F.coalesce(F.to_date("recorded_at") >= middle, F.lit(True))
    path = Stage(spark, "day-runs").root
    for part in (rows.where(~late), rows.where(late)):
        keep_runs(day_runs(part, KEYS, "value", "row_id", "recorded_at"), path)
    return _wide(select(kept_runs(spark, path), KEYS, list(PERCENTILES.values())))


def bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinned runs, of a coarse bound so that nearly all days are thinned: whether the true rank of each value is within its bound."""
    runs = day_runs(table(spark, sf_dir, "measurements"), KEYS, "value", "row_id", "recorded_at", error=0.25)
    got = select(runs, KEYS, [0.5]).where("rank_error > 0")
    number = F.col("value").cast("double")
    once = table(spark, sf_dir, "measurements").where(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")) & F.col("row_id").isNotNull()).groupBy(*KEYS, "row_id", F.to_date("recorded_at").alias("day")).agg(F.min(number).alias("x"))
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"o.{k}")) for k in KEYS]
    # the median may lie between two values of ranks next to one another, hence one rank more
    per = got.alias("g").join(once.alias("o"), same).groupBy("g.experiment_id", "g.wavelength_nm", "n", "rank_error", "value").agg(F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    at = 0.5 * (F.col("n") - 1)
    held = (F.col("below") - F.col("rank_error") - 1 <= at) & (at <= F.col("upto") + F.col("rank_error"))
    return per.groupBy(held.alias("held")).agg(F.count("*").alias("groups"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the results kept of each day."""
    return _runs(spark, sf_dir).groupBy(*KEYS, "day").agg(F.sum("n").alias("n"), F.sum(F.size("points")).cast("long").alias("kept"), F.sum("off").alias("rank_error"))


_ROWS = "(SELECT row_id, experiment_id, wavelength_nm, CAST(recorded_at AS DATE) AS day, min(value) AS v FROM measurements WHERE value IS NOT NULL AND isfinite(value) AND row_id IS NOT NULL GROUP BY ALL)"

QUERIES = {"p5_percentiles": percentiles, "p5_combined": combined, "p5_days": days, "p5_bound_held": bounded}
_PERCENTILES = "SELECT experiment_id, wavelength_nm, count(*) AS n, CAST(0 AS BIGINT) AS rank_error, " + ", ".join(f"round(quantile_cont(v, {p}), 6) AS {name}" for name, p in PERCENTILES.items()) + f" FROM {_ROWS} GROUP BY experiment_id, wavelength_nm"
ORACLES = {
    "p5_percentiles": _PERCENTILES,
    "p5_combined": _PERCENTILES,
    # a run of 4 values or more is thinned
    "p5_bound_held": f"SELECT true AS held, count(*) AS groups FROM (SELECT DISTINCT experiment_id, wavelength_nm FROM (SELECT experiment_id, wavelength_nm, day FROM {_ROWS} GROUP BY ALL HAVING count(*) >= 4)) HAVING count(*) > 0",
    "p5_days": f"SELECT experiment_id, wavelength_nm, day, count(*) AS n, count(*) AS kept, CAST(0 AS BIGINT) AS rank_error FROM {_ROWS} GROUP BY experiment_id, wavelength_nm, day",
}
