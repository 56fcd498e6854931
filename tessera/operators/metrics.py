"""Two-level metrics of measurements, guarded against mixing what must not be mixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import finite


def valid_rows(rows: DataFrame, value: str = "value", unit: str = "islet_id", channel: str = "wavelength_nm") -> DataFrame:
    """Rows with a finite value, a named analysis unit and a channel."""
    return rows.where(finite(F.col(value)) & (F.trim(F.col(unit)) != "") & F.col(channel).isNotNull())


def two_level(rows: DataFrame, keys: Sequence[str], *, value: str = "value", unit: str = "islet_id", inner: str = "dish_id", same: Sequence[Sequence[str]] = (("unit",), ("method",), ("dataset_version", "pipeline_version"))) -> DataFrame:
    """(keys..., status, mean_value, median_value, n_rows, n_units, n_inner) by group.

    The value of a unit is the median of its rows, that of a group the mean or
    median of its units.  The status is incompatible where one of ``same``
    differs in the group, else invalid where a value is not finite or a unit
    blank, else ok; values are given for ok alone.  Both levels aggregate
    partially before they shuffle; the guards ride along with the first.
    """
    blank = F.coalesce(F.trim(F.col(unit)) == "", F.lit(True))
    guards = [f(F.struct(*s)).alias(f"_{name}{k}") for k, s in enumerate(same) for name, f in (("low", F.min), ("high", F.max))]
    units = rows.groupBy(*keys, unit).agg(
        F.median(F.when(finite(F.col(value)), F.col(value))).alias("_median"),
        F.count("*").alias("_rows"),
        F.bool_or(~finite(F.col(value)) | blank).alias("_bad"),
        *guards,
    )
    mixed = F.lit(False)
    for k in range(len(same)):
        mixed = mixed | (F.min(f"_low{k}") != F.max(f"_high{k}"))
    groups = units.groupBy(*keys).agg(
        F.when(mixed, "incompatible_measurements").when(F.bool_or("_bad"), "invalid_measurement").otherwise("ok").alias("status"),
        F.avg("_median").alias("_mean"), F.median("_median").alias("_mid"), F.sum("_rows").alias("n_rows"),
        F.count(F.when(F.trim(F.col(unit)) != "", 1)).alias("n_units"),
    )
    inners = rows.where(F.trim(F.col(inner)) != "").groupBy(*keys).agg(F.count_distinct(inner).alias("_inner")).toDF(*(f"_k{i}" for i in range(len(keys))), "_inner")
    joined = groups.join(inners, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left").withColumn("n_inner", F.coalesce("_inner", F.lit(0).cast("long")))
    ok = F.col("status") == "ok"
    return joined.select(*keys, "status", F.when(ok, F.col("_mean")).alias("mean_value"), F.when(ok, F.col("_mid")).alias("median_value"), "n_rows", "n_units", "n_inner")


def answer_requests(requests: DataFrame, metrics: DataFrame, keys: Sequence[str], aggregation: str = "aggregation") -> DataFrame:
    """Each request with its group's status and the value it asks for; a group without rows is unavailable."""
    joined = requests.join(metrics, list(keys), "left")
    value = F.when(F.col(aggregation) == "mean", F.col("mean_value")).when(F.col(aggregation) == "median", F.col("median_value"))
    return joined.select(*requests.columns, F.coalesce("status", F.lit("unavailable_in_authorized_snapshot")).alias("status"), value.alias("value"), "n_rows", "n_units")


def evidence_rows(requests: DataFrame, rows: DataFrame, keys: Sequence[str], id: str, row_id: str = "row_id", *columns: str) -> DataFrame:
    """(id, row_id, columns...): the rows that each request's value is made of, one row each."""
    asked = requests.select(F.col(id).alias("_id"), *(F.col(k).alias(f"_{k}") for k in keys))
    return asked.join(rows, [F.col(f"_{k}") == F.col(k) for k in keys]).select(F.col("_id").alias(id), row_id, *columns)


def unit_values(evidence: DataFrame, id: str, unit: str = "islet_id", value: str = "value") -> DataFrame:
    """(id, unit, value, rows): the median of each analysis unit behind a request's value."""
    good = evidence.where(finite(F.col(value)) & (F.trim(F.col(unit)) != ""))
    return good.groupBy(id, unit).agg(F.median(value).alias("value"), F.count("*").alias("rows"))


def evidence_summary(evidence: DataFrame, id: str, row_id: str = "row_id", source: str = "source_row_sha256", unit: str = "islet_id", inner: str = "dish_id") -> DataFrame:
    """(id, n_images, n_islets, n_dishes, n_mice, first_row, last_row, snapshot): counts and a fingerprint of each request's rows.

    n_mice is always null: rows say nothing of animals.  The fingerprint is the
    sum of hashes of (row, source), the same in any order, so no group is gathered.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", row_id, source).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    named = lambda c: F.count_distinct(F.when(F.trim(F.col(c)) != "", F.col(c)))
    return evidence.groupBy(id).agg(F.count("*").alias("n_images"), named(unit).alias("n_islets"), named(inner).alias("n_dishes"), F.first(F.lit(None).cast("long")).alias("n_mice"), F.min(row_id).alias("first_row"), F.max(row_id).alias("last_row"), F.sum(h).cast("string").alias("snapshot"))


def catalog(rows: DataFrame, *columns: str) -> DataFrame:
    """The distinct tuples of the columns that rows have."""
    return rows.select(*columns).distinct()
