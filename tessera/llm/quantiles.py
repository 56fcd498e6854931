"""Percentiles of very large groups, from results kept per day, by multi-select.

``day_runs`` keeps, for each group, day and hash bucket of the row key, the
sorted values with weights; a day has as many buckets as its rows need, so that
none is large.  A run of more than 1 / (2 * error) values keeps
every w-th of them with weight w = 2 * error * n, so that it may be wrong in
rank by w / 2 <= error * n.  Runs of other days or files are simply unioned:
ranks add up, and so do the bounds, which ``select`` reports as an absolute
rank error (0: exact).

``select`` never gathers a group.  Its runs are merged into blocks of bounded
size; each block proposes the median of what is left of it, the weighted median
of the proposals is the pivot, the blocks count three ways, the side without
the wanted rank is discarded, and so on for all groups and percentiles at once
until each is found or the few values left can be put in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.staging import Stage, sized

RANK_ERROR = 0.0005
#: Values of a run, about: a group's day is split by the row key into as many as it needs, so that a hot day is no one task's.
RUN_VALUES = 65_536
#: Values of a block, about.
BLOCK = 262_144
#: When no target has more values left than these, they are put in order at once.
REST = 1024


def day_runs(df: DataFrame, keys: Sequence[str], value: str, row_key: str, day: str, error: float = RANK_ERROR, run_values: int = RUN_VALUES) -> DataFrame:
    """(keys..., day, bucket, n, points: array<struct<v, w>>): the mergeable results of each day.

    Rows of null, NaN or infinite ``value`` and of null ``row_key`` are left out;
    rows of one ``row_key`` count once in a group and day, with the least of
    their values, should they differ.  Null keys and a null day are groups of
    their own.  Keys can't be named like the other columns of the runs.  An empty
    table gives no runs.
    """
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")) & F.col(row_key).isNotNull())
    inner = [f"_key{k}" for k in range(len(keys))]
    rows = rows.select(*(F.col(k).alias(i) for k, i in zip(keys, inner)), F.to_date(day).alias("day"), F.xxhash64(row_key).alias("h"), number.alias("v"))
    day_of = [*inner, "day"]
    large = rows.groupBy(*day_of).agg(F.count("*").alias("rows")).where(F.col("rows") > run_values).select(*day_of, F.ceil(F.col("rows") / run_values).cast("int").alias("buckets"))
    large = Stage(df.sparkSession, "days").put(large)
    known = sized(large, large.count())
    split = rows.alias("r").join(known.alias("l"), [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in day_of], "left")
    rows = split.select("r.*", F.pmod("h", F.coalesce("buckets", F.lit(1))).cast("int").alias("bucket"))
    at = [*day_of, "bucket"]
    once = rows.repartition(*at).groupBy(*at, "h").agg(F.min("v").alias("v"))
    runs = once.groupBy(*at).agg(F.sort_array(F.collect_list("v")).alias("vs"))
    n = F.size("vs")
    w = F.greatest(F.lit(1), F.floor(F.lit(2 * error) * n)).cast("int")
    runs = runs.withColumn("n", n).withColumn("w", w)
    # the s-th slice of w values is kept as its middle one
    slices = F.sequence(F.lit(0), F.expr("int((n - 1) div w)"))
    points = F.when(F.col("w") == 1, F.transform("vs", lambda v: F.struct(v.alias("v"), F.lit(1).alias("w")))).otherwise(
        F.transform(
            slices,
            lambda s: F.struct(
                F.element_at("vs", (s * F.col("w") + F.floor((F.least(F.col("w"), F.col("n") - s * F.col("w")) + 1) / 2)).cast("int")).alias("v"),
                F.least(F.col("w"), F.col("n") - s * F.col("w")).cast("int").alias("w"),
            ),
        )
    )
    named = [F.col(i).alias(k) for k, i in zip(keys, inner)]
    return runs.select(*named, "day", "bucket", F.col("n").cast("long").alias("n"), F.when(F.col("w") > 1, F.expr("(w + 1) div 2")).otherwise(0).cast("long").alias("off"), points.alias("points"))


_STEP = "gid long, t int, less long, same long, more long, under double, over double"


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts each block three ways around the pivots and proposes the medians of both sides."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("gid", "t", "less", "same", "more", "under", "over")}
        vs, ws = batch.column("vs"), batch.column("ws")
        states = batch.column("targets").to_pylist()
        for row, gid in enumerate(batch.column("gid").to_pylist()):
            v = vs[row].values.to_numpy(zero_copy_only=False)
            sums = np.r_[0, np.cumsum(ws[row].values.to_numpy(zero_copy_only=False), dtype=np.int64)]
            for s in states[row]:
                i, j = np.searchsorted(v, s["lo"], "right") if s["lo"] is not None else 0, np.searchsorted(v, s["hi"], "left") if s["hi"] is not None else len(v)
                if i >= j:
                    continue
                if s["pivot"] is None:  # the first round only proposes
                    a = b = j
                else:
                    a, b = np.searchsorted(v, s["pivot"], "left"), np.searchsorted(v, s["pivot"], "right")
                    a, b = min(max(a, i), j), min(max(b, i), j)

                def middle(x: int, y: int) -> float | None:
                    return None if x >= y else float(v[min(y - 1, max(x, int(np.searchsorted(sums, (sums[x] + sums[y] + 1) // 2, "left")) - 1))])

                for name, item in (("gid", gid), ("t", s["t"]), ("less", int(sums[a] - sums[i])), ("same", int(sums[b] - sums[a])), ("more", int(sums[j] - sums[b])), ("under", middle(i, a)), ("over", middle(b, j))):
                    out[name].append(item)
        yield pa.RecordBatch.from_pydict({"gid": pa.array(out["gid"], pa.int64()), "t": pa.array(out["t"], pa.int32()), **{k: pa.array(out[k], pa.int64()) for k in ("less", "same", "more")}, **{k: pa.array(out[k], pa.float64()) for k in ("under", "over")}})


def _trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Discards what no open target of the group needs."""
    for batch in batches:
        kept_v, kept_w = [], []
        states = batch.column("targets").to_pylist()
        for row in range(batch.num_rows):
            v = batch.column("vs")[row].values.to_numpy(zero_copy_only=False)
            keep = np.zeros(len(v), dtype=bool)
            for s in states[row]:
                i = np.searchsorted(v, s["lo"], "right") if s["lo"] is not None else 0
                j = np.searchsorted(v, s["hi"], "left") if s["hi"] is not None else len(v)
                keep[i:j] = True
            kept_v.append(v[keep])
            kept_w.append(batch.column("ws")[row].values.to_numpy(zero_copy_only=False)[keep])
        some = [k for k, x in enumerate(kept_v) if len(x)]
        if some:
            offsets = pa.array(np.r_[0, np.cumsum([len(kept_v[k]) for k in some])].astype(np.int32))
            yield pa.RecordBatch.from_pydict({"gid": batch.column("gid").take(pa.array(some)), "vs": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([kept_v[k] for k in some]))), "ws": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([kept_w[k] for k in some]).astype(np.int32)))})


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each target, value by value."""
    for batch in batches:
        out: dict[str, list] = {"gid": [], "t": [], "todo": [], "v": [], "w": []}
        states, gids = batch.column("targets").to_pylist(), batch.column("gid").to_pylist()
        for row in range(batch.num_rows):
            v = batch.column("vs")[row].values.to_numpy(zero_copy_only=False)
            w = batch.column("ws")[row].values.to_numpy(zero_copy_only=False)
            for s in states[row]:
                i = np.searchsorted(v, s["lo"], "right") if s["lo"] is not None else 0
                j = np.searchsorted(v, s["hi"], "left") if s["hi"] is not None else len(v)
                n = max(0, j - i)
                for name, items in (("gid", [gids[row]] * n), ("t", [s["t"]] * n), ("todo", [s["todo"]] * n), ("v", v[i:j].tolist()), ("w", w[i:j].tolist())):
                    out[name] += items
        yield pa.RecordBatch.from_pydict({"gid": pa.array(out["gid"], pa.int64()), "t": pa.array(out["t"], pa.int32()), "todo": pa.array(out["todo"], pa.int64()), "v": pa.array(out["v"], pa.float64()), "w": pa.array(out["w"], pa.int64())})


def select(runs: DataFrame, keys: Sequence[str], percentiles: Sequence[float], block: int = BLOCK) -> DataFrame:
    """(keys..., n, rank_error, p, value): percentiles of the union of runs, one row each.

    A percentile p of n values is the value at rank p * (n - 1), between two
    values in proportion.  The ranks of the values given are right up to
    ``rank_error``; 0 is exact.  Equal values, single values and values of any
    finite magnitude are found as they are.
    """
    spark = runs.sparkSession
    stage = Stage(spark, "quantiles")
    names, keys = list(keys), [f"_key{k}" for k in range(len(keys))]
    runs = stage.put(runs.withColumnsRenamed(dict(zip(names, keys))))
    groups = stage.put(runs.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("off").alias("rank_error"), F.sum(F.size("points").cast("long")).alias("kept")).withColumn("gid", F.monotonically_increasing_id()))
    n_groups = groups.count()
    few = sized(groups, n_groups)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    parts = F.expr(f"pmod(xxhash64(day, bucket), greatest(1, kept div {block}))")
    merged = (
        runs.alias("r")
        .join(few.alias("g"), same)
        .select("gid", parts.alias("part"), "points")
        .groupBy("gid", "part")
        .agg(F.sort_array(F.flatten(F.collect_list("points"))).alias("points"))
        .select("gid", F.transform("points", lambda x: x["v"]).alias("vs"), F.transform("points", lambda x: x["w"]).alias("ws"))
    )
    blocks = stage.put(merged)
    ranks = F.array(*(r for p in percentiles for r in (F.floor(F.lit(float(p)) * (F.col("n") - 1)) + 1, F.ceil(F.lit(float(p)) * (F.col("n") - 1)) + 1)))
    targets = groups.select("gid", F.posexplode(F.array_sort(F.array_distinct(ranks))).alias("t", "rank"), F.col("n").alias("left"))
    nothing = F.lit(None).cast("double")
    state = stage.put(targets.select("gid", "t", F.col("rank").cast("long").alias("rank"), F.col("rank").cast("long").alias("todo"), nothing.alias("lo"), nothing.alias("hi"), nothing.alias("pivot"), nothing.alias("value"), "left"))
    done: list[DataFrame] = []
    held = None  # values in blocks, when they were last written
    while True:
        open_, left, most = state.agg(F.count("*"), F.sum("left"), F.max("left")).first()
        if not open_:
            break
        asked = sized(state.groupBy("gid").agg(F.collect_list(F.struct("t", "todo", "lo", "hi", "pivot")).alias("targets")), n_groups)
        if most <= REST:
            rest = blocks.join(asked, "gid").mapInArrow(_rest, "gid long, t int, todo long, v double, w long").groupBy("gid", "t", "todo").agg(F.sort_array(F.collect_list(F.struct("v", "w"))).alias("x"))
            none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("v"))
            pick = F.aggregate("x", none, lambda a, x: F.struct((a["n"] + x["w"]).alias("n"), F.coalesce(a["v"], F.when(a["n"] + x["w"] >= F.col("todo"), x["v"])).alias("v")))["v"]
            done.append(stage.put(rest.select("gid", "t", pick.alias("value")).join(state.select("gid", "t", "rank"), ["gid", "t"]).select("gid", "rank", "value")))
            break
        if held is None:
            held = groups.agg(F.sum("kept")).first()[0]
        elif left < held / 2:
            old, blocks, held = blocks, stage.put(blocks.join(asked, "gid").mapInArrow(_trim, "gid long, vs array<double>, ws array<int>")), left
            stage.drop(old)
        found = blocks.join(asked, "gid").mapInArrow(_step, _STEP).groupBy("gid", "t").agg(
            F.sum("less").alias("less"), F.sum("same").alias("same"), F.sum("more").alias("more"),
            F.expr("percentile(under, 0.5, less)").alias("under"), F.expr("percentile(over, 0.5, more)").alias("over"),
        )
        new = state.join(found, ["gid", "t"], "left")
        first = F.col("pivot").isNull()
        below, here = ~first & (F.col("todo") <= F.col("less")), ~first & (F.col("todo") > F.col("less")) & (F.col("todo") <= F.col("less") + F.col("same"))
        new = new.select(
            "gid", "t", "rank",
            F.when(first | below, F.col("todo")).otherwise(F.col("todo") - F.col("less") - F.col("same")).alias("todo"),
            F.when(first | below, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
            F.when(below, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(first | below, F.col("under")).otherwise(F.col("over")).alias("pivot"),
            F.when(here, F.col("pivot")).alias("value"),
            F.when(first | below, F.col("less")).otherwise(F.col("more")).alias("left"),
        )
        new = stage.put(new)
        done.append(new.where("value IS NOT NULL").select("gid", "rank", "value"))
        state = new.where("value IS NULL")
    values = state.select("gid", "rank", "value").limit(0)
    for more in done:
        values = values.union(more)
    wanted = groups.select("gid", *keys, "n", "rank_error", F.explode(F.array(*(F.lit(float(p)) for p in percentiles))).alias("p"))
    at = F.col("p") * (F.col("n") - 1)
    wanted = wanted.withColumn("low", (F.floor(at) + 1).cast("long")).withColumn("high", (F.ceil(at) + 1).cast("long"))
    low = values.toDF("gid", "low", "low_value")
    high = values.toDF("gid", "high", "high_value")
    out = wanted.join(low, ["gid", "low"]).join(high, ["gid", "high"])
    part = at - F.floor(at)
    value = F.when(F.col("low") == F.col("high"), F.col("low_value")).otherwise(F.col("low_value") * (1 - part) + F.col("high_value") * part)
    return out.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), "n", "rank_error", "p", value.alias("value"))


def keep_runs(runs: DataFrame, path: str) -> None:
    """Writes runs to a folder with one part a day; the days of ``runs`` replace those that are there, others stay."""
    runs.withColumn("_day", F.coalesce(F.col("day").cast("string"), F.lit("none"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day").parquet(path)


def kept_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs of all days that a folder holds."""
    return spark.read.parquet(path).drop("_day")
