"""Groups of related records, and splits that keep a group together.

Grouping is union-find over a bipartite graph of records and the keys they
hold.  Every input block builds its own forest and keeps one edge for each
tree and key, so that a key held by a third of all rows leaves one edge a block.
Only keys that still join two trees go on; their edges are merged in fewer,
larger forests, level by level, each forest of a bounded number of edges.  When
the edges are too many for one forest and a level shrinks them little, a level
of least-label contraction, which needs no forest, is put between.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.staging import Stage, sized
from tessera.llm.roles import _BLANK_ENDS

#: Edges that one task merges in memory.
FOREST_EDGES = 400_000


class Forest:
    """Union-find with the least member as the name of a tree."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def root(self, x: str) -> str:
        up = self.up
        top = x
        while (higher := up.get(top, top)) != top:
            top = higher
        while (higher := up.get(x, x)) != top:
            up[x] = top
            x = higher
        return top

    def join(self, x: str, y: str) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def key(prefix: str, value: Column, fold: bool = False) -> Column:
    """A key for grouping: null for null and blank values; ``fold`` ignores case and surrounding blanks."""
    bare = F.regexp_replace(value, _BLANK_ENDS, "")
    return F.when(F.length(bare) > 0, F.concat(F.lit(prefix), F.lower(bare) if fold else value))


def _trees(column: str, at_most: int = 0):
    """From (column, keys) rows of a task: the tree of each record, and the tree's keys; forests of about ``at_most`` nodes, if given."""

    def emit(forest: Forest, holder: dict[str, str], records: dict[str, None]) -> Iterator[pa.RecordBatch]:
        records = list(records)
        for at in range(0, len(records), 50_000):
            part = records[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"record": pa.array(part, pa.string()), "root": pa.array([forest.root(r) for r in part], pa.string()), "key": pa.nulls(len(part), pa.string())})
        keys = list(holder)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"record": pa.nulls(len(part), pa.string()), "root": pa.array([forest.root(holder[k]) for k in part], pa.string()), "key": pa.array(part, pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, holder, records = Forest(), {}, {}
        for batch in batches:
            for record, keys in zip(batch.column(column).to_pylist(), batch.column("keys").to_pylist()):
                records[record] = None
                for k in keys or ():
                    if k is not None:
                        forest.join(record, holder.setdefault(k, record))
            # a forest is closed at a bounded size; the next one starts empty and is joined to it a level higher
            if at_most and len(records) + len(holder) > at_most:
                yield from emit(forest, holder, records)
                forest, holder, records = Forest(), {}, {}
        yield from emit(forest, holder, records)

    return run


_TREES = "record string, root string, key string"


def related_groups(df: DataFrame, id: str, keys: Column, forest_edges: int = FOREST_EDGES) -> DataFrame:
    """(id, group): records that share a key, directly or through others, share a group.

    ``keys`` is an array of strings; null keys and a null array relate nothing.
    A group is named by its least id.  Rows of a null id are left out; repeated
    rows count once (rows of one id are taken to share a key or to have none).
    An empty table gives no rows.
    """
    spark = df.sparkSession
    stage = Stage(spark, "groups")
    rows = df.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("record"), keys.alias("keys"))
    first = stage.put(rows.mapInArrow(_trees("record", forest_edges), _TREES))
    maps: list[DataFrame] = []
    edges = first.where("key IS NOT NULL").select("root", "key")
    before = None
    while True:
        joining = edges.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("key")
        edges = stage.put(edges.join(joining, "key", "left_semi"))
        n = edges.count()
        if not n:
            break
        forests = -(-n // forest_edges)
        if forests > 1 and before is not None and n > before // 2:
            least = edges.groupBy("key").agg(F.min("root").alias("least"))
            moved = edges.join(least, "key").groupBy("root").agg(F.min("least").alias("to")).where("root <> to")
            moved = stage.put(moved)
        else:
            spread = edges.coalesce(1) if forests == 1 else edges.repartition(forests, F.xxhash64("root", F.lit(len(maps))))
            trees = spread.select("root", F.array("key").alias("keys")).mapInArrow(_trees("root"), _TREES)
            moved = stage.put(trees.where("key IS NULL AND record <> root").select(F.col("record").alias("root"), F.col("root").alias("to")).distinct())
        before = n
        maps.append(moved)
        edges = edges.join(moved, "root", "left").select(F.coalesce("to", "root").alias("root"), "key").distinct()
    out = first.where("key IS NULL").select("record", "root").distinct()
    for moved in maps:
        out = out.join(moved, "root", "left").select("record", F.coalesce("to", "root").alias("root"))
    return out.groupBy("record").agg(F.min("root").alias("group")).select(F.col("record").alias("id"), "group")


def share_out(sizes: list[tuple[int, int]], shares: Mapping[str, float]) -> dict[int, list[int]]:
    """How many groups of each size go to each split, largest first, each to the split furthest below its target.

    ``sizes`` are (size, number of groups); equal sizes are dealt in one go, as
    one by one would.  Ties go to the split named first.
    """
    total = sum(s * c for s, c in sizes)
    names = list(shares)
    whole = sum(shares.values())
    lack = [total * shares[n] / whole for n in names]
    out: dict[int, list[int]] = {}
    for size, count in sorted(sizes, reverse=True):
        got = [0] * len(names)
        spare = 4 * len(names)
        if count > spare:
            low, high = min(lack) - size * (count + 1), max(lack) + size
            for _ in range(200):
                level = (low + high) / 2
                taken = [max(0, int((d - level) // size) + 1) if d >= level else 0 for d in lack]
                if sum(taken) > count - spare // 2:
                    low = level
                else:
                    high = level
            got = [max(0, int((d - high) // size) + 1) if d >= high else 0 for d in lack]
            lack = [d - size * g for d, g in zip(lack, got)]
        heap = [(-d, k) for k, d in enumerate(lack)]
        heapq.heapify(heap)
        for _ in range(count - sum(got)):
            d, k = heap[0]
            got[k] += 1
            lack[k] -= size
            heapq.heapreplace(heap, (-lack[k], k))
        out[size] = got
    return out


def assign_splits(groups: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """(id, group, split) from (id, group): whole groups to splits, near the given shares of ids.

    The driver sees only how many groups there are of each size: distinct sizes
    of n ids number less than sqrt(2 n).  Among groups of a size, names decide.
    """
    spark = groups.sparkSession
    stage = Stage(spark, "splits")
    sizes = stage.put(groups.groupBy("group").agg(F.count("*").alias("size")).repartitionByRange(F.col("size"), F.xxhash64("group"), F.col("group")).withColumn("part", F.spark_partition_id()))
    runs = sorted(map(tuple, sizes.groupBy("part", "size").count().collect()))
    totals: dict[int, int] = {}
    begins = []
    for part, size, count in runs:
        begins.append((part, size, totals.get(size, 0)))
        totals[size] = totals.get(size, 0) + count
    if not runs:
        return groups.select("id", "group", F.lit(None).cast("string").alias("split"))
    dealt = share_out(list(totals.items()), shares)
    limits = []
    for size, got in dealt.items():
        at = 0
        for name, n in zip(shares, got):
            if n:
                limits.append((size, at, at + n, name))
            at += n
    begin = spark.createDataFrame(begins, "part int, size long, begin long")
    limit = spark.createDataFrame(limits, "size long, low long, high long, split string")
    from pyspark.sql import Window

    place = F.col("begin") + F.row_number().over(Window.partitionBy("part", "size").orderBy("group")) - 1
    ranked = sizes.join(F.broadcast(begin), ["part", "size"]).select("group", "size", place.alias("place"))
    placed = ranked.join(F.broadcast(limit), "size").where("place >= low AND place < high").select("group", "split")
    return groups.join(sized(placed, sum(totals.values())), "group").select("id", "group", "split")
