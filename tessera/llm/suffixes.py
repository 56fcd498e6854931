"""Spans of held-out records that train records have too, by a suffix array over their texts.

The suffixes of the texts, one a word, are put in one order: ranged over
partitions by their first WINDOW words and sorted within them, so that the
partitions one after another are the suffix array.  Of each held-out suffix the
nearest one of the train side, above and below, has the longest prefix in common
with it; where that is LEAST words or more it is a shared span, and the spans of
a text, merged, are its coverage.  Runs longer than the window are covered by
the suffixes that start within them.  What lies beyond a partition's ends is
known from the first and last train suffix of the others, two a partition.

Only suffixes whose first LEAST words occur on both sides enter the array: the
others share no span.  Exact copies are one text, and train suffixes of the same
window one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.staging import Stage, sized
from tessera.llm.blocks import Words, slices
from tessera.llm.overlaps import split_side

#: Words that a shared span has at least.
LEAST = 5
#: Words of a suffix that it is ordered by.
WINDOW = 8
#: Suffixes of a partition, about.
PART = 200_000


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _classes(with_id: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                words = Words(texts[a:b])
                out = {"c1": _as_long(words.whole()), "c2": _as_long(words.whole(0x5851F42D4C957F2D)), "side": batch.column("side").slice(a, b - a), "n": pa.array(np.diff(words.offsets).astype(np.int32))}
                if with_id:
                    out["id"] = batch.column("id").slice(a, b - a)
                else:
                    # 32 bits a word tell suffixes apart that agree in a 64-bit hash of LEAST words
                    out["words"] = pa.array([(words.of(i) >> np.uint64(32)).astype(">u4").tobytes() for i in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return run


def _seeds(least: int):
    """The first words of every suffix, as a hash, with the text and place it is of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, side = batch.column("c1").to_numpy(), batch.column("side").to_numpy()
            for k, raw in enumerate(batch.column("words").to_pylist()):
                w = np.frombuffer(raw, dtype=">u4").astype(np.uint64)
                m = len(w) - least + 1
                if m <= 0:
                    continue
                h = np.zeros(m, dtype=np.uint64)
                for j in range(least):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + m] + np.uint64(1)
                yield pa.RecordBatch.from_pydict({"seed": _as_long(h), "c1": pa.array(np.full(m, c1[k])), "at": pa.array(np.arange(m, dtype=np.int32)), "side": pa.array(np.full(m, side[k], dtype=np.int32))})

    return run


def _tails(raw: bytes, places: list[int]) -> list[bytes]:
    size = 4 * WINDOW
    return [raw[4 * i : 4 * i + size].ljust(size, b"\0") for i in places]


def _held_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c1, raw, places in zip(batch.column("c1").to_pylist(), batch.column("words").to_pylist(), batch.column("places").to_pylist()):
            yield pa.RecordBatch.from_pydict({"tail": pa.array(_tails(raw, places), pa.binary()), "c1": pa.array([c1] * len(places), pa.int64()), "at": pa.array(places, pa.int32()), "left": pa.array([len(raw) // 4 - i for i in places], pa.int32())})


def _train_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: set[bytes] = set()
        for raw, places in zip(batch.column("words").to_pylist(), batch.column("places").to_pylist()):
            seen.update(_tails(raw, places))
        yield pa.RecordBatch.from_pydict({"tail": pa.array(list(seen), pa.binary())})


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns of two matrices agree, row by row."""
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


def _nearest(words: np.ndarray, other: np.ndarray, before: bytes | None) -> np.ndarray:
    """For each row of an ordered matrix, the common prefix with the last row of ``other`` not after it; ``before`` is such a row ahead of all."""
    step = np.r_[0, common_prefix(words[1:], words[:-1])] if len(words) else np.empty(0, int)
    out = np.zeros(len(words), dtype=np.int64)
    now = 0
    if before is not None and len(words):
        step[0] = common_prefix(words[:1], np.frombuffer(before, dtype=">u4")[None, :])[0]
        now = words.shape[1]
    for i, (s, is_other) in enumerate(zip(step.tolist(), other.tolist())):
        now = min(now, s)
        out[i] = now
        if is_other:
            now = words.shape[1]
    return out


def _longest(edges: dict[int, tuple[bytes | None, bytes | None]]):
    """(c1, at, length) of the held-out suffixes of one partition that share LEAST words with a train suffix."""

    def run(part: pa.Table) -> pa.Table:
        tails = part.column("tail").to_pylist()
        order = sorted(range(len(tails)), key=tails.__getitem__)
        words = np.frombuffer(b"".join(tails[i] for i in order), dtype=">u4").reshape(len(tails), -1)
        train = part.column("train").to_numpy()[order]
        before, after = edges[part.column("part")[0].as_py()]
        best = np.maximum(_nearest(words, train, before), _nearest(words[::-1], train[::-1], after)[::-1])
        best = np.minimum(best, part.column("left").to_numpy()[order])
        keep = np.flatnonzero((best >= LEAST) & ~train)
        at = pa.array(np.array(order, dtype=np.int64)[keep])
        return pa.table({"c1": part.column("c1").take(at), "at": part.column("at").take(at), "length": pa.array(best[keep].astype(np.int32))})

    return run


def _ends(ranged: DataFrame, parts: int) -> dict[int, tuple[bytes | None, bytes | None]]:
    """By partition: the nearest train suffix before it, and after it."""
    ends = {r["part"]: (bytes(r["low"]), bytes(r["high"])) for r in ranged.where("train").groupBy("part").agg(F.min("tail").alias("low"), F.max("tail").alias("high")).collect()}  # one row a partition
    before, after, now = {}, {}, None
    for p in range(parts):
        before[p] = now
        now = ends[p][1] if p in ends else now
    now = None
    for p in reversed(range(parts)):
        after[p] = now
        now = ends[p][0] if p in ends else now
    return {p: (before[p], after[p]) for p in range(parts)}


def shared_spans(df: DataFrame, *, id: str = "id", split: str = "split", text: str = "text", part: int = PART) -> DataFrame:
    """(id, words, covered, longest, coverage): of each dev or test record, how much stands in spans that train records have.

    A span is a run of LEAST words
    or more; covered counts the words of all of a record's spans, each once;
    longest is the longest run of covered words.  Records of another split, of
    a null id or without words are left out; repeated rows count once; shorter
    texts than LEAST words are covered only by exact copies.  Texts are read whole.
    An empty table gives no rows.
    """
    stage = Stage(df.sparkSession, "suffixes")
    rows = df.select(F.col(id).cast("string").alias("id"), split_side(F.col(split)).alias("side"), F.col(text).alias("text")).where("id IS NOT NULL AND side IS NOT NULL AND text IS NOT NULL")
    texts = stage.put(rows.select("side", "text").mapInArrow(_classes(False), "c1 long, c2 long, side int, n int, words binary").where("n > 0").groupBy("c1", "c2").agg(F.bit_or("side").alias("side"), F.first("n").alias("n"), F.first("words").alias("words")))
    seeds = texts.select("c1", "side", "words").mapInArrow(_seeds(LEAST), "seed long, c1 long, at int, side int")
    both = stage.put(seeds.groupBy("seed").agg(F.bit_or("side").alias("side")).where("side = 3").select("seed"))
    places = seeds.join(sized(both, both.count()), "seed", "left_semi").groupBy("c1").agg(F.array_sort(F.collect_set("at")).alias("places"))  # as many as the text has words
    placed = texts.select("c1", "side", "words").join(places, "c1")
    held = placed.where("side >= 2").mapInArrow(_held_suffixes, "tail binary, c1 long, at int, left int").withColumn("train", F.lit(False))
    train = placed.where("side <> 2").select("words", "places").mapInArrow(_train_suffixes, "tail binary").distinct().withColumn("train", F.lit(True))
    parts = max(1, -(-(texts.agg(F.sum("n")).first()[0] or 0) // part))
    ranged = held.unionByName(train, allowMissingColumns=True).repartitionByRange(parts, "tail", "c1", "at").withColumn("part", F.spark_partition_id())
    ranged = stage.put(ranged)
    spans = ranged.groupBy("part").applyInArrow(_longest(_ends(ranged, parts)), "c1 long, at int, length int")

    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("longest"), F.lit(0).alias("run"), F.lit(0).alias("to"))

    def merge(state, s):
        end = s["at"] + s["length"]
        fresh = F.greatest(end - F.greatest(state["to"], s["at"]), F.lit(0))
        run = F.when(s["at"] <= state["to"], state["run"] + fresh).otherwise(s["length"])
        return F.struct((state["covered"] + fresh).alias("covered"), F.greatest(state["longest"], run).alias("longest"), run.alias("run"), F.greatest(state["to"], end).alias("to"))

    merged = spans.groupBy("c1").agg(F.array_sort(F.collect_list(F.struct("at", "length"))).alias("s")).select("c1", F.aggregate("s", start, merge).alias("m"))
    per = texts.where("side >= 2").select("c1", "c2", "side", "n").join(merged, "c1", "left")
    members = rows.where("side = 2").mapInArrow(_classes(True), "c1 long, c2 long, side int, n int, id string").where("n > 0").select("c1", "c2", "id").distinct()
    whole = F.col("side") == 3  # a train record is the same text
    covered = F.when(whole, F.col("n")).otherwise(F.coalesce("m.covered", F.lit(0)))
    longest = F.when(whole, F.col("n")).otherwise(F.coalesce("m.longest", F.lit(0)))
    return members.join(per, ["c1", "c2"]).select("id", F.col("n").alias("words"), covered.alias("covered"), longest.alias("longest"), (covered / F.col("n")).alias("coverage"))
