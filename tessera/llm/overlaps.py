"""Same or nearly same records in different splits, by an exact prefix filter.

Spans that splits share are in ``suffixes``; they can't tell which pairs share
three quarters of their words, which need no common run at all.  Two texts that have three quarters of the longer one's words in the same order
have as many in common as bags.  The words of a text, repeats numbered, are put
in an order that is the same for all texts, rare ones first; of two such texts
the first words, a quarter of each and DEPTH more, have DEPTH words in common.
Texts meet in cells by their size, where these words are counted; what passes is
compared as a whole.  No pair is left out; the order and the cells say only what
it costs.

Exact copies are one class from the start: they cost one row in the cells, not
one each, and are put back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.staging import Stage, sized
from tessera.llm.blocks import Words, mix, slices

#: Words that the first words of two near copies have in common at least; short texts: three quarters of all.
DEPTH = 8
#: Words of the train and of the held-out texts of a cell, about; a bound of memory.
CELL_WORDS = {1: 8_000_000, 2: 2_000_000}
#: Bits of the sum of a text's words by which pairs are tried before they are compared.
SUM_BITS = 512
#: Bits of the buckets in which words are counted for the order.
RANK_BITS = 20

#: Lower limits of the size bands; sizes in a ratio of 3 to 4 or more are of the same or of neighbouring bands.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(4 * BANDS[-1] // 3 + 1)


def _bag(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, the second and later ones of a text numbered."""
    order = np.lexsort((words.hash, words.text))
    word, text = words.hash[order], words.text[order]
    if not len(word):
        return word, text
    begin = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (text[1:] != text[:-1])])
    nth = np.arange(len(word)) - np.repeat(begin, np.diff(np.r_[begin, len(word)]))
    return mix(word + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), text


def _bucket(bag: np.ndarray) -> np.ndarray:
    return (bag >> np.uint64(64 - RANK_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << RANK_BITS), dtype=np.int64)
    for batch in batches:
        texts, sides = batch.column("text").to_pylist(), batch.column("side").to_numpy(zero_copy_only=False)
        for a, b in slices(texts):
            bag, text = _bag(Words(texts[a:b]))
            for k in range(2):
                counts[k] += np.bincount(_bucket(bag[sides[a:b][text] == k + 1]), minlength=1 << RANK_BITS)
    at = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "train": pa.array(counts[0][at]), "held": pa.array(counts[1][at])})


def _least(n: np.ndarray) -> np.ndarray:
    """Three quarters of n, rounded up."""
    return -(-3 * n // 4)


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _first_words(words: Words, rank: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The first words of each text in the common order, and the sum of all its words as bits."""
    bag, text = _bag(words)
    sums = np.zeros((words.n_texts, SUM_BITS), dtype=np.uint8)
    np.add.at(sums, (text, (bag % np.uint64(SUM_BITS)).astype(np.int64)), 1)
    bits = np.packbits(sums & 1, axis=1)
    bag = bag[np.lexsort((bag, rank[_bucket(bag)], text))]
    n = np.diff(words.offsets)
    first = n - _least(n) + np.minimum(DEPTH, _least(n))
    kept = np.arange(len(bag)) - words.offsets[text] < first[text]
    offsets = pa.array(np.r_[0, np.cumsum(first)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, _as_long(bag[kept])), pa.array([row.tobytes() for row in bits], pa.binary())


def _fingerprint(rank: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sides = batch.column("side").to_numpy(zero_copy_only=False)
            for a, b in slices(texts):
                words = Words(texts[a:b])
                columns = {"c1": _as_long(words.whole()), "c2": _as_long(words.whole(0x5851F42D4C957F2D)), "side": pa.array(sides[a:b], pa.int32()), "n": pa.array(np.diff(words.offsets).astype(np.int32))}
                if rank is not None:
                    columns["first"], columns["bits"] = _first_words(words, rank)
                else:
                    columns |= {"id": batch.column("id").slice(a, b - a)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            words = Words(texts[a:b])
            yield pa.RecordBatch.from_pydict({"c1": _as_long(words.whole()), "words": pa.array([words.of(i).tobytes() for i in range(b - a)], pa.binary())})


def _met(cell: pa.Table) -> pa.Table:
    """Pairs of a cell's train and held-out classes that may be near copies: all that are, and few others."""
    cell = cell.combine_chunks()
    held = cell.column("held").to_numpy()
    sides = []
    for which in (False, True):
        rows = cell.filter(pa.array(held == which)).combine_chunks()
        lists = rows.column("first").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        words = np.asarray(lists.flatten()).view(np.uint64)
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, SUM_BITS // 64)
        sides.append((rows.column("c1").to_numpy(), rows.column("n").to_numpy().astype(np.int64), words, np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))].astype(np.int64), bits))
    (c1, n, words, offsets, bits), (c1_h, n_h, words_h, offsets_h, bits_h) = sides
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(c1) and len(c1_h):
        order = np.argsort(words, kind="stable")
        owner = np.repeat(np.arange(len(c1)), np.diff(offsets))[order]
        low, high = np.searchsorted(words[order], words_h, "left"), np.searchsorted(words[order], words_h, "right")
        needed = np.minimum(DEPTH, _least(n))
        for k in range(len(c1_h)):
            runs = [owner[i:j] for i, j in zip(low[offsets_h[k] : offsets_h[k + 1]].tolist(), high[offsets_h[k] : offsets_h[k + 1]].tolist()) if i < j]
            if not runs:
                continue
            at = np.flatnonzero(np.bincount(np.concatenate(runs), minlength=len(c1)) >= np.minimum(needed, min(DEPTH, int(_least(n_h[k])))))
            size = n[at]
            large = np.maximum(size, n_h[k])
            at = at[(4 * np.minimum(size, n_h[k]) >= 3 * large) & (c1[at] != c1_h[k]) & (np.bitwise_count(bits[at] ^ bits_h[k]).sum(axis=1) <= size + n_h[k] - 2 * _least(large))]
            if len(at):
                found.append((c1[at], np.full(len(at), c1_h[k])))
    a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, dtype=np.int64) for i in range(2))
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _cells(classes: DataFrame) -> DataFrame:
    """The classes once for every cell that they belong to; a cell is a part of the train and a part of the held-out texts of two near sizes."""
    banded = classes.withColumn("band", F.lit(len(BANDS)) - F.size(F.filter(F.array(*map(F.lit, BANDS)), lambda low: low > F.col("n"))))
    sides = banded.withColumn("held", F.explode(F.when(F.col("side") == 3, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.col("side") == 2))))
    parts = {(r["band"], r["held"]): -(-r["words"] // CELL_WORDS[1 + r["held"]]) for r in sides.groupBy("band", "held").agg(F.sum("n").alias("words")).collect()}
    meets = [(x, held, parts[x, held], y, parts[y, not held]) for x, held in parts for y in (x - 1, x, x + 1) if (y, not held) in parts]
    if not meets:
        return sides.limit(0).select("c1", "n", "first", "bits", "held", F.lit("").alias("cell"))
    plan = classes.sparkSession.createDataFrame(meets, "band int, held boolean, own int, other int, others int")
    met = sides.join(F.broadcast(plan), ["band", "held"]).withColumn("part", F.pmod(F.xxhash64("c1"), F.col("own"))).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    mine, other = F.concat_ws(".", "band", "part"), F.concat_ws(".", "other", "theirs")
    cell = F.when(F.col("held"), F.concat_ws("/", other, mine)).otherwise(F.concat_ws("/", mine, other))
    return met.select("c1", "n", "first", "bits", "held", cell.alias("cell"))


def common_in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = places.get(x, 0) & row
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = []
        for x, y in zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist()):
            x, y = np.frombuffer(x, dtype=np.uint64).tolist(), np.frombuffer(y, dtype=np.uint64).tolist()
            shared.append(common_in_order(x, y) / max(len(x), len(y)))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "coverage": pa.array(shared, pa.float64())})


def split_side(split: Column) -> Column:
    """1 train, 2 dev or test, null else."""
    name = F.lower(F.trim(split))
    return F.when(name == "train", 1).when(name.isin("dev", "test"), 2).cast("int")


def word_order(rows: DataFrame) -> np.ndarray:
    """By bucket of words: its place in the common order, from the words of all texts; ``rows`` have side and text.

    The driver gets a row a bucket, however many texts there are.
    """
    counts = rows.select("side", "text").mapInArrow(_counted, "bucket long, train long, held long").groupBy("bucket").agg(F.sum("train").alias("train"), F.sum("held").alias("held")).toPandas()
    rank = np.zeros(1 << RANK_BITS, dtype=np.float32)
    rank[counts["bucket"].to_numpy(dtype=np.int64)] = np.log1p(counts["train"].to_numpy(dtype=np.float64)) + np.log1p(counts["held"].to_numpy(dtype=np.float64))
    return rank


def _linked(df: DataFrame, id: str, split: str, text: str, coverage: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, coverage) of classes across splits, and the members (c1, c2, side, id) of linked and of mixed classes."""
    if coverage < 0.75:
        raise ValueError("the filter is made for a coverage of 0.75 or more")
    spark = df.sparkSession
    stage = Stage(spark, "overlaps")
    rows = df.select(F.col(id).cast("string").alias("id"), split_side(F.col(split)).alias("side"), F.col(text).alias("text")).where("id IS NOT NULL AND side IS NOT NULL AND text IS NOT NULL")
    classes = stage.put(
        rows.select("side", "text")
        .mapInArrow(_fingerprint(word_order(rows)), "c1 long, c2 long, side int, n int, first array<long>, bits binary")
        .where("n > 0")
        .groupBy("c1", "c2")
        .agg(F.bit_or("side").alias("side"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("bits").alias("bits"))
    )
    tested = stage.put(_cells(classes).groupBy("cell").applyInArrow(_met, "a long, b long").distinct())
    ids = tested.select(F.explode(F.array("a", "b")).alias("c1")).distinct()
    few = ids.count()
    # a source row of each class: the class is recomputed, so that no text is kept twice
    texts = rows.select("text").mapInArrow(_words_of, "c1 long, words binary").join(sized(ids, few), "c1", "left_semi").dropDuplicates(["c1"])
    texts = stage.put(texts)
    x, y = (texts.select(F.col("c1").alias(k), F.col("words").alias(f"words_{k}")) for k in "ab")
    links = stage.put(tested.join(x, "a").join(y, "b").mapInArrow(_compare, "a long, b long, coverage double").where(F.col("coverage") >= coverage))

    members = rows.mapInArrow(_fingerprint(None), "c1 long, c2 long, side int, n int, id string").where("n > 0").select("c1", "c2", "side", "id")
    linked = links.select(F.explode(F.array("a", "b")).alias("c1")).union(classes.where("side = 3").select("c1")).distinct()
    members = stage.put(members.join(sized(linked, linked.count()), "c1", "left_semi").distinct())
    return links, members


def split_overlaps(df: DataFrame, *, id: str = "id", split: str = "split", text: str = "text", coverage: float = 0.75) -> DataFrame:
    """(id_a, id_b, coverage): pairs of a train and a dev or test record that are the same or nearly so.

    coverage is the part of the longer text's words that stand in the other in
    the same order; pairs below ``coverage`` (not under 0.75) are left out.
    Rows of another split, of a null id or without words give no pairs; repeated
    rows count once; a text is read whole.  Columns of ``df`` beyond the three
    named are not touched.  An empty table gives no rows.
    """
    links, members = _linked(df, id, split, text, coverage)
    a, b = members.toDF("a", "a2", "side_a", "x"), members.toDF("b", "b2", "side_b", "y")
    alike = links.join(a, "a").join(b, "b").where("side_a <> side_b AND x <> y").select("x", "y", "coverage")
    same = members.where("side = 1").select("c1", "c2", F.col("id").alias("x")).join(members.where("side = 2").select("c1", "c2", F.col("id").alias("y")), ["c1", "c2"]).where("x <> y").select("x", "y", F.lit(1.0).alias("coverage"))
    return alike.union(same).groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("coverage").alias("coverage"))


def overlapping_records(df: DataFrame, *, id: str = "id", split: str = "split", text: str = "text", coverage: float = 0.75) -> DataFrame:
    """(id, class, side, others, coverage): each record that occurs on the other side, and how often.

    The same cases as ``split_overlaps``, a row a record in place of a row a
    pair, so that many copies on both sides cost no more than their number.
    ``class`` is the same for exact copies; side is train or held_out.
    """
    links, members = _linked(df, id, split, text, coverage)
    own = members.groupBy("c1").agg(F.count_if(F.col("side") == 1).alias("train"), F.count_if(F.col("side") == 2).alias("held"))
    both = links.select(F.col("a").alias("c1"), F.col("b").alias("other"), "coverage").union(links.select("b", "a", "coverage"))
    near = both.join(own.toDF("other", "near_train", "near_held"), "other").groupBy("c1").agg(F.sum("near_train").alias("near_train"), F.sum("near_held").alias("near_held"), F.max("coverage").alias("near"))
    per = own.join(near, "c1", "left").na.fill(0)
    rows = members.join(per, "c1")
    on_train = F.col("side") == 1
    same = F.when(on_train, F.col("held")).otherwise(F.col("train"))
    out = rows.select("id", F.hex("c1").alias("class"), F.when(on_train, "train").otherwise("held_out").alias("side"), (same + F.when(on_train, F.col("near_held")).otherwise(F.col("near_train"))).alias("others"), F.when(same > 0, 1.0).otherwise(F.col("near")).alias("coverage"))
    return out.where("others > 0")
