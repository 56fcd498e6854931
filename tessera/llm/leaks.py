"""Held-out passages inside a corpus, by greedy string tiling.

The runs of ``min_words`` words of the held-out texts are the seeds; a corpus
text that shares one is tiled against the held-out text: all longest common
runs are found from the shared seeds (Karp-Rabin hashes), the longest is marked
in both, and so on with what stays unmarked, so that a passage whose parts come
in another order is still covered.  The corpus is read once, in place; only
seeds that occur in a held-out text leave the block they were found in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.staging import Stage
from tessera.llm.blocks import Words, slices

MIN_WORDS = 12
#: For languages written without blanks a token is a letter, digit or ideograph.
MIN_CHARS = 30
#: Held-out characters that may be sent to every task; more are joined by their seeds.
ITEM_CHARS = 16_000_000

_OUT = "doc_id {id}, item_id string, longest int, covered int, item_size int"


def tile(a: np.ndarray, b: np.ndarray, matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length) out of maximal common runs."""
    queue = sorted(matches, key=lambda m: (-m[2], m[0], m[1]))
    free_a, free_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    while queue:
        i, j, n = queue.pop(0)
        free = free_a[i : i + n] & free_b[j : j + n]
        if free.all():
            tiles.append((i, j, n))
            free_a[i : i + n] = False
            free_b[j : j + n] = False
            continue
        edge = np.flatnonzero(np.diff(np.r_[0, free.astype(np.int8), 0]))
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= least:
                queue.append((i + int(s), j + int(s), int(e - s)))
        queue.sort(key=lambda m: (-m[2], m[0], m[1]))
    return tiles


def common_runs(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The maximal common runs through pairs of equal places, each once."""
    seen: dict[int, int] = {}
    out = []
    for i, j in sorted(places):
        d = i - j
        if seen.get(d, -1) > i:
            continue
        s = 0
        while i - s > 0 and j - s > 0 and a[i - s - 1] == b[j - s - 1]:
            s += 1
        n = min(len(a) - i, len(b) - j)
        unlike = np.flatnonzero(a[i : i + n] != b[j : j + n])
        e = int(unlike[0]) if len(unlike) else n
        seen[d] = i + e
        out.append((i - s, j - s, s + e))
    return out


class _Seeds:
    """The held-out texts' tokens and seeds for one kind of token."""

    def __init__(self, items: list[tuple[str, list[str]]], least: int, per_char: bool):
        self.least, self.per_char = least, per_char
        self.ids = [i for i, texts in items for _ in texts]
        words = Words([t for _, texts in items for t in texts] or [None], han_single=False, per_char=per_char)
        self.words, self.size = words, np.diff(words.offsets)
        grams, at = words.grams(least)
        order = np.argsort(grams, kind="stable")
        self.grams, self.at = grams[order], at[order]
        self.item_size: dict[str, int] = {}
        for i, n in zip(self.ids, self.size):
            self.item_size[i] = self.item_size.get(i, 0) + int(n)

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, str, int, int, int]]:
        """(number of the text, item, longest run, tokens of the item covered, tokens of the item)."""
        if not len(self.grams):
            return
        words = Words(texts, han_single=False, per_char=self.per_char)
        grams, at = words.grams(self.least)
        low, high = np.searchsorted(self.grams, grams), np.searchsorted(self.grams, grams, "right")
        hit = np.flatnonzero(high > low)
        pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for h in hit:
            t = int(words.text[at[h]])
            for x in self.at[low[h] : high[h]]:
                piece = int(self.words.text[x])
                pairs.setdefault((t, piece), []).append((int(at[h] - words.offsets[t]), int(x - self.words.offsets[piece])))
        sums: dict[tuple[int, str], list[int]] = {}
        for (t, piece), places in pairs.items():
            a, b = words.of(t), self.words.of(piece)
            tiles = tile(a, b, common_runs(a, b, places), self.least)
            if tiles:
                best = sums.setdefault((t, self.ids[piece]), [0, 0])
                best[0] = max(best[0], *(n for _, _, n in tiles))
                best[1] += sum(n for _, _, n in tiles)
        for (t, item), (longest, covered) in sums.items():
            yield t, item, longest, covered, self.item_size[item]


#: Bits in which the seeds of many held-out texts are noted, so that other seeds of the corpus stay where they are.
SEED_BITS = 27
_CHUNK_BITS = 16


def _among(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set: all that were noted, and some others."""
    spot = (grams >> np.uint64(64 - SEED_BITS)).astype(np.int64)
    return np.flatnonzero((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)


def _bits(seeds: DataFrame) -> np.ndarray:
    """The bits of all seeds, 2 ** SEED_BITS of them (16 MB) however many there are; put together by chunks on the executors."""

    def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            spot = batch.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - SEED_BITS)
            for c in np.unique(spot >> np.uint64(_CHUNK_BITS)).tolist():
                mine = chunks.setdefault(c, np.zeros(1 << _CHUNK_BITS, dtype=bool))
                mine[(spot[spot >> np.uint64(_CHUNK_BITS) == c] & np.uint64((1 << _CHUNK_BITS) - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(chunks), pa.int64()), "bits": pa.array([np.packbits(x, bitorder="little").tobytes() for x in chunks.values()], pa.binary())})

    def joined(part: pa.Table) -> pa.Table:
        whole = np.zeros(1 << (_CHUNK_BITS - 3), dtype=np.uint8)
        for raw in part.column("bits").to_pylist():
            whole |= np.frombuffer(raw, dtype=np.uint8)
        return pa.table({"chunk": part.column("chunk").slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    out = np.zeros(1 << (SEED_BITS - 3), dtype=np.uint8)
    size = 1 << (_CHUNK_BITS - 3)
    for r in seeds.select("seed").mapInArrow(noted, "chunk long, bits binary").groupBy("chunk").applyInArrow(joined, "chunk long, bits binary").collect():  # 2 ** (SEED_BITS - _CHUNK_BITS) rows of 8 kB at most
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def _columns(rows: list[tuple], ids: pa.Array) -> dict[str, pa.Array]:
    t, item, longest, covered, size = zip(*rows)
    return {"doc_id": ids.take(pa.array(t, pa.int64())), "item_id": pa.array(item, pa.string()), "longest": pa.array(longest, pa.int32()), "covered": pa.array(covered, pa.int32()), "item_size": pa.array(size, pa.int32())}


def _best(rows: list[tuple]) -> list[tuple]:
    """One row a text and item, of the kind of token that covers more of the item."""
    out: dict[tuple, tuple] = {}
    for row in rows:
        old = out.get(row[:2])
        if old is None or row[3] * old[4] > old[3] * row[4]:
            out[row[:2]] = row
    return list(out.values())


def text_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    lang: str = "lang",
    passages: Sequence[str] = ("passage", "question"),
    min_words: int = MIN_WORDS,
    min_chars: int = MIN_CHARS,
    char_langs: Sequence[str] = ("zh",),
    min_coverage: float = 0.0,
    item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """(doc_id, item_id, longest, covered, item_size): texts that hold part of a held-out item.

    A leak is a run of at least ``min_words`` words of one of the item's
    ``passages``, or of ``min_chars`` letters, digits and ideographs for items
    whose ``lang`` is in ``char_langs``.  covered and item_size are in those
    tokens; ``min_coverage`` keeps items covered to that part at least.  Null and
    empty texts hold nothing; an item of null id is left out; repeated items and
    rows count once a (doc_id, item_id).  Every document is read whole.
    """
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), F.col(lang).alias("lang"), *(F.col(p).alias(f"p{k}") for k, p in enumerate(passages))).distinct()
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = _OUT.format(id=dict(docs.dtypes)["doc_id"])
    pieces = range(len(passages))
    total = rows.select(sum((F.coalesce(F.length(f"p{k}"), F.lit(0)) for k in pieces), F.lit(0)).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    kinds = ((min_words, False), (min_chars, True))

    def chosen(row, per_char: bool) -> list[str]:
        return [row[f"p{k}"] for k in pieces if row[f"p{k}"]] if not per_char or row["lang"] in char_langs else []

    if total <= item_chars:
        held = [r.asDict() for r in rows.collect()]  # proven to be within item_chars
        known = documents.sparkSession.sparkContext.broadcast([[(r["item_id"], chosen(r, per_char)) for r in held if chosen(r, per_char)] for _, per_char in kinds])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = [_Seeds(found, least, per_char) for found, (least, per_char) in zip(known.value, kinds)]
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for a, b in slices(texts):
                    hits = _best([row for s in seeds for row in s.leaks(texts[a:b])])
                    if hits:
                        yield pa.RecordBatch.from_pydict(_columns(hits, batch.column("doc_id").slice(a, b - a)))

        out = docs.mapInArrow(scan, schema)
    else:
        def seeds_of(column: str, kind: int, bits: Broadcast | None = None):
            least, per_char = kinds[kind]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    texts = batch.column("text").to_pylist()
                    for a, b in slices(texts):
                        words = Words(texts[a:b], han_single=False, per_char=per_char)
                        grams, at = words.grams(least)
                        if bits is not None:
                            kept = _among(bits.value, grams)
                            grams, at = grams[kept], at[kept]
                        both = np.unique(np.stack([grams.view(np.int64), words.text[at].astype(np.int64)]), axis=1)
                        yield pa.RecordBatch.from_pydict({column: batch.column(column).slice(a, b - a).take(pa.array(both[1])), "seed": pa.array(both[0])})

            return run

        stage = Stage(documents.sparkSession, "leaks")
        candidates = None
        for kind, (_, per_char) in enumerate(kinds):
            some = rows.where(F.col("lang").isin(*char_langs)) if per_char else rows
            flat = some.select("item_id", F.explode(F.array(*(F.col(f"p{k}") for k in pieces))).alias("text")).where("text IS NOT NULL")
            item_seeds = stage.put(flat.mapInArrow(seeds_of("item_id", kind), "item_id string, seed long").distinct())
            bits = documents.sparkSession.sparkContext.broadcast(_bits(item_seeds))
            doc_seeds = docs.mapInArrow(seeds_of("doc_id", kind, bits), f"doc_id {dict(docs.dtypes)['doc_id']}, seed long")
            pairs = doc_seeds.join(item_seeds, "seed").select("doc_id", "item_id")
            candidates = pairs if candidates is None else candidates.union(pairs)
        full = candidates.distinct().join(docs, "doc_id").join(rows, "item_id")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, row in enumerate(batch.to_pylist()):
                    hits = _best([hit for least, per_char in kinds if chosen(row, per_char) for hit in _Seeds([(row["item_id"], chosen(row, per_char))], least, per_char).leaks([row["text"]])])
                    if hits:
                        yield pa.RecordBatch.from_pydict(_columns(hits, batch.column("doc_id").slice(n, 1)))

        out = full.mapInArrow(compare, schema)
    best = F.max_by(F.struct("longest", "covered", "item_size"), F.struct(F.col("covered") / F.col("item_size"), "longest"))
    return out.where(F.col("covered") >= F.lit(min_coverage) * F.col("item_size")).groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")
