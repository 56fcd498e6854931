"""Mixing sources to target shares of the tokens, with capped repeats.

Every document has a soft membership in the domains: one for its label, where
it has one, else the posterior of a classifier trained on the labelled ones.
Documents with the same membership and cap are one cell.  Nonnegative rates,
how often a document is used on average, are fitted by projected gradient least
squares, so that the expected tokens of each domain meet its target: each
iteration is one pass over the cells, of which the driver sees one sum a
domain.  Rates become whole repeats by filling each domain with documents in
hash order up to the wanted tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.staging import BROADCAST_BYTES, Stage
from tessera.llm.blocks import Words, slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern that goes with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Hashed words the classifier counts by domain; with the number of domains, the bound of its table.
WORD_BUCKETS = 1 << 13
#: Hash buckets of a domain whose tokens are added up before any single document is placed.
PLACES = 4096
#: Documents of a domain that are added at last to fill what is left of its goal.
TOP_UPS = 3


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, id: str, text: str, domain: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, domain, tokens): the size of each text in tokens; a null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "domain": batch.column("domain"), "tokens": pa.array(counts, pa.int64())})

    rows = df.where(F.col(id).isNotNull()).select(F.col(id).alias("doc_id"), F.col(domain).cast("string").alias("domain"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(df.dtypes)[id]}, domain string, tokens long")


# ---- soft membership of unlabelled documents ----


def _counts(domains: list[str]):
    number = {d: k for k, d in enumerate(domains)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(domains), WORD_BUCKETS), dtype=np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            of = np.array([number[d] for d in batch.column("domain").to_pylist()], dtype=np.int64)
            for a, b in slices(texts):
                words = Words(texts[a:b])
                bucket = (words.hash >> np.uint64(51)).astype(np.int64)
                total += np.bincount(of[a:b][words.text] * WORD_BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        k, w = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "w": pa.array(w, pa.int32()), "n": pa.array(total[k, w], pa.int64())})

    return run


def word_model(labelled: DataFrame, domains: list[str]) -> np.ndarray:
    """Log-probabilities (domains, WORD_BUCKETS + 1) of a multinomial model over all labelled (domain, text) rows; the last column is the prior."""
    rows = labelled.where(F.col("domain").isin(*domains) & F.col("text").isNotNull())
    table = np.full((len(domains), WORD_BUCKETS), 0.5)
    for r in rows.select("domain", "text").mapInArrow(_counts(domains), "k int, w int, n long").groupBy("k", "w").agg(F.sum("n").alias("n")).collect():  # at most domains * WORD_BUCKETS rows
        table[r["k"], r["w"]] += r["n"]
    prior = table.sum(axis=1)
    return np.c_[np.log(table / prior[:, None]), np.log(prior / prior.sum())]


def posteriors(df: DataFrame, model: np.ndarray, id: str, text: str, steps: int = 20) -> DataFrame:
    """(doc_id, p: array<double>): the domains' posteriors, in whole parts of 1 / steps, so that there are few different ones."""
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                words = Words(texts[a:b])
                bucket = (words.hash >> np.uint64(51)).astype(np.int64)
                out = []
                for i in range(b - a):
                    # words of a text repeat their topic: their evidence is tempered by the root of their number
                    mine = bucket[words.offsets[i] : words.offsets[i + 1]]
                    score = table[:, mine].sum(axis=1) / max(1.0, np.sqrt(len(mine))) + table[:, -1]
                    p = np.exp(score - score.max())
                    p = np.round(p / p.sum() * steps)
                    out.append((p / p.sum()).tolist())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a), "p": pa.array(out, pa.list_(pa.float64()))})

    return df.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(df.dtypes)[id]}, p array<double>")


# ---- rates ----


def _rates(p: np.ndarray, cap: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates of cells after the projected steps so far; every step depends on the domains only."""
    rate = np.zeros(len(cap))
    for g in steps:
        rate = np.clip(rate - p @ g, 0.0, cap)
    return rate


def fit_rates(cells: DataFrame, target: np.ndarray, iterations: int = 200, tolerance: float = 1e-9) -> list[np.ndarray]:
    """Projected gradient steps for cells (p, cap, tokens), whose expected tokens a domain shall be ``target``.

    The gradient of the squared misses is scaled by the domain's tokens, so that
    one step length fits domains of any size.
    """
    context = cells.sparkSession.sparkContext
    n = len(target)

    def sums(steps: list[np.ndarray]) -> np.ndarray:
        known = context.broadcast(steps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, whole = np.zeros(n), np.zeros(n)
            for batch in batches:
                p = np.array(batch.column("p").to_pylist(), dtype=float).reshape(-1, n)
                tokens = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)
                rate = _rates(p, batch.column("cap").to_numpy(zero_copy_only=False), known.value)
                now += (rate * tokens) @ p
                whole += tokens @ (p * p)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(n), pa.int32()), "now": pa.array(now), "whole": pa.array(whole)})

        out = np.zeros((2, n))
        for r in cells.select("p", "cap", "tokens").mapInArrow(run, "k int, now double, whole double").groupBy("k").agg(F.sum("now").alias("now"), F.sum("whole").alias("whole")).collect():
            out[:, r["k"]] = r["now"], r["whole"]
        known.unpersist()
        return out

    steps: list[np.ndarray] = []
    for _ in range(iterations):
        now, whole = sums(steps)
        miss = now - target
        if np.abs(miss).max() <= tolerance * max(1.0, target.sum()):
            break
        step = np.where(whole > 0, miss / np.where(whole > 0, whole, 1.0), 0.0)
        if steps and np.abs(step).max() < 1e-12:
            break
        steps.append(step)
    return steps


def mixture(documents: DataFrame, targets: DataFrame, *, id: str = "doc_id", text: str = "text", domain: str = "source", tokenizer: str = TOKENIZER, total_tokens: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, domain, tokens, repeats) of every document, and (domain, target_share, reachable_share, cap).

    ``targets`` has (source, target_share, max_repeats), one row a domain; its
    size is that of a report.  A domain without tokens, repeats or share can't
    be had: the others' shares grow in proportion (reachable_share).  The total
    is the largest at which every reachable share can be met within the caps,
    or ``total_tokens`` if that is less.  A document of a labelled domain that
    has no target gets 0 repeats; one without a label (null or blank) is used
    for the domains its text looks like.  Null targets count as 0, repeated
    target rows once.  Empty documents or targets give 0 repeats all over.
    """
    spark = documents.sparkSession
    stage = Stage(spark, "mixing")
    label = F.when(F.trim(F.col(domain)) != "", F.col(domain))
    docs = documents.select(F.col(id), F.col(text), label.alias("domain"))
    sizes = stage.put(with_tokens(docs, id, text, "domain", tokenizer))
    wanted = {r["source"]: (max(0.0, r["share"] or 0.0), max(0, r["cap"] or 0)) for r in targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()}
    names = sorted(wanted)
    spot = {d: k for k, d in enumerate(names)}
    n = len(names)
    place = F.create_map(*(F.lit(x) for d, k in spot.items() for x in (d, k)))[F.col("domain")] if names else F.lit(None).cast("int")
    one_hot = F.when(place.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda k: (k == place).cast("double")))
    rows = sizes.where("domain IS NOT NULL").withColumn("p", one_hot)
    if names and sizes.where("domain IS NULL").limit(1).count():
        model = word_model(docs.select("domain", F.col(text).alias("text")), names)
        soft = posteriors(docs.where("domain IS NULL"), model, id, text)
        rows = rows.unionByName(sizes.where("domain IS NULL").join(soft, "doc_id"))
    caps = F.array(*(F.lit(float(wanted[d][1])) for d in names)) if names else F.lit(None).cast("array<double>")
    cap = F.array_min(F.transform(F.arrays_zip(F.col("p").alias("p"), caps.alias("c")), lambda x: F.when(x["p"] > 0, x["c"])))
    rows = rows.where("p IS NOT NULL").withColumn("cap", cap)
    cells = stage.put(rows.groupBy("p", "cap").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
    room = np.zeros(n)
    if names:
        expected = [F.sum(F.col("p")[k] * F.col("tokens") * F.col("cap")).alias(str(k)) for k in range(n)]
        room = np.array([x or 0.0 for x in cells.agg(*expected).first()], dtype=float)
    share = np.array([wanted[d][0] for d in names]) * (room > 0)
    reach = share / share.sum() if share.sum() > 0 else share
    total = min((r / s for r, s in zip(room, reach) if s > 0), default=0.0)
    if total_tokens is not None:
        total = min(total, total_tokens)
    target = reach * total
    steps = fit_rates(cells, target) if total > 0 else []

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array(batch.column("p").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            rate = _rates(p, batch.column("cap").to_numpy(zero_copy_only=False), steps)
            hard = p.max(axis=1) == 1.0
            yield pa.RecordBatch.from_pydict({"p": batch.column("p"), "cap": batch.column("cap"), "rate": pa.array(np.where(np.abs(rate - np.round(rate)) < 1e-9, np.round(rate), rate)), "hard": pa.array(hard), "best": pa.array(p.argmax(axis=1), pa.int32()), "all": batch.column("tokens")})

    rates = stage.put(cells.select("p", "cap", "tokens").mapInArrow(rated, "p array<double>, cap double, rate double, hard boolean, best int, all long"))
    n_rates = rates.count()
    small = F.broadcast(rates) if n_rates * (n + 8) * 8 <= BROADCAST_BYTES else rates
    used = rows.join(small, ["p", "cap"])
    base, part = F.floor("rate").cast("int"), F.col("rate") - F.floor("rate")
    h = F.xxhash64("doc_id")
    used = used.select("doc_id", "domain", "tokens", "hard", "best", base.alias("base"), part.alias("part"), h.alias("h"), F.pmod(h, F.lit(PLACES)).alias("place"), (part * F.col("all")).alias("goal"))
    used = stage.put(used)
    buckets = used.where("hard").groupBy("best", "place").agg(F.sum("tokens").alias("n"), F.first("goal").alias("goal"))
    ahead = lambda what, *by: F.coalesce(F.sum(what).over(Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("ahead", ahead("n", ["best"], ["place"]))
    # whole buckets are in or out; only the one in which the goal lies is looked into
    edge = buckets.where("ahead <= goal AND ahead + n > goal").select("best", "place", "ahead")
    inside = used.where("hard").join(F.broadcast(edge), ["best", "place"]).withColumn("ahead", F.col("ahead") + ahead("tokens", ["best", "place"], ["h", "doc_id"]))
    fits = inside.where(F.col("ahead") + F.col("tokens") <= F.col("goal")).select("doc_id", F.lit(1).alias("more"))
    cut = F.broadcast(edge.select("best", F.col("place").alias("edge")))
    chance = (F.col("h") / F.lit(2.0**64)) + 0.5
    more = F.when(~F.col("hard"), (chance < F.col("part")).cast("int")).when(F.col("part") == 0, 0).when(F.col("edge").isNull() | (F.col("place") < F.col("edge")), 1).when(F.col("place") == F.col("edge"), F.coalesce("more", F.lit(0))).otherwise(0)
    placed = stage.put(used.join(cut, "best", "left").join(fits, "doc_id", "left").withColumn("more", more).drop("edge"))
    # what is left of each domain's goal is filled with the largest documents that fit, a few times
    chosen: list = []
    for _ in range(TOP_UPS):
        lack = {r["best"]: r["goal"] - r["now"] for r in placed.where("hard AND part > 0").groupBy("best").agg(F.first("goal").alias("goal"), F.sum(F.col("tokens") * F.col("more")).alias("now")).collect()}
        for r in chosen:
            lack[r["best"]] -= r["tokens"]
        if not lack:
            break
        room_left = F.broadcast(spark.createDataFrame(list(lack.items()), "best int, lack double"))
        free = placed.where("hard AND part > 0 AND more = 0 AND tokens > 0")
        if chosen:
            free = free.where(~F.col("doc_id").isin([r["doc_id"] for r in chosen]))
        picks = free.join(room_left, "best").where("tokens <= lack").groupBy("best").agg(F.max(F.struct("tokens", "doc_id")).alias("x")).select("best", "x.tokens", "x.doc_id").collect()  # one row a domain
        if not picks:
            break
        chosen += picks
    more = F.when(F.col("doc_id").isin([r["doc_id"] for r in chosen]), 1).otherwise(F.col("more")) if chosen else F.col("more")
    repeats = placed.select("doc_id", (F.col("base") + more).cast("int").alias("repeats"))
    every = sizes.join(repeats, "doc_id", "left").select("doc_id", "domain", "tokens", F.coalesce("repeats", F.lit(0)).alias("repeats"))
    limits = spark.createDataFrame([(d, wanted[d][0], float(reach[k]), wanted[d][1]) for d, k in spot.items()], "domain string, target_share double, reachable_share double, cap int")
    return every, limits


def shares(mixed: DataFrame, limits: DataFrame) -> DataFrame:
    """What each domain came to: documents, tokens, tokens used and their share of all used, most repeats."""
    got = mixed.groupBy("domain").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    total = got.agg(F.sum("used_tokens").alias("total"))
    both = got.join(limits, "domain", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.crossJoin(F.broadcast(total)).select("domain", "target_share", "reachable_share", "cap", zero("documents").alias("documents"), zero("tokens").alias("tokens"), zero("used_tokens").alias("used_tokens"), F.coalesce(F.try_divide(zero("used_tokens"), "total"), F.lit(0.0)).alias("actual_share"), zero("most_repeats").alias("most_repeats"))
