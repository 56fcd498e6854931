import random
import re

import pytest

from tessera.llm.suffixes import LEAST, shared_spans


def brute(rows):
    """covered and longest of each held-out record, by comparing all runs of all texts."""
    words = {i: re.findall(r"[一-鿿]|[^\W_一-鿿]+", (t or "").lower()) for i, s, t in rows}
    side = {i: 1 if s == "train" else 2 for i, s, t in rows}
    grams = {1: set(), 2: set()}
    whole = {1: set(), 2: set()}
    for i, w in words.items():
        grams[side[i]] |= {tuple(w[k : k + LEAST]) for k in range(len(w) - LEAST + 1)}
        whole[side[i]].add(tuple(w))
    out = {}
    for i, w in words.items():
        if not w or side[i] == 1:
            continue
        on = [False] * len(w)
        for k in range(len(w) - LEAST + 1):
            if tuple(w[k : k + LEAST]) in grams[3 - side[i]]:
                on[k : k + LEAST] = [True] * LEAST
        if tuple(w) in whole[3 - side[i]]:
            on = [True] * len(w)
        longest = max((len(x) for x in "".join("x" if o else " " for o in on).split()), default=0)
        out[i] = (len(w), sum(on), longest)
    return out


def got(df, **kw):
    return {r["id"]: (r["words"], r["covered"], r["longest"]) for r in shared_spans(df, **kw).collect()}


@pytest.mark.parametrize("seed, part", [(1, 40), (2, 7), (3, 100_000)])
def test_coverage_like_brute_force(spark, seed, part):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)]
    rows = []
    for k in range(50):
        text = [rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 8, 30, 90)))]
        if k and rng.random() < 0.6:  # a part of an earlier text, and sometimes all of it
            other = rng.choice(rows)[2].split()
            at = rng.randrange(len(other))
            text = text[:5] + other[at : at + rng.choice((4, 6, 60))] + text[5:] if rng.random() < 0.8 else other
        rows.append((f"r{k:02d}", rng.choice(("train", "dev", "test")), " ".join(text)))
    assert got(spark.createDataFrame(rows, "id string, split string, text string").repartition(4), part=part) == brute(rows)


def test_runs_longer_than_the_window_and_hot_texts(spark):
    long = " ".join(f"v{k}" for k in range(3000))
    rows = [("a", "train", long), ("b", "dev", "x " + long + " y")] + [(f"c{k}", "train" if k % 2 else "test", f"own{k} all of these start in one way but end as {k}") for k in range(300)]
    want = brute(rows)
    assert want["b"] == (3002, 3000, 3000)
    assert got(spark.createDataFrame(rows, "id string, split string, text string"), part=50) == want


def test_nulls_empty_and_repeated(spark):
    rows = [("a", "train", "one two three four five six"), ("b", "dev", None), ("c", "dev", ""), (None, "dev", "one two three four five six"), ("d", None, "one two three four five six"), ("e", "test", "zero one two three four five"), ("e", "test", "zero one two three four five"), ("f", "dev", "one two"), ("g", "TRAIN", "one two")]
    df = spark.createDataFrame(rows, "id string, split string, text string")
    assert got(df) == {"e": (6, 5, 5), "f": (2, 2, 2)}
    assert got(df.limit(0)) == {} and got(df.where("split = 'train'")) == {} and got(df.where("split = 'test'")) == {"e": (6, 0, 0)}


def test_even_edits_share_no_span(spark):
    """Why pairs are not found this way: three quarters of the words in order, and no run of five."""
    base = [f"w{k}" for k in range(80)]
    rows = [("a", "train", " ".join(base)), ("b", "dev", " ".join(f"e{k}" if k % 4 == 3 else w for k, w in enumerate(base)))]
    assert got(spark.createDataFrame(rows, "id string, split string, text string")) == {"b": (80, 0, 0)}
