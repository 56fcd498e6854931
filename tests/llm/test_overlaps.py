import random

import numpy as np
import pytest

from tessera.llm import overlaps
from tessera.llm.blocks import Words
from tessera.llm.overlaps import common_in_order, overlapping_records, split_overlaps


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_in_order_like_the_textbook():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(20))] for _ in range(2))
        assert common_in_order(a, b) == lcs(a, b)


def brute(rows):
    import re

    words = {i: re.findall(r"[一-鿿]|[^\W_一-鿿]+", (t or "").lower()) for i, s, t in rows}
    side = {i: s for i, s, t in rows}
    out = set()
    for i in words:
        for j in words:
            if i < j and {side[i], side[j]} in ({"train", "dev"}, {"train", "test"}) and words[i] and words[j]:
                if lcs(words[i], words[j]) >= 0.75 * max(len(words[i]), len(words[j])):
                    out.add((i, j))
    return out


def found(df):
    return {(r["id_a"], r["id_b"]) for r in split_overlaps(df).collect()}


def fixture(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.choice((3, 6, 9, 20, 60, 120)))]
        rows.append([f"r{k:03d}", rng.choice(("train", "dev", "test")), text])
    for k in range(n):  # near copies: up to a fifth of the words changed, or a part moved
        base = rng.choice(rows[:n])
        text = list(base[2])
        for _ in range(int(len(text) * rng.choice((0, 0.05, 0.1, 0.15, 0.2)))):
            text[rng.randrange(len(text))] = rng.choice(("x", "y", "zz"))
        if rng.random() < 0.2:
            text = text[len(text) // 2 :] + text[: len(text) // 2]
        rows.append([f"s{k:03d}", rng.choice(("train", "dev", "test")), text])
    return [(i, s, rng.choice((" ", ", ", "\n")).join(t).upper() if rng.random() < 0.3 else " ".join(t)) for i, s, t in rows]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_like_brute_force(spark, seed):
    rows = fixture(seed)
    assert found(spark.createDataFrame(rows, "id string, split string, text string").repartition(5)) == brute(rows)


def test_crowds_of_copies_and_near_copies(spark):
    base = [f"w{k}" for k in range(50)]
    rows = [(f"c{n:03d}", "train" if n % 3 else "dev", " ".join(base)) for n in range(45)]
    for n in range(45):  # each differs from the others in one word
        text = list(base)
        text[n] = f"own{n}"
        rows.append((f"n{n:03d}", "train" if n % 4 else "test", " ".join(text)))
    assert found(spark.createDataFrame(rows, "id string, split string, text string")) == brute(rows)


def test_records_are_the_pairs_counted(spark):
    rows = fixture(4) + [(f"c{n}", "train" if n % 2 else "test", "copied text of a few words") for n in range(30)]
    df = spark.createDataFrame(rows, "id string, split string, text string")
    side = {i: s for i, s, _ in rows}
    want = {}
    for pair in found(df):
        for i in pair:
            want[i] = want.get(i, 0) + 1
    got = overlapping_records(df).collect()
    assert {r["id"]: r["others"] for r in got} == want
    assert all((r["side"] == "train") == (side[r["id"]] == "train") and 0.75 <= r["coverage"] <= 1 for r in got)
    assert len({r["class"] for r in got if r["id"].startswith("c")}) == 1
    assert overlapping_records(df.limit(0)).count() == 0


def test_chinese_every_character_is_a_word(spark):
    a = "葡萄糖为时峰值时间升至小时后回到基线缺少的干细胞来源胰岛中蛋白导入失去偶联"
    rows = [("a", "train", a), ("b", "dev", a[:10] + "其" + a[10:20] + "而" + a[21:] + "。"), ("c", "test", a[::-1])]
    assert found(spark.createDataFrame(rows, "id string, split string, text string")) == {("a", "b")}


def test_nulls_empty_long_repeated_and_extra_columns(spark):
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [("a", "train", long, 1), ("b", "dev", long + " end", 2), ("b", "dev", long + " end", 3), ("c", "dev", "", 4), ("d", "train", "", 5), ("e", "dev", None, 6), (None, "train", long, 7), ("f", None, long, 8), ("g", "other", long, 9), ("h", "TRAIN ", "...", 10)]
    df = spark.createDataFrame(rows, "id string, split string, text string, c1 int")
    assert found(df) == {("a", "b")}
    assert split_overlaps(df.limit(0)).count() == 0


def test_crowds_of_templates_with_edits_every_eight_to_ten_words(spark):
    rng = random.Random(11)
    rows = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(70)]
        for n in range(24):  # every seed of the template stands in more than 16 texts
            text, k = list(base), rng.randrange(8)
            while k < len(text):
                text[k] = f"own{family}x{n}y{k}"
                k += rng.randrange(8, 11)
            rows.append((f"t{family}{n:03d}", "train" if n % 3 else "dev", " ".join(text)))
    want = brute(rows)
    assert len(want) > 200
    assert found(spark.createDataFrame(rows, "id string, split string, text string").repartition(3)) == want


@pytest.mark.parametrize("n", [20, 60, 100, 240])
def test_evenly_spaced_edits_down_to_three_quarters(spark, n):
    rows, want = [], set()
    for k, coverage in enumerate((0.75, 0.76, 0.78, 0.8)):
        base = [f"b{k}w{i}" for i in range(n)]
        edits = n - -(-int(coverage * 100) * n // 100)
        changed = {i * n // edits for i in range(edits)}
        swapped = [f"e{k}w{i}" if i in changed else w for i, w in enumerate(base)]
        apart = [w for i, w in enumerate(base) if i not in changed]  # words left out here, others put in elsewhere
        for i in sorted(changed, reverse=True):
            apart.insert(min(len(apart), i * len(apart) // n + 1), f"o{k}w{i}")
        rows += [(f"a{k}", "train", " ".join(base)), (f"b{k}", "dev", " ".join(swapped)), (f"c{k}", "test", " ".join(apart))]
        want |= {(f"a{k}", f"b{k}"), (f"a{k}", f"c{k}")}
    less = [f"x{i}" if i % 4 == 0 or i == 1 else f"b0w{i}" for i in range(n)]
    rows.append(("d", "dev", " ".join(less)))
    assert brute(rows) == want
    assert found(spark.createDataFrame(rows, "id string, split string, text string")) == want


def test_the_order_counts_the_words_of_every_text(spark, monkeypatch):
    rows = [(f"r{k}", "train" if k % 3 else "dev", f"own{k} shared words of all") for k in range(40)]
    ranks, inner = [], overlaps._fingerprint
    monkeypatch.setattr(overlaps, "_fingerprint", lambda rank: (rank is not None and ranks.append(rank)) or inner(rank))
    split_overlaps(spark.createDataFrame(rows, "id string, split string, text string").repartition(4))
    want = np.zeros((2, 1 << overlaps.RANK_BITS))
    for _, split, text in rows:
        np.add.at(want[int(split == "dev")], overlaps._bucket(overlaps._bag(Words([text]))[0]), 1)
    assert np.allclose(ranks[0], np.log1p(want[0]) + np.log1p(want[1]))
