import random
import re

import numpy as np
import pytest

from tessera.llm.leaks import common_runs, text_leaks, tile

WORD = re.compile(r"[^\W_]+")
ITEMS = "item_id string, lang string, passage string, question string, doc_id int"


def brute(docs, items, words=12, chars=30):
    out = set()
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        c = "".join(w)
        grams = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
        for item, lang, *texts, _ in items:
            for t in texts:
                v = WORD.findall((t or "").lower())
                if any(tuple(v[i : i + words]) in grams for i in range(len(v) - words + 1)):
                    out.add((d, item))
                s = "".join(v)
                if lang == "zh" and any(s[i : i + chars] in c for i in range(len(s) - chars + 1)):
                    out.add((d, item))
    return out


def fixture(seed):
    rng = random.Random(seed)
    v = [f"w{k}" for k in range(60)]
    han = "胰岛细胞线粒体钙外流膜电位荧光葡萄糖显示改变之后回到基线"
    items = []
    for k in range(20):
        zh = k % 3 == 0
        text = "".join(rng.choice(han) for _ in range(90)) if zh else " ".join(rng.choice(v) for _ in range(50))
        items.append((f"i{k}", "zh" if zh else "en", text, None if k % 4 else " ".join(rng.choice(v) for _ in range(14)), k))
    docs = []
    for d in range(80):
        _, lang, passage, _, _ = rng.choice(items)
        if lang == "zh":
            a = rng.randrange(60)
            part = passage[a : a + rng.choice((20, 29, 30, 31, 60))]
            docs.append((d, "前文" + part[:7] + "，" + part[7:] + "。后文"))
        else:
            words = passage.split()
            a = rng.randrange(30)
            docs.append((d, " ".join(rng.choice(v) for _ in range(9)) + " | " + ", ".join(words[a : a + rng.choice((6, 11, 12, 13, 40))]).upper() + " ... tail"))
    return docs + [(900, None), (901, "")], items


@pytest.mark.parametrize("item_chars", [10**9, 0])
def test_pairs_like_brute_force(spark, item_chars):
    docs, items = fixture(3)
    got = text_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, ITEMS), item_chars=item_chars).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert all(0 < r["longest"] <= r["covered"] <= r["item_size"] for r in got)


def test_reordered_parts_are_covered(spark):
    words = [f"t{k}" for k in range(40)]
    moved = " ".join(words[20:] + ["between"] + words[:20])
    row = text_leaks(spark.createDataFrame([(1, moved)], "doc_id long, text string"), spark.createDataFrame([("i", "en", " ".join(words), None, 1)], ITEMS)).first()
    assert (row["longest"], row["covered"], row["item_size"]) == (20, 40, 40)


def test_tiles_do_not_overlap():
    a, b = np.array([1, 2, 3, 4, 5, 1, 2, 3]), np.array([1, 2, 3, 4, 1, 2, 3, 4, 5])
    runs = common_runs(a, b, [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]])
    tiles = tile(a, b, runs, 2)
    assert tiles[0] == (0, 4, 5) and sum(n for *_, n in tiles) == 8


def test_long_text_copies_and_empty_tables(spark):
    words = " ".join(f"t{k}" for k in range(15))
    docs = spark.createDataFrame([(1, "x " * 300_000 + words), (1, "x " * 300_000 + words), (None, words)], "doc_id long, text string")
    items = spark.createDataFrame([("i", None, words, None, 1), ("i", None, words, None, 1), (None, "en", words, None, 2)], ITEMS)
    assert [(r["doc_id"], r["item_id"]) for r in text_leaks(docs, items).collect()] == [(1, "i")]
    assert text_leaks(docs.limit(0), items).count() == 0 and text_leaks(docs, items.limit(0)).count() == 0


def test_noted_seeds_are_all_found_and_few_others(spark):
    from tessera.llm.leaks import _among, _bits

    rng = np.random.default_rng(2)
    seeds, others = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 20_000)
    bits = _bits(spark.createDataFrame([(int(x),) for x in seeds], "seed long").repartition(5))
    assert len(_among(bits, seeds.view(np.uint64))) == len(seeds)
    assert len(_among(bits, others.view(np.uint64))) < 20
    assert not _bits(spark.createDataFrame([], "seed long")).any()
