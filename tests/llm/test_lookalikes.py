import random
import unicodedata

from tessera.llm.lookalikes import AMBIGUOUS, one_form


def forms(spark, texts):
    df = spark.createDataFrame([("q", t, 7) for t in texts], "field string, text string, form int")
    return {r["text"]: (r["canonical"], r["variants"]) for r in one_form(df, "field", "text").collect()}


def test_same_looks_are_one(spark):
    alike = ["naïve β-cell", "naïve β-cell", "ｎａïｖｅ β-cell", "na​ïve β-cell", "naïvе β‑cell"]
    got = forms(spark, alike)
    assert {v for v in got.values()} == {("naïve β-cell", 5)}


def test_wording_case_digits_and_accents_count(spark):
    got = forms(spark, ["naive cell", "naïve cell", "Naive cell", "naive cell 2", "naive cell²", "naive  cell", ""])
    assert len({v[0] for v in got.values()}) == 7 and {v[1] for v in got.values()} == {1}


def test_radicals_ligatures_and_increment(spark):
    got = forms(spark, ["⼀种 ﬂow ∆ψ", "一种 flow Δψ"])
    assert len({v[0] for v in got.values()}) == 1


def test_nulls_copies_long_and_empty(spark):
    long = "ａ" * 100_000
    df = spark.createDataFrame([(None, "x"), ("f", None), ("f", long), ("f", long), (None, "ｘ")], "field string, text string")
    rows = one_form(df, "field", "text").collect()
    assert len(rows) == 5
    assert sorted((r["variants"], (r["canonical"] or "")[:2]) for r in rows) == [(0, ""), (1, "aa"), (1, "aa"), (2, "x"), (2, "x")]
    assert one_form(df.limit(0), "field", "text").count() == 0


# The test's own signs, not the program's: each looks like the key it stands under.
SAME = {"a": "аａα", "c": "сｃϲ", "e": "еｅ", "g": "ɡｇ", "h": "һｈ", "i": "іｉι", "j": "јϳ", "k": "кｋκ", "o": "оοօｏ", "p": "рｐρ", "s": "ѕｓ", "t": "тｔτ", "v": "νѵｖ", "x": "хｘ", "y": "уｙ", "A": "АΑᎪＡ", "B": "ВΒＢ", "C": "СＣᏟ", "E": "ЕΕＥ", "H": "НΗＨ", "K": "КΚＫ", "M": "МΜＭ", "N": "ΝＮ", "O": "ОΟＯ", "P": "РΡＰ", "T": "ТΤＴ", "X": "ХΧＸ", "1": "１", "2": "２", "9": "９", "-": "‐‑−－", " ": "\u00a0\u2007\u202f\u3000\u2009", "β": "ß", "μ": "µ", "Δ": "∆", "一": "⼀", "人": "⼈", ",": "，", "(": "（", "?": "？"}
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def test_recall_of_changed_texts(spark):
    """400 texts, each in three changed forms: all are found again, and no two texts fall together."""
    rng = random.Random(3)
    words = "Across hex panels the β-cell batch reads naïvely as a cliché rôle of μM doses (KCNJ11, 29) in Δψm 一批 人胰岛 más señal größer?".split(" ")
    texts = {" ".join(rng.choices(words, k=9)) + f" no {k}" for k in range(400)}
    rows = [(t, t) for t in texts]
    for t in texts:
        for _ in range(3):
            new = "".join(rng.choice(SAME[c]) if c in SAME and rng.random() < 0.3 else c for c in t)
            new = unicodedata.normalize("NFD", new) if rng.random() < 0.3 and not any(c in new for c in "⼀⼈") else new
            at = rng.randrange(len(new))
            rows.append((new[:at] + rng.choice(UNSEEN) + new[at:], t))
    df = spark.createDataFrame([("q", x, t) for x, t in rows], "field string, text string, base string")
    got = one_form(df, "field", "text").select("base", "canonical").distinct().collect()
    assert len(got) == len(texts) == len({r["canonical"] for r in got})


def test_meant_signs_stay_in_the_form(spark):
    got = forms(spark, ["groß", "α-helix", "β-cell"])
    assert {t: v[0] for t, v in got.items()} == {"groß": "groß", "α-helix": "α-helix", "β-cell": "β-cell"}
    assert all(len(a) == len(b) for a, b in AMBIGUOUS)
