import json

import pytest
from pyspark.sql import functions as F

from tessera.llm.pairs import broken_pairs, defects, language

PROMPT = "Claim: Loss of OPA1 doubled the peak width in MIN6 clusters.\nEvidence: The peak width was not changed in any of the clusters.\nQuestion: Does the evidence support the claim?"
GOOD = "The claim contradicts the reported direction of change in the clusters."


def answer(rationale, **more):
    return json.dumps({"labels": {"evidence_support": "mixed"}, "rationale": rationale, **more}, ensure_ascii=False)


@pytest.mark.parametrize(
    "text, expected",
    [
        (GOOD, []),
        (answer(GOOD), []),
        (f"```json\n{answer(GOOD)}\n```", []),
        (None, ["empty_answer"]),
        ("  \n​", ["empty_answer"]),
        ("{}", ["empty_answer"]),
        ("[]", ["empty_answer"]),
        ("null", ["empty_answer"]),
        ('""', ["empty_answer"]),
        (answer(None), ["empty_answer"]),
        (answer(" n/a "), ["empty_answer"]),
        (answer("无"), ["empty_answer"]),
        (answer(GOOD)[:-20], ["truncated_answer"]),
        (f"```json\n{answer(GOOD)}", ["truncated_answer"]),
        (answer("The claim contradicts the repor"), ["truncated_answer"]),
        (answer("The claim was read and the evidence is (at least"), ["truncated_answer"]),
        ("I'm sorry, but I can't help with that request.", ["refusal"]),
        ("Ich darf dazu keine Einschätzung abgeben.", ["refusal", "other_language"]),
        (answer("I cannot infer causality from this association, so the claim is too strong."), []),
        (answer("The evidence cannot settle the claim, since no intervention was made."), []),
        ("Claim: Loss of OPA1 doubled the peak width in MIN6 clusters. Question: Does the evidence support the claim?", ["copied_question"]),
        (answer("LOSS OF OPA1 doubled the peak width in MIN6 clusters."), ["copied_question"]),
        (answer("“Loss of OPA1 doubled the peak width in MIN6 clusters.” " + GOOD), []),
        (answer("La afirmación contradice la dirección del cambio que se vio en los islotes."), ["other_language"]),
        (answer("“主张与所报告的变化方向相反。” " + GOOD), []),
    ],
)
def test_defects(text, expected):
    assert defects(PROMPT, text) == expected


def test_no_prompt_and_long_text():
    assert defects(None, GOOD) == []
    assert defects("", "word " * 200_000) == ["truncated_answer"]


def test_language():
    assert [language(x) for x in ("The wording matches the passage and its limits.", "Die Richtung stimmt überein, das Modell jedoch nicht.", "La dirección coincide, pero el modelo es distinto.", "仅部分支持：剂量相符，时间窗不符。", "OPA1")] == ["en", "de", "es", "zh", None]


def test_more_languages_and_scripts():
    texts = {"fr": "Les données ne sont pas suffisantes pour cette conclusion.", "it": "Gli autori non sono certi della direzione del cambiamento.", "pt": "A direção não é a mesma e os dados são insuficientes.", "nl": "De richting is niet juist en het model wordt niet genoemd.", "cyrillic": "Вывод не подтверждается данными опыта.", "kana": "この結果は仮説を支持していません。", "hangul": "이 결과는 가설을 뒷받침하지 않습니다.", "arabic": "النتائج لا تدعم هذا الادعاء."}
    assert {k: language(t) for k, t in texts.items()} == {k: k for k in texts}
    assert all(defects(PROMPT, t) == ["other_language"] for t in texts.values())


def test_table(spark):
    rows = [("a", PROMPT, GOOD, 1), ("b", PROMPT, None, 2), ("b", PROMPT, None, 3), (None, PROMPT, None, 4), ("c", None, "{", 5)]
    df = spark.createDataFrame(rows, "id string, prompt string, answer string, defects int")
    got = {r["id"]: list(r["defects"]) for r in broken_pairs(df, "id", F.col("prompt"), F.col("answer")).collect()}
    assert got == {"b": ["empty_answer"], "c": ["truncated_answer"]}
    assert broken_pairs(df.limit(0), "id", F.col("prompt"), F.col("answer")).count() == 0


def test_broken_answers_keep_their_other_defects():
    asked = "Does the evidence support the claim that insulin secretion was reduced in these islets?"
    broken = lambda said: '{"labels": {"evidence_support": "mixed"}, "rationale": "' + said
    assert defects(asked, broken("I cannot help with this request.")) == ["truncated_answer", "refusal"]
    assert defects(asked, "```json\n" + broken('I cannot help with this request."}')) == ["truncated_answer", "refusal"]
    assert defects(asked, "```\nI cannot help with this request.") == ["truncated_answer", "refusal"]
    assert defects(asked, broken("Does the evidence support the claim that insulin secretion was reduced")) == ["truncated_answer", "copied_question"]
    assert defects(asked, broken("Der Befund wurde nicht mit der Messung verglichen und ist daher unklar \\u00")) == ["truncated_answer", "other_language"]
    assert defects(asked, '{"labels": {"evidence_support": "mi') == defects(asked, broken("")) == ["truncated_answer"]


def test_every_refusal_has_a_sign():
    """The quick look before the patterns lets none of them by."""
    from tessera.llm.pairs import REFUSALS, refuses

    said = ["I am unable to help", "We can\tnot\nassist", "I won't be able to comply", "I must respectfully decline", "I refuse", "I'd rather not", "I do not feel comfortable", "As an AI model", "as a language model", "That is outside my scope", "It is against my guidelines", "No verdict will be given", "我无法回答", "恕难从命", "超出了我的能力", "作为人工智能，我不能", "拒绝回答", "请换一个话题", "Das kann ich nicht beantworten", "Ich lehne das ab", "Ich möchte das ablehnen", "Als KI", "Ich bin nicht befugt, das zu beurteilen", "No puedo ayudar", "No me es posible responder", "Debo negarme", "Me niego", "Prefiero no opinar", "Como modelo de lenguaje", "Como una IA", "Fuera de mis funciones"]
    assert all(REFUSALS.search(t) and refuses(t) for t in said)
