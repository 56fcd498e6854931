"""Broken prompt and response pairs, by ordered rules.

The rules run in the order of ``DEFECTS``; every one that applies is reported.
An answer may be plain text, JSON, JSON in a fence, or either of them broken
off.  The wording that the rules judge is the rationale of the JSON, or the
plain text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFECTS = ("empty_answer", "truncated_answer", "refusal", "copied_question", "other_language")

#: Members of a JSON answer that hold its wording, the first present one counts.
WORDING = ("rationale", "answer", "response", "explanation", "text", "content")
#: Marks that stand where an answer should be, compared without case, blanks and punctuation.
FILLERS = frozenset("na none null nil nan tbd todo tba xxx unknown notapplicable notavailable noanswer blank empty 无 暂无 没有 略 空 不适用 未填 待补 未提供 ka keine keineangabe entfällt leer ninguno ninguna nada noaplica sindatos sd vacío".split())

_INVISIBLE = re.compile(r"[­​-‏⁠-⁤﻿]")
_FENCE = re.compile(r"^```[^\n`]*\n?")
_TOKEN = re.compile(r"[㐀-鿿豈-﫿]|[^\W_㐀-鿿豈-﫿]+")
_LETTER = re.compile(r"[^\W\d_]")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_END = re.compile(r"[.!?。！？…．؟][\s\"'”’»›」』)\]）】}*_`]*$")
_SAID = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|»[^«]*«|「[^」]*」|『[^』]*』|《[^》]*》|\"[^\"]*\"|\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|【[^【】]*】|`[^`]*`")
_OPEN = {"(": ")", "（": "）", "“": "”", "«": "»", "「": "」", "『": "』", "【": "】", "[": "]", "{": "}"}

#: Refusals: a speaker who will not or may not answer.  Evidence that cannot settle a claim is none.
REFUSALS = re.compile(
    r"""
    \b(?:i|we)(?:\s+am|'m|’m|\s+are)?\s+(?:really\s+|truly\s+|afraid\s+(?:that\s+)?i\s+)?(?:cannot|can\s?not|can['’]t|could\s+not|unable|not\s+able|not\s+allowed|not\s+permitted|won['’]t|will\s+not)\s+
        (?:to\s+|be\s+able\s+to\s+)*(?:help|assist|comply|answer|respond|provide|give|offer|evaluate|assess|judge|review|fulfil|fulfill|discuss|continue|engage|take\s+part|do\s+(?:that|this))\b
    | \b(?:can['’]t|cannot|won['’]t(?:\s+be\s+able\s+to)?)\s+(?:help|assist|comply)\b
    | \b(?:must|have\s+to|will|would)\s+(?:respectfully\s+|politely\s+)?(?:decline|refuse)\b
    | \bi\s+(?:respectfully\s+|politely\s+)?(?:decline|refuse)\b
    | \b(?:i['’]d|i\s+would)\s+(?:rather|prefer)\s+not\b
    | \b(?:don['’]t|do\s+not)\s+feel\s+comfortable\b | \bnot\s+comfortable\s+(?:with\s+)?(?:giving|answering|judging|assessing|providing)
    | \bas\s+an?\s+(?:ai|artificial|language\s+model)\b
    | \boutside\s+(?:of\s+)?(?:what\s+i\s+am\s+allowed|my\s+(?:remit|scope|abilities|capabilities))
    | \bagainst\s+my\s+(?:guidelines|policy|policies|rules)\b | \bno\s+(?:verdict|answer)\s+will\s+be\s+given\b
    | (?:我|本人|本助手|在下)[^。！？]{0,8}(?:无法|不能|不便|不会|不可以|难以|拒绝|不愿)[^。！？]{0,8}(?:回答|提供|协助|帮助|继续|评价|评估|作答|作出|满足|处理|讨论|完成|从命)
    | 恕[^。！？]{0,6}(?:不|难|无法)[^。！？]{0,6}(?:作答|奉告|从命|回答|提供|判断|评价)
    | 超出了?(?:我|本人|本助手)的?(?:能力|权限|职责) | 作为(?:一个|一名)?(?:人工智能|AI|语言模型)[^。！？]{0,12}(?:不能|无法|不便)
    | (?:拒绝|谢绝)(?:回答|提供|评估|评价|作答) | 请换一个(?:话题|问题)
    | \b(?:kann|darf|möchte|werde|will)\b[^.!?]{0,50}\b(?:nicht|keine?n?)\b[^.!?]{0,40}\b(?:helfen|beantworten|abgeben|beurteilen|bewerten|unterstützen|weiterhelfen|erfüllen|antworten)\b
    | \bich\b[^.!?]{0,40}\blehne\b | \b(?:muss|möchte)\b[^.!?]{0,40}\bablehnen\b | \bals\s+ki\b | \bnicht\s+(?:in\s+der\s+lage|befugt)\b[^.!?]{0,40}\b(?:helfen|beantworten|abgeben|beurteilen|bewerten)
    | \bno\s+(?:puedo|podemos|me\s+es\s+posible|podré|debo|quiero|estoy\s+autorizad[oa]|soy\s+capaz)\b[^.!?]{0,30}\b(?:ayudar\w*|responder\w*|contestar\w*|evaluar\w*|valorar\w*|juzgar\w*|opinar\w*|cumplir\w*|atender\w*|proporcionar\w*|ofrecer\w*|dar\b|asistir\w*|continuar\w*)
    | \b(?:debo|tengo\s+que)\s+(?:negarme|rechazar|declinar)\b | \bme\s+niego\b | \bprefiero\s+no\b | \bcomo\s+(?:modelo\s+de|inteligencia\s+artificial|una?\s+ia)\b | \bfuera\s+de\s+mis\s+(?:funciones|capacidades)
    """,
    re.IGNORECASE | re.VERBOSE,
)

#: One of these is in every refusal, so that most answers need no pattern.
REFUSAL_SIGNS = tuple(
    "cannot,can not,can't,can’t,could not,unable,not able,not allowed,not permitted,won't,won’t,will not,decline,refuse,rather not,prefer not,comfortable,as an ai,as a ai,as an artificial,as a artificial,as a language,as an language,outside,against my,no verdict,no answer,"
    "无法,不能,不便,不会,不可以,难以,拒绝,不愿,恕,超出,作为,谢绝,请换一个,nicht,kein,lehn,als ki,"
    "no puedo,no podemos,no me es,no podré,no debo,no quiero,no estoy,no soy,negarme,rechazar,declinar,niego,prefiero no,como modelo,como inteligencia,como un,fuera de".split(",")
)


def refuses(text: str) -> bool:
    """Whether a speaker declines to answer."""
    low = " ".join(text.lower().split())
    return any(sign in low for sign in REFUSAL_SIGNS) and REFUSALS.search(text) is not None


#: Scripts that tell a language, or a family, by themselves.
SCRIPTS = {
    "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽἀ-῿", "arabic": "؀-ۿ", "hebrew": "֐-׿", "devanagari": "ऀ-ॿ", "thai": "฀-๿", "hangul": "가-힣ᄀ-ᇿ", "kana": "぀-ヿ",
}
_SCRIPTS = {name: re.compile(f"[{chars}]") for name, chars in SCRIPTS.items()}
_OTHER_SCRIPTS = re.compile(f"[{''.join(SCRIPTS.values())}]")

#: Frequent small words, by language; a text's language is that of most of them.  Of the last four, only words that the others do not have.
SMALL_WORDS = {
    "en": frozenset("a the of and in to is was were with by at for from that this not but no nor neither it its as on after before than under only had has have does do which whether when while between during whereas could any be been are or an so".split()),
    "de": frozenset("der die das und ist war wurde wurden mit von im in den dem des ein eine einer einem einen nicht auf für zu bei nach unter durch dass ob kein keine hat haben wir sich als auch nur aber oder jedoch zwar noch weder während ohne dadurch schon es werden wird".split()),
    "es": frozenset("el la los las de del y en que se no con por para un una es fue al lo su sus como más ni sin pero entre hasta desde si sobre tras antes después vimos medimos o ha han está esta este son cuando donde también a".split()),
    "fr": frozenset("le les des du et est une dans pour pas avec qui ne sont ont été cette ces aux mais nous je il elle sur dont ainsi très où être".split()),
    "it": frozenset("il gli della delle di che è non sono nel nella alla dei degli questo questa stato anche più dopo perché".split()),
    "pt": frozenset("não uma dos das ao é são com em os pela pelo foram também após mas seu sua isso mais".split()),
    "nl": frozenset("het een van niet zijn voor met bij ook maar werd wordt deze dat naar geen heeft wij ik".split()),
}


_WORDS = re.compile(r"[^\W\d_]+")
_SPANISH, _GERMAN = re.compile(r"ñ|ción$|[áíóú]"), re.compile(r"ß|[äöü]")
#: The languages of each small word.
_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _name, _small in SMALL_WORDS.items():
    for _w in _small:
        _LANGUAGES[_w] = (*_LANGUAGES.get(_w, ()), _name)


def language(text: str) -> str | None:
    """The language or script of a text; null where it says too little."""
    if not text.isascii() and len(_OTHER_SCRIPTS.findall(text)) >= 4:
        letters = len(_LETTER.findall(text))
        for name, signs in _SCRIPTS.items():
            if (n := len(signs.findall(text))) >= 4 and 2 * n >= letters:
                return name
    han = len(_HAN.findall(text)) if not text.isascii() else 0
    words = _WORDS.findall((_HAN.sub(" ", text) if han else text).lower())
    if han >= 4 and han >= 1.2 * len(words):
        return "zh"
    counts = dict.fromkeys(SMALL_WORDS, 0)
    for w in words:
        for name in _LANGUAGES.get(w, ()):
            counts[name] += 1
        if not w.isascii():
            counts["es"] += _SPANISH.search(w) is not None
            counts["de"] += _GERMAN.search(w) is not None or w.endswith(("ung", "ungen"))
        elif w.endswith(("ung", "ungen")):
            counts["de"] += 1
    best = max(counts, key=lambda k: counts[k])
    rest = max(v for k, v in counts.items() if k != best)
    return best if counts[best] >= 2 and counts[best] > rest else None


def _unfence(text: str) -> tuple[str, bool]:
    """The text without a fence around it, and whether a fence is left open."""
    if not text.startswith("```"):
        return text, False
    body = _FENCE.sub("", text, count=1)
    at = body.rfind("```")
    return (body, True) if at < 0 else (body[:at].strip(), False)


def wording(text: str) -> tuple[str | None, bool]:
    """The judged wording of an answer (null: none is there), and whether its form breaks off."""
    body, open_fence = _unfence(text)
    body = body.strip()
    if open_fence:
        return body, True
    if body[:1] in ("{", "[", '"') or body == "null":
        try:
            value = json.loads(body)
        except (ValueError, RecursionError):
            if body[0] == "{" or re.match(r"\[\s*[\[{\"]", body):
                return body, True
            return body, False
        while isinstance(value, list) and value:
            value = value[0]
        if isinstance(value, dict):
            value = next((value[k] for k in WORDING if k in value), None)
        return (value if isinstance(value, str) else None), False
    return body, False


def _readable(body: str) -> str:
    """The wording that can be read from an answer whose JSON or fence breaks off; empty if none can."""
    if body[:1] not in ("{", "[", '"'):
        return body
    said, broken = wording(body)
    if not broken:
        return said or ""
    for name in WORDING:
        if found := re.search(rf'"{name}"\s*:\s*"((?:[^"\\]|\\.)*)', body, re.DOTALL):
            try:
                return json.loads('"' + re.sub(r"\\u[0-9a-fA-F]{0,3}$", "", found[1]) + '"', strict=False)
            except ValueError:
                return found[1]
    return ""


def _covered(part: list[str], whole: list[str], least: int = 3) -> int:
    """How many tokens of ``part`` lie in runs of ``least`` or more that ``whole`` has too."""
    places: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(whole) - least + 1):
        places.setdefault(tuple(whole[i : i + least]), []).append(i)
    covered, i = 0, 0
    while i + least <= len(part):
        longest = 0
        for j in places.get(tuple(part[i : i + least]), ()):
            n = least
            while i + n < len(part) and j + n < len(whole) and part[i + n] == whole[j + n]:
                n += 1
            longest = max(longest, n)
        covered += longest
        i += longest or 1
    return covered


def defects(prompt: str | None, answer: str | None) -> list[str]:
    """The defects of one pair, in the order of the rules."""
    text = _INVISIBLE.sub("", answer or "").strip()
    said, broken = wording(text) if text else (None, False)
    bare = re.sub(r"[\W_]+", "", said or "").lower()
    if not broken and (not bare or bare in FILLERS):
        return ["empty_answer"]
    if broken:
        said = _readable(said)
        if re.sub(r"[\W_]+", "", said).lower() in FILLERS | {""}:
            return ["truncated_answer"]
    said = said.strip()
    out = []
    if broken or not _END.search(said) or any(said.count(o) > said.count(c) for o, c in _OPEN.items()):
        out.append("truncated_answer")
    own = _SAID.sub(" ", said)
    if refuses(own):
        out.append("refusal")
    tokens = _TOKEN.findall(said.lower())
    asked = _TOKEN.findall((prompt or "").lower())
    if len(tokens) >= 3 and _covered(tokens, asked) >= len(tokens) - max(1, len(tokens) // 20):
        out.append("copied_question")
    here, there = language(own), language(prompt or "")
    if here and there and here != there:
        out.append("other_language")
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [defects(p, a) for p, a in zip(batch.column("prompt").to_pylist(), batch.column("answer").to_pylist())]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "defects": pa.array(found, pa.list_(pa.string()))})


def broken_pairs(df: DataFrame, id: str, prompt: Column, answer: Column) -> DataFrame:
    """(id, defects): the pairs with a defect and all the defects that their rules find, in order.

    A null answer is empty; a null prompt has no language and nothing to copy.
    Rows of a null id are left out; repeated rows count once.  An empty table
    gives no rows.
    """
    rows = df.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("id"), prompt.alias("prompt"), answer.alias("answer"))
    return rows.mapInArrow(_judge, "id string, defects array<string>").where(F.size("defects") > 0).dropDuplicates(["id"])
