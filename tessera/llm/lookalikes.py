"""One form for texts that look alike but differ in their characters.

Look-alike characters are mapped to one of them, characters that cannot be seen
are taken out, and what is left is grouped in SQL under the accent-sensitive
Unicode collation, in which a letter with a combining accent equals the
composed letter.  Signs that have a meaning of their own beside their look (a
sharp s, an alpha) are mapped for the grouping alone and stay in the form.  The
shortest text of a class, which is composed if any is, is its form, joined back
to every member.  All of it is built-in expressions; hot classes are joined as one row a
class on one side.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.staging import Stage

# Letters and signs of other scripts that look like the Latin (or, in the last row, Greek) one below them.
LOOKALIKES = (
    ("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ", "ABESIJKMHOPCTYXaeopcyxsijhdqw"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"),
    ("‐‑−‒˗⁃﹣", "-------"),
    ("ӀǀıӏƖ", "IIilI"),
    ("∆µΩ", "ΔμΩ"),
)

# Letters that look like the letter below them in most types, but may be meant as they are.
AMBIGUOUS = (
    ("ßϐ", "ββ"),
    ("αɑɡικρτυ", "aagikptu"),
    ("кмтѵ", "kmtv"),
    ("օսհոցզ", "ouhngq"),
    ("ᎠᎡᎪᎬᎳᎶᎷᎻᏀᏂᏃᏒᏙᏚᏞᏟᏢᏤᏦᏴ", "DRAEWGMHGhZRVSLCPVKB"),
)

#: Characters that cannot be seen, as ranges of a character class.
INVISIBLE = r"­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿"
#: Kinds of blank, beyond the ASCII one.
BLANKS = r"\t   -   　"


@lru_cache(maxsize=1)
def character_map() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to) of single characters, and the pairs of a character and its several.

    By rule: the wide, narrow and single compatibility forms that Unicode gives
    for a character that is drawn the same (radicals, ligatures), and then the
    look-alikes above.  Superscripts, fractions, circled and styled signs look
    different and stay.
    """
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in [*range(0xA0, 0x3400), *range(0xF900, 0x10000)]:
        form = unicodedata.decomposition(chr(code)).split()
        if not form:
            continue
        if form[0] in ("<wide>", "<narrow>") or form[0] == "<compat>" and len(form) == 2:
            to = "".join(chr(int(x, 16)) for x in form[1:])
        elif form[0] == "<compat>" and 0xFB00 <= code <= 0xFB06:
            to = "".join(chr(int(x, 16)) for x in form[1:])
        elif not form[0].startswith("<") and len(form) == 1:
            to = chr(int(form[0], 16))
        else:
            continue
        if to.isspace():
            continue
        (single if len(to) == 1 else several)[chr(code)] = to
    alike = {a: b for seen, as_ in LOOKALIKES for a, b in zip(seen, as_, strict=True)}
    single |= alike
    single = {a: alike.get(b, b) for a, b in single.items()}
    return "".join(single), "".join(single.values()), tuple(several.items())


def mapped(text: Column) -> Column:
    """``text`` with look-alikes mapped, blanks made one kind and what cannot be seen taken out."""
    seen, as_, several = character_map()
    out = F.regexp_replace(F.regexp_replace(text, f"[{INVISIBLE}]", ""), f"[{BLANKS}]", " ")
    long = out
    for a, b in several:
        long = F.replace(long, F.lit(a), F.lit(b))
    out = F.when(out.rlike(f"[{''.join(a for a, _ in several)}]"), long).otherwise(out)
    return F.translate(out, seen, as_)


def skeleton(form: Column) -> Column:
    """What a mapped text looks like: signs that may be meant as they are mapped too."""
    return F.translate(form, "".join(a for a, _ in AMBIGUOUS), "".join(b for _, b in AMBIGUOUS))


def _plain(form: Column) -> Column:
    """A hash of the part of a text that no accent touches: texts equal under the collation have the same, few others do."""
    return F.xxhash64(F.regexp_replace(form, r"[^\x09-\x0d\x20-\x7e\x{3400}-\x{9fff}]\p{M}*|[\x20-\x7e]\p{M}+", ""))


def one_form(df: DataFrame, field: str, text: str) -> DataFrame:
    """``df`` with ``canonical`` (the one form of its text) and ``variants`` (how many different texts have it).

    Texts are compared within a ``field``.  The canonical member is the shortest of
    the mapped texts of its class, of these the least by bytes.  A null
    text has a null form and no variants; other columns are kept as they are,
    but for those two names, which are replaced.

    Only looks that others share the plain part with can equal another under the
    collation; the rest are classes of their own and need no comparison.
    """
    spark = df.sparkSession
    kept = df.drop("canonical", "variants")
    texts = kept.where(F.col(text).isNotNull()).select(F.col(field).alias("_field"), F.col(text).alias("_text")).distinct().withColumn("_mapped", mapped(F.col("_text")))
    texts = texts.withColumn("_look", skeleton(F.col("_mapped"))).withColumn("_plain", _plain(F.col("_look")))
    # mapped once, as three plans read it; a mapped text that is its look is kept once
    stage = Stage(spark, "lookalikes")
    texts = stage.put(texts.withColumn("_mapped", F.nullif("_mapped", F.col("_look")))).withColumn("_mapped", F.coalesce("_mapped", "_look"))
    looks = texts.groupBy("_field", "_plain", "_look").agg(F.min(F.struct(F.char_length("_mapped").alias("n"), F.col("_mapped").alias("form"))).alias("best"), F.count("*").alias("texts"))
    looks = stage.put(looks.withColumn("crowd", F.count("*").over(Window.partitionBy("_field", "_plain"))))
    forms = spark.sql(
        """
        WITH looks AS (SELECT *, collate(_look, 'UNICODE') AS alike FROM {looks} WHERE crowd > 1),
        classes AS (SELECT _field, _plain, alike, min(best).form AS canonical, sum(texts) AS variants FROM looks GROUP BY _field, _plain, alike)
        SELECT looks._field, looks._plain, looks._look, classes.canonical, classes.variants
        FROM looks JOIN classes ON looks._field <=> classes._field AND looks._plain = classes._plain AND looks.alike = classes.alike
        UNION ALL SELECT _field, _plain, _look, best.form, texts FROM {looks} WHERE crowd = 1
        """,
        looks=looks,
    )
    formed = texts.alias("t").join(forms.alias("f"), F.col("t._field").eqNullSafe(F.col("f._field")) & (F.col("t._plain") == F.col("f._plain")) & (F.col("t._look") == F.col("f._look")))
    formed = formed.select("t._field", "t._text", "f.canonical", "f.variants")
    return kept.alias("d").join(formed.alias("f"), F.col(f"d.{field}").eqNullSafe(F.col("f._field")) & (F.col(f"d.{text}") == F.col("f._text")), "left").select("d.*", "f.canonical", F.coalesce("f.variants", F.lit(0).cast("long")).alias("variants"))
