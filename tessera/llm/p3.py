"""Problem 3: questions and conflicts in one consistent form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.lookalikes import AMBIGUOUS, character_map, one_form
from tessera.session import table


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pilot_5_questions").where("question_id IS NOT NULL")
    questions = rows.select(F.lit("question").alias("field"), "question_id", F.lit(0).alias("position"), F.col("question").alias("text"))
    conflicts = rows.select(F.lit("known_conflicts").alias("field"), "question_id", F.posexplode("known_conflicts").alias("position", "text"))
    return questions.union(conflicts).where("text IS NOT NULL").distinct()


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question and conflict with its one form."""
    return one_form(_entries(spark, sf_dir), "field", "text")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions with texts that look the same but differ."""
    alike = forms(spark, sf_dir).where("variants > 1").select("field", "canonical", "question_id", "text").distinct()
    a, b = alike.alias("a"), alike.alias("b")
    pairs = a.join(b, (F.col("a.field") == F.col("b.field")) & (F.col("a.canonical") == F.col("b.canonical"))).where("a.question_id < b.question_id AND a.text <> b.text")
    return pairs.select("a.field", F.col("a.question_id").alias("id_a"), F.col("b.question_id").alias("id_b")).distinct()


_FROM, _TO, _SEVERAL = character_map()


def _sql_mapped(column: str, look: bool = True) -> str:
    out = f"regexp_replace(regexp_replace({column}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{115F}}\\x{{1160}}\\x{{17B4}}\\x{{17B5}}\\x{{180B}}-\\x{{180F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}]', '', 'g'), '[\\t\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    for a, b in _SEVERAL:
        out = f"replace({out}, '{a}', '{b}')"
    quote = lambda s: s.replace("'", "''")
    if not look:
        return f"translate({out}, '{quote(_FROM)}', '{quote(_TO)}')"
    seen, alike = ("".join(x[k] for x in AMBIGUOUS) for k in (0, 1))
    return f"nfc_normalize(translate(translate({out}, '{quote(_FROM)}', '{quote(_TO)}'), '{seen}', '{alike}'))"


_ENTRIES = """SELECT DISTINCT 'question' AS field, question_id, CAST(0 AS INTEGER) AS position, question AS text FROM pilot_5_questions WHERE question IS NOT NULL AND question_id IS NOT NULL
UNION SELECT 'known_conflicts', question_id, CAST(i AS INTEGER), x FROM (SELECT question_id, unnest(known_conflicts) AS x, unnest(range(len(known_conflicts))) AS i FROM pilot_5_questions) WHERE x IS NOT NULL AND question_id IS NOT NULL"""

QUERIES = {"p3_found": found, "p3_forms": forms}
ORACLES = {
    "p3_forms": f"""
WITH e AS ({_ENTRIES}), t AS (SELECT field, text, {_sql_mapped('text', False)} AS mapped, {_sql_mapped('text')} AS look FROM (SELECT DISTINCT field, text FROM e)),
c AS (SELECT field, look, min(struct_pack(n := length(mapped), form := mapped)).form AS canonical, count(*) AS variants FROM t GROUP BY 1, 2)
SELECT e.field, question_id, position, text, canonical, variants FROM e JOIN t USING (field, text) JOIN c USING (field, look)""",
    "p3_found": f"""
WITH e AS (SELECT DISTINCT 'question' AS field, question_id AS id, question AS text FROM pilot_5_questions WHERE question IS NOT NULL AND question_id IS NOT NULL
           UNION SELECT 'known_conflicts', question_id, x FROM (SELECT question_id, unnest(known_conflicts) AS x FROM pilot_5_questions) WHERE x IS NOT NULL AND question_id IS NOT NULL),
m AS (SELECT field, id, text, {_sql_mapped('text')} AS form FROM e)
SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM m a JOIN m b ON a.field = b.field AND a.form = b.form AND a.id < b.id AND a.text <> b.text
""",
}
