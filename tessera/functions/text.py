"""Text expressions: tokens, sentence spans, escapes and small parsers.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that results must agree on.
#: Credentials, as a key name with a value or a token of a known form.
SECRET = r"(?i)sk-[A-Za-z0-9_-]{16,}|Bearer\s+[A-Za-z0-9._-]{16,}|(?:api[_ -]?key|access[_ -]?token|password)\s*[:=]\s*\S+"
#: Absolute paths of a machine.
ABSOLUTE_PATH = r"/(?:home|storage|mnt)/|(?:^|[^A-Za-z0-9])[A-Za-z]:[/\\]"
#: Claims about all literature or about what was never measured.
OVERCLAIM = r"(?i)全(?:部|体)文献.*(?:没有|不存在)|实验(?:从未|未曾|没有|未)测|never measured|no evidence anywhere|all literature"

#: The marks that end a sentence, and the sentence up to them.
_END = ".!?。！？"
_SENTENCE = f"[^{_END}]+(?:[{_END}]+|$)"

_WORD = r"[\p{L}\p{N}_-]{3,}"


def word_set(text: Column, pattern: str = _WORD) -> Column:
    """The distinct lower-case words of three or more characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def word_overlap(a: Column, b: Column) -> Column:
    """How many distinct words two word sets share."""
    return F.size(F.array_intersect(a, b))


def holds(text: Column, needle: Column) -> Column:
    """Whether a text contains another, letter case aside."""
    return F.contains(F.lower(text), F.lower(needle))


def snippet(text: Column, n: int = 240) -> Column:
    return F.substring(text, 1, n)


def statements(text: Column) -> Column:
    """The sentences of a text as array<struct<char_start, char_end, text>>, offsets in code points.

    A sentence runs to its closing marks, or to the end of the text; blanks at
    its head are not part of it, and one of blanks alone is none.
    """
    pieces = F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(0))
    lead = F.length(F.regexp_extract(text, f"^[{_END}]*", 0))
    begin = F.struct(lead.cast("int").alias("at"), F.array().cast("array<struct<char_start:int,char_end:int,text:string>>").alias("spans"))

    def add(state: Column, piece: Column) -> Column:
        bare = F.regexp_replace(piece, r"(?U)^\s+", "")
        end = (state["at"] + F.length(piece)).cast("int")
        span = F.struct((end - F.length(bare)).cast("int").alias("char_start"), end.alias("char_end"), bare.alias("text"))
        return F.struct(end.alias("at"), F.when(F.length(bare) > 0, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, begin, add, lambda s: s["spans"])


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^.*/", "")


def triple(text: Column) -> Column:
    """struct<head, relation, tail> of a text "head --relation--> tail"; null if it has another form."""
    form = r"^(.*?)\s*--([^>]+?)-->\s*(.*?)$"
    part = lambda k: F.trim(F.regexp_extract(text, form, k))
    return F.when(text.rlike(form), F.struct(part(1).alias("head"), part(2).alias("relation"), part(3).alias("tail")))


def tag_value(text: Column, tag: str = "PMID") -> Column:
    """What follows "TAG:"; null for other texts."""
    return F.nullif(F.regexp_extract(text, f"^{tag}:(.+)$", 1), F.lit(""))


def csv_cell(value: Column) -> Column:
    """A quoted cell, guarded against being read as a formula; a null is an empty cell."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    out = json
    for sign, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def natural_key(text: Column, digits: int = 20) -> Column:
    """A key that sorts numbers inside ids by value: every run of digits is padded."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), digits, "0")).otherwise(p)), "")


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of the JSON of the columns in the order of their names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def short_id(prefix: str, *columns: Column) -> Column:
    """prefix and the first 24 hex digits of the hash."""
    return F.concat(F.lit(prefix), F.substring(canonical_hash(*columns), 1, 24))


def leaves(value: Column, of: T.DataType) -> Column:
    """The leaf values of a column of any nesting as an array of texts: null ones skipped, booleans as true and false, names of members ignored."""
    none = F.array().cast("array<string>")
    if isinstance(of, T.StructType):
        return F.concat(*(leaves(value[f.name], f.dataType) for f in of.fields)) if of.fields else none
    if isinstance(of, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: leaves(x, of.elementType))), none)
    if isinstance(of, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(value), lambda x: leaves(x, of.valueType))), none)
    return F.array_compact(F.array(value.cast("string")))


def record_text(df: DataFrame, *columns: str) -> Column:
    """All leaf values of the columns (of all, if none are named) joined by blanks."""
    return F.array_join(F.concat(*(leaves(F.col(c), df.schema[c].dataType) for c in columns or df.columns)), " ")


def with_aliases(text: Column, aliases: dict[str, str]) -> Column:
    """``text`` followed by the alias of every sign that it has."""
    return F.concat(text, *(F.when(F.contains(text, F.lit(sign)), F.lit(alias)).otherwise(F.lit("")) for sign, alias in aliases.items()))
