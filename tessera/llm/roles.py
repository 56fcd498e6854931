"""Speakers of chat messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names a speaker goes by, compared without case and surrounding blanks.
SPEAKERS = {
    "user": ("user", "human", "用户"),
    "assistant": ("assistant", "ai", "bot", "model", "助手"),
    "system": ("system",),
}
_BLANK_ENDS = r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$"


def speaker(role: Column) -> Column:
    """user, assistant or system; null for any other role and for none."""
    name = F.lower(F.regexp_replace(role, _BLANK_ENDS, ""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for who, names in SPEAKERS.items():
        out = out.when(name.isin(*names), F.lit(who))
    return out


def blank(text: Column) -> Column:
    """Whether a text is null or holds nothing but blanks and invisible characters."""
    return text.isNull() | ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\p{Z}\p{Cf}\p{Cc}]")
