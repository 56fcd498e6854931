"""Authorised views of passages: listing, ranked search, reading and sentence spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import holds, snippet, statements, word_overlap, word_set


#: Parts that a group is ranked in.
PARTS = 32


def bridge(views: DataFrame, ids: str, id: str, view: str = "view_id") -> DataFrame:
    """(view, id, place): the members of each view in its order."""
    return views.select(view, F.posexplode(ids).alias("place", id)).where(F.col(id).isNotNull())


def authorised(rows: DataFrame, members: DataFrame, id: str, view: str = "view_id") -> DataFrame:
    """The rows that a view holds, once for each view."""
    return members.select(view, id, "place").join(rows, id)


def listing(members: DataFrame, offset: int = 0, limit: int = 100, filtered: bool = False, view: str = "view_id") -> DataFrame:
    """A page of each view in its order, with ``total`` and ``complete``: unfiltered, from the start and all of it."""
    w = Window.partitionBy(view)
    page = members.withColumn("total", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy("place")))
    complete = F.lit(not filtered and offset == 0) & (F.col("total") <= limit)
    return page.where((F.col("_k") > offset) & (F.col("_k") <= offset + limit)).drop("_k").withColumn("complete", complete)


def search(passages: DataFrame, query: Column | str, limit: int = 20, id: str = "evidence_id", text: str = "text", by: str | None = None) -> DataFrame:
    """The best passages for a query: exact hits first, then by shared words, then by id.

    ``exact_matches`` counts the exact hits before the limit.  Passages with
    neither an exact hit nor a shared word are no hits.  The ranking is a top-k
    (of each ``by`` group, if given), so no more than ``limit`` rows a task are
    sorted to the end.
    """
    asked = F.lit(query.strip()) if isinstance(query, str) else F.trim(query)
    exact, lexical = holds(F.col(text), asked), word_overlap(word_set(F.col(text)), word_set(asked))
    hits = passages.withColumn("exact_match", exact).withColumn("lexical_overlap", lexical).where("exact_match OR lexical_overlap > 0").withColumn("snippet", snippet(F.col(text)))
    order = [F.desc("exact_match"), F.desc("lexical_overlap"), F.asc(id)]
    if by is None:
        total = hits.agg(F.count_if("exact_match").alias("exact_matches"))
        return hits.drop(text).orderBy(*order).limit(limit).crossJoin(F.broadcast(total))
    # a large group is ranked in parts by a hash of the id, of which only the best meet
    parts = F.pmod(F.xxhash64(id), F.lit(PARTS))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = hits.drop(text).withColumn("_part", parts).withColumn("_k", rank(by, "_part")).where(F.col("_k") <= limit)
    best = first.withColumn("_k", rank(by)).where(F.col("_k") <= limit).drop("_k", "_part")
    totals = hits.groupBy(by).agg(F.count_if("exact_match").alias("exact_matches"))
    joined = best.alias("b").join(totals.alias("t"), F.col(f"b.{by}").eqNullSafe(F.col(f"t.{by}")))
    return joined.select("b.*", "t.exact_matches")


def sentence_spans(passages: DataFrame, id: str = "evidence_id", text: str = "text") -> DataFrame:
    """(id, statement_id, index, char_start, char_end, text): the literal sentences of passages."""
    spans = passages.select(id, F.posexplode(statements(F.col(text))).alias("index", "span"))
    return spans.select(id, F.concat(F.col(id).cast("string"), F.lit(":s"), F.col("index")).alias("statement_id"), "index", "span.char_start", "span.char_end", "span.text")


def read_status(requests: DataFrame, members: DataFrame, id: str, view: str = "view_id") -> DataFrame:
    """Each request (view, id) with ``status``: ok where the view holds the id, else unavailable."""
    known = members.select(view, id).distinct().withColumn("_ok", F.lit(True))
    status = F.when(F.col("_ok"), "ok").otherwise("unavailable_in_authorized_snapshot")
    return requests.join(known, [view, id], "left").withColumn("status", status).drop("_ok")
