"""The archive's tables: statuses, authors, types, each keyed by ``store_key``.

A batch of fetched entries has ``seq``, its order of arrival. A status keeps what was stored first; an
author keeps what came last; a type is added to a status once, in the order of first marks. All are
partial aggregates on the key, so they are combined before the shuffle. Of entries with the same ``seq`` that with
the smallest content counts. Entries without a status, or without its uri, are left out; so are authors without a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEDIA = "array<struct<type:string,url:string,preview_url:string,description:string>>"
ACCOUNT = "struct<acct:string,display_name:string,avatar:string,url:string>"
STATUS = f"uri:string,id:string,url:string,content:string,created_at:string,spoiler_text:string,media:{MEDIA},account:{ACCOUNT}"
#: What a page of the service holds; ``reblog`` is the boosted status.
PAGE = f"store_key string, seq long, status struct<{STATUS}>, reblog struct<{STATUS}>"
BODY = ("content", "created_at", "acct", "id", "url", "spoiler_text", "media")


def unwrapped(page: DataFrame) -> DataFrame:
    """Own entries: a boost stands for the status that it boosts."""
    kind = F.when(F.col("reblog").isNotNull(), "boost").otherwise("post")
    return page.select("store_key", "seq", F.coalesce("reblog", "status").alias("s"), kind.alias("type"))


def typed(page: DataFrame, kind: str) -> DataFrame:
    """Entries of a marked list (favourites or bookmarks)."""
    return page.select("store_key", "seq", F.col("status").alias("s"), F.lit(kind).alias("type"))


def first_statuses(entries: DataFrame) -> DataFrame:
    """One row for each status: the first that arrived."""
    body = F.struct("s.content", "s.created_at", F.col("s.account.acct").alias("acct"), "s.id", "s.url", "s.spoiler_text", "s.media")
    rank = F.struct("seq", F.to_json("s").alias("body"))  # ties by what is stored, so that the order of rows does not matter
    one = entries.where("s.uri IS NOT NULL").groupBy("store_key", F.col("s.uri").alias("uri")).agg(F.min_by(body, rank).alias("b"))
    return one.select("store_key", "uri", *[f"b.{c}" for c in BODY])


def last_authors(entries: DataFrame) -> DataFrame:
    """One row for each author: the last that arrived."""
    rank = F.struct("seq", F.to_json("s.account").alias("body"))
    one = entries.where("s.account.acct IS NOT NULL").groupBy("store_key", F.col("s.account.acct").alias("acct")).agg(F.max_by("s.account", rank).alias("a"))
    return one.select("store_key", "acct", "a.display_name", "a.avatar", "a.url")


def marks(entries: DataFrame) -> DataFrame:
    """``(store_key, uri, type, seq)``: when each type was first marked."""
    return entries.where("s.uri IS NOT NULL").groupBy("store_key", F.col("s.uri").alias("uri"), "type").agg(F.min("seq").alias("seq"))


def types_of(marked: DataFrame, *keys: str) -> DataFrame:
    """The types of each key in the order of first marks."""
    return marked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_set(F.struct("seq", "type"))), lambda m: m["type"]).alias("types"))


def add_statuses(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows to append: those whose status is not stored yet. What is stored is never changed."""
    return first_statuses(entries).join(stored.select("store_key", "uri"), ["store_key", "uri"], "left_anti")


def upsert_authors(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """The whole author table with the batch's authors put in or refreshed."""
    fresh = last_authors(entries)
    return stored.join(fresh.select("store_key", "acct"), ["store_key", "acct"], "left_anti").unionByName(fresh)


def add_marks(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Marks to append."""
    return marks(entries).join(stored.select("store_key", "uri", "type"), ["store_key", "uri", "type"], "left_anti")


def all_known(stored_marks: DataFrame, entries: DataFrame) -> bool:
    """Whether each entry's status already had the entry's type; true for an empty page."""
    keys = entries.select("store_key", F.col("s.uri").alias("uri"), "type")
    return keys.join(stored_marks, ["store_key", "uri", "type"], "left_anti").isEmpty()


def tallies(types: DataFrame) -> DataFrame:
    """``(posts, favourites, bookmarks, statuses)`` in one pass; a status may count more than once."""
    has = lambda *ts: F.count_if(F.arrays_overlap("types", F.array(*[F.lit(t) for t in ts])))
    return types.agg(has("post", "boost").alias("posts"), has("favourite").alias("favourites"), has("bookmark").alias("bookmarks"), F.count(F.lit(1)).alias("statuses"))


def pages_known(entries: DataFrame) -> DataFrame:
    """``(page, all_known)`` for entries with a ``page`` number: whether each entry's mark came on an
    earlier page already."""
    first = entries.groupBy("store_key", F.col("s.uri").alias("u"), F.col("type").alias("t")).agg(F.min("page").alias("first_page"))
    seen = entries.select("store_key", F.col("s.uri").alias("u"), F.col("type").alias("t"), "page").join(first, ["store_key", "u", "t"])
    return seen.groupBy("page").agg(F.bool_and(F.col("first_page") < F.col("page")).alias("all_known"))
