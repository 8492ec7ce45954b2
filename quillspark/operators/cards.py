"""Result cards: hits joined with their statuses and authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dates, text
from quillspark.functions.html import highlight, searchable


def index_docs(statuses: DataFrame) -> DataFrame:
    """``(uri, content)`` of what the index is built from."""
    return statuses.select("uri", searchable(F.col("content"), F.col("spoiler_text"), F.col("media")).alias("content"))


def cards(hits: DataFrame, statuses: DataFrame, authors: DataFrame, instance: Column, now: Column) -> DataFrame:
    """What is shown of each hit. A missing author or link is made up from the status."""
    a = authors.select(F.col("acct").alias("_acct"), F.col("display_name").alias("_name"), F.col("avatar").alias("_avatar"), F.col("url").alias("_profile"))
    rows = hits.join(statuses, "uri").join(a, F.col("acct") == F.col("_acct"), "left")
    link = text.status_link(F.col("url"), instance, F.col("acct"), F.col("id"))
    name = text.display_name(F.col("_name"), F.col("acct"))
    shown = F.transform("media", lambda m: F.struct(m["type"].alias("type"), text.media_link(m["url"], link).alias("link"), m["preview_url"].alias("preview_url"), m["description"].alias("description")))
    media = F.coalesce(shown, F.array().cast("array<struct<type:string,link:string,preview_url:string,description:string>>"))
    return rows.select(
        "uri",
        "score",
        "terms",
        "created_at",
        name.alias("display_name"),
        text.initial(name).alias("initial"),
        F.coalesce("_avatar", F.lit("")).alias("avatar"),
        "acct",
        link.alias("link"),
        text.profile_link(F.col("_profile"), instance, F.col("acct")).alias("profile"),
        text.badges(F.col("types")).alias("badges"),
        dates.relative_time(F.col("created_at"), now).alias("time"),
        dates.full_time(F.col("created_at")).alias("time_title"),
        "spoiler_text",
        highlight(F.col("content"), F.col("terms")).alias("content"),
        media.alias("media"),
    )
