"""Positions in the service's paged lists, and the walk through them.

A walk is given ``open_page(max_id)``, which returns one page as a DataFrame (``store.PAGE``) with the
query string of the next page, so that the network stays outside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.store import all_known, typed, unwrapped

PAGE_SIZE = 40
TOP, DONE, IDLE, RESUME = "top", "done", "idle", "resume"

Page = tuple[DataFrame, str | None]


def next_max_id(params: Column) -> Column:
    """``max_id`` of a query string; null if it has none."""
    hit = F.regexp_extract(params, r"(?:^\??|&)max_id=([^&#]*)", 1)
    return F.when(params.rlike(r"(?:^\??|&)max_id="), F.url_decode(hit))


def migrated(legacy: Column, state: Column, max_id: Column) -> Column:
    """Backfill position: the present one if there is one, else by the single cursor of older stores."""
    old = F.when(legacy == "0", F.struct(F.lit(DONE).alias("state"), F.lit(None).cast("string").alias("max_id")))
    old = old.when(legacy.isNotNull(), F.struct(F.lit(RESUME).alias("state"), legacy.alias("max_id")))
    old = old.otherwise(F.struct(F.lit(TOP).alias("state"), F.lit(None).cast("string").alias("max_id")))
    return F.when(state.isNotNull(), F.struct(state.alias("state"), max_id.alias("max_id"))).otherwise(old)


@dataclass(frozen=True)
class Position:
    """Where the two walks of a marked list stand; a max_id of None is the start."""

    backfill: str = TOP
    backfill_id: str | None = None
    catchup: str = IDLE
    catchup_id: str | None = None


def _max_id(page: DataFrame, params: str | None) -> str | None:
    if params is None:
        return None
    return page.sparkSession.range(1).select(next_max_id(F.lit(params))).first()[0]


def walk_marked(position: Position, kind: str, token: str | None, open_page: Callable[[str | None], Page], marks: Callable[[], DataFrame], save: Callable[[DataFrame | None, Position], None]) -> Position:
    """Backfills to the oldest entry, then catches up until a page holds nothing new.

    ``save`` stores a page's entries and the position together; a walk that is broken off resumes after
    the last page saved. Without a token nothing is fetched.
    """
    if not token:
        return position
    if position.backfill != DONE:
        at = position.backfill_id
        while True:
            page, params = open_page(at)
            if page.isEmpty():
                break
            at = _max_id(page, params)
            position = replace(position, backfill=RESUME, backfill_id=at) if at is not None else position
            save(typed(page, kind), position)
            if at is None:
                break
        position = replace(position, backfill=DONE, backfill_id=None)
        save(None, position)
    at = position.catchup_id
    while True:
        page, params = open_page(at)
        if page.isEmpty():
            break
        entries = typed(page, kind)
        known, at = all_known(marks(), entries), _max_id(page, params)
        position = replace(position, catchup=RESUME, catchup_id=at) if at is not None and not known else position
        save(entries, position)
        if known or at is None:
            break
    position = replace(position, catchup=IDLE, catchup_id=None)
    save(None, position)
    return position


def walk_own(min_id: str, open_page: Callable[[str], DataFrame], save: Callable[[DataFrame, str], None]) -> str:
    """Fetches own entries newer than ``min_id`` page by page; returns the last id."""
    while True:
        page = open_page(min_id)
        first = page.orderBy("seq").select("status.id").first()
        if first is None:
            return min_id
        min_id = first[0]
        save(unwrapped(page), min_id)
