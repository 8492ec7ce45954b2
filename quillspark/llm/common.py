"""What several operators share: column checks and salted tiles; tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.place import shared_dir, written

__all__ = ["broadcast_small", "need", "shared_dir", "tiled", "written"]

#: A side of at most so many rows (of 40 bytes or less) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def broadcast_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has been counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def need(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` cut to the named columns, so that any further ones cannot clash with internal names."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def tiled(rows: DataFrame, key: str, member: str, limit: int, coarse: str | None = None) -> DataFrame:
    """Adds ``tile``, ``part`` and ``cross``: the bucket itself, or for a bucket of over ``limit`` rows
    one of several tiles.

    A large bucket of c rows is dealt by a hash of ``member`` into k = ceil(c / limit) parts; a tile
    holds two parts (``cross``) or one, so that every two rows meet in some tile, no tile has more than
    about twice ``limit`` rows, and no task gets the whole bucket. Two rows of different parts meet in
    one cross tile, two of the same part in that part's own tile. Counts are aggregated before the
    shuffle, and only the few large buckets enter the join. ``coarse`` names a column that is the same
    in all rows of a bucket and has far fewer values: only buckets of its large groups are counted.
    """
    counted = rows
    if coarse:
        crowded = rows.groupBy(F.col(coarse).alias("_coarse")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
        crowded = written(crowded.select("_coarse"), "crowded")
        counted = rows.join(crowded, rows[coarse] == crowded["_coarse"], "left_semi")
    large = counted.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    large = written(large.select("_key", F.ceil(F.col("_rows") / F.lit(limit)).cast("int").alias("_k")), "large")
    dealt = rows.join(large, rows[key] == large["_key"], "left")
    part = F.coalesce(F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_k")).cast("int"), F.lit(0))
    tiles = F.transform(
        F.sequence(F.lit(0), F.coalesce(F.col("_k"), F.lit(1)) - 1),
        lambda t: F.struct((F.least(t, part).cast("long") * F.coalesce(F.col("_k"), F.lit(1)) + F.greatest(t, part)).alias("tile"), (t != part).alias("cross")),
    )
    spread = dealt.select(*[F.col(c) for c in rows.columns], part.alias("part"), F.explode(tiles).alias("_tile"))
    return spread.select(*rows.columns, "part", "_tile.tile", "_tile.cross")
