"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations.

An item of q distinct shingles that a document contains to a share of at least t has at most
q - ceil(t q) shingles elsewhere. So one of any q - ceil(t q) + 1 of its shingles is in the document. Taken
are those that the fewest items have, of these the ones with the smallest hash (a bottom-k MinHash sketch
within a frequency), so that a line shared by many items is looked for only where an item has little
else. Items are partitioned by size; a partition's sketch length follows from its largest possible q, and
a document with fewer shingles than the partition's smallest item needs is no match. The search
therefore loses no match; what it finds is verified by exact containment of the shingle texts.

Words are runs of letters and digits in lower case, shingles five words. An item of one to four words
has one shingle, its whole word sequence, which is looked for among the documents' windows of as many
words. Null texts and items, and items without words, match nothing. Rows that share a doc_id are
looked at one by one; the hits of a doc_id are those of its best row. Rows without a doc_id or
item_id are searched like others and carry null. Repeated items give one hit an item_id. Empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_ROWS, broadcast_small, need, written

WIDTH = 5
SHARE = 0.8
#: Items of at most so much text together are broadcast as shingles (about ``WIDTH`` times as much).
BROADCAST_BYTES = 8 << 20
#: Hashes of a sketch up to which their set is broadcast (some 40 bytes each).
BROADCAST_HASHES = 2_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _windows(of: Column, width: int, made) -> Column:
    """``made(list of words)`` for each window of ``width`` words; the word list is computed once."""

    def each(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        return F.when(F.size(w) >= width, F.transform(at, lambda i: made([w[i + k] for k in range(width)])))

    return F.transform(F.array(words(of)), each)[0]


def hashes(of: Column, width: int) -> Column:
    """64-bit hash of each shingle, repeats included; null if there is none."""
    return _windows(of, width, lambda ws: F.xxhash64(*ws))


def shingles(of: Column, width: int) -> Column:
    return F.array_distinct(_windows(of, width, lambda ws: F.concat_ws(" ", *ws)))


def _all_hashes(of: Column, widths: list[int]) -> Column:
    return F.flatten(F.array(*[F.coalesce(hashes(of, n), F.array().cast("array<bigint>")) for n in widths]))


def sized(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``items(item, item_text)`` with words, and ``width``: that of the item's shingles."""
    found = items.withColumn("width", F.least(F.lit(width), F.size(words(F.col("item_text")))))
    return found.where("width > 0")


def sketches(items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """``(item, need, hash)``: of each item as many of its rarest shingles as its size partition asks for."""
    own = sized(items, width)
    of_width = F.coalesce(*[F.when(F.col("width") == n, hashes(F.col("item_text"), n)) for n in range(width, 0, -1)])
    held = written(own.select("item", F.array_distinct(of_width).alias("all")).select("item", F.size("all").alias("q"), F.explode("all").alias("hash")), "item_shingles")
    often = held.groupBy(F.col("hash").alias("h")).agg(F.count(F.lit(1)).alias("items"))
    ranked = held.join(often, held["hash"] == often["h"]).groupBy("item", "q").agg(F.array_sort(F.collect_list(F.struct("items", "hash"))).alias("all"))
    q = F.col("q")
    lower = F.pow(F.lit(2.0), F.floor(F.log2(q.cast("double"))))
    missing = 2 * lower - 1 - F.ceil(F.lit(share) * (2 * lower - 1) - 1e-9)
    kept = F.slice("all", F.lit(1), F.least(q, (missing + 1).cast("int")))
    return ranked.select("item", F.ceil(F.lit(share) * lower - 1e-9).cast("int").alias("need"), F.explode(kept).alias("k")).select("item", "need", "k.hash")


def _met(looked: DataFrame, sketch: DataFrame) -> DataFrame:
    """Shingles of documents that are in a sketch. A large sketch is shuffled, and documents' shingles first
    go through the set of its hashes, as long as that is small enough to be broadcast."""
    n = sketch.limit(BROADCAST_ROWS + 1).count()
    if n > BROADCAST_ROWS:
        once = written(sketch.select(F.col("hash").alias("h")).distinct(), "sketch_hashes")
        if once.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
            looked = looked.join(F.broadcast(once), looked["shingle"] == once["h"], "left_semi")
    else:
        sketch = F.broadcast(sketch)
    return looked.join(sketch, (looked["shingle"] == sketch["hash"]) & (looked["size"] >= sketch["need"]))


def contained(docs: DataFrame, bench: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """``(doc_id, text_key, item_id, n_shingles, matched)`` for each row and item found in it."""
    rows = need(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    items = need(bench, "item_id", "text").select(F.struct("item_id", F.xxhash64("text").alias("item_key")).alias("item"), F.col("text").alias("item_text")).distinct()
    items = written(sized(items, width), "items")
    # The widths that items have: the usual one, and those of short items, ``width`` at most.
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    if not widths:
        return rows.select("doc_id", "text_key", F.lit(None).cast(bench.schema["item_id"].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("matched")).where("1 = 0")
    sketch = written(sketches(items, width, share), "sketches")
    shingled = rows.select("doc_id", "text_key", _all_hashes(F.col("text"), widths).alias("all"))
    looked = shingled.select("doc_id", "text_key", F.size("all").alias("size"), F.explode("all").alias("shingle"))
    found = written(_met(looked, sketch).select("doc_id", "text_key", "item").distinct(), "candidates")
    of_width = lambda c: F.coalesce(*[F.when(F.col("width") == n, shingles(F.col(c), n)) for n in widths])
    own = items.select(F.col("item").alias("of"), of_width("item_text").alias("wanted"))
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    pairs = found.join(F.broadcast(own) if size <= BROADCAST_BYTES else own, found["item"] == own["of"])
    pairs = pairs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "item", "wanted")
    texts = rows.join(broadcast_small(found.select(F.col("doc_id").alias("i"), F.col("text_key").alias("h")).distinct()), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("h")), "left_semi")
    texts = written(texts.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.flatten(F.array(*[F.coalesce(shingles(F.col("text"), n), F.array().cast("array<string>")) for n in widths])).alias("has")), "suspects")
    checked = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    hits = checked.select("doc_id", "text_key", F.col("item.item_id").alias("item_id"), F.size("wanted").cast("long").alias("n_shingles"), F.size(F.array_intersect("wanted", "has")).cast("long").alias("matched"))
    return hits.where(F.col("matched") >= F.ceil(F.lit(share) * F.col("n_shingles") - 1e-9))


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """``docs`` with all its columns, without the rows that contain an item."""
    hits = written(contained(docs, bench, width, share).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct(), "hits")
    whole = docs.select(F.struct("*").alias("row"))
    gone = F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("k"))
    return whole.join(broadcast_small(hits), gone, "left_anti").select("row.*")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every (document, item) of which the document contains at least 0.8."""
    hits = contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("matched") / F.col("n_shingles")).alias("containment"), "matched", "n_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shingles", "best.matched", F.round("best.containment", 6).alias("containment"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT least(5, len(w)) AS width FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS s FROM d, k),
bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS width, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, width, count(*) AS n_shingles FROM bs GROUP BY item_id, width),
m AS (SELECT doc_id, item_id, width, count(*) AS matched FROM ds JOIN bs USING (width, s) GROUP BY doc_id, item_id, width)
SELECT doc_id, item_id, n_shingles, matched, round(matched::DOUBLE / n_shingles, 6) AS containment
FROM m JOIN n USING (item_id, width) WHERE matched >= ceil(0.8 * n_shingles - 1e-9)
"""
