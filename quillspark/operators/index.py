"""The inverted index as four tables: docs, terms, postings, meta.

``docs(uri, field_length)`` has every document, empty ones too; ``postings(term, uri, tf, field_length)`` a
row for each term of a document, with all that scoring needs; ``terms(term, df, is_cjk, len)`` the
dictionary; ``meta`` one row.

On disk an index is a list of segments, each with docs, postings and terms of its own documents. Growth
writes a segment of the new documents and merges it with those before it that are not much larger, so
there are few segments and each posting is rewritten a logarithmic number of times. Document frequencies
are summed over segments when read. The list is published as a whole (``place.publish``), so that
readers and crashes see an old or a new index, never a part of one.

Rows with a null uri are not indexed. Of rows that share a uri the smallest content counts. Null and
empty contents are documents without terms. An empty table gives an empty index.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import is_cjk, terms, tokens, utf16_length
from quillspark.sources.place import delete, others, publish, published, written

#: To be raised whenever tokens, scores, tables or the indexed content change.
VERSION = 2
SEGMENT = "version int, name string, document_count long, total_length long"
#: A segment is merged with the newer ones if it has at most so many times their documents.
MERGE = 2


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    terms: DataFrame
    postings: DataFrame
    meta: DataFrame

    def stats(self) -> tuple[int, float]:
        """Number of documents and mean field length (0 if there is none); one row is collected."""
        row = self.meta.first()
        return row["document_count"], row["total_length"] / row["document_count"] if row["document_count"] else 0.0


def _dictionary(postings: DataFrame) -> DataFrame:
    counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.select("term", "df", is_cjk(F.col("term")).alias("is_cjk"), utf16_length(F.col("term")).alias("len"))


def _meta(docs: DataFrame) -> DataFrame:
    totals = docs.agg(F.count(F.lit(1)).alias("document_count"), F.coalesce(F.sum("field_length"), F.lit(0)).cast("long").alias("total_length"))
    return totals.select(F.lit(VERSION).alias("version"), "document_count", "total_length")


def build(docs: DataFrame, normalized: bool = False) -> Index:
    """Index of ``docs(uri, content)``; its counts are written, so no text is cut twice.

    The texts are shuffled once, by uri. That makes uris unique, spreads an input of few large files over
    the tasks, and counts the terms of a document without a shuffle of postings.
    """
    one = docs.select("uri", "content").where("uri IS NOT NULL").groupBy("uri").agg(F.min("content").alias("content"))
    # The generator keeps the tokens from being computed once for each use.
    cut = one.select("uri", F.explode(F.array(tokens(F.col("content"), normalized))).alias("raw"))
    cut = cut.select("uri", "raw", F.size(F.array_distinct("raw")).cast("long").alias("field_length"))  # before the rows are multiplied
    counted = cut.select("uri", "field_length", F.explode_outer(terms(F.col("raw"))).alias("term"))
    # A document without terms has one row with a null term here, so one table holds both postings and lengths.
    counted = written(counted.groupBy("uri", "field_length", "term").agg(F.count(F.lit(1)).alias("tf")), "counted")
    postings = counted.where("term IS NOT NULL").select("term", "uri", "tf", "field_length")
    lengths = counted.select("uri", "field_length").groupBy("uri").agg(F.first("field_length").alias("field_length"))
    return Index(lengths, _dictionary(postings), postings, _meta(lengths))


def _write(index: Index, base: str) -> tuple[int, str, int, int]:
    """Writes a segment; its row of the list."""
    spark, name = index.docs.sparkSession, uuid.uuid4().hex
    path = f"{base}/segments/{name}"
    index.docs.write.parquet(f"{path}/docs")
    # Sorted by term, so that a lookup of given terms skips files and row groups; a hot term may span files.
    index.postings.repartitionByRange("term", "uri").sortWithinPartitions("term", "uri").write.parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    _dictionary(stored).sortWithinPartitions("is_cjk", "term").write.partitionBy("is_cjk").parquet(f"{path}/terms")
    row = _meta(spark.read.parquet(f"{path}/docs")).first()
    return (VERSION, name, row["document_count"], row["total_length"])


def _read(spark: SparkSession, base: str, segments: list) -> Index:
    paths = lambda table: [f"{base}/segments/{s[1]}/{table}" for s in segments]
    # Partitioned tables cannot be read by one list of paths; segments are few.
    found = reduce(DataFrame.unionByName, [spark.read.schema("term string, df long, len int, is_cjk boolean").parquet(p).select("term", "df", "is_cjk", "len") for p in paths("terms")])
    if len(segments) > 1:  # filters on the term, its class and length are pushed below the sum
        found = found.groupBy("term", "is_cjk", "len").agg(F.sum("df").alias("df")).select("term", "df", "is_cjk", "len")
    return Index(
        spark.read.schema("uri string, field_length long").parquet(*paths("docs")),
        found,
        spark.read.schema("term string, uri string, tf long, field_length long").parquet(*paths("postings")),
        spark.createDataFrame([(min(s[0] for s in segments), sum(s[2] for s in segments), sum(s[3] for s in segments))], "version int, document_count long, total_length long"),
    )


def _publish(spark: SparkSession, base: str, segments: list) -> None:
    """Makes ``segments`` the index; removes those that only versions before the last one have."""
    before = published(spark, f"{base}/current", SEGMENT) or []
    known = {s[1] for s in before} | {s[1] for s in segments}
    publish(spark.createDataFrame(segments, SEGMENT), f"{base}/current")
    for old in others(spark, f"{base}/segments", known):
        delete(spark, old)


def save(index: Index, base: str) -> Index:
    """Writes the index as one segment under ``base``, makes it the current one, and returns it as stored."""
    spark = index.docs.sparkSession
    _publish(spark, base, [_write(index, base)])
    return load(spark, base)


def load(spark: SparkSession, base: str) -> Index | None:
    """The current index under ``base``, or nothing."""
    segments = published(spark, f"{base}/current", SEGMENT)
    return _read(spark, base, [tuple(s) for s in segments]) if segments else None


def unseen(docs: DataFrame, index: Index | None) -> DataFrame:
    """Rows of ``docs`` whose uri is not indexed."""
    return docs if index is None else docs.join(index.docs.select("uri"), "uri", "left_anti")


def has(docs: DataFrame, index: Index) -> DataFrame:
    """Rows of ``docs`` whose uri is indexed."""
    return docs.join(index.docs.select("uri"), "uri", "left_semi")


def grow(index: Index | None, docs: DataFrame, normalized: bool = False) -> Index:
    """``index`` with the documents it lacks; equal to one built from all of them. Nothing is stored."""
    added = build(unseen(docs, index), normalized)
    return added if index is None else _merged([index, added])


def _merged(parts: list[Index]) -> Index:
    docs, postings = (reduce(DataFrame.unionByName, [getattr(p, t) for p in parts]) for t in ("docs", "postings"))
    both = reduce(DataFrame.unionByName, [p.terms for p in parts]).groupBy("term", "is_cjk", "len").agg(F.sum("df").alias("df"))
    return Index(docs, both.select("term", "df", "is_cjk", "len"), postings, _meta(docs))


def append(spark: SparkSession, base: str, docs: DataFrame, normalized: bool = False) -> Index:
    """Stores the documents that the index under ``base`` lacks, as a segment of their own or merged with
    the segments before that are not much larger."""
    segments = [tuple(s) for s in published(spark, f"{base}/current", SEGMENT) or []]
    fresh = _write(build(unseen(docs, _read(spark, base, segments) if segments else None), normalized), base)
    if segments and not fresh[2]:
        delete(spark, f"{base}/segments/{fresh[1]}")
        return _read(spark, base, segments)
    tail = [fresh]
    while segments and segments[-1][2] <= MERGE * sum(s[2] for s in tail):
        tail.insert(0, segments.pop())
    if len(tail) > 1:
        whole = _write(_merged([_read(spark, base, [s]) for s in tail]), base)
        delete(spark, f"{base}/segments/{fresh[1]}")
        tail = [whole]
    _publish(spark, base, segments + tail)
    return load(spark, base)


def violations(index: Index) -> DataFrame:
    """``(rule, n)``: how often each rule of a sound index is broken; terms and documents count once each.

    Postings, documents and terms are each read in one grouped pass.
    """
    pairs = index.postings.groupBy("term", "uri").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("tf") < 1).alias("low"))
    copies = index.docs.groupBy("uri").agg(F.count(F.lit(1)).alias("copies"))
    joined = pairs.join(copies, "uri", "left")
    by_term = joined.groupBy("term").agg(
        F.sum("rows").alias("rows"),
        F.sum("low").alias("low"),
        F.count_if(F.col("rows") > 1).alias("repeated"),
        F.sum(F.when(F.col("copies").isNull(), F.col("rows")).otherwise(0)).alias("orphan"),
    )
    known = index.terms.groupBy("term").agg(F.min("df").alias("least"), F.max("df").alias("most"), F.count_if(F.col("is_cjk") != is_cjk(F.col("term"))).alias("flags"), F.count_if(F.col("term") == "").alias("empty"))
    both = known.join(by_term, "term", "full")
    off = ~(F.col("least").eqNullSafe(F.col("rows")) & F.col("most").eqNullSafe(F.col("rows")))
    of_terms = both.agg(
        F.count_if(off).alias("df_differs"), F.coalesce(F.sum("empty"), F.lit(0)).alias("empty_term"), F.coalesce(F.sum("flags"), F.lit(0)).alias("flag_differs"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("frequency_below_one"), F.coalesce(F.sum("orphan"), F.lit(0)).alias("orphan_posting"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated_posting"),
    )
    count = index.stats()[0]
    of_docs = copies.agg((F.coalesce(F.sum("copies"), F.lit(0)) != count).cast("long").alias("document_count_differs"), F.count_if(F.col("copies") > 1).alias("repeated_document"))
    rules = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n")) for c in df.columns])).alias("r")).select("r.*")
    return rules(of_terms).unionByName(rules(of_docs))


def usable(index: Index | None, document_count: int) -> bool:
    """Whether a stored index may be used for a store of so many documents."""
    row = index and index.meta.first()
    return bool(row) and row["version"] == VERSION and row["document_count"] == document_count


def load_or_build(spark: SparkSession, base: str, docs: DataFrame) -> Index:
    """The stored index if it fits the documents and is sound, else one that is built and stored."""
    index = load(spark, base)
    if usable(index, docs.where("uri IS NOT NULL").select("uri").distinct().count()) and violations(index).where("n > 0").isEmpty():
        return index
    return save(build(docs), base)


def clear(spark: SparkSession, base: str) -> None:
    """Leaves no current index under ``base``."""
    publish(spark.createDataFrame([], SEGMENT), f"{base}/current")
