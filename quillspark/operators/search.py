"""Search: exact and bounded-edit-distance matches of all query tokens, ranked by BM25+."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import is_cjk, terms, tokens, utf16_length
from quillspark.operators.index import Index
from quillspark.sources.place import written

# The BM25+ constants, share and bound of the edit budget, weight of an inexact match.
K, B, D = 1.2, 0.7, 0.5
BUDGET_SHARE, BUDGET_MOST, INEXACT = 0.35, 4, 0.45

HITS = "uri string, score double, terms array<string>"


def edit_budget(term: Column) -> Column:
    """Edits that a query term of this length allows."""
    return F.least(F.lit(BUDGET_MOST), F.floor(utf16_length(term) * F.lit(BUDGET_SHARE) + F.lit(0.5)).cast("int"))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance, -1 if over ``most``."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def inexact_weight(length: Column, distance: Column) -> Column:
    return F.lit(INEXACT) * length / (length + distance)


def bm25(tf: Column, df: Column, n: int, length: Column, mean: float) -> Column:
    rarity = F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))
    return rarity * (F.lit(D) + tf * F.lit(K + 1) / (tf + F.lit(K) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean or 1.0))))


def query_tokens(index: Index, query: str) -> DataFrame:
    """``(qpos, qterm)`` by the tokenizer of the index."""
    spark = index.docs.sparkSession
    row = spark.createDataFrame([(query,)], "q string").select(terms(tokens(F.col("q"))).alias("ts"))
    return row.select(F.posexplode("ts").alias("qpos", "qterm"))


#: Candidates up to which they are collected and their terms pushed into the scan of the postings, and
#: beyond that up to which they are broadcast.
PUSHED, BROADCAST = 500, 100_000


def one_of(column: Column, values: list[str]) -> Column:
    """Membership in a form that is pushed into a Parquet scan: a few values one by one (a list of over ten would
    be pushed as a range), more of them as a range and then looked up in a set."""
    if len(values) > 30:
        return column.isin(values)
    return reduce(lambda a, b: a | b, [column.isin(values[k : k + 10]) for k in range(0, len(values), 10)])


def candidates(index: Index, asked: list[tuple[int, str]]) -> DataFrame:
    """``(qpos, qterm, term, df, distance, weight)``: dictionary terms that a query token matches.

    The few query tokens are broadcast; exact matches are a pushed filter on the term. Inexact matches join
    on the length of the term, from budget below to budget above that of the token, which is pushed too,
    and CJK terms are left out by partition.
    """
    spark = index.docs.sparkSession
    q = spark.createDataFrame(asked, "qpos int, qterm string")
    named = index.terms.where(one_of(F.col("term"), sorted({t for _, t in asked})))
    exact = named.join(F.broadcast(q), F.col("term") == F.col("qterm")).select("qpos", "qterm", "term", "df", F.lit(0).alias("distance"), F.lit(1.0).alias("weight"))
    budget, n = edit_budget(F.col("qterm")), utf16_length(F.col("qterm"))
    loose = q.where(~is_cjk(F.col("qterm"))).where(budget > 0).select("qpos", "qterm", budget.alias("budget"), F.explode(F.sequence(n - budget, n + budget)).alias("near"))
    lengths = sorted({r[0] for r in loose.select("near").collect()})  # a few a query token
    met = index.terms.where(~F.col("is_cjk") & F.col("len").isin(lengths)).join(F.broadcast(loose), F.col("len") == F.col("near"))
    # The generator keeps the distance from being computed once for each use.
    met = met.select("qpos", "qterm", "term", "df", "len", "budget", F.explode(F.array(F.levenshtein(F.col("term"), F.col("qterm"), BUDGET_MOST))).alias("distance"))
    inexact = met.where("distance BETWEEN 1 AND budget").select("qpos", "qterm", "term", "df", "distance", inexact_weight(F.col("len"), F.col("distance")).alias("weight"))
    return exact.unionByName(inexact)


def matched_postings(index: Index, asked: list[tuple[int, str]]) -> DataFrame:
    """Postings of all candidates, with ``qpos``, ``df`` and ``weight``. Usually the candidates are few: then
    the scan reads only the row groups that may hold their terms."""
    spark = index.docs.sparkSession
    found = candidates(index, asked).select("qpos", "term", "df", "weight")
    rows = found.limit(PUSHED + 1).collect()
    if not rows:
        return index.postings.where("1 = 0").join(found, "term")
    if len(rows) <= PUSHED:
        few = spark.createDataFrame([tuple(r) for r in rows], "qpos int, term string, df long, weight double")
        return index.postings.where(one_of(F.col("term"), sorted({r["term"] for r in rows}))).join(F.broadcast(few), "term")
    kept = written(found, "candidates")
    return index.postings.join(F.broadcast(kept) if kept.count() <= BROADCAST else kept, "term")


def search(index: Index, query: str) -> DataFrame:
    """``(uri, score, terms)`` of the documents that match every token of ``query``, unordered.

    Candidates, their postings, a sum for each document, and the condition that all positions
    have matched. A token that occurs twice counts twice in the sum, once in the final factor. A query
    without tokens, or an empty index, has no hits.
    """
    spark = index.docs.sparkSession
    asked = [(r["qpos"], r["qterm"]) for r in query_tokens(index, query).collect() if r["qterm"]]
    n, mean = index.stats()
    if not asked or not n:
        return spark.createDataFrame([], HITS)
    found = matched_postings(index, asked)
    one = F.col("weight") * bm25(F.col("tf").cast("double"), F.col("df").cast("double"), n, F.col("field_length").cast("double"), mean)
    summed = found.groupBy("uri").agg(F.sum(one).alias("sum"), F.size(F.collect_set("qpos")).alias("matched"), F.array_sort(F.collect_set("term")).alias("terms"))
    factor = len({t for _, t in asked})
    return summed.where(F.col("matched") == len(asked)).select("uri", (F.col("sum") * float(factor)).alias("score"), "terms")


# The types that are shown unless asked otherwise.
SHOWN = ("post", "boost")


def with_types(statuses: DataFrame, enabled: tuple[str, ...] = SHOWN) -> DataFrame:
    """Rows of which any type is enabled; none if none is."""
    return statuses.where(F.arrays_overlap("types", F.array(*[F.lit(t) for t in enabled]).cast("array<string>")))


def result_counts(hits: DataFrame, statuses: DataFrame, enabled: tuple[str, ...] = SHOWN) -> DataFrame:
    """``(found, shown)``: hits of stored statuses, and those of them with an enabled type, in one pass."""
    own = hits.join(statuses.select("uri", "types"), "uri")
    fits = F.arrays_overlap("types", F.array(*[F.lit(t) for t in enabled]).cast("array<string>"))
    return own.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.coalesce(fits, F.lit(False))).alias("shown"))


def ordered(hits: DataFrame, by: str = "relevance") -> DataFrame:
    """By relevance, or by the text of ``created_at`` (newest or oldest first); ties by relevance, uri."""
    relevance = [F.desc("score"), F.asc("uri")]
    first = {"relevance": [], "newest": [F.desc("created_at")], "oldest": [F.asc("created_at")]}[by]
    return hits.orderBy(*first, *relevance)


def ranked(hits: DataFrame, by: str = "relevance") -> DataFrame:
    """``hits`` with ``rank`` from 1 in the order of ``ordered``, without one task that sees all rows.

    Rows are dealt by ranges of the order and numbered in each; the counts of the ranges before, one
    small row each, are added.
    """
    keys = {"relevance": [], "newest": [F.desc("created_at")], "oldest": [F.asc("created_at")]}[by] + [F.desc("score"), F.asc("uri")]
    dealt = hits.repartitionByRange(*keys).sortWithinPartitions(*keys)
    places = written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranked")
    counts = places.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return places.join(F.broadcast(before), "_part").select(*hits.columns, (F.col("_before") + F.col("_at") + 1).alias("rank"))
