"""The registered queries of the search-and-archive engine, and DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import dates, text
from quillspark.functions.html import BLOCKS, highlight, html_to_text
from quillspark.operators import index, search, store
from quillspark.operators.cards import cards, index_docs
from quillspark.sources import paging
from quillspark.sources.paging import PAGE_SIZE, migrated, next_max_id
from quillspark.sources.place import fresh_dir, published
from quillspark.sources.sessions import Account, Sessions
from quillspark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


# --- inputs ---


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("uri"), F.col("text").alias("content"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(F.concat_ws("/", "conv_id", "turn").alias("uri"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return table.select(F.col("page_id").cast("string").alias("uri"), F.col("html").alias("content"), "url")


def entries(events: DataFrame) -> DataFrame:
    """Events as entries: the user stands for the status, the type for the author and the mark."""
    account = F.struct(F.col("event_type").alias("acct"), F.col("props").alias("display_name"), F.lit("").alias("avatar"), F.col("event_id").cast("string").alias("url"))
    status = F.struct(
        F.col("user_id").cast("string").alias("uri"), F.col("event_id").cast("string").alias("id"), F.lit(None).cast("string").alias("url"), F.col("props").alias("content"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.lit("").alias("spoiler_text"), F.array().cast(store.MEDIA).alias("media"), account.alias("account"),
    )
    return events.select(F.lit("store:a:1").alias("store_key"), F.col("event_id").alias("seq"), status.alias("s"), F.col("event_type").alias("type"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark.read.parquet(f"{sf_dir}/events.parquet"))


def stored_index(spark: SparkSession, docs: DataFrame) -> index.Index:
    return index.save(index.build(docs), fresh_dir(spark, "index"))


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def _values(values: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in values) + f") v({names})"


# --- SQL of the index and of search ---

DOCS_SQL = "SELECT doc_id::VARCHAR AS uri, text AS content FROM documents"
TURNS_SQL = "SELECT conv_id::VARCHAR || '/' || turn::VARCHAR AS uri, text AS content FROM conversations"


def index_sql(source: str = DOCS_SQL) -> str:
    return rf"""
d AS (SELECT uri, list_filter(regexp_split_to_array(content, '[\n\r\pZ\pP]+'), lambda x: x <> '') AS raw FROM ({source})),
l AS (SELECT uri, len(list_distinct(raw))::BIGINT AS field_length FROM d),
p AS (SELECT term, uri, count(*) AS tf FROM (SELECT uri, lower(unnest(raw)) AS term FROM d) GROUP BY term, uri),
t AS (SELECT term, count(*) AS df FROM p GROUP BY term),
m AS (SELECT count(*)::DOUBLE AS n, avg(field_length) AS mean FROM l)"""


def _near(a: str, b: str) -> str:
    """Edit distance in characters: DuckDB counts bytes, so the letters that are longer become others."""
    plain = lambda x: f"translate({x}, 'ßäçèéêíñóöü©', 'ABCDEFGHIJKL')"
    return f"levenshtein({plain(a)}, {plain(b)})"


BUDGET_SQL = "least(4, floor(length(qterm) * 0.35e0 + 0.5e0))"


def hits_sql(tokens: list[str], source: str = DOCS_SQL) -> str:
    asked = _values([(k, t) for k, t in enumerate(tokens)], "qpos, qterm")
    return f"""{index_sql(source)},
q AS (SELECT * FROM {asked}),
c AS (SELECT qpos, qterm, term, df, distance, CASE WHEN distance = 0 THEN 1e0 ELSE 0.45e0 * length(term) / (length(term) + distance) END AS weight
      FROM (SELECT *, {_near("term", "qterm")} AS distance FROM q JOIN t ON abs(length(term) - length(qterm)) <= {BUDGET_SQL})
      WHERE distance <= {BUDGET_SQL}),
h AS (SELECT uri, sum(weight * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (0.5e0 + tf * 2.2e0 / (tf + 1.2e0 * (0.3e0 + 0.7e0 * field_length / mean)))) * {len(set(tokens))} AS score,
             list_sort(list_distinct(list(term))) AS terms
      FROM c JOIN p USING (term) JOIN l USING (uri), m GROUP BY uri HAVING count(DISTINCT qpos) = {len(tokens)})"""


def search_sql(tokens: list[str], source: str = DOCS_SQL) -> str:
    return f"WITH {hits_sql(tokens, source)} SELECT uri, round(score, 6) AS score, array_to_string(terms, ' ') AS terms FROM h"


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("uri", F.round("score", 6).alias("score"), F.array_join("terms", " ").alias("terms"))


# --- index ---


@query("tok_counts", rf"WITH {index_sql()} SELECT uri, len(raw)::BIGINT AS n_tokens, len(list_distinct(raw))::BIGINT AS n_distinct FROM d")
def tok_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = documents(spark, sf_dir).select("uri", F.explode(F.array(text.tokens(F.col("content")))).alias("raw"))
    return cut.select("uri", F.size("raw").cast("long").alias("n_tokens"), F.size(F.array_distinct("raw")).cast("long").alias("n_distinct"))


@query("term_freq", f"WITH {index_sql()} SELECT term, uri, tf FROM p")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(documents(spark, sf_dir)).postings.select("term", "uri", "tf")


@query("doc_freq", f"WITH {index_sql()} SELECT term, df, length(term)::INT AS len FROM t")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(documents(spark, sf_dir)).terms.select("term", "df", "len")


@query("field_len", f"WITH {index_sql()} SELECT uri, field_length FROM l")
def field_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(documents(spark, sf_dir)).docs


@query("corpus_stats", f"WITH {index_sql()} SELECT count(*) AS document_count, sum(field_length)::BIGINT AS total_length, round(avg(field_length), 6) AS mean_length FROM l")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = index.build(documents(spark, sf_dir)).meta
    return meta.select("document_count", "total_length", F.round(F.col("total_length") / F.col("document_count"), 6).alias("mean_length"))


@query("validate_index", "SELECT unnest(['df_differs', 'document_count_differs', 'empty_term', 'flag_differs', 'frequency_below_one', 'orphan_posting', 'repeated_document', 'repeated_posting']) AS rule, 0::BIGINT AS n")
def validate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.violations(stored_index(spark, documents(spark, sf_dir)))


@query("grow_equals_rebuild", f"WITH {index_sql()} SELECT term, df, (SELECT sum(tf)::BIGINT FROM p WHERE p.term = t.term) AS total FROM t")
def grow_equals_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built from the even documents, grown by all as a stored segment: the dictionary of all."""
    docs, base = documents(spark, sf_dir), fresh_dir(spark, "index")
    index.save(index.build(docs.where(F.col("uri").cast("long") % 2 == 0)), base)
    grown = index.append(spark, base, docs)
    totals = grown.postings.groupBy("term").agg(F.sum("tf").alias("total"))
    return grown.terms.select("term", "df").join(totals, "term")


@query("grow_segments", """SELECT step, count(doc_id)::BIGINT AS documents, least(step, 1)::BIGINT AS current FROM (VALUES (1), (2), (3), (4)) v(step)
LEFT JOIN documents ON doc_id % 4 < step GROUP BY step""")
def grow_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents is added at a time; each version is whole when it is published."""
    docs, base, out = documents(spark, sf_dir), fresh_dir(spark, "index"), []
    for step in range(1, 5):
        grown = index.append(spark, base, docs.where(F.col("uri").cast("long") % 4 < step))
        sound = violations_of(grown) == 0
        out.append((step, grown.stats()[0], int(sound and index.load(spark, base).stats() == grown.stats())))
    return rows(spark, out, "step int, documents long, current long")


def violations_of(built: index.Index) -> int:
    return index.violations(built).agg(F.sum("n")).first()[0]


STORED_SQL = "SELECT count(*) AS n FROM documents"


@query("load_or_build", f"""SELECT step, if(step = 'cleared', 0, n) AS documents, step = 'again' AS reused
FROM (VALUES ('first'), ('again'), ('cleared'), ('after')) v(step), ({STORED_SQL})""")
def load_or_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built when there is none, then loaded; cleared there is none, and it is built again."""
    docs, base, out, seen = documents(spark, sf_dir), fresh_dir(spark, "index"), [], set()

    def name() -> str | None:
        found = published(spark, f"{base}/current", index.SEGMENT)
        return found[0]["name"] if found else None

    for step in ("first", "again", "cleared", "after"):
        if step == "cleared":
            index.clear(spark, base)
            built = index.load(spark, base)
        else:
            built = index.load_or_build(spark, base, docs)
        out.append((step, built.stats()[0] if built else 0, name() is not None and name() in seen))
        seen.add(name())
    return rows(spark, out, "step string, documents long, reused boolean")


@query("cache_gate", "SELECT kind, kind = 'same' AS usable FROM (VALUES ('none'), ('same'), ('more documents'), ('other version')) v(kind)")
def cache_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index is used only if its version and its number of documents fit."""
    docs = conversations(spark, sf_dir)
    built, n = stored_index(spark, docs), docs.count()
    other = index.Index(built.docs, built.terms, built.postings, built.meta.withColumn("version", F.lit(index.VERSION - 1)))
    cases = [("none", index.usable(None, n)), ("same", index.usable(built, n)), ("more documents", index.usable(built, n + 1)), ("other version", index.usable(other, n))]
    return rows(spark, cases, "kind string, usable boolean")


@query("stored_order", "SELECT kind, 0::BIGINT AS descents FROM (VALUES ('dictionary'), ('postings')) v(kind)")
def stored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within each file of a stored index, how often a row comes before the one above it."""
    built = stored_index(spark, documents(spark, sf_dir))

    def descents(table: DataFrame, kind: str, *keys: str) -> DataFrame:
        key = F.struct(*keys)
        placed = table.select(key.alias("k"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
        last = F.lag("k").over(Window.partitionBy("file").orderBy("at"))
        return placed.withColumn("last", last).agg(F.count_if(F.col("last") > F.col("k")).alias("descents")).select(F.lit(kind).alias("kind"), "descents")

    return descents(built.terms, "dictionary", "is_cjk", "term").unionByName(descents(built.postings, "postings", "term", "uri"))


@query("has_uris", "SELECT doc_id::VARCHAR AS uri FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) GROUP BY doc_id")
def has_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that an index of the even ones has."""
    docs = documents(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("uri")).distinct()
    return index.has(asked, index.build(docs.where(F.col("uri").cast("long") % 2 == 0)))


#: Letters and digits of full width, which compatibility normalisation turns into plain ones.
WIDE = {ord(c): chr(ord(c) + 0xFEE0) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}


@query("tok_fullwidth", f"WITH {index_sql()} SELECT term, df FROM t")
def tok_fullwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of the documents, rewritten in letters of full width, is that of the plain ones."""
    plain = "".join(map(chr, WIDE))
    wide = documents(spark, sf_dir).withColumn("content", F.translate("content", plain, plain.translate(WIDE)))
    return index.build(wide).terms.select("term", "df")


# --- tokenizer on literals: the tables hold no CJK text ---

CJK_TEXTS = [("火车站",), ("開門",), ("國",), ("機",), ("語",), ("他在Berlin讀書",), ("north；；south……",), ("？！、",), ("早安，朋友",), ("佐々木",), ("",), ("up\tdown left",), ("€9 = q|r",), ("サービス・ア",)]
_CLASS = r"\x{2E80}-\x{2EFF}\x{2F00}-\x{2FDF}\x{3040}-\x{309F}\x{30A0}-\x{30FA}\x{30FC}-\x{30FF}\x{3100}-\x{312F}\x{3200}-\x{32FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
_SPACED = rf"regexp_replace(regexp_replace(s, '([{_CLASS}])([^{_CLASS}])', '\1 \2', 'g'), '([^{_CLASS}])([{_CLASS}])', '\1 \2', 'g')"
_FOLDED = "translate(s, '開門國機語讀書車關', '开门国机语读书车关')"


@query("script_boundary", f"SELECT s, {_SPACED} AS spaced FROM {_values(CJK_TEXTS, 's')}")
def script_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, CJK_TEXTS, "s string").select("s", text.spaced(F.col("s")).alias("spaced"))


@query("fold_t2s", f"SELECT s, {_FOLDED} AS folded FROM {_values([*CJK_TEXTS, ('國語開關',)], 's')}")
def fold_t2s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [*CJK_TEXTS, ("國語開關",)], "s string").select("s", text.fold(F.col("s")).alias("folded"))


@query("tokenize_cjk", rf"""WITH x AS (SELECT s, {_SPACED.replace("(s,", f"({_FOLDED},")} AS t FROM {_values(CJK_TEXTS, 's')}),
g AS (SELECT s, list_filter(regexp_split_to_array(t, '[\n\r\pZ\pP]+'), lambda w: w <> '') AS ws FROM x)
SELECT s, array_to_string(flatten(list_transform(ws, lambda w: CASE WHEN regexp_full_match(w, '[{_CLASS}]+')
  THEN list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)), list_transform(range(1, length(w)), lambda i: substr(w, i, 2))) ELSE [w] END)), '/') AS tokens FROM g""")
def tokenize_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, CJK_TEXTS, "s string").select("s", F.array_join(text.tokens(F.col("s")), "/").alias("tokens"))


# --- search ---


def _search(name: str, asked: str, tokens: list[str], source=documents, sql: str = DOCS_SQL) -> None:
    @query(name, search_sql(tokens, sql))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(search.search(stored_index(spark, source(spark, sf_dir)), asked))


_search("search_exact_one", "a", ["a"])
_search("search_and_two", "The, and", ["the", "and"])
_search("search_dup_token", "thing thing", ["thing", "thing"])
_search("search_no_hit", "the qqqqqqqqqqqqqqqqqqqq", ["the", "qqqqqqqqqqqqqqqqqqqq"])
_search("search_fuzzy", "thing thtion", ["thing", "thtion"])
_search("search_accented", "ément", ["ément"])
_search("search_conversations", "tion hand", ["tion", "hand"], conversations, TURNS_SQL)


@query("search_terms", f"WITH {hits_sql(['heit', 'von'])} SELECT uri, unnest(terms) AS term FROM h")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(stored_index(spark, documents(spark, sf_dir)), "heit von").select("uri", F.explode("terms").alias("term"))


ASKED = ["thing", "thtion", "a", "ément", "des", "the"]


@query("fuzzy_candidates", f"WITH {hits_sql(ASKED)} SELECT qpos::INT AS qpos, term, df, distance::INT AS distance, round(weight, 6) AS weight FROM c")
def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.candidates(stored_index(spark, documents(spark, sf_dir)), list(enumerate(ASKED)))
    return found.select("qpos", "term", "df", "distance", F.round("weight", 6).alias("weight"))


PAIRS = [("bitter", "butter"), ("abc", "abc"), ("", "abc"), ("ab", "ba"), ("book", "back"), ("walking", "walkng"), ("a", "bcdefg")]


@query("edit_distance", f"SELECT a, b, CASE WHEN levenshtein(a, b) <= 2 THEN levenshtein(a, b) ELSE -1 END::INT AS distance FROM {_values(PAIRS, 'a, b')}")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, PAIRS, "a string, b string").select("a", "b", search.edit_distance(F.col("a"), F.col("b"), 2).alias("distance"))


@query("fuzzy_budget", f"SELECT qterm, {BUDGET_SQL}::INT AS budget FROM (SELECT repeat('x', i::INT) AS qterm FROM range(1, 21) r(i))")
def fuzzy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 21).select(F.repeat(F.lit("x"), F.col("id").cast("int")).alias("qterm")).select("qterm", search.edit_budget(F.col("qterm")).alias("budget"))


def _dated(hits: DataFrame) -> DataFrame:
    return hits.withColumn("created_at", F.concat(F.lit("2024-01-"), F.lpad((F.col("uri").cast("long") % 28 + 1).cast("string"), 2, "0"))).withColumn("score", F.round("score", 6))


def _rank(by: str, order: str) -> None:
    sql = f"""WITH {hits_sql(["hand", "the"])}, g AS (SELECT uri, round(score, 6) AS score, '2024-01-' || lpad((uri::BIGINT % 28 + 1)::VARCHAR, 2, '0') AS created_at FROM h)
SELECT uri, score, created_at, row_number() OVER (ORDER BY {order}score DESC, uri) AS rank FROM g"""

    @query(f"search_rank_{by}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = search.search(stored_index(spark, documents(spark, sf_dir)), "hand the")
        return search.ranked(_dated(hits).drop("terms"), by)


_rank("relevance", "")
_rank("newest", "created_at DESC, ")
_rank("oldest", "created_at, ")


# --- pages ---


_BLOCKS = "|".join(sorted(BLOCKS, key=lambda b: (-len(b), b)))
#: Text of the pages: script text stays as it is, comments go, block elements give a space, other tags nothing.
_TEXT = "regexp_replace(html, '<!--.*?-->', '', 'gs')"
_TEXT = f"replace({_TEXT}, regexp_extract(html, '<script>(.*?)</script>', 1), translate(regexp_extract(html, '<script>(.*?)</script>', 1), '<', chr(1)))"
_TEXT = rf"regexp_replace(regexp_replace({_TEXT}, '<(?:{_BLOCKS})(?:\s[^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g')"
_TEXT = f"replace(replace(replace(replace({_TEXT}, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
TEXT_SQL = rf"trim(regexp_replace(translate({_TEXT}, chr(1), '<'), '[\s\v]+', ' ', 'g'))"
PAGES_SQL = f"SELECT page_id::VARCHAR AS uri, {TEXT_SQL} AS content FROM pages"


@query("strip_html", f"SELECT uri, content AS text FROM ({PAGES_SQL})")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("uri", html_to_text(F.col("content")).alias("text"))


@query("page_search", search_sql(["theand", "tion"], PAGES_SQL))
def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pages(spark, sf_dir).select("uri", html_to_text(F.col("content")).alias("content"))
    return shown(search.search(stored_index(spark, texts), "theand tion"))


@query("searchable_statuses", f"""SELECT uri, content || if(uri::BIGINT % 3 = 0, ' warned ' || uri, '') || if(uri::BIGINT % 2 = 0, ' first image second image', '') AS text FROM ({PAGES_SQL})""")
def searchable_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, content warning (null, empty or given) and media descriptions (some of them null or empty)."""
    n = F.col("uri").cast("long")
    warning = F.when(n % 3 == 0, F.concat(F.lit("warned "), "uri")).when(n % 3 == 1, F.lit(""))
    told = [F.struct(F.lit("image").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("url", "preview_url")], F.lit(d).cast("string").alias("description")) for d in ("first image", None, "", "second image")]
    media = F.when(n % 2 == 0, F.array(*told).cast(store.MEDIA))
    stored = pages(spark, sf_dir).withColumn("spoiler_text", warning).withColumn("media", media)
    return index_docs(stored).withColumnRenamed("content", "text")


FOUND = ["the", "des", "von", "ément"]
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("highlight_documents", rf"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\s\pP\pZ]+|[^\s\pP\pZ]+')) AS run, generate_subscripts(regexp_extract_all(text, '[\s\pP\pZ]+|[^\s\pP\pZ]+'), 1) AS k FROM documents)
SELECT doc_id::VARCHAR AS uri, '<p>' || string_agg(CASE WHEN lower(run) IN ({", ".join(map(repr, FOUND))}) THEN '<mark>' || {_ESCAPED.format("run")} || '</mark>' ELSE {_ESCAPED.format("run")} END, '' ORDER BY k) || '</p>' AS content FROM r GROUP BY doc_id""")
def highlight_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.col("content")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    page = documents(spark, sf_dir).select("uri", F.concat(F.lit("<p>"), escaped, F.lit("</p>")).alias("content"))
    return page.select("uri", highlight(F.col("content"), F.array(*[F.lit(t) for t in FOUND])).alias("content"))


MARKED = [("開門見山", "开门 门"), ("开门 開  门", "开 门 开门"), ("山門", "开门"), ("x開門y", "开门"), ("見山", "")]


@query("highlight_cjk", f"""SELECT s, found, CASE found WHEN '开门 门' THEN regexp_replace(s, '([開开][門门]|[門门])', '<mark>\\1</mark>', 'g') WHEN '开 门 开门' THEN regexp_replace(s, '([開开門门]+)', '<mark>\\1</mark>', 'g')
WHEN '开门' THEN regexp_replace(s, '([開开][門门])', '<mark>\\1</mark>', 'g') ELSE s END AS content FROM {_values(MARKED, "s, found")}""".replace("\\\\", "\\"))
def highlight_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = rows(spark, MARKED, "s string, found string")
    return given.select("s", "found", highlight(F.col("s"), F.split("found", " ")).alias("content"))


@query("highlight_pages")
def highlight_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir).withColumn("found", F.array(F.lit("the"), F.lit("des"), F.lit("von")))
    return found.select("uri", highlight(F.col("content"), F.col("found")).alias("content"))


CARD_SQL = f"""WITH {hits_sql(["theand"])}, o AS (SELECT doc_id, doc_id::VARCHAR AS uri, source FROM documents)
SELECT h.uri, round(score, 6) AS score, if(doc_id % 3 = 0, upper(source), source) AS display_name, upper(substr(source, 1, 1)) AS initial, '' AS avatar, source AS acct,
if(doc_id % 2 = 0, 'https://l/' || h.uri, 'https://i/@' || source || '/' || h.uri) AS link, 'https://i/@' || source AS profile, '原創,喜歡' AS badges, '前天' AS time, '2024/5/1 12:00:00' AS time_title
FROM h JOIN o USING (uri)"""


def status_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored statuses: the source is the author."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    uri, nothing = F.col("doc_id").cast("string"), F.lit(None).cast("string")
    types = F.array(F.lit("post"), F.lit("favourite"))
    return table.select(
        uri.alias("uri"), F.col("text").alias("content"), F.lit("2024-05-01T12:00:00Z").alias("created_at"), F.col("source").alias("acct"), uri.alias("id"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://l/"), uri)).otherwise(F.lit("")).alias("url"), nothing.alias("spoiler_text"), F.lit(None).cast(store.MEDIA).alias("media"), types.alias("types"),
    )


@query("result_cards", CARD_SQL)
def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits joined with statuses and authors; a third of the authors' rows has a name."""
    stored = status_table(spark, sf_dir)
    names = stored.select("acct").distinct().select("acct", F.upper("acct").alias("display_name"), F.lit(None).cast("string").alias("avatar"), F.lit(None).cast("string").alias("url"))
    hits = search.search(stored_index(spark, documents(spark, sf_dir)), "theand")
    third = F.col("uri").cast("long") % 3 == 0
    now = F.lit("2024-05-03 12:00:00").cast("timestamp")
    made = [cards(hits.where(own), stored, authors, F.lit("https://i"), now) for own, authors in ((third, names), (~third, names.where("1 = 0")))]
    both = made[0].unionByName(made[1])
    return both.select("uri", F.round("score", 6).alias("score"), "display_name", F.col("initial"), "avatar", "acct", "link", "profile", F.array_join("badges", ",").alias("badges"), "time", "time_title")


@query("result_counts", f"""WITH {hits_sql(["hand", "the"])} SELECT count(*) AS found, count(*) FILTER (WHERE uri::BIGINT % 5 < 2) AS shown FROM h""")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits there are, and how many of them are of the types that are shown."""
    built = stored_index(spark, documents(spark, sf_dir))
    kinds = F.array(*[F.array(F.lit(t)) for t in ("post", "boost", "favourite", "bookmark", "other")])
    types = documents(spark, sf_dir).select("uri", F.get(kinds, (F.col("uri").cast("long") % 5).cast("int")).alias("types"))
    return search.result_counts(search.search(built, "hand the"), types)


NO_HITS = "SELECT ''::VARCHAR AS uri, 0e0 AS score, ''::VARCHAR AS terms WHERE false"


@query("search_blank", NO_HITS)
def search_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.search(index.build(documents(spark, sf_dir)), " ,. \n"))


@query("search_empty_index", NO_HITS)
def search_empty_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.search(index.build(documents(spark, sf_dir).where("1 = 0")), "the"))


# --- archive ---


@query("type_filter", """WITH u AS (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS uri FROM u WHERE list_has_any(types, ['purchase', 'signup'])""")
def type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = store.types_of(store.marks(events(spark, sf_dir)), "uri")
    return search.with_types(marked, ("purchase", "signup")).select("uri")


@query("type_tallies", """WITH n AS (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY user_id)
SELECT count(*) FILTER (WHERE list_has_any(types, ['click', 'error'])) AS posts, count(*) FILTER (WHERE list_contains(types, 'view')) AS favourites,
count(*) FILTER (WHERE list_contains(types, 'purchase')) AS bookmarks, count(*) AS statuses FROM n""")
def type_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("click", "post", "error", "boost", "view", "favourite", "purchase", "bookmark")])
    renamed = events(spark, sf_dir).withColumn("type", F.coalesce(names[F.col("type")], F.col("type")))
    return store.tallies(store.types_of(store.marks(renamed), "uri"))


@query("dedup_first", """SELECT user_id::VARCHAR AS uri, arg_min(props, event_id) AS content, strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S') AS created_at,
arg_min(event_type, event_id) AS acct FROM events GROUP BY user_id""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_statuses(events(spark, sf_dir)).select("uri", "content", "created_at", "acct")


@query("upsert_last", "SELECT event_type AS acct, arg_max(props, event_id) AS display_name, max(event_id)::VARCHAR AS url FROM events GROUP BY event_type")
def upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_entries = events(spark, sf_dir)
    early = store.last_authors(all_entries.where("seq % 2 = 0"))
    late = all_entries  # a second batch that brings everything again
    return store.upsert_authors(early, late).select("acct", "display_name", "url")


@query("mark_types", """WITH m AS (SELECT user_id, event_type, min(event_id) AS seq FROM events GROUP BY ALL)
SELECT user_id::VARCHAR AS uri, string_agg(event_type, ',' ORDER BY seq) AS types FROM m GROUP BY user_id""")
def mark_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.types_of(store.marks(events(spark, sf_dir)), "uri").select("uri", F.array_join("types", ",").alias("types"))


@query("page_all_known", f"""WITH e AS (SELECT *, event_id // {PAGE_SIZE} AS page FROM events), f AS (SELECT user_id, event_type, min(page) AS first_page FROM e GROUP BY ALL)
SELECT page, bool_and(first_page < page) AS all_known FROM e JOIN f USING (user_id, event_type) GROUP BY page""")
def page_all_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = events(spark, sf_dir).withColumn("page", F.floor(F.col("seq") / PAGE_SIZE))
    return store.pages_known(paged)


@query("add_batches", "SELECT count(DISTINCT user_id) AS statuses, count(DISTINCT (user_id, event_type)) AS marks FROM events")
def add_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the second with all of the first again: nothing is stored twice."""
    both = events(spark, sf_dir)
    first = both.where("seq % 3 = 0")
    statuses, marks = store.first_statuses(first), store.marks(first)
    statuses = statuses.unionByName(store.add_statuses(statuses, both))
    marks = marks.unionByName(store.add_marks(marks, both))
    return statuses.agg(F.count(F.lit(1)).alias("statuses")).join(marks.agg(F.count(F.lit(1)).alias("marks")))


@query("stream_ingest", """SELECT user_id::VARCHAR AS uri, 'post' AS types,
coalesce(arg_min(props, event_id) FILTER (WHERE event_id % 2 = 0), arg_min(props, event_id)) AS content FROM events GROUP BY user_id""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events landed as page files, ingested as a stream that is broken off and goes on."""
    landing, base = fresh_dir(spark, "landing"), fresh_dir(spark, "archive")
    nothing = F.lit(None).cast(f"struct<{store.STATUS}>").alias("reblog")
    own = events(spark, sf_dir)
    for part in (0, 1):
        page = own.where(F.col("seq") % 2 == part).select("store_key", "seq", F.col("s").alias("status"), nothing)
        page.write.mode("append").json(landing)
        ingest.ingest(spark, landing, base).awaitTermination()
    return ingest.statuses(spark, base).select("uri", F.array_join("types", ",").alias("types"), "content")


def page_of(own: DataFrame, boosted: Column | None = None) -> DataFrame:
    """Entries as a page of the service."""
    nothing = F.lit(None).cast(f"struct<{store.STATUS}>")
    wrapper = F.col("s").withField("uri", F.concat(F.lit("w"), F.col("seq").cast("string"))) if boosted is not None else F.col("s")
    status = F.when(boosted, wrapper).otherwise(F.col("s")) if boosted is not None else wrapper
    return own.select("store_key", "seq", status.alias("status"), (F.when(boosted, F.col("s")) if boosted is not None else nothing).alias("reblog"))


@query("own_entries", """WITH m AS (SELECT user_id, if(event_type = 'click', 'boost', 'post') AS type, min(event_id) AS seq FROM events GROUP BY ALL),
t AS (SELECT user_id, string_agg(type, ',' ORDER BY seq) AS types FROM m GROUP BY user_id)
SELECT user_id::VARCHAR AS uri, types, content FROM t JOIN (SELECT user_id, arg_min(props, event_id) AS content FROM events GROUP BY user_id) USING (user_id)""")
def own_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own posts and boosts: a boost stands for the status that it boosts."""
    found = store.unwrapped(page_of(events(spark, sf_dir), F.col("type") == "click"))
    types = store.types_of(store.marks(found), "store_key", "uri")
    return store.first_statuses(found).join(types, ["store_key", "uri"]).select("uri", F.array_join("types", ",").alias("types"), "content")


@query("marked_lists", """WITH e AS (SELECT *, if(event_type = 'purchase', 'favourite', 'bookmark') AS type FROM events WHERE event_type IN ('purchase', 'view')),
m AS (SELECT user_id, type, min(event_id) AS seq FROM e GROUP BY ALL)
SELECT user_id::VARCHAR AS uri, string_agg(type, ',' ORDER BY seq) AS types, (SELECT coalesce(arg_min(props, event_id) FILTER (WHERE type = 'favourite'), arg_min(props, event_id)) FROM e WHERE e.user_id = m.user_id) AS content FROM m GROUP BY user_id""")
def marked_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites, then bookmarks, each ingested as a stream of landed pages into one archive."""
    base, own = fresh_dir(spark, "archive"), events(spark, sf_dir)
    for kind, event in (("favourite", "purchase"), ("bookmark", "view")):
        landing = fresh_dir(spark, "landing")
        page_of(own.where(F.col("type") == event)).write.json(landing)
        ingest.ingest(spark, landing, base, kind=kind).awaitTermination()
    return ingest.statuses(spark, base).select("uri", F.array_join("types", ",").alias("types"), "content")


@query("walk_favourites", "SELECT event_id::VARCHAR AS uri, 'favourite' AS types, props AS content, 'done idle' AS position, 0 AS without_token FROM events WHERE event_type = 'purchase'")
def walk_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of purchases, newest first, is walked back page by page; a walk is broken off and goes on;
    then newer entries have come, and a second walk catches up until a page holds nothing new."""
    base, own = fresh_dir(spark, "archive"), events(spark, sf_dir).where(F.col("type") == "purchase")
    own = own.withColumn("s", F.col("s").withField("uri", F.col("seq").cast("string")))
    low, high = own.agg(F.min("seq"), F.max("seq")).first()
    size = (high - low) // 5 + 1
    state = {"at": paging.Position(), "top": low + 3 * size, "opened": 0, "breaks": 2, "n": 0}

    def open_page(max_id: str | None) -> tuple[DataFrame, str | None]:
        state["opened"] += 1
        if state["opened"] == state["breaks"]:
            raise ConnectionError
        end = min(int(max_id), state["top"]) if max_id is not None else state["top"]
        page = own.where((F.col("seq") >= end - size) & (F.col("seq") < end))
        return page_of(page), f"limit={size}&max_id={end - size}" if end - size > low else None

    def save(found: DataFrame | None, position: paging.Position) -> None:
        if found is not None:
            state["n"] += 1
            ingest.save_entries(found, base, state["n"])
        state["at"] = position

    def walk(token: str | None) -> None:
        paging.walk_marked(state["at"], "favourite", token, open_page, lambda: ingest.table(spark, base, "marks", ingest.MARKS), save)

    walk(None)
    untouched = state["opened"]
    try:
        walk("token")
    except ConnectionError:
        walk("token")
    state["top"] = high + 1
    walk("token")
    at = state["at"]
    kept = ingest.statuses(spark, base).select("uri", F.array_join("types", ",").alias("types"), "content")
    return kept.select("*", F.lit(f"{at.backfill} {at.catchup}").alias("position"), F.lit(untouched).alias("without_token"))


@query("store_round_trip", "SELECT event_type AS acct, arg_max(props, event_id) AS display_name, max(event_id)::VARCHAR AS url, (SELECT count(DISTINCT user_id) FROM events) AS statuses FROM events GROUP BY event_type")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches stored, the second one twice, and read back."""
    base, own = fresh_dir(spark, "archive"), events(spark, sf_dir)
    for k, batch in enumerate((own.where("seq % 2 = 0"), own, own)):
        ingest.save_entries(batch, base, k)
    n = ingest.statuses(spark, base).count()
    return ingest.authors(spark, base).select("acct", "display_name", "url", F.lit(n).cast("long").alias("statuses"))


ACCOUNTS = [("https://north.example", "ida@north.example", "4"), ("https://south.example", "jo@south.example", "4"), ("https://north.example", "kim@north.example", "9")]
_STEPS = [("add", 0, "0", 0), ("add", 1, "0 1", 1), ("add", 2, "0 1 2", 2), ("activate", 0, "0 1 2", 0), ("remove", 0, "1 2", 1), ("remove", 2, "1", 1), ("activate", None, "1", None), ("remove", 1, "", None)]


@query("sessions", f"SELECT step, accounts, active FROM {_values([(str(k), a, None if b is None else str(b)) for k, (_, _, a, b) in enumerate(_STEPS)], 'step, accounts, active')}")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts are added, made active and removed; after each step, which are there and which is active."""
    given = [Account(*a) for a in ACCOUNTS]
    keys, kept, out = [a.key for a in given], Sessions(spark, fresh_dir(spark, "sessions")), []
    for k, (step, which, _, _) in enumerate(_STEPS):
        getattr(kept, step)(given[which] if step == "add" else None if which is None else keys[which])
        active = kept.active()
        out.append((str(k), " ".join(str(keys.index(a.key)) for a in kept.accounts()), None if active is None else str(keys.index(active))))
    return rows(spark, out, "step string, accounts string, active string")


@query("session_switch", """SELECT place, documents, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = if(place = 'second', 'view', 'purchase')) AS statuses
FROM (VALUES ('second'), ('first'), ('unknown')) v(place), LATERAL (SELECT count(DISTINCT user_id) AS documents FROM events WHERE event_type = if(place = 'second', 'view', 'purchase'))""")
def session_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two accounts with archives of their own: each is opened with its statuses and its index; an unknown key
    leaves the one that is open."""
    kept, own, out = Sessions(spark, fresh_dir(spark, "sessions")), events(spark, sf_dir), []
    first, second = (Account(*a) for a in ACCOUNTS[:2])
    for account, event in ((first, "purchase"), (second, "view")):
        ingest.save_entries(own.where(F.col("type") == event), kept.folder(kept.add(account)), 0)
    for place, opened in (("second", lambda: kept.open()), ("first", lambda: kept.switch(first.key)), ("unknown", lambda: kept.switch("store:none:0"))):
        now = opened()
        out.append((place, now.index.stats()[0], now.statuses.count()))
    return rows(spark, out, "place string, documents long, statuses long")


# --- names, links, positions, times ---

TYPED = [("someone@host.example",), ("@someone@host.example",), ("host.example",), ("https://host.example/",), ("http://host.example",), ("https://host.example/@someone",), ("  host.example  ",)]


@query("instance_url", f"SELECT s, 'https://' || split_part(regexp_replace(regexp_replace(regexp_replace(trim(s), '^@', ''), '^https?://', ''), '/.*$', ''), '@', -1) AS origin FROM {_values(TYPED, 's')}")
def instance_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, TYPED, "s string").select("s", text.instance_url(F.col("s")).alias("origin"))


@query("handle_check", f"SELECT s, regexp_full_match(s, '[^@\\s]+@[^@\\s]+') AS handle, split_part(s, '@', 1) AS name FROM {_values(TYPED, 's')}")
def handle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, TYPED, "s string").select("s", text.is_handle(F.col("s")).alias("handle"), text.account_name(F.col("s")).alias("name"))


@query("store_keys", "SELECT c_custkey, 'store:https://' || c_nationkey || '.example:' || c_custkey AS store_key, 'index:https://' || c_nationkey || '.example:' || c_custkey AS index_key FROM customer")
def store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/customer.parquet")
    site, owner = F.concat(F.lit("https://"), F.col("c_nationkey").cast("string"), F.lit(".example")), F.col("c_custkey").cast("string")
    return table.select("c_custkey", text.store_key(site, owner).alias("store_key"), text.index_key(site, owner).alias("index_key"))


LINKS = [("u1", "a@b", "7", "N", "https://m/1"), ("", "a", "8", "", ""), (None, "c@d.e", "9", None, None)]


@query("link_fallback", f"""SELECT id, coalesce(nullif(url, ''), 'https://i/@' || acct || '/' || id) AS link, coalesce(nullif(name, ''), acct) AS display_name,
coalesce(nullif(media, ''), coalesce(nullif(url, ''), 'https://i/@' || acct || '/' || id)) AS media_link, coalesce(nullif(url, ''), 'https://i/@' || acct) AS profile,
upper(substr(coalesce(nullif(name, ''), acct), 1, 1)) AS initial, CASE WHEN contains(acct, '@') THEN acct ELSE acct || '@i' END AS qualified FROM {_values(LINKS, 'url, acct, id, name, media')}""")
def link_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    site, name = F.lit("https://i"), text.display_name(F.col("name"), F.col("acct"))
    link = text.status_link(F.col("url"), site, F.col("acct"), F.col("id"))
    return rows(spark, LINKS, "url string, acct string, id string, name string, media string").select(
        "id", link.alias("link"), name.alias("display_name"), text.media_link(F.col("media"), link).alias("media_link"),
        text.profile_link(F.col("url"), site, F.col("acct")).alias("profile"), text.initial(name).alias("initial"), text.qualified(F.col("acct"), F.col("acct"), F.lit("i")).alias("qualified"),
    )


@query("type_badges", """SELECT s, coalesce(string_agg(CASE t WHEN 'post' THEN '原創' WHEN 'boost' THEN '轉嘟' WHEN 'favourite' THEN '喜歡' WHEN 'bookmark' THEN '書籤' END, ',' ORDER BY k), '') AS badges
FROM (SELECT s, unnest(string_split(s, ',')) AS t, unnest(range(len(string_split(s, ',')))) AS k FROM (VALUES ('post,boost'), ('bookmark,other,favourite'), ('other')) v(s)) GROUP BY s""")
def type_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, [("post,boost",), ("bookmark,other,favourite",), ("other",)], "s string").select("s", F.array_join(text.badges(F.split("s", ",")), ",").alias("badges"))


PARAMS = [("max_id=12&limit=40",), ("limit=40&max_id=7",), ("limit=40",), ("max_id=",), ("min_id=3&xmax_id=9",), (None,)]


@query("next_cursor", f"SELECT s, CASE WHEN regexp_matches(s, '(^|&)max_id=') THEN regexp_extract(s, '(?:^|&)max_id=([^&]*)', 1) END AS max_id FROM {_values(PARAMS, 's')}")
def next_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, PARAMS, "s string").select("s", next_max_id(F.col("s")).alias("max_id"))


CURSORS = [("0", None, None), ("123", None, None), (None, None, None), ("5", "resume", "77"), (None, "done", None)]


@query("cursor_migrate", f"""SELECT legacy, now, now_id, coalesce(now, CASE WHEN legacy = '0' THEN 'done' WHEN legacy IS NOT NULL THEN 'resume' ELSE 'top' END) AS state,
CASE WHEN now IS NOT NULL THEN now_id WHEN legacy <> '0' THEN legacy END AS max_id FROM {_values(CURSORS, 'legacy, now, now_id')}""")
def cursor_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = rows(spark, CURSORS, "legacy string, now string, now_id string")
    return given.select("*", migrated(F.col("legacy"), F.col("now"), F.col("now_id")).alias("p")).select("legacy", "now", "now_id", "p.state", "p.max_id")


FIXED_NOW = "2024-01-30 12:00:00"


@query("relative_time", f"""WITH e AS (SELECT event_id, ts, floor(epoch_us(ts)::DOUBLE / 1e6 - epoch('{FIXED_NOW}'::TIMESTAMP) + 0.5e0)::BIGINT AS off FROM events),
x AS (SELECT *, abs(off) AS size, floor(off / 60e0 + 0.5e0)::BIGINT AS mi, floor(off / 3600e0 + 0.5e0)::BIGINT AS ho, floor(off / 86400e0 + 0.5e0)::BIGINT AS da FROM e)
SELECT event_id, CASE WHEN size < 60 THEN '剛剛' WHEN size < 3600 THEN abs(mi) || ' 分鐘' || if(mi > 0, '後', '前') WHEN size < 86400 THEN abs(ho) || ' 小時' || if(ho > 0, '後', '前')
WHEN size < 604800 THEN CASE da WHEN -1 THEN '昨天' WHEN -2 THEN '前天' WHEN 1 THEN '明天' WHEN 2 THEN '後天' ELSE abs(da) || ' 天' || if(da > 0, '後', '前') END
ELSE month(ts) || '月' || day(ts) || '日' END AS shown FROM x""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    iso: Column = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table.select("event_id", dates.relative_time(iso, F.lit(FIXED_NOW).cast("timestamp")).alias("shown"))


@query("full_time", "SELECT event_id, strftime(ts, '%Y/%-m/%-d %H:%M:%S') AS shown FROM events")
def full_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return table.select("event_id", dates.full_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("shown"))


@query("handle_parts", "SELECT c_custkey, 'u' || c_custkey AS name, if(c_custkey % 2 = 0, 'n' || c_nationkey || '.example', NULL) AS host, 'u' || c_custkey || '@' || if(c_custkey % 2 = 0, 'n' || c_nationkey || '.example', 'home.example') AS qualified, c_custkey % 2 = 0 AS handle FROM customer")
def handle_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local and remote accounts, cut into name and host."""
    table = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    acct = F.when(F.col("c_custkey") % 2 == 0, F.concat(name, F.lit("@n"), F.col("c_nationkey").cast("string"), F.lit(".example"))).otherwise(name)
    given = table.select("c_custkey", acct.alias("acct"))
    a = F.col("acct")
    return given.select("c_custkey", text.account_name(a).alias("name"), text.account_host(a).alias("host"), text.qualified(a, a, F.lit("home.example")).alias("qualified"), text.is_handle(a).alias("handle"))


@query("count_labels", "SELECT r_regionkey, format('{:,}', r_regionkey * 1234567) AS label FROM region")
def count_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", text.count_label(F.col("r_regionkey").cast("long") * 1234567).alias("label"))
