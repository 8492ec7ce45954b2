"""Tables, positions, sessions and streams of the archive."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import store
from quillspark.sources.paging import DONE, IDLE, RESUME, TOP, Position, next_max_id, walk_marked, walk_own
from quillspark.sources.place import fresh_dir
from quillspark.sources.sessions import Account, Sessions
from quillspark.streaming import ingest


def status(uri, content="c", acct="ann", name="Ann"):
    return (uri, f"id-{uri}", None, content, "2024-01-01T00:00:00Z", "", [], (acct, name, "", ""))


def pages(spark, rows):
    """Rows of (seq, status, reblog)."""
    return spark.createDataFrame([("store:i:1", k, s, r) for k, s, r in rows], store.PAGE)


def test_first_status_last_author_and_types(spark):
    page = pages(spark, [(1, status("u", "old", name="A"), None), (2, status("x"), status("u", "new", name="B")), (3, status("v", acct="bob"), None), (4, status("u", "newer", name="C"), None)])
    entries = store.unwrapped(page)
    found = {r["uri"]: (r["content"], r["acct"]) for r in store.first_statuses(entries).collect()}
    assert found == {"u": ("old", "ann"), "v": ("c", "bob")}
    assert {r["acct"]: r["display_name"] for r in store.last_authors(entries).collect()} == {"ann": "C", "bob": "Ann"}
    types = store.types_of(store.marks(entries), "uri")
    assert {r["uri"]: r["types"] for r in types.collect()} == {"u": ["post", "boost"], "v": ["post"]}
    assert tuple(store.tallies(types).first()) == (2, 0, 0, 2)


def test_known_needs_the_same_type(spark):
    posts = store.unwrapped(pages(spark, [(1, status("u"), None)]))
    marked = store.typed(pages(spark, [(2, status("u"), None)]), "favourite")
    assert store.all_known(store.marks(posts), posts) and not store.all_known(store.marks(posts), marked)
    assert store.all_known(store.marks(posts), posts.where("1 = 0"))


class Service:
    """A list of marked statuses, newest first, in pages of two; breaks once at a given page."""

    def __init__(self, spark, uris):
        self.spark, self.uris, self.opened, self.fail = spark, uris, [], None

    def open(self, max_id):
        self.opened.append(max_id)
        if max_id is not None and max_id == self.fail:
            raise ConnectionError
        at = 0 if max_id is None else int(max_id)
        own = self.uris[at : at + 2]
        page = pages(self.spark, [(1000 + at + k, status(u), None) for k, u in enumerate(own)])
        return page, f"limit=2&max_id={at + 2}" if at + 2 < len(self.uris) else None


class Kept:
    def __init__(self, spark):
        self.spark, self.base, self.n, self.position = spark, fresh_dir(spark, "archive"), 0, Position()

    def marks(self):
        return ingest.table(self.spark, self.base, "marks", ingest.MARKS)

    def save(self, entries, position):
        if entries is not None:
            ingest.save_entries(entries, self.base, self.n)
            self.n += 1
        self.position = position

    def uris(self):
        return {r["uri"] for r in ingest.statuses(self.spark, self.base).collect()}


def test_backfill_breaks_resumes_and_catches_up(spark):
    service, kept = Service(spark, [f"u{k}" for k in range(5)]), Kept(spark)
    walk = lambda: walk_marked(kept.position, "favourite", "token", service.open, kept.marks, kept.save)
    service.fail = "2"
    with pytest.raises(ConnectionError):
        walk()
    assert kept.position == Position(RESUME, "2") and kept.uris() == {"u0", "u1"}
    service.fail, service.opened = None, []
    assert walk() == Position(DONE, None, IDLE, None) and kept.uris() == {f"u{k}" for k in range(5)}
    assert service.opened == ["2", "4", None]  # goes on, then looks at the top once
    service.uris, service.opened = ["n0", "n1", "n2", *service.uris], []
    walk()
    assert kept.uris() >= {"n0", "n1", "n2"} and service.opened == [None, "2", "4"]  # until a page is all known
    assert {tuple(r["types"]) for r in ingest.statuses(spark, kept.base).collect()} == {("favourite",)}


def test_no_token_no_walk(spark):
    service = Service(spark, ["u"])
    assert walk_marked(Position(), "bookmark", None, service.open, None, None) == Position(TOP) and not service.opened


def test_own_entries(spark):
    batches, seen = [["c", "b"], ["e", "d"], []], []
    open_page = lambda min_id: pages(spark, [(k, status(u), None) for k, u in enumerate(batches[len(seen)])])
    assert walk_own("0", open_page, lambda entries, at: seen.append((at, entries.count()))) == "id-e"
    assert seen == [("id-c", 2), ("id-e", 2)]


def test_next_max_id(spark):
    cases = {"max_id=12&limit=40": "12", "limit=40&max_id=7": "7", "limit=40": None, "xmax_id=9": None, "max_id=a%2Bb": "a+b", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", next_max_id(F.col("s")).alias("m")).collect()
    assert {r["s"]: r["m"] for r in rows} == cases


def test_sessions(spark):
    sessions = Sessions(spark, fresh_dir(spark, "sessions"))
    assert sessions.accounts() == [] and sessions.active() is None
    a, b = Account("https://i", "ann@i", "1"), Account("https://j", "bob@j", "1")
    sessions.add(a)
    sessions.add(b)
    assert a.key != b.key and sessions.accounts() == [a, b] and sessions.active() == b.key
    spark.range(3).write.parquet(f"{sessions.folder(a.key)}/statuses")
    again = Account("https://i", "ann2@i", "1")
    sessions.add(again)
    assert sessions.accounts() == [again, b] and sessions.active() == a.key
    assert spark.read.parquet(f"{sessions.folder(a.key)}/statuses").count() == 3
    sessions.remove(a.key)
    assert sessions.accounts() == [b] and sessions.active() == b.key
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{sessions.folder(a.key)}/statuses")
    sessions.activate(None)
    assert sessions.active() is None
    sessions.remove(b.key)
    assert sessions.accounts() == []


def test_a_single_old_account_moves_over(spark):
    base = fresh_dir(spark, "sessions")
    spark.createDataFrame([("https://i", "ann@i", "1")], "instance_url string, acct string, account_id string").write.parquet(f"{base}/account")
    sessions = Sessions(spark, base)
    assert sessions.accounts() == [Account("https://i", "ann@i", "1")] and sessions.active() == "store:https://i:1"


def test_stream_restarts_add_nothing_twice(spark):
    landing, base = fresh_dir(spark, "landing"), fresh_dir(spark, "archive")
    pages(spark, [(1, status("u", "<p>hello</p>"), None), (2, status("x"), status("v", "world"))]).write.json(landing)
    ingest.ingest(spark, landing, base).awaitTermination()
    pages(spark, [(3, status("u", "changed"), None), (4, status("w", "three"), None)]).write.mode("append").json(landing)
    ingest.ingest(spark, landing, base).awaitTermination()
    ingest.ingest(spark, landing, base).awaitTermination()
    later = fresh_dir(spark, "landing")
    pages(spark, [(11, status("u", "again"), None), (12, status("x"), status("v")), (14, status("w"), None)]).write.json(later)
    ingest.ingest(spark, later, base, kind="bookmark").awaitTermination()  # a marked list, which has no boosts
    rows = {r["uri"]: (r["content"], r["types"]) for r in ingest.statuses(spark, base).collect()}
    assert rows == {"u": ("<p>hello</p>", ["post", "bookmark"]), "v": ("world", ["boost"]), "w": ("three", ["post", "bookmark"]), "x": ("c", ["bookmark"])}
    from quillspark.operators import index, search

    built = index.load(spark, f"{base}/index")
    assert built.stats()[0] == 4 and [r["uri"] for r in search.search(built, "hello").collect()] == ["u"]


def test_a_batch_that_runs_again(spark):
    base = fresh_dir(spark, "archive")
    entries = store.unwrapped(pages(spark, [(1, status("u"), None)]))
    for _ in range(2):
        ingest.save_entries(entries, base, 0)
    assert ingest.statuses(spark, base).count() == 1 and ingest.authors(spark, base).count() == 1


def test_event_time_streams(spark):
    folder, out = fresh_dir(spark, "events"), fresh_dir(spark, "out")
    rows = [("u", "post", "2024-01-01 00:00:10"), ("u", "post", "2024-01-01 00:00:20"), ("v", "boost", "2024-01-01 00:05:00"), ("w", "post", "2024-01-01 02:00:00")]
    table = spark.createDataFrame(rows, "uri string, type string, at string").withColumn("at", F.col("at").cast("timestamp"))
    table.coalesce(1).write.parquet(folder)
    read = lambda: spark.readStream.schema(table.schema).parquet(folder)

    def drain(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{out}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["uri"] for r in drain(ingest.deduplicated(read(), "10 minutes"), "single")) == ["u", "v", "w"]
    assert {(r["type"], r["n"]) for r in drain(ingest.tallied(read(), "1 minute", "10 minutes"), "tallies")} >= {("post", 2), ("boost", 1)}
