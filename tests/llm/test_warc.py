import gzip
import hashlib
import uuid
import zlib

import pytest
from pyarrow import fs

from quillspark.llm import warc as w

PAGES = [(1, "http://a/", "x" * 200), (2, None, "x" * 200), (3, "b\r\nInjected: 1", "x" * 200), (2, "again", "x" * 200), (4, "c", None), (5, "d", ""), (6, "e", "y"), (7, "f", "y"), (None, "g", "x" * 200), (8, "é", "é" * 50), (9, "h", "é" * 50), (10, "i", "WARC/1.1\r\n\r\n" * 30_000), (None, "j", "only without ids " * 10)]


def table(spark, rows=None):
    return spark.createDataFrame([(*r, "z", "z") for r in (PAGES if rows is None else rows)], "page_id long, url string, html string, digest string, first string")


def test_pages_come_back(spark):
    archives, base = w.archive_pages(spark, table(spark))
    rows = w.read_archives(archives, base).collect()
    assert len(rows) == len(PAGES)
    html = {}
    for i, _, h in PAGES:
        html.setdefault(i, []).append((h or "").encode())
    first = {}
    for i, _, h in PAGES:
        if i is not None and h:
            first[h] = min(first.get(h, i), i)
    for r in rows:
        digests = {hashlib.sha256(p).hexdigest(): p for p in html[r["page_id"]]}
        payload = digests[r["payload_digest"]]
        assert r["payload_bytes"] == len(payload)
        known = first.get(payload.decode()) if len(payload) >= 100 else None
        again = known is not None and r["page_id"] != known
        assert (r["record_type"], r["refers_to"]) == (("revisit", known) if again else ("response", None))
    urls = {r["page_id"]: r["url"] for r in rows}
    assert urls[3] == "b%0D%0AInjected: 1" and urls[8] == "é" and urls[1] == "http://a/"


def test_ids_are_unique(spark):
    """Rows that share a page_id, or page_id and payload; many copies of one payload."""
    same = "same " * 40
    rows = [(1, "a", same), (1, "b", same), (1, "c", "x" * 300), (2, "d", same), (3, "e", "small"), (3, "f", "small"), *((10 + k, "g", same) for k in range(40))]
    archives, base = w.archive_pages(spark, table(spark, rows))
    system, folder = w._place(base)
    ids, refers = [], []
    for f in system.get_file_info(fs.FileSelector(folder)):
        if f.path.endswith(".idx"):
            for line in system.open_input_file(f.path).read().splitlines():
                offset, size, kind, urn = w.json.loads(line)
                ids.append(urn)
                meta, block = w.read_record(system, f.path.removesuffix(".idx"), offset, size)
                assert (kind == "revisit") == block.endswith(b"\r\n\r\n")
                refers += [meta["warc-refers-to"]] if kind == "revisit" else []
    assert len(ids) == len(set(ids)) == len(rows) and len(refers) == 41 and len(set(refers)) == 1
    found = w.read_archives(archives, base).toPandas()
    assert sorted(found.page_id) == sorted(r[0] for r in rows) and set(found.refers_to.dropna()) == {1}
    assert set(found[found.payload_digest == hashlib.sha256(same.encode()).hexdigest()].payload_bytes) == {200}


def test_each_record_is_a_member(spark):
    archives, base = w.archive_pages(spark, table(spark))
    system, folder = w._place(base)
    files = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".gz")]
    assert files and not any("mono-" in f for f in files)
    n = 0
    for path in files:
        raw = system.open_input_file(path).read()
        lines = [w.json.loads(x) for x in system.open_input_file(path + ".idx").read().splitlines()]
        assert sum(x[1] for x in lines) == len(raw) and [x[0] for x in lines] == [sum(y[1] for y in lines[:k]) for k in range(len(lines))]
        for offset, size, kind, urn in lines:
            engine = zlib.decompressobj(31)
            engine.decompress(raw[offset : offset + size])
            assert engine.eof and not engine.unused_data
            meta, _ = w.read_record(system, path, offset, size)
            assert meta["warc-type"] == kind and meta["warc-record-id"] == urn and meta[""] == "WARC/1.1"
            n += 1
    assert n == len(PAGES)


@pytest.mark.parametrize("members", ["one", "each", "pairs"])
def test_any_gzip_is_normalised(tmp_path, members):
    records = [w.record(k, f"http://{k}/", bytes([k]) * (k * 50_000), hashlib.sha256(bytes([k]) * (k * 50_000)).hexdigest(), None) for k in range(12)]
    parts = {"one": [b"".join(records)], "each": records, "pairs": [a + b for a, b in zip(records[::2], records[1::2])]}[members]
    (tmp_path / "in.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    system = fs.LocalFileSystem()
    assert w.normalise(system, f"{tmp_path}/in.gz", f"{tmp_path}/out.gz") == 12
    assert gzip.decompress((tmp_path / "out.gz").read_bytes()) == b"".join(records)
    for k, line in enumerate((tmp_path / "out.gz.idx").read_text().splitlines()):
        offset, size, _, urn = w.json.loads(line)
        assert urn.startswith(f"<urn:page:{k}:") and w.read_record(system, f"{tmp_path}/out.gz", offset, size)[1].endswith(bytes([k]) * (k * 50_000))


def test_a_cut_archive_is_an_error(tmp_path):
    whole = w.record(1, "u", b"p" * 1000, "0", None)
    (tmp_path / "in.gz").write_bytes(gzip.compress(whole[:-300]))
    with pytest.raises(ValueError):
        w.normalise(fs.LocalFileSystem(), f"{tmp_path}/in.gz", f"{tmp_path}/out.gz")
    assert not (tmp_path / "out.gz").exists()


def test_a_repeated_task_finds_its_work_done(spark):
    base = f"{w.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    system, folder = w._place(base)
    system.create_dir(folder)
    mono = w.written(w.write_archives(w.typed_pages(table(spark)), base), "mono")
    first = sorted(map(tuple, w.normalise_archives(mono, base).collect()))
    assert sorted(map(tuple, w.normalise_archives(mono, base).collect())) == first


def test_no_pages(spark):
    archives, base = w.archive_pages(spark, table(spark).where("1 = 0"))
    assert w.read_archives(archives, base).collect() == []
