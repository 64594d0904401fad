"""Archives round trip, and copies become revisits."""

from __future__ import annotations

import gzip
import hashlib
import random
from base64 import b32encode

import pytest

from snapcount.llm import warc
from snapcount.sources.stores import store

SCHEMA = "page_id long, url string, html string, file string, record_type string"


def digest(html: str | None) -> str:
    return b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages() -> list[tuple]:
    rng = random.Random(2)
    texts = ["", None, "<p>a</p>", "ñ𝄞\r\n\r\nWARC/1.1\r\n", "x" * 300_000] + [f"<p>{rng.random()}</p>" for _ in range(20)]
    rows = [(i, f"http://h/{i} a\n", texts[i % 7] if i % 3 else texts[5 + i % 20], "f", None) for i in range(90)]
    return rows + [(200, None, "<p>a</p>", None, None), (None, "", "<p>a</p>", None, None), (200, "again", "<p>a</p>", None, None)]


def expected(rows: list[tuple], least: int = 0) -> list[tuple]:
    groups: dict = {}
    for page, _, html, *_ in rows:
        groups.setdefault(digest(html), []).append(-1 if page is None else page)
    found, taken = [], set()
    for page, _, html, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else -r[0]):
        size, top = len((html or "").encode()), max(groups[digest(html)])
        first = page == top and digest(html) not in taken
        if first:
            taken.add(digest(html))
        copy = size >= least and not first
        found.append((page, size, digest(html), "revisit" if copy else "response", top if copy else None))
    return sorted(found, key=repr)


def read_back(spark, folder: str) -> list[tuple]:
    rows = warc.read(spark, folder).collect()
    number = lambda x: None if x is None else int(x)
    return sorted(
        ((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to_page)) for r in rows), key=repr
    )


@pytest.mark.parametrize("least", [0, 9])
def test_each_payload_is_stored_once(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "FILE_BYTES", 2_000)
    first, second = f"file://{tmp_path}/crawl", f"{tmp_path}/once"
    records = warc.write(spark.createDataFrame(pages(), SCHEMA).repartition(4), first)
    assert {r.record_type for r in records.collect()} == {"response"} and records.count() == 93
    assert records.select("file").distinct().count() > 5
    for given in (None, records):
        target = f"{second}-{given is None}"
        warc.deduplicate(spark, first, target, least, records=given)
        assert read_back(spark, target) == expected(pages(), least)
        again = f"{target}-again"
        warc.deduplicate(spark, target, again, least)
        assert read_back(spark, again) == expected(pages(), least)
        assert not list(tmp_path.glob("*/_staging*"))


def test_archives_follow_the_format(spark, tmp_path):
    folder, once = f"{tmp_path}/a", f"{tmp_path}/b"
    rows = [(1, "http://h/1", "<p>one</p>", None, None), (2, "http://h/2", "<p>one</p>", None, None)]
    warc.deduplicate(spark, folder, once, records=warc.write(spark.createDataFrame(rows, SCHEMA), folder))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "b").glob("*.warc.gz")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(b"<p>one</p>\r\n\r\n") == 1
    assert b"WARC-Refers-To-Target-URI: http://h/2\r\n" in data
    found = {r.record_type: r for r in warc.read(spark, once).collect()}
    assert found["revisit"].refers_to == found["response"].record_id and found["revisit"].page_id == "1"
    payloads = [bytes(r.payload) for r in warc.headers(spark, once, payloads=True).collect() if r.record_type == "response"]
    assert payloads == [b"<p>one</p>"]


def test_damaged_archives_are_refused(spark, tmp_path):
    folder = f"{tmp_path}/a"
    row = warc.write(spark.createDataFrame([(1, "u", "<p>one</p>", None, None)], SCHEMA), folder).head()
    system, root = store(folder)
    content = warc.response(row.asDict(), warc.http_head(10) + b"<p>two</p>")
    with system.open_output_stream(f"{root}/{row.file}", compression=None) as out:
        out.write(content)
    with pytest.raises(Exception, match="another digest"):
        warc.headers(spark, folder).collect()
    with system.open_output_stream(f"{root}/{row.file}", compression=None) as out:
        out.write(content[:-9])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.headers(spark, folder).collect()


def test_no_pages(spark, tmp_path):
    folder, once = f"{tmp_path}/a", f"{tmp_path}/b"
    assert warc.write(spark.createDataFrame([], SCHEMA), folder).count() == 0
    assert warc.deduplicate(spark, folder, once).count() == 0
    assert warc.read(spark, once).count() == 0
