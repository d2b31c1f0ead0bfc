import gzip

from foldstream.llm import warc
from foldstream.session import scratch_path

SCHEMA = "page_id long, url string, html string, key string, file string"


def pages(spark):
    same = "<p>é same</p>"
    rows = [(1, "http://www.Example.com:80/a?b=1", same), (2, "https://example.com/", same), (7, "http://example.com", same),
            (3, None, None), (4, "http://a.b.c/x", ""), (5, "not a url\r\nX: 1", "x" * 300_000), (6, "http://[bad", "y"),
            (8, "http://a.b.c/x", "z"), (8, "http://a.b.c/x", "z"), (None, "http://n.o/", "q")]
    return spark.createDataFrame([(*r, "k", "f") for r in rows], SCHEMA), rows


def test_keys():
    assert warc.reversed_url("http://u@WWW.Example.com:80/A?q=B") == "com,example,www)/A?q=B"
    assert warc.reversed_url(None) == "" and warc.reversed_url("http://x.y") == "y,x)/"


def test_round_trip(spark):
    df, rows = pages(spark)
    got = warc.archive_and_read(df).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, h in rows:
        largest.setdefault(h or "", []).append(i)
    for r in got:
        url, html = next((u, h or "") for i, u, h in rows if i == r["page_id"])
        ids = largest[html]
        top = max((i for i in ids if i is not None), default=None)
        revisit = len(ids) > 1 and r["page_id"] != top
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (top if revisit else None)
        assert r["payload"] == (None if revisit else html)
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == warc.digest_of(html.encode())
    assert warc.archive_and_read(df.where("false")).count() == 0


def test_lookup_reads_blocks_of_one_key(spark):
    folder = scratch_path(spark, "warc-test")
    rows = [(i, f"http://h{i % 7}.com/{'hot' if i % 3 else i}", f"page {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    shards = warc.write_index(warc.write_archives(df, folder), folder, lines=9)
    keys = [warc.reversed_url(u) for u in ("http://h3.com/hot", "http://h0.com/0", "http://none.com/", "")]
    found = warc.lookup(spark.createDataFrame([(k,) for k in keys * 2], "key string"), shards, folder)
    got = sorted(r["page_id"] for r in warc.read_records(found, folder).collect())
    assert got == sorted(i for i, u, _ in rows if u in ("http://h3.com/hot", "http://h0.com/0"))
    store, root = warc.open_store(folder)
    one = found.first()
    with store.open_input_file(f"{root}/{one['file']}") as source:
        head = gzip.decompress(source.read_at(one["length"], one["offset"]))
    assert head.startswith(b"WARC/1.1\r\n") and head.endswith(b"\r\n\r\n")
