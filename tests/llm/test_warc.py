import gzip

import pytest

from quarrymill.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_versions_and_declared_lengths():
    v1 = warc.arc_version_block("a.arc", 1, "20240102030405") + warc.arc_record(1, "http://a/ b", "1.2.3.4", "20240102030405", "text/html", b"HTTP/1.0 200 OK\n\nhi\nthere\n")
    v1 += warc.arc_record(1, "dns:a", "1.2.3.4", "2024", "text/dns", b"")
    got = list(warc.read_arc(v1))
    assert [r.header["URL"] for r in got] == ["http://a/ b", "dns:a"] and got[0].content.endswith(b"hi\nthere\n")
    row = warc.convert_record("a.arc", got[0])
    assert row[2] == "2024-01-02T03:04:05Z" and row[6] == b"hi\nthere\n" and row[8] == warc.digest32(b"hi\nthere\n")
    assert warc.convert_record("a.arc", got[1])[2] == "2024-01-01T00:00:00Z"
    v2 = warc.arc_version_block("b.arc", 2, "20240102030405") + warc.arc_record(2, "http://b/", "1.2.3.4", "20240102030405", "text/html", b"x" * 10, filename="f")
    assert next(warc.read_arc(v2)).header["Filename"] == "f"
    for bad in (v1[10:], v2[:-5], v1.replace(b" text/dns", b"")):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))


def test_round_trip_with_odd_rows(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, " ", ""), (None, "http://c", "same"), (7, "http://d x\n", "é\r\n\r\nWARC/1.1\r\n\r\n" * 50), (5, "http://a", "y" * 200_000), (2, "http://b", "same")]
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages(spark, rows)).collect()}
    d = lambda t: (len(t.encode()), warc.digest32(t.encode()))
    assert got == {
        (1, *d("same"), "response", None), (2, *d("same"), "revisit", 1), (None, *d("same"), "revisit", 1), (3, *d(""), "response", None), (4, *d(""), "revisit", 3),
        (7, *d(rows[5][2]), "response", None), (5, *d("y" * 200_000), "response", None),
    }
    kinds = {(r.page_id, r.record_type) for r in warc.archive_pages(pages(spark, rows), min_revisit_bytes=1).collect()}
    assert (4, "response") in kinds and (2, "revisit") in kinds
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_foreign_archives_of_any_bytes(spark, tmp_path):
    """Both versions, plain and gzip, Latin-1, binary and empty bodies, headless content, and a record of several members."""
    date, big = "20010203040506", bytes(range(256)) * 70_000
    head = b"HTTP/1.0 200 OK\r\nContent-Type: text/plain; charset=iso-8859-1\r\n\r\n"
    bodies = [b"caf\xe9 \r\n\r\nWARC/1.1", b"\x00\xff\x1f\x8b", b"", b"caf\xe9 \r\n\r\nWARC/1.1", big]
    files = []
    for v in (1, 2):
        data = warc.arc_version_block("a.arc", v, date)
        for n, b in enumerate(bodies):
            data += warc.arc_record(v, f"http://a/{n}", "1.2.3.4", date, "text/plain", head + b, filename=f"page-{n}")
        data += warc.arc_record(v, "dns:a", "1.2.3.4", date, "text/dns", b"20010203 a \xe9")
        files.append((f"{v}.arc", data if v == 1 else gzip.compress(data)))
    records = warc.convert_arc(spark.createDataFrame(files, "path string, content binary")).collect()
    assert sorted(bytes(r.payload) for r in records) == sorted([*bodies, b"20010203 a \xe9"] * 2)
    again = spark.createDataFrame(records, warc.CONVERTED)
    warc.write_warc(warc.mark_revisits(again), f"file://{tmp_path}/w", archive_bytes=50_000)
    names = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(names) > 1
    kinds = []
    for f in names:
        data = f.read_bytes()
        plain = gzip.decompress(data)
        assert plain == warc.gunzip(data)
        found = list(warc.read_warc_bytes([plain]))
        assert found[0][0]["warc-type"] == "warcinfo" and "warc-date" in found[0][0]
        for h, block in found:
            kinds.append(h["warc-type"])
            if "warc-block-digest" in h:
                assert h["warc-block-digest"] == "sha1:" + warc.digest32(block)
            if h["warc-type"] == "revisit":
                assert h["warc-refers-to"].startswith("<urn:uuid:") and h["warc-refers-to-target-uri"].startswith("http://a/") and h["warc-refers-to-date"] == "2001-02-03T04:05:06Z"
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r.payload_digest for r in got) == sorted(r.payload_digest for r in records) and kinds.count("resource") == 2
    by_id = {r.record_id: r for r in got}
    assert all(by_id[r.refers_to].payload_digest == r.payload_digest for r in got if r.refers_to)


def test_frequent_digests_without_a_broadcast(spark, monkeypatch):
    rows = [(i, f"http://a/{i}", "same" if i % 3 else f"{i}") for i in range(400)]
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    got = {r.page_id: r.refers_to for r in warc.archive_pages(pages(spark, rows)).collect()}
    assert got == {i: 1 if i % 3 and i > 1 else None for i in range(400)}
