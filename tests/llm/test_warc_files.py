"""Response records of real WARC files: versions, gzip members, lengths, codings."""

import gzip
import zlib

import pytest

from weftline.llm.warc import derived_records, read_responses, split_records


def record(kind, block, version="1.0", uri="http://a.example/", eol=b"\r\n", n=1):
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{n}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2020-05-06T07:08:09Z", "Content-Type: application/http;", "  msgtype=response", f"content-length: {len(block)}"]
    return eol.join(x.encode() for x in head) + eol * 2 + block + eol * 2


def http(body, *lines):
    return b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", *lines]) + b"\r\n\r\n" + body


PAGE = "<html lang=de><title>Grüße</title><p>eins<p>zwei"
TRICKY = ("<p>a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n<p>b" + PAGE).encode()


@pytest.fixture
def folder(tmp_path):
    raw = PAGE.encode()
    one = [record("warcinfo", b"software: x\r\n"), record("response", http(raw), n=2), record("request", b"GET / HTTP/1.1\r\n\r\n", n=3), record("response", http(TRICKY), "1.1", n=4), record("response", b"", n=5)]
    (tmp_path / "a.warc").write_bytes(b"".join(one))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    chunks = b"5;x=1\r\n" + raw[:5] + b"\r\n" + f"{len(raw) - 5:x}".encode() + b"\r\n" + raw[5:] + b"\r\n0\r\n\r\n"
    coded = [record("response", http(chunks, b"Transfer-Encoding: chunked"), n=6), record("response", http(gzip.compress(raw), b"Content-Encoding: gzip"), n=7), record("response", http(zlib.compress(raw), b"Content-Encoding: deflate"), n=8), record("response", http("é".encode("latin-1")).replace(b"utf-8", b"iso-8859-1"), n=9, eol=b"\n"), record("response", http(b"x").replace(b"utf-8", b"odd"), n=10)]
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(coded)))
    (tmp_path / "notes.txt").write_text("no records")
    return tmp_path


def test_responses_are_read_by_length(spark, folder):
    got = {(r["file"].rpartition("/")[2], r["source_id"]): r for r in read_responses(spark, str(folder)).collect()}
    want = {2: PAGE, 4: TRICKY.decode(), 5: ""}
    for file in ("a.warc", "b.warc.gz"):
        assert {k[1]: r["payload"] for k, r in got.items() if k[0] == file} == {f"<urn:uuid:{n}>": t for n, t in want.items()}
    coded = {k[1]: r["payload"] for k, r in got.items() if k[0] == "c.warc.gz"}
    assert coded == {f"<urn:uuid:{n}>": t for n, t in {6: PAGE, 7: PAGE, 8: PAGE, 9: "é", 10: "x"}.items()}
    one = got["b.warc.gz", "<urn:uuid:4>"]
    assert (one["warc_version"], one["date"], one["target_uri"]) == ("WARC/1.1", "2020-05-06T07:08:09Z", "http://a.example/") and one["http_headers"].startswith("HTTP/1.1 200 OK\r\nContent-Type: text/html")


def test_derived_from_files(spark, folder):
    records = derived_records(read_responses(spark, f"{folder}/a.warc")).collect()
    made = {r["warc_type"]: r for r in records if r["refers_to"] == "<urn:uuid:2>"}
    assert made["conversion"]["block"] == "eins\nzwei" and "Grüße" in made["metadata"]["block"] and made["metadata"]["source_content_type"] == "text/html; charset=utf-8"
    assert len(records) == 6


@pytest.mark.parametrize("bad", [b"junk", record("response", b"x" * 10)[:-8], record("response", b"").replace(b"content-length: 0", b"content-length: -3"), gzip.compress(record("response", b""))[:-9]])
def test_broken_files_fail(spark, tmp_path, bad):
    (tmp_path / "bad.warc.gz").write_bytes(bad)
    with pytest.raises(Exception, match="bad.warc.gz"):
        read_responses(spark, str(tmp_path)).collect()


def test_no_records():
    assert list(split_records(b"")) == list(split_records(b"\r\n\r\n")) == []


def test_links_agree_with_sql(spark):
    import duckdb

    from weftline.llm.queries import ORACLES, QUERIES

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet'")
    got = QUERIES["warc_source_links"](spark, at)
    want = con.sql(ORACLES["warc_source_links"])
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(map(tuple, want.select(", ".join(sorted(got.columns))).fetchall()))
