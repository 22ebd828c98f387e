import gzip
import hashlib

import pytest

from sedge.llm import warc


def test_round_trip_and_revisits(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1 " + "x" * 1000
    rows = [(1, "http://a/x", big, 0), (2, "http://b/", big, 0), (3, None, None, 0), (4, "http://c", "small", 0), (5, "http://d", "small", 0), (5, "http://d", "small", 0), (6, "u\r\nv", "y" * 50000, 0)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, payload int"), path)
    got = warc.captures(spark, path).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert len(r.requests) == 1 and len(r.metadata) == 1
        by.setdefault(int(r.metadata[0].fields["page-id"]), []).append(r.response)
    assert by[2][0].record_type == "response" and by[2][0].payload.decode() == big
    assert by[1][0].record_type == "revisit" and by[1][0].payload is None and by[1][0].payload_bytes == len(big.encode())
    assert by[1][0].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert by[3][0].payload == b"" and [x.record_type for x in by[5]] == ["response"] * 2
    assert by[6][0].payload == b"y" * 50000


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captures(spark, path).count() == 0


def test_many_files_members_and_lone_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CAPTURES_PER_FILE", 3)
    rows = [(i if i else None, f"http://a/{i}", f"é {i} " + "z" * 900 * (i % 3)) for i in range(20)]
    path = tmp_path / "w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{path}")
    files = sorted(path.glob("part*"))
    assert len(files) == 7
    plain = gzip.decompress(files[0].read_bytes())
    (path / f".{files[0].name}.crc").unlink()
    files[0].write_bytes(b"".join(gzip.compress(plain[i : i + 100]) for i in range(0, len(plain), 100)))
    got = warc.captures(spark, f"file://{path}").collect()
    assert sorted(r.response.payload.decode() for r in got) == sorted(h for _, _, h in rows)
    assert sum("page-id" not in r.metadata[0].fields for r in got) == 1
    lone = warc.read_archives(spark, f"file://{path}").where("record_type = 'request'")
    assert all(r.response is None and len(r.requests) == 1 and r.metadata == [] for r in warc.assemble(lone).collect())


def test_broken_framing_is_an_error():
    import io

    good = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nab"
    assert [r["payload"] for r in warc.parse(io.BytesIO(good + b"\r\n\r\n" + good))] == [b"ab", b"ab"]
    for bad in (good[:-1], good + b"c\r\n\r\n" + good, b"x\r\n" + good):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))
