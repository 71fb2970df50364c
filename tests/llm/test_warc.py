"""Archives against gzip and a plain parser, and faults that the reader must find."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest
from tests.llm.conftest import words
from tidewell.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, largest long, path string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)


LONG = "é" * 500  # 1000 bytes
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, "http://a/3", LONG), (3, "http://a/3b", LONG), (None, "http://a/n", LONG),
    (4, "http://a/4", "é" * 499 + "a"), (5, "http://a/5", "é" * 499 + "a"), (6, None, None), (7, "", ""), (8, "a\r\nX: b", "WARC/1.1\r\n\r\n\r\n"),
    (None, None, None), (9, "http://ü/?q=%20 x", words(1, 200)), (10, " http://a ", words(2, 60_000)), (11, "u", words(1, 200)), (11, "u", words(1, 200)),
]


def want(rows):
    largest = {}
    for d, _, t in rows:
        if len((t or "").encode()) >= 1000:
            largest[t] = max(d if d is not None else -1, largest.get(t, -1))
    out = []
    for d, _, t in rows:
        body = (t or "").encode()
        top = largest.get(t, -1)
        revisit = top >= 0 and (d is None or d < top)
        out.append((d, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def got(archives):
    rows = warc.read_archives(archives).where("record_type != 'warcinfo'").collect()
    as_id = lambda x: None if x is None else int(x)
    return sorted(((as_id(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, as_id(r.refers_to)) for r in rows), key=repr)


@pytest.mark.parametrize("archive_bytes", [1, 1 << 30])
def test_round_trip(spark, archive_bytes):
    archives = warc.write_archives(pages_of(spark, ROWS).repartition(3), archive_bytes=archive_bytes)
    assert got(archives) == want(ROWS)
    assert archives.count() == (len(ROWS) if archive_bytes == 1 else 3)


def test_other_readers_can_read_it(spark, tmp_path):
    """gzip and a parser of its own: a member per record, at the offsets the index gives; texts come back."""
    archives = warc.write_archives(pages_of(spark, ROWS).coalesce(1), folder=f"file://{tmp_path}/w")
    index = warc.read_archives(archives, want_payload=True).collect()
    paths = list(Path(tmp_path, "w").glob("*.warc.gz"))
    assert len(paths) == 1 and {r.archive for r in index} == {f"file://{tmp_path}/w/{paths[0].name}"}
    raw = paths[0].read_bytes()
    assert [r.offset for r in index] == [0, *(r.offset + r.length for r in index)][:-1] and index[-1].offset + index[-1].length == len(raw)
    seen = []
    for r in index:
        data = gzip.decompress(raw[r.offset : r.offset + r.length])
        head, block = data.split(b"\r\n\r\n", 1)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert block[int(fields[b"Content-Length"]) :] == b"\r\n\r\n"
        if fields[b"WARC-Type"] == b"response":
            body = block[: int(fields[b"Content-Length"])].split(b"\r\n\r\n", 1)[1]
            assert bytes(r.payload) == body
            seen.append(body.decode())
    responses = [r for r in want(ROWS) if r[3] == "response"]
    assert sorted(map(len, map(str.encode, seen))) == sorted(r[1] for r in responses)
    urls = {r.record_id: r.target_uri for r in index if r.record_id}
    assert urls["8"] == "a%0D%0AX: b" and urls["9"] == "http://ü/?q=%20 x" and urls["10"] == " http://a " and urls["6"] is None and urls["7"] == ""


def test_only_listed_archives_are_read(spark, tmp_path):
    archives = warc.write_archives(pages_of(spark, ROWS), folder=f"file://{tmp_path}/w")
    left = next(Path(tmp_path, "w").glob("*.gz")).read_bytes()[:-9]
    Path(tmp_path, "w", "left-by-a-lost-task.warc.gz").write_bytes(left)
    assert got(archives) == want(ROWS)


def test_empty_table(spark):
    archives = warc.write_archives(pages_of(spark, []))
    assert archives.count() == 0 and got(archives) == []


def archive(*bodies):
    records = [warc.page_record(str(k), "u", b, None, False, "2000-01-01T00:00:00Z") for k, b in enumerate(bodies)]
    return [warc.member(r) for r in records], records


def read(data, strict=False):
    return list(warc.read_stream(io.BytesIO(data), True, strict))


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_block_size_makes_no_difference(monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    bodies = [b"", b"\r\n\r\n", random.Random(3).randbytes(5000), b"x" * 30_000]
    members, _ = archive(*bodies)
    rows = read(b"".join(members))
    assert [r[8] for r in rows] == bodies and [r[1] for r in rows] == list(map(len, members)) and not any(r[9] for r in rows)


def test_faults_are_found():
    members, records = archive(b"first page", b"second page", b"third")
    whole = b"".join(members)
    wrong = [
        (records[1].replace(b"second page", b"second pane"), "digest of a block", 3),
        (records[1].replace(b"\r\n\r\nsecond page\r\n\r\n", b"\r\n\r\nsecond page!\r\n\r\n"), "longer or shorter", 3),
        (records[1][:-4], "longer or shorter", 3),
        (records[1][:-9], "lacks", 2),
        (records[1] + records[2], "longer or shorter", 3),
        (records[1].replace(b"WARC/1.1", b"HTML/1.1"), "WARC head", 2),
        (records[1].replace(b"Content-Length: ", b"Content-Size: ", 1), "content length", 2),
    ]
    for bad, what, n in wrong:
        data = members[0] + warc.member(bad) + members[2]
        rows = read(data)
        assert what in rows[1][9] and len(rows) == n and not rows[0][9], what
        with pytest.raises(ValueError, match=what):
            read(data, strict=True)
    # a payload digest alone
    stated = warc._digest(b"first page")
    bad = records[0].replace(stated.encode(), warc._digest(b"another").encode(), 1)
    assert bad != records[0] and "digest of a payload" in read(warc.member(bad))[0][9]
    for cut in range(1, len(members[2])):
        rows = read(whole[:-cut])
        assert len(rows) == 3 and rows[2][9], cut
    flipped = bytearray(whole)
    flipped[len(members[0]) + 30] ^= 0x55
    assert any(r[9] for r in read(bytes(flipped)))
    assert "gzip" in read(whole + b"junk")[3][9]
    assert read(b"") == []


def test_memory_is_bounded_by_blocks():
    """A record of 64 MB inflates in pieces, none of which is larger than a block."""
    data = warc.member(warc.record("resource", [("WARC-Record-ID", "<urn:row:1>")], b"\0" * (64 << 20), "d"))
    members = warc.Members(io.BytesIO(data))
    assert max(map(len, members.pieces())) <= warc.BLOCK
    assert read(data, strict=True)[0][6] == 64 << 20
