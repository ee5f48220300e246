import base64
import hashlib
import random

import pytest

from lumenframe.llm import warc


def brute(rows, least=0):
    last = {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if page_id is not None and len(payload) >= least:
            last[payload] = max(page_id, last.get(payload, page_id))
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        to = last.get(payload) if len(payload) >= least else None
        revisit = to is not None and to != page_id
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def pages():
    rng = random.Random(2)
    bodies = ["", "x", "é中😀", "<html>" + "long " * 2000, *("<p>" + " ".join(rng.choice(["a", "b", "word"]) for _ in range(50)) for _ in range(10))]
    rows = [(i, f"http://h/{i}", rng.choice(bodies)) for i in range(80)]
    return rows + [(80, None, None), (81, "http://h/\r\nX: y", warc.EMPTY_FRAME * 3), (3, "again", rows[3][2]), (None, "no id", "only here"), (None, "no id", rows[4][2])]


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, least):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_round_trip(df, least)
    found = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(rows, least)


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def records(n):
    return [warc.make_record(i, f"http://h/{i}", f"<html><body>page {i} of the same site</body></html>".encode() * 20, hashlib.sha1(str(i).encode()).digest(), None, 0) for i in range(n)]


def test_dictionary_leads_and_helps():
    own = records(300)
    frames = list(warc.frames(iter(own)))
    assert int.from_bytes(frames[0][:4], "little") == warc.DICTIONARY_FRAME
    assert len(frames) == 301
    assert list(warc.read_archive(b"".join(f + warc.EMPTY_FRAME.encode() for f in frames))) == own
    plain = warc.zstandard.ZstdCompressor(level=3)
    assert sum(map(len, frames[1:])) < sum(len(plain.compress(r)) for r in own)


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_few_records_have_a_dictionary_too(n):
    own = records(n)
    frames = list(warc.frames(iter(own)))
    assert list(warc.read_archive(b"".join(frames))) == own
    assert int.from_bytes(frames[0][:4], "little") == warc.DICTIONARY_FRAME and len(frames) == n + 1
    assert list(warc.frames(iter([]))) == []


def test_archives_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    own = records(300)
    found = list(warc.archives(iter(own)))
    assert len(found) > 3 and [r for a in found for r in warc.read_archive(a)] == own
    for archive in found:
        assert int.from_bytes(archive[:4], "little") == warc.DICTIONARY_FRAME
        assert sum(map(len, list(warc.read_archive(archive))[:-1])) < 50_000
    monkeypatch.undo()
    rows = [(i, "u", f"page {i} " * 400_000) for i in range(60)]
    path = str(tmp_path / "out")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), path)
    sizes = spark.read.format("binaryFile").load(path).select("length", "content").collect()
    assert len(sizes) >= 3
    for r in sizes:
        assert sum(len(x) for x in list(warc.read_archive(bytes(r["content"])))[:-1]) < warc.ARCHIVE_BYTES
    assert warc.read_archives(spark, path).count() == 60


def test_every_record_has_its_own_id_and_revisits_name_one(spark):
    rows = pages() + [(7, "again", "é中😀"), (7, "again", "é中😀"), (None, "no id", "é中😀"), (None, "no id", "é中😀"), (99, "u", "é中😀"), (99, "u", "é中😀")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), 0).collect()
    assert len({r["record_id"] for r in got}) == len(got) == len(rows)
    responses = {r["record_id"]: r for r in got if r["record_type"] == "response"}
    for r in got:
        if r["record_type"] == "revisit":
            to = responses[r["refers_to_id"]]
            assert to["page_id"] == r["refers_to"] and to["payload_digest"] == r["payload_digest"]


def test_a_cut_archive_is_an_error():
    data = b"".join(warc.frames(iter(records(3))))
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-5]))


def test_revisits_name_their_response():
    data = warc.make_record(5, "http://h", b"", hashlib.sha1(b"p").digest(), 9, 1)
    fields, http, payload = warc.parse_record(data)
    assert fields["WARC-Type"] == "revisit" and fields["WARC-Refers-To"] == warc.record_id(9) and payload == b""
