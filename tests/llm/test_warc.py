import glob
import hashlib
import struct

import zstandard
from awkward import plain, prose

from logtel.llm import warc
from logtel.llm.common import stored
from logtel.session import new_path

BIG = "<p>" + prose(3, 400) + "</p>"
ROWS = [
    (1, "http://a.example/1", BIG),
    (2, "http://a.example/2\r\nX: y", BIG),
    (2, "http://a.example/2", BIG),  # repeats the largest id
    (None, None, BIG),
    (3, None, None),
    (4, "http://b.example/", ""),
    (5, "http://b.example/é", "short"),
    (6, "http://b.example/", "short"),
    (None, "http://c.example/", "only row, " + BIG),
    (7, "u", "\r\n\r\n" + "é" * 600),
    (8, "u", "\r\n\r\n" + "é" * 600),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], "page_id bigint, url string, html string, digest string, keep string")


def expected(rows, least=1000):
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    found = []
    for page, data in payloads:
        same = [p for p, d in payloads if d == data and p is not None]
        keep = max(same, default=None) if len(data) >= least and sum(d == data for _, d in payloads) > 1 else None
        revisit = keep is not None and page != keep
        found.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(found, key=repr)


def round_trip(spark, rows, spec=warc.Archives()):
    folder = new_path(spark, "warc")
    index = stored(warc.write_archives(warc.with_record_types(pages(spark, rows), spec), folder, spec), "index")
    return folder, index, warc.read_archives(spark, index)


def test_awkward_rows(spark):
    _, _, read = round_trip(spark, ROWS)
    got = []
    for r in read.collect():
        if r.record_type == "response":
            assert (len(r.payload), hashlib.sha1(r.payload).hexdigest()) == (r.n_bytes, r.digest)
        else:
            assert r.payload is None
        got.append((r.page_id, r.n_bytes, r.digest, r.record_type, r.refers_to))
    assert sorted(got, key=repr) == expected(ROWS)


def test_archives_are_valid_and_records_stand_alone(spark):
    rows = [(i, f"http://x.example/{i}", prose(i, 200)) for i in range(120)]
    folder, index, read = round_trip(spark, rows, warc.Archives(archive_bytes=40_000))
    files = glob.glob(folder.removeprefix("file://") + "/*.warc.zst")
    assert len(files) > 3 and read.count() == 120
    entries = index.collect()
    for path in files[:3]:
        with open(path, "rb") as file:
            data = file.read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.DICTIONARY_MAGIC
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        for e in entries:
            if e.archive.endswith(path.rpartition("/")[2]):  # one frame is read without the others
                record = reader.decompress(data[e.offset : e.offset + e.length])
                assert record.startswith(b"WARC/1.1\r\n") and f"<urn:page:{e.page_id}>".encode() in record


def test_the_dictionary_helps():
    records = [f"<html><head><title>{i}</title></head><body class='article-page'>{prose(i, 20)}</body></html>".encode() for i in range(500)]
    with_it = zstandard.ZstdCompressor(level=3, dict_data=warc._dictionary(records, 110_000))
    without = zstandard.ZstdCompressor(level=3)
    assert sum(len(with_it.compress(r)) for r in records) < 0.8 * sum(len(without.compress(r)) for r in records)


def test_cut_off_archive_is_an_error(spark):
    folder, _, _ = round_trip(spark, ROWS[:1])
    (path,) = glob.glob(folder.removeprefix("file://") + "/*.warc.zst")
    with open(path, "rb") as file:
        data = file.read()
    try:
        list(warc.records_in(data[:-20]))
    except ValueError as error:
        assert "ends within a record" in str(error)
    else:
        raise AssertionError("no error")


def test_empty_table(spark):
    assert plain(round_trip(spark, [])[2]) == []
