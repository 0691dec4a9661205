import hashlib
import io
import zlib

import pytest

from tessera.llm import warc


def gz(raw):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def test_round_trip(spark):
    big = "é" * 700
    data = [(1, "http://a/", big), (2, "http://b/", big), (9, None, big), (3, "http://c/\r\nX: y", "x" * 999), (4, "u", "x" * 999), (5, "v", None), (6, "w", ""), (None, "z", big), (9, None, big), (7, "long", "ab\r\n\r\n" * 200000)]
    pages = spark.createDataFrame([(*d, "e") for d in data], "page_id long, url string, html string, refers_to string")
    names = warc.write_archives(spark, pages)
    assert sum(r.records for r in names.collect()) == len(data)
    got = sorted(warc.read_archives(spark, names).collect(), key=str)
    assert len(got) == len(data)
    for i, u, h in data:
        raw = (h or "").encode()
        revisit = h == big and i != 9
        want = (i, u.replace("\r", "%0D").replace("\n", "%0A") if u else u, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)
        assert want in [tuple(g) for g in got]


def test_empty(spark):
    names = warc.write_archives(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(spark, names).collect() == []


def test_damage_is_found():
    good = warc.record(1, "u", b"payload", None)
    assert [b for _, b in warc.read_records(io.BytesIO(gz(good) * 3))][2].endswith(b"payload")
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gz(good)[:-9])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gz(good[:-2]))))
    [(header, block)] = warc.read_records(io.BytesIO(gz(good.replace(b"payload", b"pAyload"))))
    with pytest.raises(ValueError):
        warc.parsed(header, block)
