"""Archive readers on any bytes, and near-duplicates among rows without an id."""
import gzip
import random

import pytest
from pyspark.sql import functions as F

from timefuse.llm import simhash, warc
from timefuse.session import scratch_path

ARC = (b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain 77\n1 0 pages\nURL IP-address Archive-date Content-type Archive-length\n"
       + b"x" * (77 - 67) + b"\n" + b"".join(b"http://h/%d 1.2.3.4 20010909014640 text/html %d\n%s\n" % (i, len(b), b)
                                              for i, b in enumerate([b"HTTP/1.1 200 OK\r\n\r\n<p>one", b"two\nlines", b""])))
WARC = b"".join(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b)
                for i, b in enumerate([b"HTTP/1.1 200 OK\r\n\r\nabc", b"", b"\x00\xff" * 50]))


@pytest.mark.parametrize("seed", range(3))
def test_no_bytes_make_a_reader_fail(seed):
    rng = random.Random(seed)
    for _ in range(400):
        for read, whole in ((warc.arc_records, ARC), (warc.warc_records, WARC)):
            packed = rng.random() < .5
            data = bytearray(gzip.compress(whole[:300]) + gzip.compress(whole[300:]) if packed else whole)
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(data))
                kind = rng.random()
                if kind < .4:
                    data[at] = rng.randrange(256)
                elif kind < .6:
                    del data[at:at + rng.randrange(1, 40)]
                elif kind < .8:
                    data[at:at] = rng.choice([b"\n", "²".encode(), b" 9999999999999999999999 ", b"Content-Length: x\r\n", b"WARC/", b"1.1 0 p\nURL a b\n"])
                else:
                    del data[at:]
                data = data or bytearray(b" ")
            list(read(bytes(data), packed))


def test_odd_headers():
    odd = b"http://h/a 1.2.3.4 20010909014640 text/html \xc2\xb2\nhttp://h/b 1.2.3.4 2001 text/html 3\nabc\n"
    assert [(f["URL"], b, ok) for _, _, f, b, ok in warc.arc_records(odd, False)] == [("http://h/b", b"abc", True)]
    dotted = b"filedesc://x 0 0 text/plain 42\n1.1 0 pages\nURL Other-name Date Kind Bytes\n\nu i d k 2\nhi\n"
    assert [(v, b) for _, v, _, b, _ in warc.arc_records(dotted, False)][-1][1] == b"hi"
    assert [(b, ok) for _, b, ok in warc.warc_records(b"WARC/1.0\r\nContent-Length: x\r\n\r\nabc", False)] == [(b"", False)]
    cut = gzip.compress(WARC)
    found = list(warc.warc_records(cut[:len(cut) // 2] + b"\x00" * 30, True))
    assert all(ok for _, _, ok in found[:-1])


def test_other_field_names_are_converted(spark, tmp_path):
    about = b"1 0 pages\nURL Who Archive-date Kind Archive-length\n"
    (tmp_path / "a.arc").write_bytes(b"filedesc://x 0 20010101000000 text/plain %d\n%s\nhttp://h 1 20010909014640 t 2\nhi\n" % (len(about), about))
    (tmp_path / "bad.arc.gz").write_bytes(gzip.compress(ARC)[:60] + b"damaged")
    got = warc.read_arc(spark, str(tmp_path)).filter("not about and file = 'a.arc'").collect()
    assert [(r.url, r.ip, r.mime, bytes(r.payload)) for r in got] == [("http://h", None, None, b"hi")]
    out = scratch_path(spark, "warc")
    warc.write_warc(warc.convert(spark, warc.read_arc(spark, str(tmp_path)).filter("file = 'a.arc'")), out)
    assert [bytes(r.payload) for r in warc.read_warc(spark, out).filter("type = 'response'").collect()] == [b"hi"]


def test_rows_without_an_id_are_deduplicated_too(spark):
    a, b, c = ("alpha beta gamma delta " * 30, "one two three four five six " * 20, "x y z w " * 9)
    rows = [(None, a), (None, a), (3, a), (None, b), (None, b), (7, c), (7, c), (9, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("n", F.lit("k")).repartition(3)
    got = simhash.keep_one(spark, df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, a), (None, b), (7, c), (9, None)], key=str)
