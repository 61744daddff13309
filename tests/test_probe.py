"""Headers and first epochs from the first bytes of CSV files, and the scans built on them."""
import gzip
import os

import pytest
from pyspark.sql import functions as F

from timefuse.sources import probe, scan


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def blocks(data, size=7):
    data = data.encode() if isinstance(data, str) else data
    return [data[i:i + size] for i in range(0, len(data), size)]


@pytest.mark.parametrize("text, options, header", [
    ("a,b\n1,2\n", {}, ["a", "b"]), ("\n \n\r\na,b\n1,2\n", {}, ["a", "b"]), ("a;b\r\n1;2\r\n", {"sep": ";"}, ["a", "b"]),
    ("﻿a\tb", {"delimiter": "\t"}, ["a", "b"]), ('"a,x","b ""q"""\n1,2', {}, ["a,x", 'b "q"']), ("", {}, None), ("\n\n", {}, None),
    ('"two\nlines",b\n', {"multiLine": True}, ["two\nlines", "b"]), ("# note\na,b", {"comment": "#"}, ["a", "b"]),
    ("a||b||c\n", {"sep": "||"}, ["a", "b", "c"]), ("'a,b',c", {"quote": "'"}, ["a,b", "c"]), ("é,ü\rx,y\r", {}, ["é", "ü"]),
    ("é,ü\n".encode("latin-1"), {"encoding": "latin-1"}, ["é", "ü"]), ("a,b\r", {}, ["a", "b"]), ("only", {}, ["only"])])
def test_header(text, options, header):
    for size in (1, 2, 7, 1000):
        assert probe.head(blocks(text, size), probe.Dialect(options))[0] == header


def test_first_known_epoch():
    d = probe.Dialect()
    head = lambda text: probe.head(blocks(text), d, ("dt", "UNIX_TIMESTAMP"))
    assert head("dt,v\n,1\nx,2\n1704067200,3\n1,4")[1] == 2024
    assert head("v,UNIX_TIMESTAMP\n1,-1\n")[1] == 1969 and head("dt\n1672531200.9\n")[1] == 2022 + 1
    assert head("dt\n\n9e99\nnan\n")[1] is None and head("v\n1\n")[1] is None and head("")[1] is None
    assert head("UNIX_TIMESTAMP,dt\n1,\n1,1704067200\n")[1] == 2024  # dt comes first wherever it stands


def test_no_more_is_read_than_needed():
    def endless():
        yield b"dt,v\n1704067200,"
        yield b"1\n"
        raise AssertionError("read on")

    assert probe.head(endless(), probe.Dialect(), ("dt",)) == (["dt", "v"], 2024)
    assert probe.head(endless(), probe.Dialect())[0] == ["dt", "v"]


def test_listing_reads_no_content(spark, tmp_path):
    write(f"{tmp_path}/a b/é.csv", "x,y\n1,2\n")
    write(f"{tmp_path}/big.csv", "x,z\n" + "1,2\n" * 100_000)
    write(f"{tmp_path}/none.csv", "\n\n")
    write(f"{tmp_path}/empty.csv", "")  # Spark lists no file without bytes
    write(f"{tmp_path}/packed.csv.gz", gzip.compress(b"x\n"))
    plan = probe.files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    got = {os.path.basename(r.path): r.header for r in probe.probe(spark, str(tmp_path)).collect()}
    assert got == {"é.csv": ["x", "y"], "big.csv": ["x", "z"], "none.csv": None}
    miss = {(os.path.basename(r.path), r.missing) for r in probe.missing_columns(spark, str(tmp_path), ["x", "y"]).collect()}
    assert miss == {("big.csv", "y"), ("none.csv", "x"), ("none.csv", "y")}
    hadoop = list(probe._hadoop_blocks(spark, (tmp_path / "big.csv").as_uri()))
    assert len(hadoop[0]) == probe.BLOCK and b"".join(hadoop) == (tmp_path / "big.csv").read_bytes()


def test_scan_with_blank_first_lines_and_separators(spark, tmp_path):
    write(f"{tmp_path}/t/a-2020.csv", "\n\nid;name\n1;x\n2;\n")
    write(f"{tmp_path}/t/b-2021.csv", "name;more;id\ny;'p;q';3\n")
    pats, o = {"t": r"/t/(?<category>\w+)-(?<year>\d{4})\.csv$"}, {"sep": ";", "quote": "'"}
    want = [(1, "x", 2020), (2, None, 2020), (3, "y", 2021)]
    for schema in (None, "id bigint, name string"):
        got = scan.scan_csv_tree(spark, str(tmp_path), pats, schema, o)
        assert sorted((r.id, r.name, r.year) for r in got.collect()) == want
    assert [r.more for r in got.where("id = 3").collect()] == ["p;q"]
    with pytest.raises(ValueError, match="nowhere"):
        scan.scan_csv_tree(spark, str(tmp_path), pats, "id bigint, nowhere string", o)


def test_quoted_line_breaks(spark, tmp_path):
    write(f"{tmp_path}/q.csv", '"two\nlines",v\n"a\n\nb",1\nc,2\n')
    got = scan.read_csv_by_header(spark, str(tmp_path), options={"multiLine": True})
    assert sorted((r["two\nlines"], r.v) for r in got.collect()) == [("a\n\nb", 1), ("c", 2)]


def test_types_from_all_known_cells(spark, tmp_path):
    write(f"{tmp_path}/a.csv", "i,d,t,s,n,big\n1,1.5,true,x,NA,123456789012345678\n-2,NaN,FALSE,1,,1\n")
    write(f"{tmp_path}/b.csv", "d,i,u\n1e3, 7 ,z\n")
    got = scan.read_csv_by_header(spark, str(tmp_path))
    assert {k: v for k, v in got.dtypes if not k.startswith("source")} == {
        "i": "bigint", "d": "double", "t": "boolean", "s": "string", "n": "string", "big": "bigint", "u": "string"}
    assert sorted((r.i, r.d) for r in got.collect()) == [(-2, None), (1, 1.5), (7, 1000.0)]
    assert "FileScan csv" not in got._jdf.queryExecution().executedPlan().toString()


def test_years_from_first_rows(spark, tmp_path):
    write(f"{tmp_path}/w/a.csv", "dt,v\n,1\n1704067200,2\n")
    write(f"{tmp_path}/w/b.csv", "v,UNIX_TIMESTAMP\n3,1672531200\n4,1704067200\n")
    write(f"{tmp_path}/w/c.csv", "dt,v\n,5\n")
    write(f"{tmp_path}/w/d-1999.csv", "v\n6\n")
    pats = {"named": r"/w/d-(?<year>\d{4})\.csv$", "w": r"/w/\w+\.csv$"}
    got = scan.scan_csv_tree(spark, str(tmp_path), pats, "v int", epoch_cols=("dt", "UNIX_TIMESTAMP"))
    assert sorted((r.v, r.year) for r in got.select("v", "year").collect()) == [(1, 2024), (2, 2024), (3, 2023), (4, 2023), (6, 1999)]
    assert len(scan.scan_csv_tree(spark, str(tmp_path), pats, "v int").collect()) == 6


def test_row_positions_are_by_block(spark, tmp_path):
    # every line longer than a split: the rows of one file come from many tasks
    lines = [f"{i},{'' if i < 5 else 1704067200 - i * 31536000},{'x' * 3000}" for i in range(40)]
    write(f"{tmp_path}/p.csv", "i,dt,x\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = spark.read.option("header", True).schema("i int, dt bigint, x string").csv(str(tmp_path)) \
            .withColumn("source_file", F.col("_metadata.file_name"))
        assert df.rdd.getNumPartitions() > 5
        assert {r.year for r in scan.year_from_content(df, ("dt",)).collect()} == {2019}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="order"):
        scan.year_from_content(spark.createDataFrame([("f", 1)], "source_file string, dt long"), ("dt",))
