"""CSV trees in the reference's directory layout, renames, year from content,
and the streaming source."""
import os

from pyspark.sql import functions as F

from timefuse.operators import schema
from timefuse.sources import scan


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_reference_layout_dispatch(spark, tmp_path):
    root = str(tmp_path)
    _write(f"{root}/Weather/Toronto.csv", "dt,dt_iso,temp\n1704067200,2024-01-01 00:00:00 +0000 UTC,1.5\n")
    _write(f"{root}/Space Data/space_events_2024.csv", "startTime,speed\n2024-01-02T10:00Z,400\n")
    _write(f"{root}/Near Earth Space Data/CME-2023.csv", "activityID,speed\n2023-05-01T00:00:00-CME-001,500\n")
    _write(f"{root}/Near Earth Space Data/notes.csv", "x\n1\n")  # no category-year name: skipped
    pats = scan.reference_patterns("Weather", "Space Data", "Near Earth Space Data")
    df = scan.scan_csv_tree(spark, root, pats)
    got = sorted((r.source, r.category, r.year, r.source_file) for r in df.select("source", "category", "year", "source_file").collect())
    assert got == [("base", None, None, "Toronto.csv"), ("category", "CME", 2023, "CME-2023.csv"),
                   ("events", None, 2024, "space_events_2024.csv")]


def test_rename_many_to_one_keeps_first(spark):
    df = spark.createDataFrame([(1, "a", "b", 2.0)], "id int, startTime string, endTime string, visability double")
    out = schema.rename_columns(df)
    assert out.columns == ["id", "UTC_DATE", "visibility"]
    assert out.first().UTC_DATE == "a"


def test_wind_speed_duplicate_key_last_wins():
    assert schema.standard_mapping()["wind_speed"] == "wind_speed_average"


def test_year_from_content(spark, tmp_path):
    _write(f"{tmp_path}/w/a.csv", "dt,v\n,1\n1704067200,2\n")
    _write(f"{tmp_path}/w/b.csv", "dt,v\n1672531200,3\n")
    _write(f"{tmp_path}/w/c.csv", "dt,v\n,4\n")
    df = spark.read.option("header", True).schema("dt bigint, v int").csv(f"{tmp_path}/w") \
        .withColumn("source_file", F.col("_metadata.file_name"))
    got = sorted((r.source_file, r.year) for r in scan.year_from_content(df, ("dt",)).select("source_file", "year").distinct().collect())
    assert got == [("a.csv", 2024), ("b.csv", 2023)]


def test_load_and_combine_reference_layout(spark, tmp_path):
    from timefuse.plans.combine import load_and_combine
    root = str(tmp_path)
    hours = ["2024-01-01 %02d:00:00 +0000 UTC" % h for h in range(24)] + \
            ["2024-01-02 %02d:00:00 +0000 UTC" % h for h in range(24)]
    lines = ["dt,dt_iso,temp,humidity,sea_level"]
    for i, h in enumerate(hours):
        lines.append(f"{1704067200 + 3600 * i},{h},{i * 0.5},{50 + i % 7},{'' if i else 1000}")
    _write(f"{root}/Weather/Toronto.csv", "\n".join(lines) + "\n")
    _write(f"{root}/Space Data/space_events_2024.csv",
           "startTime,kp_18\n2024-01-01T03:00Z,2\n2024-01-01T09:00Z,4\n2024-01-02T01:00Z,6\n")
    _write(f"{root}/Near Earth Space Data/CME-2024.csv",
           "startTime,speed,halfAngle\n2024-01-01T05:00Z,400,10\n2024-01-01T07:00Z,600,30\n")
    _write(f"{root}/Near Earth Space Data/FLR-2024.csv", "peakTime,flrID\n2024-01-02T02:00Z,x\n")
    _write(f"{root}/Near Earth Space Data/XYZ-2024.csv", "startTime,speed\n2024-01-01T05:00Z,999\n")
    res = load_and_combine(spark, f"{root}/Weather", f"{root}/Space Data", f"{root}/Near Earth Space Data",
                           targets=["humidity"], categories=["CME", "FLR"])
    rows = {r.ts.hour + 24 * (r.ts.day - 1): r for r in res.data.collect()}
    assert len(rows) == 48
    assert "sea_level" not in res.data.columns            # > 50 % null: dropped
    assert rows[0].space_kp_18 == 3.0 and rows[30].space_kp_18 == 6.0
    assert rows[5].near_earth_CME_speed == 500.0 and rows[5].near_earth_CME_half_angle == 20.0
    assert rows[30].near_earth_CME_speed is None
    assert res.targets == [] and [r.target for r in res.thin_targets.collect()] == ["humidity"]  # 48 < 100 values


def test_reference_json_features(spark):
    from timefuse.functions.jsoncols import extract_reference_json_features
    df = spark.createDataFrame([("[{'latitude': 1.5, 'longitude': -2.0}]", '[{"speed": 700.0}]'),
                                ("None", "[]")], "impact_list string, cme_analyses string")
    got = [(r.impact_latitude, r.impact_longitude, r.cme_speed) for r in extract_reference_json_features(df).collect()]
    assert got == [(1.5, -2.0, 700.0), (None, None, None)]


def test_stream_then_reprocess_modified_file(spark, tmp_path):
    from timefuse.functions import timeparse as tp
    from timefuse.streaming import files as streams
    src = f"{tmp_path}/in"
    _write(f"{src}/a.csv", "id,ts,x\n1,2024-01-01 01:00:00,1.0\n2,2024-01-01 02:00:00,2.0\n")
    _write(f"{src}/b.csv", "id,ts,x\n3,2024-01-01 03:00:00,3.0\n")
    schema_ = "id int, ts timestamp_ntz, x double"
    coefs = {"y": {"intercept": 1.0, "x": 2.0}}
    sink = f"{tmp_path}/sink"
    q = streams.stream_score_files(spark, src, schema_, coefs, lambda d: d, sink, f"{tmp_path}/ckpt",
                                   keep=["id"], options={"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"})
    q.awaitTermination()
    got = {r.id: r.pred_y for r in streams.read_predictions(spark, sink).collect()}
    assert got == {1: 3.0, 2: 5.0, 3: 7.0}
    _write(f"{src}/a.csv", "id,ts,x\n1,2024-01-01 01:00:00,10.0\n")  # file changed in place
    streams.reprocess_files(spark, [f"{src}/a.csv"], schema_, coefs, lambda d: d, sink, keep=["id"],
                            options={"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"})
    rows = streams.read_predictions(spark, sink).collect()
    assert sorted((r.id, r.pred_y, r.source_file) for r in rows) == [(1, 21.0, "a.csv"), (3, 7.0, "b.csv")]


def test_files_with_unlike_headers(spark, tmp_path):
    _write(f"{tmp_path}/t/a-2020.csv", "alpha,beta\n1,x\nNA,nan\n")
    _write(f"{tmp_path}/t/b b-2021.csv", "beta,alpha,more\ny,2.5,q\n")
    _write(f"{tmp_path}/t/skipped.csv", "alpha\n9\n")
    pats = {"t": r"/t/(?<category>[\w ]+)-(?<year>\d{4})\.csv$"}
    got = scan.scan_csv_tree(spark, str(tmp_path), pats)
    assert dict(got.dtypes)["alpha"] == "double"
    assert sorted(((r.alpha, r.beta, r.more, r.category, r.year) for r in got.collect()), key=str) == sorted(
        [(1.0, "x", None, "a", 2020), (None, None, None, "a", 2020), (2.5, "y", "q", "b b", 2021)], key=str)
    typed = scan.scan_csv_tree(spark, str(tmp_path), pats, "beta string, alpha double")
    assert sorted((r.alpha, r.beta) for r in typed.where("beta is not null").collect()) == [(1.0, "x"), (2.5, "y")]
    assert scan.read_csv_by_header(spark, f"{tmp_path}/t", "none*.csv") is None
    assert scan.scan_csv_tree(spark, str(tmp_path), {"t": "/nowhere/"}, "alpha double").count() == 0


def test_types_of_cells(spark):
    """A column is what all its known cells are; whole numbers among numbers are numbers, truth values are not."""
    rows = [("1", "1", "true", "1", "true", None, "x", "1"), (" +2 ", " .5e3", "False ", "true", "2.5", None, "1", None), (None,) * 8]
    cells = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(8)))
    got = scan.typed(cells, ("c7",))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "double", "boolean", "string", "string", "string", "string", "string"]
    assert tuple(got.collect()[1])[:3] == (2, 500.0, False)


def test_profiled_trees_are_written_by_all_tasks(spark, tmp_path):
    """One task that writes a whole tree does not get shorter with more machines."""
    from conftest import SF_SMALL
    from timefuse.queries_io import q_combine_profile
    from timefuse.tables import load
    for t in ("orders", "lineitem"):
        load(spark, SF_SMALL, t).repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    trees = lambda: {f.getPath().toString() for f in fs.listStatus(path) if f.getPath().getName().startswith("csv-trees")}
    before = trees()
    got = sorted(map(tuple, q_combine_profile(spark, str(tmp_path)).collect()), key=repr)
    new = trees() - before
    assert len(new) == 1
    for folder, start in (("base", "town-"), ("log", "space_events_2024-"), ("kinds", "CME-2024-")):
        names = [f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{next(iter(new))}/{folder}"))]
        assert sum(n.startswith(start) and n.endswith(".csv") for n in names) > 1
    assert got == sorted(map(tuple, q_combine_profile(spark, SF_SMALL).collect()), key=repr)
