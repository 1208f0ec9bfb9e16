"""Row operations, sources/sinks and streaming against brute force or batch twins."""

from pyspark.sql import functions as F

from synthkit.operators import rowops
from synthkit.session import scratch_dir
from synthkit.sources import readers, sinks
from synthkit.sources.xlsx import write_workbook
from synthkit.streaming import stream
from synthkit.streaming.late import LateRows
from tests.conftest import SF


def test_entry_smoke(spark):
    import __spark_entry__ as e
    rows = e.entry(spark).collect()
    assert len(rows) == 6 and {r["column"] for r in rows} >= {"o_orderkey", "o_totalprice"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_list_summary_phrases(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("b", "q")], "g string, v string")
    got = {r["g"]: r["summary"] for r in rowops.list_summary(df, "g", "v").collect()}
    assert got == {"a": "x, y +1 more", "b": "q"}


def test_ranked_sort_positions(spark):
    df = spark.createDataFrame([(1, False, None), (2, True, 3), (3, True, None), (4, False, 1)],
                               "k long, on boolean, ord int")
    got = [r["k"] for r in rowops.ranked_sort(df, "on", "ord", "k", position="pos").orderBy("pos").collect()]
    assert got == [3, 2, 1, 4]


def test_stage_status(spark):
    log = spark.createDataFrame([("j", "a1", 1), ("j", "a2", 2), ("j", "a3", 3), ("j", "a2", 4)],
                                "job string, stage string, seq int")
    got = {r["stage"]: r["status"] for r in rowops.stage_status(log, "job", "stage", ["seq"]).collect()}
    assert got == {"a1": "done", "a2": "running", "a3": "queued"}


def test_xlsx_round_trip(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    (d / "one.xlsx").write_bytes(write_workbook([["name", "qty"], ["bolt", 3], ["nut", 7]]))
    (d / "two.xlsx").write_bytes(write_workbook([["name", "qty"], ["gear", 1]]))
    df = readers.read_xlsx(spark, str(d))
    got = sorted((r["name"], r["qty"]) for r in df.collect())
    assert got == [("bolt", "3"), ("gear", "1"), ("nut", "7")]


def test_csv_arrays_written_as_json(spark):
    df = spark.createDataFrame([(1, ["HTN", "CKD"])], "id long, labels array<string>")
    path = scratch_dir(spark, "csvtest")
    sinks.write_csv(df, path)
    back = readers.read_csv(spark, path).first()
    assert back["labels"] == '["HTN","CKD"]'


def test_vendor_and_jdbc_options(spark):
    import pytest
    with pytest.raises(ValueError):
        readers.vendor_reader(spark, "snowflake", {"sfUrl": "x"})
    r = readers.vendor_reader(spark, "bigquery", {"table": "p.d.t"})
    assert r is not None
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "jdbc:postgresql://h/db", "t", partition_col="id")


def test_file_inventory_prunes_content(spark):
    inv = readers.file_inventory(spark, SF, glob="*.parquet")
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]
    assert inv.count() == 14


def test_list_summary_of_listed_groups(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), (None, "n"), ("unlisted", "u")], "g string, v string")
    groups = spark.createDataFrame([("a",), ("a",), ("empty",), (None,)], "g string")
    got = {r["g"]: (r["n"], r["summary"]) for r in rowops.list_summary(df, "g", "v", groups=groups).collect()}
    assert got == {"a": (3, "x, y +1 more"), "empty": (0, rowops.EMPTY_LIST_PHRASE), None: (1, "n")}


def test_sources_are_scanned_with_their_subfolders(spark, tmp_path):
    for i, sub in enumerate(("", "y2024", "y2024/m01")):
        (tmp_path / sub).mkdir(exist_ok=True)
        (tmp_path / sub / f"f{i}.csv").write_text("id\n" + "1\n" * (i + 1))
    profile = [{"name": "all", "path": str(tmp_path), "format": "csv", "options": {"header": "true"}},
               {"name": "top", "path": str(tmp_path), "format": "csv", "recursive": False, "glob": "f0.csv"}, {"name": "off", "path": "nowhere", "enabled": False}]
    sources = readers.scan_sources(spark, profile)
    got = {(r["source"], r["file"].split(str(tmp_path))[1]): r["rows"] for r in readers.file_counts(sources).collect()}
    assert got == {("all", "/f0.csv"): 1, ("all", "/y2024/f1.csv"): 2, ("all", "/y2024/m01/f2.csv"): 3, ("top", "/f0.csv"): 2}
    assert readers.scan_sources(spark, profile, path_col=None)["all"].columns == ["id"]


def test_sources_that_are_folders_of_part_files(spark, tmp_path):
    spark.range(7).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "sub" / "u"))
    next((tmp_path / "sub" / "u").glob("part-*")).rename(tmp_path / "sub" / "t.parquet")  # a file of that name elsewhere
    sources = readers.scan_sources(spark, [{"name": "t", "path": str(tmp_path), "glob": "t.parquet"}])
    got = {r["file"]: r["rows"] for r in readers.file_counts(sources, root=str(tmp_path)).collect()}
    assert got == {"t.parquet": 7, "sub": 5} and sorted(r.id for r in sources["t"].collect()) == sorted([*range(7), *range(5)])
    assert readers.file_counts(sources).count() >= 3


def test_streams_of_folders_of_part_files(spark, tmp_path):
    rows = [(1, 0, "user", "mail me at a.b@example.com"), (2, 0, "user", "nothing here")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(str(tmp_path / "c.parquet"))
    schema = "conv_id bigint, turn bigint, role string, text string"
    for glob, n in (("c.parquet", 1), ("later.parquet", 0)):
        src = stream.stream_pii(stream.events_stream(spark, str(tmp_path), schema, ts=None, glob=glob), ["text"])
        found = stream.run_to_table(src)[0].collect()
        assert [(r.conv_id, r.pii) for r in found] == [(1, "email")][:n]


def test_late_rows_counted(spark, tmp_path):
    d = tmp_path / "ev"
    d.mkdir()
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.filter("ts >= '2024-01-05'").write.parquet(str(d / "a"))
    late = ev.filter("ts < '2024-01-02'")
    src = spark.readStream.schema(ev.schema).parquet(str(d / "*")).withColumn("ts", F.col("ts").cast("timestamp"))
    q_df = stream.stream_profile(src, "ts", "event_type", "value")
    out = scratch_dir(spark, "s")
    ck = scratch_dir(spark, "c")
    with LateRows(spark, scratch_dir(spark, "late")) as counter:
        for new in (None, late):
            if new is not None:
                new.write.parquet(str(d / "b"))  # arrives after the watermark moved on
            q = (q_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
                 .trigger(availableNow=True).start())
            q.awaitTermination()
            # the state store sees partial aggregates: one dropped row per late (window, key) group
            groups = late.select(F.date_trunc("day", "ts"), "event_type").distinct().count()
            assert counter.total(q) == (0 if new is None else groups)


def _event_files(spark, n, repeats=False):
    """events in n files by time, so that a one-file trigger gives n batches."""
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    path = scratch_dir(spark, f"events-{n}")
    rows = ev.orderBy("ts").collect()
    for i in range(n):
        part = rows[i * len(rows) // n:(i + 1) * len(rows) // n]
        spark.createDataFrame(part + (part[-5:] if repeats else []), ev.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_streams_give_the_same_for_one_and_many_batches(spark):
    from synthkit.plans.catalog_stream import EVENTS_SCHEMA
    got = []
    for n in (1, 5):
        src = stream.events_stream(spark, _event_files(spark, n, repeats=True), EVENTS_SCHEMA, max_files=1)
        profile, q = stream.run_to_table(stream.stream_profile(src, "ts", "event_type", "value"), "p", keys=["window_start", "event_type"])
        assert len(q.recentProgress) >= n
        dedup, _ = stream.run_to_table(stream.stream_dedup(src, ["event_id"], "ts"), "d")
        drift, _ = stream.run_to_table(stream.stream_drift(src, "ts", "value", [1.0, 5.0]), "f", keys=["window_start", "bin"])
        got.append([sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.collect()), key=str)
                    for x in (profile.select("window_start", "event_type", "n", "min"), dedup.select("event_id"),
                              stream.drift_of(drift, [0.3, 0.4, 0.3]))])
    total = spark.read.parquet(f"{SF}/events.parquet").count()
    assert got[0][1] == got[1][1] and len(got[0][1]) == total
    assert sum(r[2] for r in got[1][0]) == total + 25 and sum(r[2] for r in got[0][0]) == total + 5
    assert {r[:2] for r in got[0][0]} == {r[:2] for r in got[1][0]} and len(got[0][2]) == len(got[1][2])


def test_a_restart_goes_on_in_the_same_folders(spark):
    from synthkit.plans.catalog_stream import EVENTS_SCHEMA
    path = _event_files(spark, 3)
    folders = {"out": scratch_dir(spark, "o"), "checkpoint": scratch_dir(spark, "c")}
    for _ in range(2):  # the second run finds nothing new
        src = stream.events_stream(spark, path, EVENTS_SCHEMA, max_files=1)
        out, _ = stream.run_to_table(src.select("event_id"), "r", process=lambda b, i: b, **folders)
        assert out.count() == spark.read.parquet(path).count()


def test_rank_correlations_rank_within_each_pair(spark):
    from synthkit.operators.profile import rank_correlations
    rows = [(i, float(i * 7 % 31), float(i * i % 23), float(i % 5) if i % 3 == 0 else None, 1.0 * i if i % 3 == 1 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")

    def rho(i, j):
        both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        ranks = [[sum(w < v for w in col) + (col.count(v) + 1) / 2 for v in col] for col in zip(*both)]
        if not ranks:
            return None
        x, y = ([v - sum(r) / len(r) for v in r] for r in ranks)
        return sum(p * q for p, q in zip(x, y)) / (sum(p * p for p in x) * sum(q * q for q in y)) ** 0.5
    got = {(r.a, r.b): r.r for r in rank_correlations(df, ["a", "b", "c", "d"], "id").collect()}
    assert len(got) == 6 and got["c", "d"] is None
    for (a, b), r in got.items():
        if (a, b) != ("c", "d"):
            assert abs(r - rho("iabcd".index(a), "iabcd".index(b))) < 1e-9
