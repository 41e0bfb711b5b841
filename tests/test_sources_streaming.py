import json

import pytest
from pyspark.sql import functions as F

from aerolattice import streaming as ST
from aerolattice.sources import archive as AR
from aerolattice.sources import payloads as P

STATIONS = [{"id": "S128", "device_id": "S128", "deviceId": "S128", "name": "Bishan", "location": {"latitude": 1.35, "longitude": 103.84}}]


def payload(spark, value):
    return spark.createDataFrame([(json.dumps(value), "f.json")], "payload string, source_file string")


def test_v1_keeps_null_readings(spark):
    v = {"metadata": {"stations": STATIONS, "reading_unit": "c"}, "items": [{"timestamp": "2026-05-07T13:00:00+08:00", "readings": [{"station_id": "S128", "value": 31.2}, {"station_id": "S9", "value": None}]}]}
    rows = P.flatten_v1(payload(spark, v), "official_wbgt_c").orderBy("station_id").collect()
    assert [(r.station_id, r.value, r.station_name, r.value_missing) for r in rows] == [("S128", 31.2, "Bishan", False), ("S9", None, None, True)]


def test_v2_and_weather(spark):
    v = {"code": 0, "data": {"stations": STATIONS, "readings": [{"timestamp": "2026-05-07T13:00:00", "data": [{"stationId": "S128", "value": 30}]}], "readingUnit": "c"}}
    assert P.flatten_v2(payload(spark, v), "air_temperature_c").first().station_lat == 1.35
    w = {"data": {"records": [{"datetime": "2026-05-07T13:00:00", "item": {"readings": [{"station": {"id": "S1", "name": "A", "townCenter": "T"}, "location": {"latitude": "1.3", "longtitude": "103.8"}, "heatStress": "Low", "wbgt": "29.1"}]}}]}}
    r = P.flatten_weather(payload(spark, w), "official_wbgt_c").first()
    assert (r.value, r.station_lon, r.heat_stress_category) == (29.1, 103.8, "Low")


def test_hourly_tolerates_short_arrays(spark):
    v = {"latitude": 1.3, "longitude": 103.8, "hourly": {"time": ["2026-05-07T00:00", "2026-05-07T01:00"], "temperature_2m": [28.0, 27.5], "cloud_cover": [50.0]}}
    rows = P.flatten_hourly(payload(spark, v), ["temperature_2m", "cloud_cover"]).orderBy("time").collect()
    assert [(r.temperature_2m, r.cloud_cover) for r in rows] == [(28.0, 50.0), (27.5, None)]


def test_map_elements_and_features(spark):
    side = 0.001
    square = [{"lat": 1.3, "lon": 103.8}, {"lat": 1.3, "lon": 103.8 + side}, {"lat": 1.3 + side, "lon": 103.8 + side}, {"lat": 1.3 + side, "lon": 103.8}, {"lat": 1.3, "lon": 103.8}]
    v = {"elements": [{"type": "way", "id": 1, "tags": {"building": "yes"}, "geometry": square}, {"type": "way", "id": 2, "tags": {}, "geometry": square[:2]}, {"type": "node", "id": 3}]}
    got = {r.id: (r.shape, r.area_m2) for r in P.flatten_map_elements(payload(spark, v)).collect()}
    assert got[2] == ("line", 0.0) and got[1][0] == "polygon" and got[1][1] == pytest.approx((111_320 * side) ** 2, rel=1e-2)
    f = {"features": [{"properties": {"LU_DESC": "PARK", "GPR": "EVA"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"properties": {"LU_DESC": "x"}, "geometry": None}]}
    assert [r.LU_DESC for r in P.read_features(payload(spark, f), "LU_DESC:string,GPR:string").collect()] == ["PARK"]


def test_read_tables_unwraps_and_unites(spark, tmp_path):
    (tmp_path / "a.csv").write_text("station,v\nS1,1\n")
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"station": "S2", "w": "2"}]}))
    rows = P.read_tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.json")], "k").orderBy("station").collect()
    assert [(r.station, r.v, r.w, r.source_kind) for r in rows] == [("S1", "1", None, "k"), ("S2", None, "2", "k")]


def test_archive_merge_and_retention(spark, tmp_path):
    path = str(tmp_path / "archive")
    frame = lambda *rows: spark.createDataFrame(list(rows), "station_id string, variable string, value double, run long, day string").select("station_id", "variable", "value", "run", F.to_date("day").alias("obs_date"))
    a = AR.merge_into_archive(spark, frame(("S1", "t", 1.0, 1, "2026-05-01"), ("S1", "t", 2.0, 1, "2026-05-02")), path, ["station_id", "variable"], ["run"]).first()
    b = AR.merge_into_archive(spark, frame(("S1", "t", 5.0, 2, "2026-05-02"), ("S2", "t", 3.0, 2, "2026-05-02")), path, ["station_id", "variable"], ["run"]).first()
    rows = spark.read.parquet(path)
    assert (a.days, b.rows_added) == (2, 1)
    assert sorted((r.station_id, r.value) for r in rows.collect()) == [("S1", 1.0), ("S1", 5.0), ("S2", 3.0)]
    assert AR.retain_days(rows, "obs_date", 1).count() == 2


def stream_rows(spark, tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    return spark.readStream.schema("station_id string, event_time timestamp, value double, cell string, wbgt_c double, utci_c double").json(str(folder))


def drain(df, tmp_path, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


ROWS = [{"station_id": "S1", "event_time": f"2026-05-07T0{h}:{m}:00", "value": 20.0 + h} for h in (1, 2) for m in ("00", "15")]


def test_tumbling_and_sliding(spark, tmp_path):
    s = stream_rows(spark, tmp_path, ROWS)
    rows = drain(ST.tumbling_hour(s, "value"), tmp_path, "complete", "tumbling")
    assert sorted((r.mean, r.n) for r in rows) == [(21.0, 2), (22.0, 2)]
    assert {r.mean_3h for r in ST.sliding_3h(spark.createDataFrame([("S1", "2026-05-07 01:00:00", 4.0)], "station_id string, e string, value double").withColumn("event_time", F.to_timestamp("e")), "value").collect()} == {4.0}


def test_dedup_and_alert(spark, tmp_path):
    s = stream_rows(spark, tmp_path, ROWS + ROWS[:1])
    assert len(drain(ST.dedup_stream(s, ["station_id", "event_time"]), tmp_path, "append", "dedup")) == 4
    (tmp_path / "b").mkdir()
    cells = stream_rows(spark, tmp_path / "b", [{"event_time": "2026-05-07T01:00:00", "cell": "c", "wbgt_c": 33.5, "utci_c": 39.0}])
    (tmp_path / "b" / "cp2").mkdir()
    assert drain(ST.alert_stream(cells), tmp_path / "b", "complete", "alerts")[0].alert == "high"


def test_upsert_batches_writes_a_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("S1", "t", 1.0, 1, "2026-05-01"), ("S1", "t", 2.0, 2, "2026-05-01")], "station_id string, variable string, value double, run long, day string").select("station_id", "variable", "value", "run", F.to_date("day").alias("obs_date"))
    run = ST.upsert_batches(str(tmp_path / "a"), str(tmp_path / "m"), ["station_id", "variable"], ["run"])
    run(rows, 0)
    run(rows, 0)
    assert spark.read.parquet(str(tmp_path / "a")).first().value == 2.0
    assert spark.read.parquet(str(tmp_path / "m")).first().rows_fetched == 1


def test_alarms_come_while_a_station_is_silent(spark, tmp_path):
    from aerolattice import streaming as ST

    folder, batches = str(tmp_path / "in"), []

    def put(*rows):
        spark.createDataFrame(list(rows), "station_id string, m long").selectExpr("station_id", "timestamp_seconds(m * 60) as event_time").coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable() if batches is not None and query else None
        got = [tuple(r) for b in batches for r in b]
        batches.clear()
        return sorted(got)

    query = None
    put(("a", 0), ("b", 0), ("a", 5), (None, 3))
    name, value = ST.ROCKSDB
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        rows = spark.readStream.schema("station_id string, event_time timestamp").parquet(folder)
        query = ST.silence_alarms(rows).writeStream.foreachBatch(lambda b, _: batches.append(b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        assert put(("b", 20)) == []
        # The watermark is ten minutes behind the newest row of any station.
        assert put(("b", 50)) == [("a", 300, 2100, 30, "YELLOW"), ("b", 1200, 3000, 30, "YELLOW")]
        assert put(("b", 60), ("b", 110)) == [("a", 300, 5700, 90, "RED"), ("b", 3600, 5400, 30, "YELLOW")]
        assert put(("a", 111)) == []  # both of its alarms came before
        assert put(("b", 300)) == [("a", 6660, 8460, 30, "YELLOW"), ("a", 6660, 12060, 90, "RED"), ("b", 6600, 8400, 30, "YELLOW"), ("b", 6600, 12000, 90, "RED")]
    finally:
        query and query.stop()
        spark.conf.set(name, before)


def test_payloads_of_any_version(spark):
    from aerolattice.sources import payloads as P

    docs = [
        '{"items":[{"timestamp":"t1","readings":[{"station_id":"S1","value":30.5},{"station_id":"S2","value":null},{"value":3}]}],"metadata":{"stations":[{"id":"S1","name":"One"},{"id":null}],"reading_unit":"deg"}}',
        '{"data":{"readings":[{"timestamp":"t2","data":[{"stationId":"S1","value":"31.5","drift":1,"more":{"x":2}}]}],"stations":[]}}',
        '{"data":{"records":[{"updatedTimestamp":"t3","item":{"readings":[{"station":{"id":"S9","name":"Nine"},"wbgt":"n/a"}]}}]}}',
        "not json", "[]", "{}", '{"items":[]}', None,
    ]
    frame = spark.createDataFrame([("f1" if k < 2 else "f2", d) for k, d in enumerate(docs)], "source_file string, payload string")
    got = sorted((r.timestamp, r.station_id, r.value, r.unit, r.station_name, r.value_missing, r.unread) for r in P.flatten_any(frame, "x").collect())
    assert got == [("t1", "S1", 30.5, "deg", "One", False, 0), ("t1", "S2", None, "deg", None, True, 0), ("t2", "S1", 31.5, None, None, False, 2), ("t3", "S9", None, None, "Nine", True, 0)]
    shapes = {r.source_file: (r.documents, r.bad, r.shape) for r in P.payload_shapes(frame).collect()}
    assert shapes["f1"][:2] == (2, 0) and shapes["f2"][:2] == (6, 2) and "drift" in shapes["f1"][2] and "items" in shapes["f1"][2]


def committed(spark, path):
    from aerolattice.sources.commits import Archive

    archive = Archive(spark, path)
    frame = lambda *rows: spark.createDataFrame(list(rows), "station_id string, value double, run long, obs_date string")
    read = lambda: sorted(tuple(r) for r in archive.read(frame(("", 0.0, 0, "")).schema).collect())
    return archive, frame, read


def test_commits_of_two_writers_keep_both(spark, tmp_path, monkeypatch):
    from aerolattice.sources.commits import Archive

    archive, frame, read = committed(spark, str(tmp_path / "archive"))
    assert read() == [] and archive.commit(frame(("S1", 1.0, 1, "2026-05-01"), ("S1", 1.0, 1, "2026-05-02")), ["station_id"], ["run"]) == (1, 2)
    publish, turns = Archive._publish, []

    def late(self, number, days):
        """Before this writer publishes, another one commits: once to the same day, once to another day."""
        if len(turns) < 2:
            turns.append(number)
            day = ("2026-05-02", "2026-05-03")[len(turns) - 1]
            monkeypatch.setattr(Archive, "_publish", publish)
            Archive(spark, str(tmp_path / "archive")).commit(frame((f"T{len(turns)}", 7.0, 5, day)), ["station_id"], ["run"])
            monkeypatch.setattr(Archive, "_publish", late)
        return publish(self, number, days)

    monkeypatch.setattr(Archive, "_publish", late)
    assert archive.commit(frame(("S1", 2.0, 2, "2026-05-02"), ("S2", 2.0, 2, "2026-05-02")), ["station_id"], ["run"]) == (4, 1)
    assert read() == [("S1", 1.0, 1, "2026-05-01"), ("S1", 2.0, 2, "2026-05-02"), ("S2", 2.0, 2, "2026-05-02"), ("T1", 7.0, 5, "2026-05-02"), ("T2", 7.0, 5, "2026-05-03")]


def test_a_commit_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    from aerolattice.sources.commits import Archive

    archive, frame, read = committed(spark, str(tmp_path / "archive"))
    archive.commit(frame(("S1", 1.0, 1, "2026-05-01"), ("S1", 1.0, 1, "2026-05-02")), ["station_id"], ["run"])
    before = read()

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Archive, "_publish", die)
        with pytest.raises(KeyboardInterrupt):
            archive.commit(frame(("S1", 9.0, 2, "2026-05-01"), ("S1", 9.0, 2, "2026-05-02")), ["station_id"], ["run"])
    assert read() == before and archive.version()[0] == 1
    assert archive.commit(frame(("S1", 9.0, 2, "2026-05-01"), ("S1", 9.0, 2, "2026-05-02")), ["station_id"], ["run"]) == (2, 0)
    assert {r[1] for r in read()} == {9.0}
    with pytest.raises(ValueError):
        archive.commit(frame(("S1", 9.0, 2, None)), ["station_id"], ["run"])


def test_windows_read_few_files(spark, tmp_path):
    import pyarrow.parquet as pq

    from aerolattice.operators import geo

    boxes = spark.range(40_000).selectExpr("id", "cast((id * 7919) % 10007 as double) as x_min", "cast((id * 104729) % 10009 as double) as y_min").selectExpr("*", "x_min + 5 as x_max", "y_min + 5 as y_max")
    geo.write_clustered(boxes, str(tmp_path / "curve"), 32, 500)
    boxes.repartition(80).write.parquet(str(tmp_path / "plain"))

    def share(name):
        """The share of row groups whose statistics don't rule the window out."""
        groups = [g for f in (tmp_path / name).glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(k) for k in range(m.num_row_groups))]
        stats = [{g.column(c).path_in_schema: g.column(c).statistics for c in range(g.num_columns)} for g in groups]
        return sum(s["x_max"].max >= 2000 and s["x_min"].min <= 3000 and s["y_max"].max >= 2000 and s["y_min"].min <= 3000 for s in stats) / len(stats)

    assert share("curve") < 0.1 < 0.9 < share("plain")
    assert spark.read.parquet(str(tmp_path / "curve")).count() == 40_000


def test_sketches_of_days_unite(spark):
    from aerolattice.operators import aggregates as A

    rows = spark.range(30_000).selectExpr("id % 7 as day", "id % 9000 as who", "id % 2 as kind")
    daily = A.daily_sketches(rows, "day", ["who"], ["kind"])
    got = {r.kind: (r.rows, r.who_count) for r in A.united_counts(daily, ["who"], ["kind"]).collect()}
    assert all(n == 15_000 and abs(c - 4500) < 4500 * 0.05 for n, c in got.values()) and A.united_counts(daily.limit(0), ["who"], ["kind"]).count() == 0
