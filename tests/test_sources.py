import json

import pytest
from pyspark.sql import functions as F

from rainloom import __main__ as jobs
from rainloom.operators import studies
from rainloom.sources import hashing, platform, readers, sinks, store
from rainloom.streaming import events as streams


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(7, "2001-02-03", 0.5, float("nan"))], "id int, date string, rain double, tmax double")
    where = f"file://{tmp_path}/obs.csv"
    df.write.option("header", True).csv(where)
    back = readers.read_tabular(spark, where, {"id": "station_id", "rain": "precip"}, {"precip": "m"})
    r = back.first()
    assert (r.station_id, str(r.date), r.precip, r.tmax) == ("7", "2001-02-03", 500.0, None)
    assert readers.problems(back) == [] and len(readers.problems(df)) == 2
    with pytest.raises(ValueError):
        readers.read_tabular(spark, f"{tmp_path}/x.xlsx")
    with pytest.raises(ValueError):
        readers.read_tabular(spark, where, {"rain": "precip"}, {"precip": "furlong"})


def test_payload_and_vector(spark):
    text = json.dumps({"data": {"rows": [{"station_id": 1, "v": {"precip": 2}}, {"station_id": 2, "v": {"precip": None}}]}})
    rows = readers.read_payload(spark, text, "data.rows", {"v.precip": "precip"}).orderBy("station_id").collect()
    assert [(r.station_id, r.precip) for r in rows] == [("1", 2.0), ("2", None)]
    shape = {"features": [{"properties": {"basin": "b"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}
    assert readers.vector_edges(spark, json.dumps(shape), "basin").count() == 3
    shape["crs"] = {"properties": {"name": "EPSG:32645"}}
    with pytest.raises(ValueError):
        readers.vector_edges(spark, json.dumps(shape), "basin")


def test_dataset_versions(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("station_id"), F.col("id").alias("x"))
    root = f"file://{tmp_path}/sets"
    version = sinks.write_dataset(root, {"observations": df})
    assert sinks.latest(spark, root).endswith(version)
    assert spark.read.parquet(f"{sinks.latest(spark, root)}/observations.parquet").count() == 10
    assert hashing.fingerprint(df.orderBy(F.desc("x")).repartition(3)).first() == hashing.fingerprint(df).first()
    with pytest.raises(Exception, match="already exists"):
        sinks.write_dataset(root, {"observations": df})
    assert hashing.file_hashes(spark, f"{root}/LATEST").first().sha256


def test_constraints_and_json(spark):
    df = spark.createDataFrame([("a", 1, float("nan")), ("a", 1, 2.0), ("b", 2, None)], "k string, f int, v double")
    parent = spark.createDataFrame([(1,)], "f int")
    got = {r.rule: r.n for r in sinks.constraint_violations(df, ["k"], parent, "f", {"k": ["a"]}).collect()}
    assert got == {"primary key": 1, "foreign key f": 1, "check k": 1}
    assert sorted(r.json for r in sinks.as_json(df).collect())[0] == '{"k":"a","f":1,"v":2.0}'
    assert sinks.insert_absent(df.limit(1), df, ["k"]).count() == 2


def test_raster_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 1.5)], "row int, col int, value double")
    sinks.write_raster(cells, (80.0, 1.0, 30.0, 1.0), f"file://{tmp_path}/dem")
    back, grid = readers.read_raster(spark, f"file://{tmp_path}/dem")
    assert back.first().value == 1.5 and grid == (80.0, 1.0, 30.0, 1.0)


def test_configuration_is_inherited(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nb: 1\n")
    (tmp_path / "own.yaml").write_text("inherits: base.yaml\na: {y: 3}\n")
    assert platform.load_config(str(tmp_path / "own.yaml")) == {"a": {"x": 1, "y": 3}, "b": 1}


def test_data_sets_keep_status_and_history(spark, tmp_path):
    sets = platform.Datasets(spark, str(tmp_path))
    sets.register("d", "1", {"obs": "a"})
    with pytest.raises(ValueError):
        sets.move("d", "1", "approved")
    with pytest.raises(ValueError):
        sets.move("d", "2", "checked")
    sets.move("d", "1", "checked", "fine")
    sets.register("d", "1", {"obs": "b"})
    sets.move("d", "1", "approved")
    sets.register("d", "2", {"obs": "c"})
    again = platform.Datasets(spark, str(tmp_path))
    assert [(r.event, r.status) for r in again.history("d", "1").collect()] == [("register", "registered"), ("checked", "checked"), ("register", "checked"), ("approved", "approved")]
    one = again.latest("d", "approved").first()
    assert (one.version, one.files) == ("1", {"obs": "b"}) and again.latest("d").first().version == "2"


def test_provenance_and_experiments(spark, tmp_path):
    log = platform.Provenance(spark, str(tmp_path))
    log.record("d", "dedup", "dropped", before="a", after="b", affected=2, by="date")
    log.record("d", "qc", "flagged", before="b", after="c")
    assert [(r.step, r.before, r.after, r.affected) for r in log.chain("d").collect()] == [("dedup", "a", "b", 2), ("qc", "b", "c", None)]
    book = platform.Experiments(spark, str(tmp_path))
    assert book.rollback("m") is None
    for v in ("1", "2", "3"):
        book.register("m", v, {"auprc": 0.5})
    book.deploy("m", "2")
    book.deploy("m", "3")
    assert {r.version: r.status for r in book.versions().collect()} == {"1": "evaluated", "2": "evaluated", "3": "deployed"}
    book.archive("m", "2")
    assert book.rollback("m") == "1" and {r.version: r.status for r in book.versions().collect()} == {"1": "deployed", "2": "archived", "3": "evaluated"}
    book.states.append("e1", "first", "running", {})
    book.states.append("e1", "first", "completed", {"auprc": 0.4})
    book.runs.append("e1", "r1", "gbt", "temporal", {"auprc": 0.5})
    book.runs.append("e1", "r2", "forest", "spatial", {"auprc": 0.4})
    held = book.experiments().first()
    assert held.status == "completed" and [r.run for r in held.runs] == ["r1", "r2"]
    assert {(r.model, r.value) for r in platform.compared(book.runs.rows(), ["e1"], "auprc").collect()} == {("gbt", 0.5), ("forest", 0.4)}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(2).write.parquet(f"{tmp_path}/events")
    stream = streams.runs(streams.read_events(spark, f"{tmp_path}/events", 10), 50.0)
    query = stream.writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    by = "PARTITION BY user_id ORDER BY ts, event_id"
    batch.createOrReplaceTempView("ev")
    want = spark.sql(f"SELECT CAST(user_id AS STRING) AS station_id, event_id, CAST(sum(o) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, IF(value > 50, 1, 0) AS o, sum(IF(value > 50, 0, 1)) OVER ({by}) AS g FROM ev)")
    key = lambda r: (r.station_id, r.event_id, r.run)
    assert sorted(map(key, spark.table("runs").collect())) == sorted(map(key, want.collect()))


def test_jobs_from_the_command_line(spark, sf_dir, tmp_path, capsys):
    assert jobs.main(["list"]) == 0 and "g3_static_features" in capsys.readouterr().out
    assert jobs.main(["run", "a27_value_counts", "--data", sf_dir, "--out", f"{tmp_path}/o"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/o").count() > 0
    with pytest.raises(SystemExit):
        jobs.main(["run", "no_such_query", "--data", sf_dir, "--out", "x"])


def test_store_and_preview(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS station_id, DATE'2001-01-01' AS date, 1.0D AS precip UNION ALL SELECT 'b', DATE'2001-01-02', 2.0D")
    rows.write.parquet(f"{tmp_path}/obs.parquet")
    held = store.Store(spark, f"file://{tmp_path}")
    first = held.table("obs")
    assert first.count() == 2 and held.table("obs") is first
    rows.union(rows).write.mode("overwrite").parquet(f"{tmp_path}/obs.parquet")
    held.reload()
    assert held.table("obs").count() == 4
    with pytest.raises(FileNotFoundError):
        held.table("none")
    wrong, shown = store.preview(spark, f"{tmp_path}/obs.parquet", 3)
    assert wrong == [] and [r["station_id"] for r in shown] == ["a", "a", "b"]
    spark.range(2).write.parquet(f"{tmp_path}/ids.parquet")
    assert len(store.preview(spark, f"{tmp_path}/ids.parquet")[0]) == 3


def test_slice_ddl_selection_and_guard(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS station_id, DATE'2001-01-01' AS date, 1.0D AS precip UNION ALL SELECT 'b', DATE'2003-01-02', 2.0D")
    assert [r.station_id for r in sinks.release_slice(rows, "2002-01-01", f"{tmp_path}/r").collect()] == ["b"]
    text = sinks.ddl(rows, "obs", ["station_id", "date"], {"station_id": "stations"}, {"station_id": ["a", "b"]})
    assert "station_id TEXT NOT NULL REFERENCES stations CHECK (station_id IN ('a', 'b'))" in text and "PRIMARY KEY (station_id, date)" in text
    assert studies.selected(rows, "a").count() == studies.selected(rows, date="2003-01-02").count() == 1
    with pytest.raises(LookupError):
        studies.selected(rows, "c")
    studies.check_request(400, 40)
    with pytest.raises(ValueError):
        studies.check_request(401, 40)
