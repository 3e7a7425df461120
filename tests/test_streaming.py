"""Streams driven to completion over folders of files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from amperoute.functions import parse
from amperoute.operators.sequences import vehicle_day
from amperoute.schema import DAILY_VALUES
from amperoute.streaming import ingest, trips

RAW = "timeStamp string, speed string, odometer string"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("timeStamp,speed,odometer\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")


def samples(stream):
    typed = stream.select(
        "code",
        parse.datetime(F.col("timeStamp")).alias("timestamp"),
        parse.number(F.col("speed")).alias("speed"),
        parse.number(F.col("odometer")).alias("mileage"),
    )
    return typed.withColumn("date", F.to_date("timestamp"))


def test_late_and_repeated_files_merge_idempotently(spark, tmp_path):
    inbox, table, marks = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "marks")

    def run():
        stream = samples(ingest.file_stream(spark, str(inbox), RAW))
        ingest.merge_stream(stream, table, ["code", "timestamp", "date"], marks, order=[F.col("mileage").desc()]).awaitTermination()
        return sorted((r.code, str(r.timestamp), r.speed, r.mileage) for r in spark.read.parquet(table).collect())

    write(inbox, "T1.csv", [("2024-01-02 10:00:00", 5, 1), ("2024-01-02 10:00:00", 6, 2), ("2024-01-03 10:00:00", 7, 3)])
    first = run()
    assert first == [("T1", "2024-01-02 10:00:00", 6.0, 2.0), ("T1", "2024-01-03 10:00:00", 7.0, 3.0)]
    write(inbox, "T2.csv", [("2024-01-01 10:00:00", 1, 1), ("2024-01-02 10:00:00", 2, 2)])
    assert run() == sorted(first + [("T2", "2024-01-01 10:00:00", 1.0, 1.0), ("T2", "2024-01-02 10:00:00", 2.0, 2.0)])
    assert len(run()) == 4


def test_streamed_trips_split_at_long_stops(spark, tmp_path):
    source = tmp_path / "tel"
    start = datetime(2024, 1, 2, 8)
    rows = [(1, start + timedelta(minutes=m), s, float(m)) for m, s in ((0, 9.0), (10, 9.0), (12, 0.0), (40, 9.0), (45, 9.0), (500, 0.0), (501, 9.0))]
    schema = "veh_id int, timestamp timestamp_ntz, speed double, mileage double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    closed = trips.trips(stream, late_minutes=30)
    query = closed.writeStream.format("memory").queryName("closed_trips").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("closed_trips").orderBy("trip_start").collect()
    assert [(r.samples, r.init_odo, r.final_odo) for r in got] == [(2, 0.0, 10.0), (2, 40.0, 45.0)]


def test_touched_days_are_recomputed(spark, tmp_path):
    tel, daily = str(tmp_path / "tel"), str(tmp_path / "daily")
    schema = "veh_id int, timestamp timestamp_ntz, mileage double, soc double, speed double"
    start = datetime(2024, 1, 2, 8)
    rows = [(v, start + timedelta(days=d, minutes=m), float(m), 0.9, 5.0) for v in (1, 2) for d in (0, 1) for m in (0, 30)]
    stored = spark.createDataFrame(rows, schema).withColumn("date", F.to_date("timestamp"))
    stored.write.partitionBy("date").parquet(tel)
    vehicle_day(stored).withColumn("peak_payload", F.lit(100)).write.partitionBy("date").parquet(daily)
    late = spark.createDataFrame([(1, start + timedelta(minutes=90), 90.0, 0.5, 5.0)], schema)
    late.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(tel)
    trips.refresh_days(tel, daily, columns=DAILY_VALUES)(late, 0)
    got = {(r.veh_id, r.date.day): (r.tot_dist, r.peak_payload) for r in spark.read.parquet(daily).collect()}
    assert got == {(1, 2): (90.0, 100), (1, 3): (30.0, 100), (2, 2): (30.0, 100), (2, 3): (30.0, 100)}


def test_streamed_vehicle_days_equal_the_batch_over_restarts(spark, tmp_path):
    import random

    from amperoute.streaming import vehicle_days

    rng, rows = random.Random(4), []
    for veh in range(6):
        at = datetime(2024, 1, 2, 6)
        for _ in range(80):
            at += timedelta(minutes=rng.choice([1, 5, 14, 15, 16, 90]))
            rows.append((veh, at, rng.choice([None, float(len(rows))]), rng.choice([None, 0.5, 0.7]), rng.choice([0.0, 5.0, 9.0, None])))
    schema = "veh_id int, timestamp timestamp_ntz, mileage double, soc double, speed double"
    rows.append((None, datetime(2024, 1, 2, 9), 1.0, 0.1, 3.0))
    rows.append((9, None, 1.0, 0.1, 3.0))
    late = lambda r: (r[1] or datetime(2024, 1, 3)) + timedelta(minutes=rng.choice([0, 40]))
    arriving = sorted(((late(r), r) for r in rows), key=lambda x: x[0])
    parts = [[], [], [], [(-1, datetime(2024, 2, 1), None, None, None)]]
    for when, row in arriving:
        parts[0 if when < datetime(2024, 1, 3) else 1 if when < datetime(2024, 1, 3, 20) else 2].append(row)
    folders = [str(tmp_path / n) for n in ("in", "out", "marks")]
    for part in parts:
        vehicle_days.drained(spark.createDataFrame(part, schema), *folders)
    vehicle_days.drained(spark.createDataFrame([], schema), *folders)
    got = spark.read.parquet(folders[1])
    want = vehicle_day(spark.createDataFrame(rows, schema).where("veh_id is not null")).select(*got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() == 12


def test_streamed_days_make_no_python_call_per_day_and_take_late_samples_of_open_days(spark, tmp_path):
    from amperoute.streaming import vehicle_days

    schema = "veh_id int, timestamp timestamp_ntz, mileage double, soc double, speed double"
    at = lambda hour, minute=0, day=2: datetime(2024, 1, day, hour, minute)
    first = [(1, at(8), None, None, 5.0), (1, at(8, 20), 10.0, 0.9, 0.0), (1, at(9), 20.0, 0.8, 5.0), (2, at(23), 1.0, 0.5, 0.0)]
    late = [(1, at(8, 10), 5.0, 0.95, 5.0), (-1, at(0, day=9), None, None, None)]  # the first is behind the watermark, its day is open
    folders = [str(tmp_path / n) for n in ("in", "out", "marks")]
    for part in (first, late[:1], late[1:]):
        vehicle_days.drained(spark.createDataFrame(part, schema).coalesce(1), *folders)
    got = spark.read.parquet(folders[1])
    want = vehicle_day(spark.createDataFrame(first + late[:1], schema)).select(*got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() == 2
    stream = vehicle_days.vehicle_days(spark.readStream.schema(schema).parquet(folders[0]))
    assert "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
