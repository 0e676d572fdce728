import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarmac.functions.windows import SIX_HOURS
from tarmac.operators import airline_status
from tarmac.queries import rounded
from tarmac.schema import FLIGHT, Q1, RAW_DOUBLE, VIEW
from tarmac.sources import flights as source
from tarmac.sources import avro, ingest, streams
from tarmac.sources.flights import EVENT_AIRLINES
from tarmac.streaming import jobs, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture
def flights(spark):
    return source.flights(spark, SF)


def rows(df):
    return sorted(map(str, rounded(df).collect()))


def test_last_window_is_emitted(spark, flights):
    """The predicate must stay above the watermark, or the stream's end is filtered out before it counts."""
    got = jobs.replayed(flights, lambda s: jobs.status(s, EVENT_AIRLINES))
    batch = airline_status.status(flights, EVENT_AIRLINES)
    assert got.schema.names == Q1.names
    assert rows(got) == rows(batch)
    assert got.agg(F.max("window_start")).first() == batch.agg(F.max("window_start")).first()


def test_restart_adds_nothing(spark, flights, tmp_path):
    streams.write_chunks(flights, f"{tmp_path}/in", "0", 1, end=False)
    stream = lambda: jobs.status(streams.from_files(spark, f"{tmp_path}/in"), EVENT_AIRLINES)
    run = lambda: sinks.to_files(stream(), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    read = lambda: spark.read.schema(Q1).option("timestampNTZFormat", sinks.TIME).csv(f"{tmp_path}/out")
    run()
    before = read().count()
    run()
    assert read().count() == before
    streams.end_of_stream(spark).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert rows(read()) == rows(airline_status.status(flights, EVENT_AIRLINES))


def test_sinks_get_the_same_rows(spark, flights, tmp_path):
    streams.write_chunks(flights, f"{tmp_path}/in", "event_id % 2", 2)
    key = ["window_start", "airline"]
    seen = []
    write = sinks.keyed(f"{tmp_path}/table", key)

    def twice(batch, number):
        write(batch, number)
        write(batch, number)

    stream = jobs.status(streams.from_files(spark, f"{tmp_path}/in", 9), EVENT_AIRLINES)
    sinks.fan_out(stream, f"{tmp_path}/checkpoint", twice, lambda batch, _: seen.extend(r.value for r in sinks.as_json(sinks.plain(batch)).collect())).awaitTermination()
    batch = airline_status.status(flights, EVENT_AIRLINES)
    assert rows(sinks.read_keyed(spark, f"{tmp_path}/table", key).select(*Q1.names)) == rows(batch)
    back = sinks.from_json(spark.createDataFrame([(v,) for v in seen], "value string"), Q1)
    assert rows(back) == rows(batch)


def test_late_rows_are_dropped(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    row = lambda n, minutes: (n, at + dt.timedelta(minutes=minutes), "AA", 1, 2, 0.0, 0.0, 0.0)
    schema = "event_id long, rowtime timestamp_ntz, airline string, origin_airport_id int, dest_airport_id int, dep_delay double, cancelled double, diverted double"
    df = spark.createDataFrame([row(1, 5), row(2, 150), row(3, 151), row(4, 10)], schema)
    streams.write_chunks(df, f"{tmp_path}/in", "event_id - 1", 4)
    got = jobs.status(streams.from_files(spark, f"{tmp_path}/in"), delay=60)
    sinks.to_files(got, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "parquet").awaitTermination()
    assert sorted((r.window_start.hour, r.num_flights) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, 1), (2, 2)]


def test_global_window_fires(spark, flights):
    got = jobs.replayed(flights, lambda s: jobs.ranking(s, SIX_HOURS, 1))
    assert got.count() and got.agg(F.max("airport_rank")).first()[0] <= 10


def test_partials_as_a_stream(spark, flights):
    """The watermark is behind the filter; still the stream's end closes the last window."""
    got = jobs.replayed(flights, lambda s: jobs.status_by_partials(s, EVENT_AIRLINES), format="csv")
    assert rows(got) == rows(airline_status.status(flights, EVENT_AIRLINES))


def test_upsert_in_a_database(spark, flights, tmp_path):
    """Derby comes with Spark. The same batch twice, and an early partial batch, leave each key's last row."""
    url, key = f"jdbc:derby:{tmp_path}/db;create=true", ["window_start", "airline"]
    whole = airline_status.status(flights, EVENT_AIRLINES).select("window_start", "airline", "num_flights", "dep_delay_mean")
    early = whole.withColumn("num_flights", F.lit(-1).cast("long")).filter("airline <> 'click'")
    if "derby" not in " ".join(spark.sparkContext._jvm.java.lang.System.getProperty("java.class.path").split(":")):
        pytest.skip("no database driver")
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    db = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    db.createStatement().execute("CREATE TABLE q1 (window_start TIMESTAMP, airline VARCHAR(20), num_flights BIGINT, dep_delay_mean DOUBLE, PRIMARY KEY (window_start, airline))")
    db.createStatement().execute("CREATE TABLE q1_staging (window_start TIMESTAMP, airline VARCHAR(20), num_flights BIGINT, dep_delay_mean DOUBLE)")
    db.close()
    write = sinks.jdbc(url, "q1", key, driver, form="merge")
    write(early, 0)
    write(whole, 1)
    write(whole, 1)
    got = spark.read.jdbc(url, "q1", properties=driver)
    assert rows(got.toDF(*[c.lower() for c in got.columns]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))) == rows(whole)


def test_statements_of_an_upsert():
    import sqlite3

    assert sinks.merge_sql("t", ["k"], ["k"]).endswith("DO NOTHING")
    with pytest.raises(ValueError):
        sinks.merge_sql("t", ["k"], ["k"], "other")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, v INT)")
    db.execute("CREATE TABLE t_staging (k INT, v INT)")
    db.execute("INSERT INTO t VALUES (1, 0)")
    db.executemany("INSERT INTO t_staging VALUES (?, ?)", [(1, 6), (2, 7)])
    for _ in range(2):
        db.execute(sinks.merge_sql("t", ["k", "v"], ["k"]))
    assert sorted(db.execute("SELECT * FROM t")) == [(1, 6), (2, 7)]


def test_keyed_table_folds(spark, tmp_path):
    write = sinks.keyed(f"{tmp_path}/t", ["k"], fold=3)
    for i in range(8):
        write(spark.createDataFrame([(0, i), (i, i)], "k int, v int").distinct(), i)
    assert sorted(tuple(r) for r in sinks.read_keyed(spark, f"{tmp_path}/t", ["k"]).collect()) == [(0, 7), *((i, i) for i in range(1, 8))]
    assert len(list((tmp_path / "t").iterdir())) < 6


def test_rates_are_logged(spark, flights, tmp_path):
    said = []
    listener = sinks.rates(said.append)
    spark.streams.addListener(listener)
    try:
        jobs.replayed(flights, lambda s: jobs.status(s, EVENT_AIRLINES))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert any("throughput=" in line and "rows=" in line for line in said)


def test_topics_need_only_the_connector(spark, flights, tmp_path):
    """Without Spark's Kafka connector, the sink and the source fail at it and at nothing before."""
    streams.write_chunks(flights, f"{tmp_path}/in", "0", 1)
    with pytest.raises(Exception, match="(?i)kafka"):
        sinks.to_kafka(jobs.status(streams.from_files(spark, f"{tmp_path}/in")), "none:9092", "q1", f"{tmp_path}/c").stop()
    with pytest.raises(Exception, match="(?i)kafka"):
        streams.from_kafka(spark, "none:9092", "flights")
    with pytest.raises(ValueError):
        streams.from_kafka(spark, "none:9092", "flights", "xml")


def test_nothing_is_produced_twice(spark, flights, tmp_path):
    at = f"{tmp_path}/topic"
    assert jobs.produced(flights, at, "0", 1) and not jobs.produced(flights, at, "0", 1)
    n = spark.read.parquet(at).count()
    assert n == flights.count() + 1
    assert jobs.produced(flights, at, "0", 1, again=True) and spark.read.parquet(at).count() == 2 * n


def events_of(flights):
    """Flights as events, and the stream's end behind them."""
    zero = [F.lit(0).alias(n) for n in ("year", "month", "day_of_month", "crs_dep_time")]
    none = [F.lit(None).cast("double").alias(n) for n in RAW_DOUBLE.values() if n not in ("dep_delay", "cancelled", "diverted")]
    rows = flights.select(*[F.col(f.name).cast(f.dataType) for f in VIEW]).union(streams.end_of_stream(flights.sparkSession))
    return rows.select(F.unix_millis("rowtime").alias("event_time"), "*", *zero, *none).select(*FLIGHT.names)


def test_over_http(spark, flights, tmp_path):
    """Posted in lines, taken by a listener that first refuses, read as a stream."""
    with ingest.Listener(f"{tmp_path}/topic") as listener:
        sinks.post(listener.url, lines=37)(events_of(flights).repartition(2), 0)
        with pytest.raises(Exception, match="404"):
            sinks.post(listener.url + "x", tries=1)(events_of(flights).limit(1), 0)
    files = [f for f in (tmp_path / "topic").iterdir() if not f.name.startswith(".")]
    assert sum(f.read_text().count("\n") for f in files) == flights.count() + 1 and max(f.read_text().count("\n") for f in files) <= 37
    got = jobs.status(streams.from_lines(spark, f"{tmp_path}/topic", 10_000), EVENT_AIRLINES)
    sinks.to_files(got, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "parquet").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(airline_status.status(flights, EVENT_AIRLINES))
    with pytest.raises(Exception, match="(?i)refused|urlopen"):
        sinks.post(listener.url, tries=2, wait=0.01)(flights.limit(1), 0)


def test_runs_on_at_a_pace(spark, flights, tmp_path):
    streams.write_chunks(flights, f"{tmp_path}/in", "event_id % 2", 2)
    running = sinks.to_files(jobs.status(streams.from_files(spark, f"{tmp_path}/in", 9), EVENT_AIRLINES), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "parquet", every="200 milliseconds")
    try:
        running.processAllAvailable()
        assert running.isActive
    finally:
        running.stop()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(airline_status.status(flights, EVENT_AIRLINES))


def test_wire_records_as_a_stream(spark, flights, tmp_path):
    """What a topic's values hold, here in files: decoded, watermarked and counted, by both forms of Q1."""
    avro.encoded(events_of(flights).repartition(3), 7).write.parquet(f"{tmp_path}/topic")
    batch = rows(airline_status.status(flights, EVENT_AIRLINES))
    for name, query in (("sql", jobs.status), ("ds", jobs.status_by_partials)):
        raw = spark.readStream.schema("value binary").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/topic")
        stream = query(streams.of_events(avro.decoded(raw)), EVENT_AIRLINES)
        sinks.to_files(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint", "parquet").awaitTermination()
        assert rows(spark.read.parquet(f"{tmp_path}/{name}")) == batch
