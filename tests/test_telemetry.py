"""Events equal the results of the plans that they come from."""

import math
import time

from pyspark.sql import functions as F

from larkspur.streaming.telemetry import Run, summary


def test_metrics_of_a_batch(spark):
    rows = [(float(v),) for v in range(100)] + [(None,), (math.nan,), (math.inf,)]
    run = Run(spark, "r1", rate=0.5)
    df, pending = run.observe(spark.createDataFrame(rows, "x double").repartition(3), 4, {"rows": F.count("*"), **summary("x")})
    assert df.where("x < 10").count() == 10  # what is observed is the table before the filter
    found = pending.emit()
    assert found["rows"] == 103 and found["x.max"] == 99 and found["x.mean"] == 49.5 and found["x.finite"] == 100 / 102
    run.metric(5, "loss", 0.25)
    events = run.events().collect()
    assert [e["kind"] for e in events[:2]] == ["run.start", "config"] and {e["run_id"] for e in events} == {"r1"}
    assert {(e["step"], e["name"]): e["value"] for e in events if e["kind"] == "metric"} == {**{(4, k): v for k, v in found.items()}, (5, "loss"): 0.25}


def test_metrics_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10 + k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = Run(spark)
    run.watch_streams()
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = run.observe_stream(stream, {"rows": F.count("*"), "total": F.sum("id")}).writeStream.format("parquet")
        query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(90)
        out = spark.read.parquet(str(tmp_path / "out")).agg(F.count("*").alias("n"), F.sum("id").alias("s")).first()
        for _ in range(100):  # the listener hears of a batch a little later
            got = [e for e in run.events().collect() if e["kind"] == "metric"]
            if sum(e["value"] for e in got if e["name"] == "rows") == out["n"]:
                break
            time.sleep(0.2)
    finally:
        run.close()
    assert sum(e["value"] for e in got if e["name"] == "rows") == out["n"] == 33 == sum(e["value"] for e in got if e["name"] == "input_rows")
    assert sum(e["value"] for e in got if e["name"] == "total") == out["s"] and len({e["step"] for e in got}) == 3
