"""The stream goes on from its markers."""

from pyspark.sql import functions as F

from sluice.operators import rollup
from sluice.sources import tables
from sluice.streaming import rollup as streaming


def plain(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_restarts_and_repeated_batches_change_nothing(spark, small, tmp_path):
    e = tables.web_events(spark, small)
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    early = F.col("event_id") <= (low + high) // 2
    log, state = f"{tmp_path}/log", f"{tmp_path}/state"
    e.where(early).repartition(3).write.parquet(log)
    assert plain(streaming.run(spark, log, e.schema, state, None)) == plain(rollup.daily_rollup(e.where(early)))
    assert plain(streaming.run(spark, log, e.schema, state, None)) == plain(rollup.daily_rollup(e.where(early)))
    e.where(~early).repartition(3).write.mode("append").parquet(log)
    want = plain(rollup.daily_rollup(e))
    assert plain(streaming.run(spark, log, e.schema, state, None)) == want
    streaming.merge(e.where(~early), 1, state)
    streaming.merge(e.where(early), 0, state)
    assert [n for n, _ in streaming.committed(spark, state)] == [0, 1]
    assert plain(streaming.run(spark, log, e.schema, state, None)) == want


def test_a_batch_that_failed_midway_is_done_anew(spark, small, tmp_path, monkeypatch):
    e, state = tables.web_events(spark, small), str(tmp_path)
    late = F.col("event_id") % 2 == 1
    streaming.merge(e.where(~late), 0, state)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(streaming, "increment", broken)
        try:
            streaming.merge(e.where(late), 1, state)
        except OSError:
            pass
    assert [n for n, _ in streaming.committed(spark, state)] == [0]
    streaming.merge(e.where(late), 1, state)
    metrics = spark.read.parquet(f"{streaming.committed(spark, state)[-1][1]}/metrics")
    views = lambda df: plain(df.where("metric_key = 'page_views'"))
    assert views(metrics) == views(rollup.daily_rollup(e))


def test_a_stream_without_input_is_empty(spark, small, tmp_path):
    e = tables.web_events(spark, small)
    e.where("false").coalesce(1).write.parquet(f"{tmp_path}/log")
    assert streaming.run(spark, f"{tmp_path}/log", e.schema, f"{tmp_path}/state").count() == 0
