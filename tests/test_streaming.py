import random
import time

import pytest
from table_rows import rows
from pyspark.sql import functions as F
from test_operators import MESSAGE, close, init, make_messages, replay, replay_sync, start

from foldstream.operators.evaluation import slot_report
from foldstream.plans.store import ParamTable, read_batches
from foldstream.sources import sinks, text, topics
from foldstream.streaming import params, windows
from foldstream.streaming.run import each_batch, run_available


def feed(spark, data, schema, path, pieces, writer):
    """Write the rows in order, a piece at a time, and let the stream catch up after each."""
    size = -(-len(data) // pieces)
    for at in range(0, len(data), size):
        spark.createDataFrame(data[at:at + size], schema).repartition(3).write.mode("append").parquet(path)
        run_available(writer(spark.readStream.schema(schema).parquet(path)))
    return -(-len(data) // size)


def to_files(df, tmp_path, mode="append"):
    return (df.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).outputMode(mode))


@pytest.mark.parametrize("pieces", [1, 3, 10])
def test_state_does_not_depend_on_batches(spark, tmp_path, pieces):
    sent = make_messages(200)
    out = str(tmp_path / "out")

    def writer(stream):
        save = lambda batch, _: batch.write.mode("overwrite").parquet(out)
        return each_batch(params.param_state(stream, 2, init), save, str(tmp_path / "state")).outputMode("complete")

    feed(spark, sent, MESSAGE, str(tmp_path / "in"), pieces, writer)
    close(rows(spark.read.parquet(out)), sorted(replay(spark, sent)[1].items()))


@pytest.mark.parametrize("pieces", [1, 4])
def test_serving_from_a_table(spark, tmp_path, pieces):
    sent = make_messages(200)
    held = ParamTable(spark, str(tmp_path / "table"), 2, compact_every=2).create()
    out = str(tmp_path / "out")
    n = feed(spark, sent, MESSAGE, str(tmp_path / "in"), pieces,
             lambda s: params.serve_from_table(s, held, out, init, str(tmp_path / "state")))
    answers, state = replay(spark, sent)
    close(rows(read_batches(spark, out, n).select("src", "dest", "vec")), sorted(answers))
    close(rows(held.read(n)), sorted(state.items()))


def test_callbacks(spark, tmp_path):
    sent = make_messages(120)

    def on_pull(key, source, vec):
        vec = [0.0, 0.0] if vec is None else vec
        return vec, [float(key), float(source)]

    def on_push(key, source, vec, delta):
        vec = delta if vec is None else [max(a, b) for a, b in zip(vec, delta)]
        return vec, vec

    feed(spark, sent, MESSAGE, str(tmp_path / "in"), 3,
         lambda s: to_files(params.keyed_server(s, on_pull, on_push), tmp_path))
    state, expected = {}, []
    for kind, src, dest, vec, _ in sent:
        if kind == "Push":
            state[dest] = [max(a, b) for a, b in zip(state[dest], vec)] if dest in state else vec
            expected.append((dest, src, state[dest]))
        else:
            state.setdefault(dest, [0.0, 0.0])
            expected.append((dest, src, [float(dest), float(src)]))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == sorted(expected)


def test_topic_roundtrip(spark, tmp_path):
    topic, back = str(tmp_path / "topic"), str(tmp_path / "back")
    sent = ["Pull:1:2", "Push:3:4:1.0,2.5", "Pull:5:6"]
    spark.createDataFrame([(x,) for x in sent], "value string").repartition(3).write.text(topic)
    echoed = topics.read_topic(spark, topic, per_batch=1).transform(text.decode_messages).transform(text.encode_messages)
    run_available(topics.write_topic(echoed, back, str(tmp_path / "state")))
    assert rows(spark.read.text(back)) == sorted((x,) for x in sent)


@pytest.mark.parametrize("pieces", [1, 4])
def test_count_windows(spark, tmp_path, pieces):
    rng = random.Random(8)
    data = [(0 if rng.random() < 0.5 else rng.randint(1, 3), float(i)) for i in range(100)]
    feed(spark, data, "k bigint, x double", str(tmp_path / "in"), pieces,
         lambda s: to_files(windows.count_windows(s, "k", "x", 6), tmp_path))
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    counts = {k: sum(1 for d, _ in data if d == k) // 6 for k in range(4)}
    assert [(k, w) for k, w, _ in got] == [(k, w) for k in range(4) for w in range(counts[k])]


RESULT = "eval_id bigint, ndcg double, ts bigint"


def test_sessions_report_each_slot(spark, tmp_path):
    data = [(i, 0.5 if i % 2 else 1.0, (i % 3) * 86400) for i in range(30)]
    path = str(tmp_path / "in")
    spark.createDataFrame(data, RESULT).write.parquet(path)
    stream = spark.readStream.schema(RESULT).parquet(path)
    query = (windows.slot_sessions(stream).writeStream.format("memory").queryName("slots").outputMode("complete")
             .option("checkpointLocation", str(tmp_path / "state")))
    run_available(query)
    expected = rows(slot_report(spark.createDataFrame(data, RESULT)))
    assert rows(spark.table("slots")) == expected


def test_stream_report_file(spark, tmp_path):
    data = [(i, 0.5, i * 40_000) for i in range(10)]
    path, report = str(tmp_path / "in"), str(tmp_path / "report")
    feed(spark, data, RESULT, path, 2,
         lambda s: sinks.stream_report(windows.slot_totals(s), report, str(tmp_path / "state")))
    assert rows(sinks.read_report(spark, report)) == rows(slot_report(spark.createDataFrame(data, RESULT)))


def test_slots_to_console(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(0, 0.5, 10)], RESULT).write.parquet(path)
    stream = spark.readStream.schema(RESULT).parquet(path)
    query = run_available(sinks.console_slots(windows.slot_totals(stream), str(tmp_path / "state")))
    assert query.exception() is None


def test_correlation_and_latency_streams(spark, tmp_path):
    asked = [(i, 50 + i, 1000 + i, f"2024-01-01 00:00:{i:02d}") for i in range(5)]
    # answer 9 has no request; the late rows move the watermarks past everything else
    answers = [(i, f"2024-01-01 00:01:{i:02d}") for i in (0, 1, 2, 9)]
    requests_path, answers_path = str(tmp_path / "r"), str(tmp_path / "a")
    r_schema, a_schema = "eval_id bigint, item_id bigint, ts bigint, at string", "eval_id bigint, at string"

    def streams():
        r = spark.readStream.schema(r_schema).parquet(requests_path).withColumn("asked", F.to_timestamp("at")).drop("at")
        a = spark.readStream.schema(a_schema).parquet(answers_path).withColumn("answered", F.to_timestamp("at")).drop("at")
        return r, a

    def step(r_rows, a_rows, name, make):
        spark.createDataFrame(r_rows, r_schema).write.mode("append").parquet(requests_path)
        spark.createDataFrame(a_rows, a_schema).write.mode("append").parquet(answers_path)
        writer = make().writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state"))
        run_available(writer)

    late = "2024-01-01 05:00:00"
    correlate = lambda: windows.correlate_requests_stream(*reversed(streams()))
    step(asked, answers, "c", correlate)
    step([(100, 0, 0, late)], [(101, late)], "c", correlate)
    step([(102, 0, 0, late)], [(103, late)], "c", correlate)
    got = spark.read.parquet(str(tmp_path / "c-out")).where("eval_id < 100").select("eval_id", "item_id", "ts")
    assert rows(got) == [(0, 50, 1000), (1, 51, 1001), (2, 52, 1002), (9, -1, -1)]

    def latency():
        r, a = streams()
        return windows.latency_stream(r.withColumnRenamed("asked", "entered"), a.withColumnRenamed("answered", "left"))

    run_available(latency().writeStream.format("parquet").option("path", str(tmp_path / "l-out"))
                  .option("checkpointLocation", str(tmp_path / "l-state")))
    assert rows(spark.read.parquet(str(tmp_path / "l-out"))) == [(0, 60.0), (1, 60.0), (2, 60.0)]
