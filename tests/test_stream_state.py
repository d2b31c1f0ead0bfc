"""Keyed state machines, carried counters and the folder topic: results do not depend on the micro-batches."""

import random

import pytest
from pyspark.sql import functions as F
from table_rows import rows

from foldstream.sources import folder_topic, topics
from foldstream.streaming import counters, keyed
from foldstream.streaming.run import run_available


def arrive(spark, path, data, schema, writer, pieces):
    for i in range(pieces):
        spark.createDataFrame(data[i::pieces], schema).coalesce(1).write.mode("append").parquet(path)
        run_available(writer(spark.readStream.schema(schema).parquet(path)))


def to(path):
    return lambda df: df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")


@pytest.mark.parametrize("pieces", [1, 4])
def test_ordered_windows(spark, tmp_path, pieces):
    rng = random.Random(4)
    data = [(rng.choice([1, 1, 1, 2, 3]), i, 1000.0 + i) for i in range(90)]
    expected = []
    for key in (1, 2, 3):
        own = [i for k, i, _ in data if k == key]
        expected += [(key, w, own[4 * w:4 * w + 4]) for w in range(len(own) // 4)]
    rng.shuffle(data)
    schema = "k long, seq long, second double"

    def writer(stream):
        timed = stream.withColumn("at", F.timestamp_seconds("second")).drop("second")
        found = keyed.ordered_count_windows(timed, "k", "seq", "at", 4, lambda r: (r["seq"].tolist(),), "seqs array<bigint>", "100 seconds")
        return to(tmp_path)(found)

    with keyed.state_store(spark):
        arrive(spark, f"{tmp_path}/in", data, schema, writer, pieces)
        arrive(spark, f"{tmp_path}/in", [(None, None, 1e6)], schema, writer, 1)  # the watermark passes all
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == expected


def test_lists_merge_when_their_last_part_is_there(spark, tmp_path):
    schema = "eval_id long, item_id long, ts long, topk array<struct<item_id:long,score:double>>"
    data = [(e, 7 if p == 1 else -1, 100 + e if p == 1 else -1, [(10 * p + i, float(i % 2)) for i in range(3)]) for e in range(3) for p in range(2)]
    data.append((9, 7, 1, [(1, 1.0)]))  # its other part never comes
    with keyed.state_store(spark):
        arrive(spark, f"{tmp_path}/in", data, schema, lambda s: to(tmp_path)(keyed.merge_evaluations_stream(s, 2, 3)), 3)
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == [(e, 7, 100 + e, r, i, x) for e in range(3) for r, i, x in ((1, 1, 1.0), (2, 11, 1.0), (3, 0, 0.0))]


def test_callbacks_start_from_the_model(spark, tmp_path):
    schema = "kind string, src long, dest long, vec array<double>, seq long"
    data = [("Pull", 5, 1, None, 0), ("Push", 5, 1, [1.0], 1), ("Pull", 6, 1, None, 2), ("Pull", 5, 2, None, 3), ("Push", 5, 2, [3.0], 4),
            ("Pull", 6, 2, None, 5)]
    model = spark.createDataFrame([(1, [10.0])], "id long, vec array<double>")

    def writer(stream):
        return to(tmp_path)(keyed.model_callbacks(stream, "dest", "seq", keyed.answer_or_add, "src bigint, dest bigint, vec array<double>", model))

    with keyed.state_store(spark):
        for row in (data[:3], data[3:]):
            arrive(spark, f"{tmp_path}/in", row, schema, writer, 1)
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(1, 5, [10.0]), (1, 6, [11.0]), (2, 6, [3.0])]


def test_numbers_have_no_gaps_and_do_not_change(spark, tmp_path):
    data = [(x,) for x in range(100, 0, -1)]
    out = f"{tmp_path}/out"
    arrive(spark, f"{tmp_path}/in", data, "x long", lambda s: counters.dense_ids_stream(s, ["x"], out, f"{tmp_path}/state"), 3)
    got = rows(spark.read.parquet(*(f"{out}/batch={b}" for b in range(3))).select("eval_id", "x"))
    assert [i for i, _ in got] == list(range(100))
    # a batch that runs again: same numbers, and the ones behind it stay
    again = counters.dense_ids_stream(spark.readStream.schema("x long").parquet(f"{tmp_path}/in"), ["x"], out, f"{tmp_path}/other")
    assert again is not None
    for i in range(3):
        part = sorted(x for (x,) in data[i::3])
        at = sum(len(data[j::3]) for j in range(i))
        assert [x for _, x in got[at:at + len(part)]] == part


def test_topic_of_a_folder(spark, tmp_path):
    topic, lines = f"{tmp_path}/topic", f"{tmp_path}/lines"

    def publish(texts):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").parquet(lines)
        run_available(topics.write_folder_topic(spark.readStream.schema("value string").parquet(lines), topic, f"{tmp_path}/sent"))

    def listen(name, starting):
        run_available(to(f"{tmp_path}/{name}")(topics.read_folder_topic(spark, topic, starting)))
        return rows(spark.read.schema("value string").parquet(f"{tmp_path}/{name}/out"))

    publish(["a", "b\nc", ""])
    assert listen("late", "latest") == [] and listen("all", "earliest") == [("",), ("a",), ("b\nc",)]
    publish(["d"])
    (tmp_path / "topic/lines/stray").write_text('"lost task"\n')  # of a task that did not end: no commit names it
    assert listen("late", "latest") == [("d",)] == listen("late", "latest")
    assert listen("all", "earliest") == [("",), ("a",), ("b\nc",), ("d",)]
    assert folder_topic.commits(topic) == [0, 1]
    writer = folder_topic._Writer(topic)
    writer.commit([writer.write(iter([("d",)]))], 1)  # the same batch again
    assert folder_topic.commits(topic) == [0, 1] and listen("anew", "earliest") == [("",), ("a",), ("b\nc",), ("d",)]
    with pytest.raises(Exception, match="starting"):
        listen("wrong", "middle")


def test_open_lists_share_a_state(spark, tmp_path, monkeypatch):
    """Two buckets: lists of a bucket close in different micro-batches, one has no id, and an id that comes again starts anew."""
    monkeypatch.setattr(keyed, "EVALUATION_BUCKETS", 2)
    schema = "eval_id long, item_id long, ts long, topk array<struct<item_id:long,score:double>>"
    big = (1 << 60) + 1  # a double would not hold it
    ids = [None, big, *range(20)]
    first = [(e, 7, 70, [(1, 1.0), (2, 3.0)]) for e in ids] + [(0, -1, -1, []), (0, 8, 80, [(5, 0.5)])]
    second = [(e, -1, -1, [(3, 2.0)]) for e in ids if e != 1]

    def writer(stream):
        return to(tmp_path)(keyed.merge_evaluations_stream(stream, 2, 2))

    with keyed.state_store(spark):
        for data in (first, second):
            arrive(spark, f"{tmp_path}/in", data, schema, writer, 1)
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(r["eval_id"], []).append((r["rank"], r["item_id"], r["score"], r["target_id"]))
    assert set(got) == set(ids) - {1}
    assert all(sorted(got[e]) == [(1, 2, 3.0, 7), (2, 3, 2.0, 7)] for e in got if e != 0)
    assert len(got[0]) >= 2


def test_one_call_for_the_lists_of_a_bucket(spark, tmp_path):
    """So many calls of the state as there are buckets, not as there are lists."""
    calls = spark.sparkContext.accumulator(0)

    class Counted(keyed._MergeParts):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            return super().handleInputRows(key, rows, timerValues)

    schema = "eval_id long, item_id long, ts long, topk array<struct<item_id:long,score:double>>"
    with pytest.MonkeyPatch.context() as patch, keyed.state_store(spark):
        patch.setattr(keyed, "EVALUATION_BUCKETS", 3)
        patch.setattr(keyed, "_MergeParts", Counted)
        arrive(spark, f"{tmp_path}/in", [(e, 1, 1, [(e, 1.0)]) for e in range(200)], schema, lambda s: to(tmp_path)(keyed.merge_evaluations_stream(s, 1, 3)), 1)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200 and calls.value == 3
