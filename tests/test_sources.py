import pytest
from table_rows import rows

from foldstream.sources import sinks, text


def lines(spark, *values):
    return spark.createDataFrame([(x,) for x in values], "value string")


def test_interactions(spark):
    df = text.decode_interactions(lines(spark, "900000123,21,4", "5,6,7,8,9"))
    assert rows(df) == [(6, 7, 1.0, 5), (21, 4, 1.0, 900000123)]
    other = text.decode_interactions(lines(spark, "4,1000000017,6,7"), eval_id=0, ts=1, user=2, item=3, ts_offset=1000000007)
    assert rows(other) == [(4, 6, 7, 1.0, 10)]


@pytest.mark.parametrize("line", ["1,2", "a,1,2", "1,,2", ""])
def test_malformed_interaction_ends_the_job(spark, line):
    with pytest.raises(Exception, match="not a bigint"):
        text.decode_interactions(lines(spark, line)).collect()


def test_interaction_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("10,1,2\n20,3,4\n")
    assert rows(text.read_interactions(spark, str(tmp_path))) == [(1, 2, 1.0, 10), (3, 4, 1.0, 20)]


def test_model_lines(spark):
    line = "8,0.5,-1.25e-3,7,0.1"
    (row,) = text.decode_model(lines(spark, line)).collect()
    assert row["id"] == 8
    assert row["vec"] == [float(x) for x in line.split(",")[1:]]
    params = spark.createDataFrame([(3, [1.0, -2.5])], "id bigint, vec array<double>")
    assert rows(text.encode_model(params)) == [("3:1.0,-2.5",)]
    assert rows(text.encode_model(params, sep=",").transform(text.decode_model)) == [(3, [1.0, -2.5])]


def test_messages_roundtrip(spark):
    sent = lines(spark, "Pull:1:2", "Push:3:4:1.0,2.5")
    decoded = text.decode_messages(sent)
    assert [tuple(r) for r in decoded.orderBy("src").collect()] == [("Pull", 1, 2, None), ("Push", 3, 4, [1.0, 2.5])]
    assert rows(text.encode_messages(decoded)) == rows(sent)


@pytest.mark.parametrize("line", ["Poke:1:2", "Push:1:2", "Push:1:2:", "Push:1:2:x", "Pull:1", "Pull:a:2", ""])
def test_bad_message(spark, line):
    with pytest.raises(Exception, match="not supported|not a "):
        text.decode_messages(lines(spark, line)).collect()
    good, bad = text.split_rejects(lines(spark, line, "Pull:1:2", "Push:1:2:3"))
    assert rows(bad) == [(line,)]
    assert text.decode_messages(good).count() == 2


def test_answers(spark):
    (row,) = text.decode_answers(lines(spark, "7:9:1.0,-2.0")).collect()
    assert tuple(row) == (7, 9, [1.0, -2.0])
    answer = spark.createDataFrame([("PullAnswer", 7, 9, [1.0, -2.0])], "kind string, src bigint, dest bigint, vec array<double>")
    assert rows(text.encode_messages(answer)) == [("7:9:1.0,-2.0",)]


def test_report_file(spark, tmp_path):
    path = str(tmp_path / "out")
    report = spark.createDataFrame([(16230, 0.5, 3), (16231, 0.25, 1)], "time_slot bigint, ndcg double, n bigint")
    sinks.save_report(report.limit(1), path)
    sinks.save_report(report, path)
    assert rows(spark.read.text(path)) == [("16230,0.5,3",), ("16231,0.25,1",)]
    assert rows(sinks.read_report(spark, path)) == rows(report)


def test_slots_on_console(spark, capsys):
    sinks.show_slots(spark.createDataFrame([(16230, 0.5, 3)], "time_slot bigint, ndcg double, n bigint"))
    assert "16230" in capsys.readouterr().out
