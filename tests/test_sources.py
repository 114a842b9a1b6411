"""Sources: parsing with rejects, text round trip, event ticks."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tiltframe.sources.tables import event_points, lineitem_points
from tiltframe.sources.text import parse_vectors, read_text_points, render_vectors


def test_parse_with_rejects(spark):
    lines = spark.createDataFrame([("1 2 3",), ("4 x 6",), ("7 8",), ("  9 10 11 ",), ("1 2 3 lbl",), (None,)], "value string")
    pts, rej = parse_vectors(lines, "value", dim=3)
    assert sorted(tuple(r["x"]) for r in pts.collect()) == [(1.0, 2.0, 3.0), (9.0, 10.0, 11.0)]
    assert sorted(r["reason"] for r in rej.collect()) == ["bad_size", "bad_token", "bad_token", "null_line"]
    lab, _ = parse_vectors(lines.where("value = '1 2 3 lbl'"), "value", dim=3, drop_label=True)
    r = lab.first()
    assert r["x"] == [1.0, 2.0, 3.0] and r["label"] == "lbl"


def test_text_round_trip(spark, tmp_path):
    pts = lineitem_points(spark, SF_SMALL).select("x")
    render_vectors(pts).select("value").write.text(str(tmp_path / "t"))
    back, rej = read_text_points(spark, str(tmp_path / "t"), dim=4)
    assert rej.count() == 0
    assert sorted(tuple(r["x"]) for r in back.collect()) == sorted(tuple(r["x"]) for r in pts.collect())


def test_event_ticks_are_days_since_origin(spark):
    ev = event_points(spark, SF_SMALL)
    t = ev.agg(F.min("tick").alias("a"), F.max("tick").alias("b")).first()
    assert t["a"] == 0 and t["b"] == 29
    assert ev.where(F.size("x") != 2).count() == 0
