"""Hours of bus sections, a row for each section from beginning to end."""

from waymill.operators import timing


def test_rows_are_not_multiplied_by_hours(spark):
    df = spark.createDataFrame([("r", None, "7"), ("r", "4", "8"), ("r", "5", "-1"), ("r", "x", "12")], "k string, a string, b string")
    out = timing.section_hours(df, ["k"], ["a", "b"], 3)
    assert "explode" not in out._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in out.collect()] == [("r", [4, 8])]
