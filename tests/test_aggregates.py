"""Group representatives."""

from harvestry.operators.aggregates import group_first


def test_group_first_is_the_smallest_value_whatever_the_order(spark):
    rows = [("a", 3.0, None), ("a", 1.0, "y"), ("b", 2.0, "z"), ("b", None, "x"), ("c", None, None), (None, 7.0, "q")]
    for ordered in (rows, rows[::-1]):
        got = {r.g: (r.x, r.s) for r in group_first(spark.createDataFrame(ordered, "g string, x double, s string"), ["g"], ["x", "s"]).collect()}
        assert got == {"a": (1.0, "y"), "b": (2.0, "x"), "c": (None, None), None: (7.0, "q")}
