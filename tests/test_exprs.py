import math

from pyspark.sql import functions as F

from cohortline.functions import exprs as x


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("v")).first()["v"]


def test_to_number_guard(spark):
    cases = {"12": 12.0, "12.": 12.0, "12.5": 12.5, "-3": -3.0, "": None, ".": None, "abc": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", x.to_number("t").alias("v")).collect()}
    assert got == cases


def test_integer_guard(spark):
    df = spark.createDataFrame([("12",), ("123456",), ("1.5",), ("",)], "t string")
    assert [r[0] for r in df.select(x.to_number("t", x.INTEGER_TEXT)).collect()] == [12.0, None, None, None]


def test_ladder_takes_first_rung_and_skips_unknown(spark):
    df = spark.createDataFrame([(None, 8.0), (12.0, 1.0), (3.0, None)], "a double, b double")
    col = x.ladder([(F.col("a") > 10, 4), ((F.col("a") > 2) | (F.col("b") > 5), 3)], 0)
    assert [r[0] for r in df.select(col).collect()] == [3, 4, 3]


def test_mask_is_open_unless_told(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (100.0,), (None,)], "v double")
    assert [r[0] for r in df.select(x.mask_range("v", 0, 100)).collect()] == [None, 1.0, None, None]
    assert [r[0] for r in df.select(x.mask_range("v", 0, 100, high_closed=True)).collect()] == [None, 1.0, 100.0, None]


def test_floor_div_below_zero(spark):
    df = spark.createDataFrame([(-1,), (-10,), (0,), (9,), (10,)], "v long")
    assert [r[0] for r in df.select(x.floor_div(F.col("v"), 10)).collect()] == [-1, -1, 0, 0, 1]


def test_like_any_and_not_error(spark):
    df = spark.createDataFrame([("BiPAP", None), ("mv 3", 1), (None, 0)], "t string, e int")
    assert [r[0] for r in df.select(x.flag(x.like_any("t", ["%bipap%", "mv%"], ci=True))).collect()] == [1, 1, 0]
    assert [r[0] for r in df.select(x.not_error("e")).collect()] == [True, False, True]


def test_two_sided_p(spark):
    for z in (0.0, 0.5, 1.96, 3.3):
        got = one(spark, x.two_sided_p(F.col("z")), z=z)
        assert abs(got - math.erfc(z / math.sqrt(2))) < 2e-7


def test_body_mass_index_and_logistic(spark):
    assert abs(one(spark, x.body_mass_index("w", "h"), w=80.0, h=200.0) - 20.0) < 1e-12
    assert one(spark, x.body_mass_index("w", "h"), w=80.0, h=0.0) is None
    assert one(spark, x.logistic("a"), a=0.0) == 0.5
