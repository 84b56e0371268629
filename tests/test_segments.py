import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators import segments as sg


def skewed(spark, rows=4000):
    rng = random.Random(9)
    data = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 20)}", rng.randint(0, 5000)) for i in range(rows)]
    data += [(rows, None, 5), (rows + 1, None, 6)]
    return spark.createDataFrame(data, "id long, k string, p long")


def test_row_numbers_equal_a_plain_window(spark):
    df = skewed(spark)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("p", "id")))
    cut = sg.row_numbers(df, ["k"], [F.col("p"), F.col("id")], sg.by_position("p", 50), "n")
    assert {tuple(r) for r in cut.select("id", "n").collect()} == {tuple(r) for r in plain.select("id", "n").collect()}


def test_running_sum_equals_a_plain_window(spark):
    df = skewed(spark)
    upto = Window.partitionBy("k").orderBy("p", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("s", F.sum("p").over(upto))
    cut = sg.running_sum(df, ["k"], [F.col("p"), F.col("id")], sg.by_position("p", 7), F.col("p"), "s")
    assert {tuple(r) for r in cut.select("id", "s").collect()} == {tuple(r) for r in plain.select("id", "s").collect()}


def test_run_numbers_equal_lag_and_sum(spark):
    df = skewed(spark)
    order = Window.partitionBy("k").orderBy("p", "id")
    flagged = df.withColumn("o", F.when(F.col("p") - F.lag("p").over(order) < 3, 0).otherwise(1))
    plain = flagged.withColumn("r", F.sum("o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = sg.run_numbers(
        df, ["k"], ["p", "id"], sg.by_position("p", 11), ["p"], lambda a, b: b["p"] - a["p"] >= 3, "r"
    )
    assert {tuple(r) for r in cut.select("id", "r").collect()} == {tuple(r) for r in plain.select("id", "r").collect()}
