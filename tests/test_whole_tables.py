from pyspark.sql import functions as F

import __spark_entry__
from lumifuzz.operators import conformal
from lumifuzz.plans import queries


def test_every_row_is_explained(spark, sf):
    made = __spark_entry__.queries()["explain_orders"](spark, sf)
    assert made.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert "explain_orders" in __spark_entry__.oracle_sql()


def test_conformal_queries_score_every_row_outside_calibration(spark, sf):
    rest = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 5 <> 0")
    sets = __spark_entry__.queries()["conformal_sets"](spark, sf)
    assert sets.agg(F.sum("n")).first()[0] == rest.count()
    df, cal = queries._calibrated(spark, sf)
    made = conformal.predict_set_with_rules(df.where("l_orderkey % 5 <> 0"), cal, 0.3)
    explained = __spark_entry__.queries()["conformal_explained"](spark, sf)
    assert explained.agg(F.sum("n")).first()[0] == made.agg(F.sum(F.size("contributions"))).first()[0]
