"""Places of the given tables, and small helpers, shared by the tests."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
