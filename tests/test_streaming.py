"""The streaming hourly mean equals the batch one on the same rows."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from fixture_paths import SF0001
from tempora.sources.tables import EVENT_TYPES, hourly_frame
from tempora.streaming.hourly import start_append


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp()
    src = os.path.join(d, "in")
    os.makedirs(src)
    shutil.copy(os.path.join(SF0001, "events.parquet"), os.path.join(src, "events.parquet"))
    schema = spark.read.parquet(src).schema
    out, ck = os.path.join(d, "out"), os.path.join(d, "ck")
    q = start_append(spark, src, schema, out, ck, F.col("user_id") % 8, "ts", "value", "event_type",
                     EVENT_TYPES, watermark="0 seconds")
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    exp = hourly_frame(spark, SF0001)
    # the watermark holds back the still-open last hour of each run
    last = exp.agg(F.max("ts")).first()[0]
    exp = exp.filter(F.col("ts") < last)
    got = got.filter(F.col("ts") < last)
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0 or _close(got, exp)


def _close(a, b):
    pa = a.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    pb = b.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    import numpy as np
    for c in EVENT_TYPES:
        np.testing.assert_allclose(pa[c].to_numpy(dtype=float), pb[c].to_numpy(dtype=float), equal_nan=True)
    return True
