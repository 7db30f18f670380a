"""C4 on tables stored by key: same rows as the plain upsert, one exchange, on the load."""

import re
import uuid

from pyspark.sql import functions as F

from acadspark.operators.upsert import upsert
from acadspark.sources.bucketed import merged, upsert_table, write_bucketed


def test_upsert_into_a_stored_table(spark):
    name = f"t_{uuid.uuid4().hex}"
    first = spark.range(0, 5000).select(F.col("id").alias("k"), F.lit("v0").alias("v"), (F.col("id") % 7).alias("w"))
    write_bucketed(first, f"{name}_1", ["k"], 8)
    src = spark.range(4900, 5100).select((F.col("id") * 3 % 6000).alias("k"), F.lit("v1").alias("v"), F.lit(9).cast("long").alias("w"))
    args = dict(id_col=None, created_col=None, updated_col=None)
    want = upsert(first, src, ["k"], ["v"], "2025-01-01 00:00:00", **args)
    got = upsert_table(spark, f"{name}_1", src, ["k"], ["v"], "2025-01-01 00:00:00", 8, f"{name}_2", **args)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # the second version is stored by key too, and the load is what is exchanged
    for version in (1, 2):
        plan = merged(spark, f"{name}_{version}", src, ["k"], ["v"], "2025-01-01 00:00:00", 8, **args)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange\b", text)) == 1, text
        assert "SelectedBucketsCount: 8 out of 8" in text or "Bucketed: true" in text
    again = upsert_table(spark, f"{name}_2", src, ["k"], ["v"], "2025-01-01 00:00:00", 8, f"{name}_3", **args)
    assert again.exceptAll(got).count() == 0 and got.exceptAll(again).count() == 0
