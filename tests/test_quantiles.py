"""Exact quantiles, whatever approximate quantiles say, and however often they are found anew."""

import random

import numpy as np
from pyspark.sql import functions as F

from emberframe.operators import levels, quality


def test_ends_that_change(spark, monkeypatch):
    """Merged in another order, approximate quantiles have other values; here they have others on every call."""
    some = F.udf(lambda values: sorted(random.SystemRandom().sample(values, 20)), "array<double>").asNondeterministic()
    monkeypatch.setattr(quality.F, "percentile_approx", lambda c, *_: some(F.collect_list(c)))
    values = {"a": [float(i * i % 1009) for i in range(3000)], "b": [float(i % 7) for i in range(500)], None: [0.5 * i for i in range(801)]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    for _ in range(3):
        got = {r["k"]: r for r in quality.distribution(rows, "v", ["k"]).collect()}
        for k, vs in values.items():
            assert [round(got[k][f"p{p}"], 6) for p in (25, 50, 75, 90, 95, 99)] == [round(float(np.percentile(vs, p)), 6) for p in (25, 50, 75, 90, 95, 99)]
        sizes = {r["k"]: r.median for r in levels.partition_sizes(rows, ["k"], "v").collect()}
        assert sizes == {k: float(np.percentile(vs, 50)) for k, vs in values.items()}
