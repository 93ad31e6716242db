"""Sweeps simplify equal rings once."""

import pandas as pd
from pyspark.sql import functions as F

from emberframe.functions import shapes
from emberframe.operators import levels


def test_equal_rings_are_simplified_once(spark, monkeypatch):
    done = spark.sparkContext.accumulator(0)

    @F.pandas_udf(shapes.RINGS)
    def counted(rings: pd.Series, tolerance: pd.Series) -> pd.Series:
        done.add(len(rings))
        return rings

    monkeypatch.setattr(levels, "simplify_rings", counted)
    ring = [[0.0, 0.0], [0.0, 5.0], [0.01, 9.0], [9.0, 9.0], [9.0, 0.0], [0.0, 0.0]]
    rows = spark.createDataFrame([(i, [ring]) for i in range(50)], "ident long, rings array<array<array<double>>>")
    got = levels.sweep(rows, [0.0, 0.5]).select("ident", "tolerance", "before", "after").collect()
    assert len(got) == 100 and {(r.tolerance, r.before, r.after) for r in got if r.ident < 50} == {(0.0, 5, 5), (0.5, 5, 5)}
    assert 0 < done.value < 20
