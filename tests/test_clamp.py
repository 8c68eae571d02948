import pytest

from gainsieve.operators.encode import fit_numeric, quantile_edges
from gainsieve.operators.order_stats import FEW_VALUES
from gainsieve.sources.workspace import Workspace


@pytest.mark.parametrize("distinct", [FEW_VALUES - 100, FEW_VALUES + 500, FEW_VALUES + 2000])
def test_bins_are_clamped_by_the_true_count(spark, distinct):
    df = spark.createDataFrame([(float(i % distinct), "n" if i % 2 else "y", -0.0 if i % distinct else 0.0) for i in range(2 * distinct)], "`x.y` double, y string, z double")
    ws = Workspace(spark)
    for bins in (distinct + 500, distinct, distinct - 1, distinct - 40):
        want = quantile_edges(df.withColumnRenamed("x.y", "x"), ["x"], min(bins, distinct - 1), ws)["x"]
        x, z = fit_numeric(df, [], ["x.y", "z"], bins, "y", 2, ws)
        assert x.edges == want
        assert bins < distinct - 1 or x.bins == distinct - 1
        assert z.edges == []
