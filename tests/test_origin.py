from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from customsloom.operators import origin

TEXT = "EUR.1 enclosed for all positions except positions 3-5 and 8"


def test_positions_of_an_exception_with_and_without_ranges(spark):
    df = spark.createDataFrame([(i, TEXT) for i in range(1, 10)], "position int, text string")
    assert df.select(origin.named_positions(F.col("text"), "eur1_except"), origin.named_positions(F.col("text"), "eur1_except", "reference")).first()[:] == ([3, 4, 5, 8], [3])
    no = lambda mode: [r["position"] for r in df.where(origin.line_preference(F.col("position"), F.col("text"), mode=mode) == "NO").orderBy("position").collect()]
    assert no("ranges") == [3, 4, 5, 8] and no("reference") == [3]
    with pytest.raises(ValueError):
        origin.named_positions(F.col("text"), "eur1_except", "other")
