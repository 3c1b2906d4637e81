from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from customsloom.operators import tuning


def score(spark, base=10.0, sensor=False, automation=False, families=(), heading="", hints=None, penalised=None, matched=(), excluded=(), says=""):
    names = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>") if xs is not None else F.lit(None).cast("array<string>")
    one = tuning.industrial(F.lit(base), F.lit(sensor).cast("boolean"), F.lit(automation).cast("boolean"), names(families), F.lit(heading), names(hints), names(penalised), names(matched), names(excluded), F.lit(says))
    return spark.range(1).select(one).first()[0]


def test_sensors_and_what_is_none(spark):
    assert score(spark, sensor=True, heading="9025") == 19.0 and score(spark, heading="9025") == 10.0
    assert score(spark, sensor=True, heading="8536", hints=["8536"], families=["proximity_sensor"]) == pytest.approx(10 + 6.5 + 6.5 * 1.85)
    assert score(spark, families=["proximity_sensor"], heading="8536") == 10.0  # not a sensor: the family alone doesn't count
    assert score(spark, sensor=True, families=["temperature_sensor", "proximity_sensor"], says="clinical thermometer") == 12.5 and score(spark, sensor=True, families=["proximity_sensor"], says="clinical thermometer") == 4.5


def test_ribbon_in_its_heading_costs_once(spark):
    assert score(spark, families=["stationery_marker"], heading="9612", says="ribbon") == score(spark, families=["stationery_marker"], heading="9608", says="ribbon") == pytest.approx(0.6)


def test_model_words_alone(spark):
    assert score(spark, matched=["x1"], excluded=["x1", "x2"]) == 0.5 and score(spark, matched=["x1", "y"], excluded=["x1"]) == 10.0 and score(spark, matched=[], excluded=["x1"]) == 10.0
    assert score(spark, heading="8501", penalised=["8501"], families=["electric_motor"]) == pytest.approx((10 + 9.1) * 0.03)


def test_nulls(spark):
    assert score(spark, sensor=None, automation=None, families=None, heading=None, matched=None, excluded=None, says=None) == 10.0
    assert score(spark, base=None) is None
