"""Labels of steps, by need: a mart that reads failure modes only doesn't pay for intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.intents import with_intent
from ..functions.outcomes import action_category, failure_mode, verify_outcome


def taxonomy(spark: SparkSession, session: bool = False) -> DataFrame:
    """(intent, category, letter, phase); with the intents that transcripts add if ``session``."""
    return spark.createDataFrame(dims.taxonomy(session), "intent string, category string, letter string, phase string")


def with_modes(steps: DataFrame) -> DataFrame:
    """``steps(action, observation)`` with the failure mode, null without one."""
    return steps.withColumn("mode", failure_mode(F.col("action"), F.col("observation")))


def with_acts(steps: DataFrame) -> DataFrame:
    """``steps(action)`` with the coarse class of the action."""
    return steps.withColumn("act", action_category(F.col("action")))


def label(steps: DataFrame) -> DataFrame:
    """Steps with intent, category, letter, phase, outcome, mode and action category; no shuffle."""
    out = with_intent(steps).withColumn("outcome", verify_outcome(F.col("action"), F.col("observation"), F.col("intent")))
    return with_acts(with_modes(out)).join(F.broadcast(taxonomy(steps.sparkSession)), "intent", "left")  # 51 rows
