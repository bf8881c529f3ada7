"""The operators by name in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from markloom.functions import render, tree
from markloom.functions.policy import PRESETS

from .legacy import compiled
from .parse import EVENTS, arrow_function, register_udtfs


def _cleaner(policy):  # noqa: ANN001, ANN202
    return lambda s: "".join(render.sanitized(tree.build(s), policy))


def register(spark: SparkSession) -> None:
    """``html_text``, ``html_events``, ``html_serialize``, ``html_lenient``, ``html_sanitize_<preset>`` and the table functions.

    Each takes one string; null gives null.
    """
    spark.udf.register("html_text", arrow_function(lambda s: render.plain_text(tree.build(s)), "string"))
    spark.udf.register("html_events", arrow_function(lambda s: render.events(tree.build(s)), EVENTS))
    spark.udf.register("html_serialize", arrow_function(lambda s: render.serialized(tree.build(s)), "string"))
    spark.udf.register("html_lenient", arrow_function(compiled().clean, "string"))
    for name, policy in PRESETS.items():
        spark.udf.register(f"html_sanitize_{name}", arrow_function(_cleaner(policy), "string"))
    register_udtfs(spark)
