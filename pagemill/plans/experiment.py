"""Prompt experiments: render, join the stored outputs, score, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.conversations import parse_response
from pagemill.operators.prompts import (
    PRESETS,
    Template,
    comparison_table,
    output_metrics,
    render_grid,
)


def experiment_results(
    inputs: DataFrame,
    responses: DataFrame,
    *,
    names: Sequence[str] | None = None,
    templates: Sequence[Template] = PRESETS,
) -> DataFrame:
    """Every input and prompt with its scored outputs, all runs of them.

    ``inputs(input_id, text)``, ``responses(input_id, prompt_name, raw, latency_ms, run_no)``.
    A prompt without a readable answer is one row with ``answered`` false; answers
    that can't be read are listed by :func:`unreadable_responses`.
    """
    grid = render_grid(inputs, names=names, templates=templates).select(
        "input_id", "prompt_name", "ord", F.col("text").alias("input_text"), "system", "user_message"
    )
    outputs = parse_response(responses).filter(F.col("parse_error").isNull()).drop("parse_error")
    scored = output_metrics(outputs.withColumn("token_total", F.col("total_tokens")))
    return grid.join(scored, ["input_id", "prompt_name"], "left").withColumn("answered", F.col("text").isNotNull())


def unreadable_responses(responses: DataFrame) -> DataFrame:
    """Stored responses that no score counts, with why."""
    return parse_response(responses).filter(F.col("parse_error").isNotNull()).select(
        "input_id", "prompt_name", "run_no", "parse_error"
    )


def run_experiment(inputs: DataFrame, responses: DataFrame, **options: object) -> DataFrame:
    """One comparison report per input."""
    return comparison_table(experiment_results(inputs, responses, **options))
