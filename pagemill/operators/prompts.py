"""Prompt templates, output scores and comparison reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import excerpt, has_citation, has_json, word_count

# Doubled braces, placeholders, and what lies between them.
PIECES = r"(?s)\{\{|\}\}|\{\w+\}|[^{}]+|[{}]"


@dataclass(frozen=True)
class Template:
    name: str
    description: str
    system: str
    user: str


PRESETS = (
    Template("plain", "the text alone", "", "{input}"),
    Template(
        "for_newcomers",
        "everyday words for readers new to the subject",
        "Your readers meet this subject for the first time. Use everyday words and explain every term you can't avoid.",
        "{input}",
    ),
    Template(
        "claims_with_sources",
        "every claim with where it comes from",
        "After each claim name the passage it rests on in square brackets. Leave out what no passage supports.",
        "Text to work from:\n{input}",
    ),
    Template(
        "two_sides",
        "the case for and the case against",
        "First make the strongest case for the statement, then the strongest case against it. Do not decide.",
        "Statement: {input}",
    ),
    Template(
        "csv_facts",
        "facts as lines of a table",
        "Write nothing but lines of the form subject;property;value, one fact to a line.",
        "{input}",
    ),
)


def prompt_registry(spark, templates: Sequence[Template] = PRESETS) -> DataFrame:
    rows = [(t.name, t.description, t.system, t.user, i) for i, t in enumerate(templates)]
    return spark.createDataFrame(
        rows, "name string, description string, system string, user_template string, ord int"
    )


def _template_literal(template: Template, ord_: int) -> Column:
    return F.struct(
        F.lit(template.name).alias("prompt_name"),
        F.lit(template.system).alias("system"),
        F.lit(template.user).alias("user_template"),
        F.lit(ord_).alias("ord"),
    )


def render(template: Column, values: Mapping[str, Column]) -> Column:
    """Put values in place of ``{name}``; each place is filled once.

    The template is cut at its placeholders and looked up piece by piece, so a
    value that itself looks like a placeholder stays as it is. A placeholder
    without a value makes the result null.
    """
    pieces = F.regexp_extract_all(template, F.lit(PIECES), F.lit(0))

    def fill(piece: Column) -> Column:
        filled = (
            F.when(piece == "{{", F.lit("{"))
            .when(piece == "}}", F.lit("}"))
            .when(~piece.rlike(r"\A\{\w+\}\z"), piece)
        )
        for name, value in values.items():
            filled = filled.when(piece == f"{{{name}}}", F.coalesce(value, F.lit("")))
        return filled

    done = F.transform(pieces, fill)
    return F.when(~F.exists(done, lambda p: p.isNull()), F.array_join(done, ""))


def render_prompts(
    inputs: DataFrame, values: Mapping[str, str], *, template: str = "user_template"
) -> DataFrame:
    """Add ``user_message``, and ``reject_reason`` where a placeholder has no value."""
    message = render(F.col(template), {k: F.col(c) for k, c in values.items()})
    return inputs.withColumn("user_message", message).withColumn(
        "reject_reason", F.when(F.col("user_message").isNull(), F.lit("missing value"))
    )


def render_grid(
    inputs: DataFrame,
    *,
    text: str = "text",
    names: Sequence[str] | None = None,
    templates: Sequence[Template] = PRESETS,
) -> DataFrame:
    """Every input with every chosen template; names that are not known give nothing.

    Templates are a short list in the program, so they are literals of the plan
    and each input row is expanded where it is.
    """
    known = {t.name: t for t in templates}
    chosen = [known[n] for n in (names or known) if n in known]
    grid = inputs.withColumn(
        "_t", F.explode(F.array(*[_template_literal(t, i) for i, t in enumerate(chosen)]))
    ).select(*inputs.columns, "_t.*")
    return render_prompts(grid, {"input": text}).drop("user_template")


def unknown_names(
    selection: DataFrame, *, name: str = "prompt_name", templates: Sequence[Template] = PRESETS
) -> DataFrame:
    """Selected names that no template has, with how often each was asked for."""
    return (
        selection.filter(~F.col(name).isin(*[t.name for t in templates]))
        .groupBy(name)
        .agg(F.count("*").alias("n"))
    )


def output_metrics(outputs: DataFrame, *, text: str = "text") -> DataFrame:
    """Add length, word count and the JSON and citation flags of each output."""
    out = F.col(text)
    return outputs.withColumns(
        {
            "char_count": F.length(out),
            "word_count": word_count(out),
            "has_json": has_json(out),
            "has_citation": has_citation(out),
        }
    )


def prompt_metrics_summary(results: DataFrame) -> DataFrame:
    """Per prompt: how its outputs came out."""
    return results.filter("answered").groupBy("prompt_name").agg(
        F.count("*").alias("outputs"),
        F.round(F.avg("char_count"), 4).alias("avg_chars"),
        F.round(F.avg("word_count"), 4).alias("avg_words"),
        F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
        F.sum("token_total").cast("bigint").alias("tokens"),
        F.count_if("has_json").alias("json_outputs"),
        F.count_if("has_citation").alias("cited_outputs"),
    )


def comparison_table(results: DataFrame) -> DataFrame:
    """A Markdown report per input: a row per prompt and run, then an excerpt of each output.

    ``results`` has unique (input_id, prompt_name, run_no) and the prompts' order
    ``ord``; a prompt without an answer is one row that says so.
    """
    tick = lambda flag: F.when(flag, "✅").otherwise("—")
    label = F.concat(F.col("prompt_name"), F.coalesce(F.concat(F.lit(" #"), F.col("run_no").cast("string")), F.lit("")))
    figures = F.concat_ws(
        " | ",
        F.col("char_count").cast("string"),
        F.bround("latency_ms", 0).cast("bigint").cast("string"),
        F.col("token_total").cast("string"),
        tick(F.col("has_json")),
        tick(F.col("has_citation")),
    )
    row = F.concat(
        F.lit("| "), label, F.lit(" | "), F.when(F.col("answered"), figures).otherwise("no answer | | | |"), F.lit(" |")
    )
    detail = F.when(
        F.col("answered"),
        F.concat(F.lit("### "), label, F.lit("\n\n```\n"), excerpt(F.col("text")), F.lit("\n```\n")),
    )
    lines = results.withColumn("_row", row).withColumn("_detail", detail)
    listed = lines.groupBy("input_id").agg(
        F.min("input_text").alias("input_text"),
        F.count_if("answered").alias("answers"),
        F.count_if(~F.col("answered")).alias("missing"),
        F.expr("listagg(_row, '\\n') WITHIN GROUP (ORDER BY ord, run_no)").alias("_rows"),
        F.expr("listagg(_detail, '\\n') WITHIN GROUP (ORDER BY ord, run_no)").alias("_details"),
    )
    report = F.concat(
        F.lit("# Prompt comparison\n\n**Input**: "),
        F.col("input_text"),
        F.lit("\n\n| Prompt | Characters | Latency (ms) | Tokens | JSON | Citation |\n"),
        F.lit("|---|---|---|---|---|---|\n"),
        F.col("_rows"),
        F.lit("\n\n## Outputs\n\n"),
        F.coalesce(F.col("_details"), F.lit("")),
    )
    return listed.select("input_id", "answers", "missing", report.alias("report"))
