"""JSON result sets to rows; a broken answer and an empty one stay different."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ENVELOPE = (
    "total_matching int, returned int, attribution string, "
    "cities array<struct<slug:string,name:string,country:string,region:string,"
    "overall_score:double,cost_usd:double>>, _corrupt string"
)

CALL_RESULT = "isError boolean, content array<struct<type:string,text:string>>"


def first_text(result: Column) -> Column:
    """Text of the first text block of a tool answer; '' when there is none."""
    blocks = F.filter(result["content"], lambda b: F.coalesce(b["type"], F.lit("text")) == "text")
    return F.coalesce(F.get(blocks, F.lit(0))["text"], F.lit(""))


def unwrap_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Adds ``text`` and ``refused``: an error flag and an empty answer are refusals."""
    parsed = answers.withColumn("_r", F.from_json(F.col(column), CALL_RESULT))
    text = first_text(F.col("_r"))
    flagged = F.coalesce(F.col("_r.isError"), F.lit(False))
    refused = F.when(flagged, "reported_error").when(text == "", "no_content")
    return parsed.withColumns({"text": text, "refused": refused}).drop("_r")


def parse_envelopes(texts: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``parsed``; text that is not JSON is kept beside it as ``plain_text``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(F.col(column), ENVELOPE, options)
    corrupt = F.col("parsed._corrupt").isNotNull() | F.col("parsed").isNull()
    return texts.withColumn("parsed", parsed).withColumn("plain_text", F.when(corrupt, F.col(column)))


def city_rows(parsed: DataFrame, carry: list[str]) -> DataFrame:
    """One row per entity of the readable envelopes, beside the envelope's own counts."""
    return parsed.filter("plain_text IS NULL").select(
        *carry, "parsed.total_matching", "parsed.returned", F.inline("parsed.cities")
    )
