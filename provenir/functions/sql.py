"""The text functions by name, for queries written in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import rules
from .rx import WS, java


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def register(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions text_words, text_word_count, text_paragraph_count, text_trim and text_matches; their names."""
    word = _quoted(java(rules.WORD))
    made = {
        "text_words(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(t, {word}, 0)",
        "text_word_count(t STRING) RETURNS BIGINT": f"CAST(regexp_count(t, {word}) AS BIGINT)",
        "text_paragraph_count(t STRING) RETURNS BIGINT": f"CAST(size(filter(split(t, {_quoted(f'[\\n][{WS}]*[\\n]')}), p -> p rlike {word})) AS BIGINT)",
        "text_trim(t STRING) RETURNS STRING": f"regexp_replace(t, {_quoted(f'^[{WS}]+|[{WS}]+$')}, '')",
        "text_matches(t STRING, p STRING) RETURNS ARRAY<STRING>": "array_distinct(regexp_extract_all(lower(t), p, 0))",
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in made]
