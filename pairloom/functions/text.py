"""Column expressions over raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.settings import PROMPT_CHARACTERS, WORD_PATTERN

# Everything Python counts as blank: ASCII controls and separators, NEL, and the Unicode separators.
BLANK = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def words(text: Column) -> Column:
    """Lower-cased word and punctuation tokens of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def normalize_prompt(text: Column, limit: int = PROMPT_CHARACTERS) -> Column:
    """Lower case, at most ``limit`` characters, no blanks at the ends."""
    return strip(F.substring(F.lower(text), 1, limit))


def prompt_route(text: Column) -> Column:
    """What a prompt asks for. Text behind a colon is only labelled, never run."""
    prompt = F.lower(text)
    return (
        F.when(prompt == ":s", "samples")
        .when(prompt == ":ts", "temperature_samples")
        .when(prompt == ":q", "quit")
        .when(prompt == ":a", "architecture")
        .when(prompt == ":p", "parameters")
        .when(prompt.startswith(":"), "rejected")
        .otherwise("prompt")
    )
