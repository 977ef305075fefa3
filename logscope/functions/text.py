"""Text features and log-line parsing as column expressions
(FEA1-FEA4, PRP14, SRC5 helpers, TOK1 default counter)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masking rules of the message normaliser, applied in order
# (pattern, replacement). Variable parts become <*>.
MASK_RULES: list[tuple[str, str]] = [
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<*>"),  # uuid
    (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<*>"),                                         # ip[:port]
    (r"\bblk_-?\d+\b", "<*>"),                                                                 # block id
    (r"\b0[xX][0-9a-fA-F]+\b", "<*>"),                                                         # hex literal
    (r"(?:/[\w.\-]+)+", "<*>"),                                                                # path
    (r"\b\d+(?:\.\d+)?\b", "<*>"),                                                             # number
]

# Line-field patterns of service logs (group 1 is the field).
FIELD_PATTERNS = {
    "thread": r"\[([^\]]+)\]",
    "request_id": r"\] +(\S+)",
    "level": r"\] +\S+ +(\w+)",
    "class_method": r"\w+ +(\S+ +<init>)",
    "log_text": r"<init> - (.*)",
}

# Leading time of day of service log lines, and its parse format.
TIME_PATTERN = r"^(\d{1,2}:\d{2}:\d{2}\.\d{3})"
TIME_FORMAT = "HH:mm:ss.SSS"

# Default token counter: word runs and single punctuation marks (no vocabulary needed).
TOKEN_RULE = r"\w+|[^\w\s]"


def normalise(text: Column, rules: Sequence[tuple[str, str]] = MASK_RULES) -> Column:
    """Mask variable parts with an ordered fold of ``regexp_replace``."""
    out = text
    for pat, rep in rules:
        out = F.regexp_replace(out, pat, rep)
    return out


def words(text: Column) -> Column:
    """Whitespace-separated words, empties removed."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Character trigrams in order; empty for texts shorter than 3. One pass over the text: each character is
    matched with the two after it (``substring`` at a place would count up to it from the first character)."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("(?s)(?=(...))."), 1), F.array().cast("array<string>"))


def lengths(words_col: Column, trigrams_col: Column, text: Column, event_id: Column | None = None) -> dict[str, Column]:
    """Length features: words, trigrams, chars, lines (newlines + 1), event id length."""
    out = {
        "e_words_len": F.size(words_col),
        "e_trigrams_len": F.size(trigrams_col),
        "e_chars_len": F.char_length(text),
        "e_lines_len": F.size(F.split(text, "\n")),
    }
    out["e_event_id_len"] = F.char_length(event_id) if event_id is not None else F.lit(0)
    return out


def extract_fields(text: Column) -> dict[str, Column]:
    """The five service-log fields; ``''`` when a pattern does not match."""
    return {name: F.regexp_extract(text, pat, 1) for name, pat in FIELD_PATTERNS.items()}


def extract_time(text: Column, pattern: str = TIME_PATTERN, fmt: str = TIME_FORMAT) -> Column:
    """Leading time of day -> timestamp on 1970-01-01; lenient (bad or missing -> null).
    A one-digit hour is left-padded first; the fraction is padded to millis."""
    raw = F.regexp_extract(text, pattern, 1)
    fixed = F.when(F.regexp_extract(raw, r"^(\d):", 1) != "", F.concat(F.lit("0"), raw)).otherwise(raw)
    fixed = F.rpad(fixed, 12, "0")
    ts = F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), fixed), F.lit("yyyy-MM-dd " + fmt))
    return F.when(raw == "", F.lit(None).cast("timestamp")).otherwise(ts)


def strip_time(text: Column, pattern: str = TIME_PATTERN) -> Column:
    """Message without the leading time of day."""
    return F.regexp_replace(text, pattern, "")


def count_tokens(text: Column, rule: str = TOKEN_RULE) -> Column:
    """Default token count of one text (word runs + punctuation marks)."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rule), 0))
