"""Rule-based detectors, cleaners and parsers as column expressions; Python only where a scan needs state."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases of requests for information and for comments, and what rules a field out.
RFI = r"(?i)\brequest(?:s)?\s+for\s+information\b|\bRFI\b"
RFC = r"(?i)\brequest(?:s)?\s+for\s+comments?\b|\bRFC\b"
NOT_REQUEST = r"(?i)\bIETF\b|\bInternet\s+Engineering\s+Task\s+Force\b|\bRFC\s*\d{3,5}\b|\brequest\s+for\s+correction\b"
#: Signs that a text answers comments, by priority.
CITATIONS = (
    r"(?i)\bresponse[s]?\s+to\s+comment",
    r"(?i)\bcomment(?:er)?s?\s+(?:argued|suggested|requested|recommended)",
    r"(?i)\bcomment\s+\d+\b",
    r"(?i)\bafter\s+reviewing\s+the\s+comments\b",
    r"(?i)\bwe\s+received\s+.*\bcomment",
)
#: Lines that screenshots of chat pages leave behind, and the short lines that mean something.
OCR_NOISE = (
    r"^[€©®]+",
    r"^[|\[\]{}]+$",
    r"^chat\.openai\.com",
    r"^G Gmail",
    r"^Microsoft Office",
    r"^\+ ?(New ?chat|New Tab)",
    r"^Default \(GPT",
    r"^Regenerate response",
    r"^Free Research Preview",
    r"^ChatGPT (May|June|July|Aug|Sep|Oct|Nov|Dec|Jan|Feb|Mar|Apr)",
    r"^Send a message",
    r"^\d+/\d+$",
)
OCR_SHORT = ("i", "a", "ok", "no")


def request_label(fields: dict[str, Column]) -> Column:
    """(is_request, label, matched): RFI, RFC, both or NONE over fields that nothing rules out."""
    usable = {n: F.when(c.rlike(NOT_REQUEST), F.lit("")).otherwise(F.coalesce(c, F.lit(""))) for n, c in fields.items()}
    any_of = lambda p: F.greatest(*(c.rlike(p) for c in usable.values()), F.lit(False))
    rfi, rfc = any_of(RFI), any_of(RFC)
    label = F.when(rfi & rfc, "RFI;RFC").when(rfi, "RFI").when(rfc, "RFC").otherwise("NONE")
    hits = F.array(*(F.when(usable[n].rlike(RFI) | usable[n].rlike(RFC), F.lit(n)) for n in sorted(usable)))
    return F.struct((rfi | rfc).alias("is_request"), label.alias("label"), F.array_join(F.array_compact(hits), ";").alias("matched"))


def citation_snippet(*texts: Column) -> Column:
    """Up to 280 characters around the first sign, by text and then by priority; null without one."""
    found = []
    for text in texts:
        for pattern in CITATIONS:
            at = F.regexp_instr(text, F.lit(pattern))
            size = F.length(F.regexp_extract(text, pattern, 0))
            begin = F.greatest(at - 120, F.lit(1))
            cut = F.trim(F.regexp_replace(F.substring(text, begin, at + size + 160 - begin), r"\s+", " "))
            found.append(F.when(at > 0, F.when(F.length(cut) > 280, F.concat(F.left(cut, F.lit(277)), F.lit("..."))).otherwise(cut)))
    return F.coalesce(*found)


def comment_status(now: Column, start: Column, due: Column, open_flag: Column) -> Column:
    """The flag where there is one, else what the dates say as of ``now``."""
    by_date = F.when(now < start, "scheduled").when(now > due, "closed").when(start.isNotNull(), "open").otherwise("unknown")
    return F.when(open_flag, "open").when(~open_flag, "closed").otherwise(by_date)


def is_active(now: Column, due: Column, stored: Column) -> Column:
    """Days until due, rounded up, above 0; the stored flag without a date."""
    days = F.ceil((F.unix_timestamp(due.cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))) / 86400)
    return F.when(due.isNotNull(), days > 0).otherwise(F.coalesce(stored, F.lit(False)))


def in_closing_range(due: Column, low: Column, high: Column) -> Column:
    """Between inclusive bounds; a missing date passes."""
    return due.isNull() | ((low.isNull() | (due >= low)) & (high.isNull() | (due <= high)))


def glued_chat_date(text: Column) -> Column:
    """Timestamps whose time follows the year without a space."""
    spaced = F.trim(F.regexp_replace(text, r"(\d{4})(\d{1,2}:\d{2})", "$1 $2"))
    return F.coalesce(*(F.try_to_timestamp(spaced, F.lit(p)) for p in ("M/d/yyyy h:mm a", "M/d/yyyy H:mm", "M/d/yyyy")))


def clean_ocr(text: Column) -> Column:
    """A text without the lines of page furniture and without one or two stray letters."""

    def stays(line: Column) -> Column:
        bare = F.trim(line)
        noise = bare.rlike("(?i)" + "|".join(f"(?:{p})" for p in OCR_NOISE))
        return ~noise & ((F.length(bare) > 2) | F.lower(bare).isin(*OCR_SHORT))

    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def filing_numbers(text: Column) -> Column:
    """Upper-case file numbers that begin with SR- or S7-, each once, in order; odd dashes and spaces are mended."""
    mended = F.regexp_replace(F.upper(text), "[‐‑‒–—−]", "-")
    found = F.regexp_extract_all(mended, F.lit(r"\bS(?:R|7)\s*-\s*[A-Z0-9]+(?:\s*-\s*[A-Z0-9]+)*"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "-{2,}", "-")))


def first_list(raw: str | None) -> list | None:
    """The first JSON list in a text, whatever stands around it."""
    decoder, at = json.JSONDecoder(), -1
    while raw and (at := raw.find("[", at + 1)) >= 0:
        try:
            return decoder.raw_decode(raw, at)[0]
        except ValueError:
            continue
    return None


def claims(raw: str | None) -> tuple[list[str] | None, bool]:
    """A list of strings as JSON or as a Python literal, and whether it is one."""
    got = first_list(raw)
    if got is None and raw:
        try:
            got = ast.literal_eval(raw.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            got = None
    good = isinstance(got, list) and all(isinstance(x, str) for x in got)
    return (got, True) if good else (None, False)


@F.pandas_udf(T.StructType([T.StructField("claims", T.ArrayType(T.StringType())), T.StructField("ok", T.BooleanType())]))
def parse_claims(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([claims(x) for x in raw], columns=["claims", "ok"])


def _leaves(value) -> list[str]:
    if isinstance(value, dict):
        return [x for v in value.values() for x in _leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in _leaves(v)]
    return [] if value is None else [str(value)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def leaf_texts(raw: pd.Series) -> pd.Series:
    """Leaf values of nested JSON, depth first; what is no JSON has none."""

    def one(text):
        try:
            return _leaves(json.loads(text))
        except (TypeError, ValueError):
            return []

    return raw.map(one)
