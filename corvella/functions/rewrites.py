"""Cleaning of texts that a language model has rewritten, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# What a model leaves around its rewrite. Results hang on each of them and on their order.
OPENING_TAG = r'(?i)^\s*[_(">]*<[_]?(?:rewritten[_\s-]*comment[_\s]*\d*|rewritten[_\s-]*response|comment|new\s+version\s+of\s+comment|_END_OF_COMMENT_)>[)"]*\s*'
CLOSING_TAG = r"(?i)\s*</(?:rewritten[_\s-]*comment[_\s]*\d*|rewritten[_\s-]*response|comment)>\s*$"
PREFIX = (
    r"(?im)^\s*(?:and\s+)?(?:Here is|Here's)\s+(?:the|a|my)\s+(?:rewritten|new|revised|alternative|different)\s+(?:comment|version|response)(?:\s+of\s+the\s+comment)?\s*:?\s*"
    r"|^\s*(?:completely |public comment )?rewritten\s*(?:comment|version)?\s*:?\s*\n"
    r"|^\s*(?:on\s*)?[Ss]ubmitting a rewritten version of the comment>?\s*\n"
    r"|^\s*(?:version of the comment\s*(?:rewritten|revised)?|of the comment|was (?:not )?provided)\s*:?\s*\n"
    r"|^\s*(?:New [Cc]omment|New [Vv]ersion|Version of [Cc]omment|Here is the (?:comment|new comment)|Revised [Cc]omment)\s*:?\s*\n"
    r"|^\s*public comment submitted by\s+<[^>]+>\s+on\s+<[^>]+>[^:]*:?\s*\n"
    r"|^\s*[Bb]elow is a rewritten version[^\n]*:?\s*\n"
    r"|^\s*SIGNING OFF\s*\n"
)
LEADING_JUNK = r"(?i)^\s*(?:<\w+>)?(?:;?\s*<?\w*>?)?\s*(?:COMMENT\s*\d*\s*>{0,2})?\s*(?:THISCOMMENT|No)?\s*(?:false|true)\s*\n+(?:\s*\d+\s*\n+)?"
STRAY_START = r'(?i)^\s*(?:[:\)\],;*\[\.">]+|EUR|\d{1,2}|No|is)\s*\n'
LEADING_URL = r"^\s*<https?://[^>]+>\s*\n?"
NEXT_COMMENT = (
    r"(?i)(?:</comment\s*\d*\s*>|<comment\s*\d+>|<END\s+OF\s+COMMENT|<{2,}\s*(?:REWRITTEN[\s_]*)?COMMENT[\s_]*(?:\d+)?[\s_]*(?:END)?[\s_]*>{2,}|<rewritten_response>|<rewritten_comment>"
    r"|<\|reserved_special_token|</rewritten_comment>|<{2,}\s*(?:END\s*)?COMMENT|<{3,}|<{2,}\s*PAGE\s*\d|-{3,}\s*ENDED?\s+COMMENT|<-+\s*End\s+of\s+Comment|<-+\s*COMMENT\s*\d|<new\s+version|</assistant|<resubmit|<NAME>|<DATE>)"
)
SELF_TALK = (
    r"(?im)^(?:(?:Please )?[Rr]ewrite (?:the|this) (?:following |above )?comment|[Rr]ewrite the following|[Dd]rafting this comment from scratch|[Hh]ere is the next comment|[Tt]he (?:original|following) comment"
    r"|[Nn]ow,? (?:here is|I will|let me)|was rewritten to|[Tt]his rewritten comment|[Mm]y rewritten comment|[Ee]nd of (?:rewritten )?comment|the rewritten comment (?:as|for|is|meets|maintains)|[Ff]inal [Aa]nswer|[Ss]core:\s*\d"
    r"|becomes:?\s*$|[Tt]he best answer is|I made the following changes|I am trying to maintain|I (?:also )?(?:changed|kept|made|rewrote|used)|_optional_ provide|Your (?:rewritten )?comment (?:is|should)|rewritten_response:"
    r"|.{0,40}(?:the|to the) original comment|.{0,20}rewritten (?:comment|version|response) (?:is|also|maintains|meets|will|that)|<end of rewritten|is too long and exceeds|is not accurate to the|was removed (?:by|and)|seems to be a? ?corrupted"
    r"|appears to be an? (?:image|scan)|[Ll]et's start fresh|is removed,? and (?:the|this)|was altered to:?|this is the rewritten|New [Cc]omment:?|(?:Here is|Here's) (?:the|a) (?:different|new|revised|alternative) (?:version|comment)"
    r"|[Mm]y revised comment|[Rr]evised comment:?|Invoice:|I have rewritten the comment)"
)
REMARK = (
    r"(?im)^(?:(?:\()?Note:?\s|Note that\s|Please (?:ensure|let me know|go ahead|note|provide)|I hope this|I would (?:be happy|like to)|I'd be happy|I'm (?:happy to|glad)|Your rewritten comment|Here is (?:the|a) (?:rewritten|new|revised|alternative)"
    r"|Here's (?:the|a) (?:rewritten|new|revised)|Let me know|This is the complete response|Therefore,? the response remains|Now,? let's try another|Let's try another|If you (?:have any|need|would like)|You're welcome"
    r"|Thank you for (?:the opportunity|your)|I look forward|I'll be in touch|I will (?:provide|talk|make sure)|Submission of this comment does not)"
)
SIGNATURE = r"(?i)\[Your (?:Name|Address|City|State|Zip|Email|Phone)[^\]]*\]|\[(?:NAME|CONTACT INFORMATION|SIGNATURE|ADDRESS|EMAIL|PHONE|Attachment:[^\]]*|Cook Group Representative|Removed[^\]]*)\]"
FAKE_ADDRESS = r"\bAnytown,?\s+[A-Z]{2,3}\s+\d{5}\b"
TRAILING = (
    r"\s*</?\w+>\s*$",
    r"(?i)\n\s*(?:[\d\s]+(?:false|true)[\d\s]*)+\s*$",
    r"(?i)\n\s*(?:false|true)\s*(?:\n\s*\d+\s*)*$",
    r"(?i)\s+(?:PAGE\s*\d+|\d{1,2}|false\s*end\.?|end\.?)$",
    r"\n\s*[×•·]+\s*$",
)
#: Of the shorter variant, which is for rules and notices.
VARIANT = (
    r"(?i)</?(?:rule|notice|proposed_rule|comment|rewritten_notice|rewritten_rule|rewritten_proposed_rule|rewritten|page|date|effective-date|title|doc|section|preamble|summary|action|agency|heading)\b[^>]*>",
    r"(?i)<<(?:COMMENT|PAGE)\s*\d*>>",
    r"(?m)^\s*\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?Z?\s*$",
    r"(?im)^\s*(?:true|false)\s*$",
    r"(?i)\[(?:your|insert|add|doc|name|address|date|title|agency|department|organization|city|state|zip|email|phone|signature)[^\]]{0,60}\]",
)
PREAMBLES = (
    r"(?i)^\s*(?:here\s+is|here's)\s+(?:the\s+)?(?:a\s+)?(?:rewritten|rephrased|revised|new)\s+.*?[:\n]",
    r"(?i)^\s*(?:the\s+)?(?:rewritten|rephrased|revised)\s+(?:version|text|rule|notice|document)\s*.*?[:\n]",
    r"(?i)^\s*becomes\s*:\s*",
    r"(?i)^\s*(?:sure|okay|ok)[,!.]?\s*(?:here|i(?:'ll| will))\s+.*?[:\n]",
)
POSTAMBLES = (
    r"(?i)(?:i\s+hope|let\s+me\s+know|please\s+(?:let|note)|don't\s+hesitate|feel\s+free)\s+.*$",
    r"(?i)(?:note\s*:\s*(?:i|the|this)\s+).*$",
    r"(?i)(?:best|warm|kind)?\s*regards[,.]?\s*$",
)
STRIP = r"^\s+|\s+$"
SHORTEST, SHORTEST_VARIANT, TAIL = 20, 50, 500


def rewrite_steps() -> list[str]:
    """The patterns in the order in which what they match goes; a cut takes the rest of the text with it."""
    rest = r"[\s\S]*"
    steps = [STRIP, OPENING_TAG, CLOSING_TAG, r'^[>"]+', STRIP, PREFIX, LEADING_JUNK, STRAY_START, STRIP, LEADING_URL, STRIP]
    steps += [NEXT_COMMENT + rest, SELF_TALK + rest, REMARK + rest, SIGNATURE, FAKE_ADDRESS, STRIP]
    return steps + [p for t in TRAILING for p in (t, STRIP)]


def bounded(text: Column, most: Column) -> Column:
    """A text of more than ``most`` characters is cut: at the last paragraph beyond half of it, else at the last sentence
    beyond three tenths, else there."""

    def cut(head: Column) -> Column:
        at = lambda mark: F.length(head) - F.locate(mark[::-1], F.reverse(head)) - 1
        has = lambda mark, share: head.contains(mark) & (at(mark) > most * share)
        whole = F.when(has("\n\n", 0.5), F.substring(head, F.lit(1), at("\n\n"))).when(has(". ", 0.3), F.substring(head, F.lit(1), at(". ") + 1)).otherwise(head)
        return F.regexp_replace(whole, STRIP, "")

    return F.when(F.length(text) > most, let(F.substring(text, F.lit(1), most), cut)).otherwise(text)


def clean_rewrite(text: Column, original_length: Column | None = None, max_ratio: float = 3.0) -> Column:
    """A rewrite without the model's wrappers, talk and placeholders, and no longer than ``max_ratio`` originals; empty
    where fewer than ``SHORTEST`` characters remain."""
    out = F.coalesce(text, F.lit(""))
    for pattern in rewrite_steps():
        out = F.regexp_replace(out, pattern, "")
    if original_length is not None:
        out = F.when(original_length > 0, bounded(out, F.floor(original_length * max_ratio).cast("int"))).otherwise(out)
    return let(out, lambda t: F.when(F.length(t) >= SHORTEST, t).otherwise(""))


def clean_corpus(frame: DataFrame, text_col: str, original_col: str | None = None, max_ratio: float = 3.0) -> DataFrame:
    """The rows whose cleaned text is worth keeping, with that text."""
    length = None if original_col is None else F.length(original_col)
    return frame.withColumn(text_col, clean_rewrite(F.col(text_col), length, max_ratio)).where(F.length(text_col) >= SHORTEST)


def clean_notice(text: Column) -> Column:
    """The shorter variant: tags, markers, echoed dates, preambles, what is said at the end, bold marks, empty lines."""
    out = F.regexp_replace(text, STRIP, "")
    for pattern in VARIANT:
        out = F.regexp_replace(out, pattern, "")
    for pattern in PREAMBLES:
        out = F.regexp_replace(out, pattern, "")

    def split(t: Column) -> Column:
        body = F.when(F.length(t) > TAIL, F.substring(t, F.lit(1), F.length(t) - TAIL)).otherwise("")
        tail = F.when(F.length(t) > TAIL, F.substring(t, F.length(t) - TAIL + 1, F.lit(TAIL))).otherwise(t)
        for pattern in POSTAMBLES:
            tail = F.regexp_replace(tail, pattern, "")
        return F.concat(body, tail)

    out = F.regexp_replace(let(out, split), r"\*\*([^*]+)\*\*", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), STRIP, "")
