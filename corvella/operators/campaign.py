"""Rule cascade that tells single comments, campaigns and parts of other submissions apart.

Every signal is a column expression, so a cascade over a table is one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.functions.text import let

# Patterns and thresholds that the classes hang on.
BLANK = r"[ \t\n\x0B\f\r]"
ALPHA_WORD = "[a-zA-Z]{3,}"
SEE_ATTACHED = r"(?i)(?:see|please\s+see)\s+(?:the\s+|our\s+)?(?:attached|attachments?|uploaded)|attached\s+please\s+find|please\s+find\s+attached"
SKIPPED_LINES = (
    r"(?i)^\s*(?:false|true|\d+)?\s*$"
    r"|^\s*see\s+(?:attached|attachments?|attachment)\s*(?:file)?(?:\(s\))?\s*\.?\s*$"
    r"|^\s*please\s+see\s+(?:attached|attachments?|attachment|our\s+uploaded)\s*(?:file)?(?:\(s\))?\s*\.?\s*$"
    r"|^\s*attached\s+please\s+find.*$"
)
PHRASES = {
    "on behalf of": r"on behalf of",
    "submitting N comments": r"submitting\s+[\d,]+\s+comments",
    "N individual comments": r"[\d,]+\s+individual\s+(public\s+)?comments",
    "split across N attachments": r"split across\s+\d+\s+attachments?",
    "split across N PDFs": r"split across\s+\d+\s+pdf",
    "separated into N separate": r"separated into\s+\d+\s+separate",
    "demonstrating opposition": r"demonstrating opposition",
    "confirm receipt of all": r"please confirm.+received all",
    "majority read as follows": r"the majority read as follows",
    "individual comments may differ": r"individual comments may differ",
    "sample attached/letter": r"sample\s+(attached|letter)",
}
COUNTS = (
    r"submitting\s+([\d,]+)\s+comments",
    r"([\d,]+)\s+individual\s+(?:public\s+)?comments",
    r"([\d,]+)\s+comments\s+demonstrating",
    r"attached.+?([\d,]+)\s+comments",
    r"find\s+([\d,]+)\s+individual",
)
REFERENCES = {
    "submission N of M": r"(?:submission|upload)\s+\d+\s+(?:of|through)\s+\d+",
    "uploaded in other submissions": r"(?:uploaded|submitted|upload)\s+(?:in|via|as)\s+submission",
    "remaining materials in other uploads": r"remaining\s+(?:exhibits?|attachments?|files?|documents?)\s+(?:will\s+be\s+)?(?:uploaded|submitted)",
    "comment body in separate submission": r"comments?\s+(?:themselves?\s+)?(?:will\s+be\s+)?(?:uploaded|submitted)\s+in\s+submission",
    "exhibit batch reference": r"(?:please\s+)?find\s+exhibits?\s+\S+\s+through\s+\S+",
    "supporting materials for separate comment": r"(?:references?\s+cited\s+in|attachments?\s+to)\s+(?:the\s+)?(?:\w+\s+)?(?:comments?|submission)",
}
PARENTS = (
    r"(?:primary|parent|main)\s+submission\s+(?:id|number|#)\s+(?:associated\s+with\s+\S+\s+\S+\s+)?(?:is|:)\s*([a-zA-Z0-9_-]{6,})",
    r"submission\s+(?:id|number|#)\s*(?:is|:)\s*([a-zA-Z0-9_-]{6,})",
)
PART_LABELS = {"part N of N in submission text": r"\bpart\s+\d+\s+of\s+\d+\b", "[Part N] label": r"\[part\s+\d+\]"}
SIGNATORY = (
    r"^(?:rev\.?|dr\.?|mr\.?|ms\.?|mrs\.?|bishop)\s+[A-Z][A-Za-z'.-]+(?:\s+[A-Z][A-Za-z'.-]+){0,3},\s*[A-Za-z .'-]+$"
    r"|^[A-Z][A-Za-z'.-]+(?:\s+[A-Z][A-Za-z'.-]+){1,4},\s*[A-Za-z .'-]+(?:,\s*[A-Za-z .'-]+)?$"
    r"|^[A-Z][A-Za-z'.-]+(?:\s+[A-Z][A-Za-z'.-]+){1,4}\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?$"
    r"|^[A-Z][A-Za-z0-9&.,'() -]{4,},\s*[A-Za-z .'-]+(?:,\s*[A-Za-z .'-]+)?$"
)
SIGNATORY_HEADER = r"first\s+name\s+last\s+name\s+city\s+state"
NOISE = r"[~=|><{}\[\]^`\\]|[^\x00-\x7F]"
SCREENSHOT = (r"change\.org", r"\blte\b", r"\b\d{1,2}:\d{2}\s*(?:am|pm)\b", r"share this petition", r"share\s+tweet\s+email", r"\bmail\b.*\blte\b")
MASS_TITLES = r"mass comment campaign|write[\s-]*in campaign|mass mailing|mass comment"
WEAK_TITLES = r"multiple letters|form letter"
ADDRESS_LINE, CITY_LINE = r"^\d+\s+\w+", r"^[A-Z][a-z]+,\s*[A-Z]{2}\s+\d{5}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def alpha_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(ALPHA_WORD), F.lit(0)))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def numbered_parts(raw: Column) -> Column:
    """(number, text) of every <<PART n>>, or <<COMMENT n>> where there is no part, by number; the last of a number counts."""

    def cut(marker: str) -> Column:
        numbers = F.transform(F.regexp_extract_all(raw, F.lit(rf"<<{marker}\s+(\d+)>>"), F.lit(1)), lambda n: n.cast("long"))
        texts = F.split(raw, rf"<<{marker}\s+\d+>>")
        all_of = F.transform(numbers, lambda n, i: F.struct(n.alias("n"), texts[i + 1].alias("t")))
        return let(all_of, lambda found: F.array_sort(F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y["n"] == x["n"]))))

    return F.when(raw.contains("<<PART"), cut("PART")).otherwise(cut("COMMENT"))


def pages_of(part: Column) -> Column:
    return F.filter(F.transform(F.split(part, r"<<PAGE\s+\d+>>"), strip), lambda p: p != "")


def labelled(text: Column, patterns: dict[str, str]) -> Column:
    """The labels of the patterns that a text holds."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in patterns.items())), lambda x: x.isNotNull())


def explicit_count(text: Column) -> Column:
    """The first count of comments that a letter names."""
    low = F.lower(text)
    return F.coalesce(*(F.replace(F.regexp_extract(low, p, 1), F.lit(","), F.lit("")).try_cast("long") for p in COUNTS))


def normalized_page(page: Column) -> Column:
    """A page without short lines and addresses, in lower case."""
    lines = F.transform(F.split(page, "\n"), strip)
    kept = F.filter(lines, lambda x: (F.length(x) >= 40) & ~(x.rlike(ADDRESS_LINE) & (F.length(x) < 60)) & ~x.rlike(CITY_LINE))
    return F.lower(F.array_join(kept, " "))


def page_repetition(pages: Column) -> Column:
    """Share of later pages whose words are the first page's (Jaccard above 0.7); null below three pages of 25 words."""
    sets = F.transform(F.filter(F.transform(pages, normalized_page), lambda p: alpha_words(p) >= 25), lambda p: F.array_distinct(tokens(p)))

    def share(found: Column) -> Column:
        like = lambda p: F.size(F.array_intersect(found[0], p)) / F.size(F.array_union(found[0], p)) > 0.7
        later = F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))
        return F.when(F.size(found) >= 3, F.size(F.filter(later, like)) / (F.size(found) - 1))

    return let(sets, share)


def is_signatory_page(page: Column) -> Column:
    def judged(lines: Column) -> Column:
        signed = F.size(F.filter(lines, lambda x: F.length(x).between(6, 90) & x.rlike(SIGNATORY)))
        return F.lower(F.array_join(lines, " ")).rlike(SIGNATORY_HEADER) | (signed >= 8) | ((F.size(lines) >= 12) & (signed / F.size(lines) >= 0.45))

    return let(F.filter(F.transform(F.split(page, "\n"), strip), lambda x: x != ""), lambda lines: (F.size(lines) > 0) & judged(lines))


def is_ocr_garbage(part: Column) -> Column:
    noise = (F.length(part) - F.length(F.regexp_replace(part, NOISE, ""))) / F.length(part)
    letters = F.length(F.regexp_replace(part, r"[^\p{L}]", ""))

    def by_words(w: Column) -> Column:
        some = F.greatest(F.size(w), F.lit(1))
        mean = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / some
        short = F.size(F.filter(w, lambda x: F.length(x) <= 2)) / some
        return ((noise > 0.1) & (short > 0.4)) | ((mean < 2.5) & (F.size(w) > 5))

    return (F.length(part) >= 20) & ((letters == 0) | (noise > 0.15) | let(tokens(part), by_words))


def is_screenshot(part: Column) -> Column:
    low = F.lower(part)
    return sum((low.rlike(p).cast("int") for p in SCREENSHOT[1:]), low.rlike(SCREENSHOT[0]).cast("int")) >= 2


def classify(comments: DataFrame, *, text_col: str, title_col: str) -> DataFrame:
    """All columns and: classification, campaign_count, phrases, indicators, parent_id, repetition, n_parts, n_pages,
    single, campaign, hints (the sums of signals), screenshot.

    A null text has no parts; a null title gives no signal. Only comments that refer to no other submission are read for
    campaign language.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    one = comments.withColumn("__numbered", numbered_parts(raw))
    first = F.filter("__numbered", lambda x: x["n"] == 1)
    others = F.filter("__numbered", lambda x: x["n"] != 1)
    two = one.select(
        *comments.columns,
        F.size("__numbered").alias("n_parts"),
        strip(F.when(F.size(first) > 0, first[0]["t"]).otherwise("")).alias("__part1"),
        F.transform(others, lambda x: strip(x["t"])).alias("__parts"),
        F.flatten(F.transform(others, lambda x: pages_of(x["t"]))).alias("__pages"),
    )
    lines = F.filter(F.transform(F.split("__part1", "\n"), strip), lambda x: x != "")
    body = strip(F.array_join(F.filter(F.split("__part1", "\n"), lambda x: ~x.rlike(SKIPPED_LINES)), "\n"))
    three = two.withColumns({"__meta": F.when((F.size(lines) >= 2) & F.get(lines, F.lit(1)).rlike(r"^[+-]?\d+$"), F.get(lines, F.lit(1)).try_cast("long")), "__body": body})
    cover, has_parts = F.coalesce(F.get("__parts", F.lit(0)), F.lit("")), F.size("__parts") > 0
    scanned = F.lower(F.when(cover != "", F.concat("__body", F.lit("\n"), F.substring(cover, 1, 2000))).otherwise(F.col("__body")))
    parent = F.coalesce(*(F.nullif(F.regexp_extract(scanned, p, 1), F.lit("")) for p in PARENTS))
    indicators = F.concat(labelled(scanned, REFERENCES), F.when(parent.isNotNull(), F.array(F.lit("references parent submission ID"))).otherwise(F.array().cast("array<string>")), labelled(F.lower("__body"), PART_LABELS))
    title = F.lower(strip(F.coalesce(F.col(title_col), F.lit(""))))
    four = three.withColumns(
        {
            "n_pages": F.size("__pages"),
            "indicators": indicators,
            "parent_id": parent,
            "repetition": F.when(F.size("__pages") >= 3, page_repetition(F.col("__pages"))),
            "screenshot": F.exists("__parts", is_screenshot),
            "__words": F.size(tokens(F.col("__body"))),
            "__alpha": alpha_words(F.col("__body")) + F.aggregate(F.transform("__pages", alpha_words), F.lit(0), lambda a, n: a + n),
            "__meaningful": F.exists("__parts", lambda p: alpha_words(p) > 10),
            "__phrases": labelled(F.lower(F.substring(cover, 1, 3000)), PHRASES),
            "__count": explicit_count(F.substring(cover, 1, 3000)),
            "__signed": F.size(F.filter("__pages", is_signatory_page)),
            "__prose": F.size(F.filter("__pages", lambda p: ~is_signatory_page(p) & (alpha_words(p) >= 80))),
            "__docusign": F.size(F.filter("__pages", lambda p: F.lower(p).contains("docusign envelope id") & (alpha_words(p) <= 20))),
            "__garbage": F.exists("__parts", is_ocr_garbage),
        }
    )
    n = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    refers = F.size("indicators") > 0
    read = has_parts & ~refers
    meta = F.coalesce(F.col("__meta") > 10, F.lit(False))
    strong = (F.size("__phrases") >= 2) | (F.size(F.array_remove("__phrases", "on behalf of")) > 0)
    counted = F.col("__count").isNotNull()
    cover_signals = 3 * n(read & strong) + 3 * n(read & counted)
    alike, apart = F.coalesce(F.col("repetition") > 0.6, F.lit(False)), F.coalesce(F.col("repetition") < 0.1, F.lit(False))
    appendix = alike & (F.col("__words") >= 80) & (cover_signals == 0)
    campaign = cover_signals + 2 * n(alike & ~appendix)
    low, mass = (F.col("__alpha") < 120) & (F.col("n_pages") <= 2), title.rlike(MASS_TITLES)
    attached = F.col("__part1").rlike(SEE_ATTACHED) & has_parts & (campaign == 0) & ~refers & F.col("__meaningful") & ~(alike & (F.col("__words") < 80))
    single = (
        2 * n(F.col("__words") > 20)
        + 2 * n((F.col("__words") > 20) & ~F.col("__meaningful"))
        + n(F.col("n_pages") <= 2)
        + n(appendix)
        + n(apart)
        + 2 * n((F.col("n_pages") >= 2) & (F.col("__docusign") / F.col("n_pages") >= 0.75))
        + 2 * n((F.col("__signed") >= 1) & (F.col("__prose") >= 1) & (campaign == 0))
        + n(F.col("__garbage"))
        + 2 * n(attached)
    )
    with_title = campaign + 3 * n(mass & low)
    hints = n(meta) + n(read & ~strong & (F.size("__phrases") > 0)) + n(read & counted & meta) + n(mass & ~low) + n(title.rlike(WEAK_TITLES))
    five = four.withColumns({"single": single, "hints": hints, "campaign": with_title + n((with_title > 0) & (hints > 0)), "phrases": F.when(read, F.col("__phrases")).otherwise(F.array().cast("array<string>")), "campaign_count": F.coalesce(F.when(read, F.col("__count")), F.when(meta, F.col("__meta")))})
    kind = (
        F.when(refers, "references_other_submission")
        .when(F.col("campaign") >= 3, "definitely_campaign")
        .when((F.col("campaign") >= 2) & (F.col("hints") >= 2) & (F.col("single") == 0), "definitely_campaign")
        .when((F.col("single") >= 2) & (F.col("campaign") <= 1), "definitely_single")
        .otherwise("uncertain")
    )
    added = ["campaign_count", "phrases", "indicators", "parent_id", "repetition", "n_parts", "n_pages", "single", "campaign", "hints", "screenshot"]
    return five.select(*comments.columns, kind.alias("classification"), *added)
