"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word is in both engines, whatever the alphabet.
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often and however deep within lambdas it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased words of a text; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def embedding_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and apostrophes of ASCII."""
    return words(text, "[a-z0-9']+")


def sentences(text: Column) -> Column:
    """Sentences: lines split after . ! or ? before white space, trimmed, empty ones left out."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda x: F.trim(x)), lambda s: F.length(s) > 0)


def sentence_words(text: Column, more_than: int = 10, pattern: str = WORD, at_least: int | None = None) -> Column:
    """Words of each sentence without those of digits alone; only sentences of ``more_than`` words, or of
    ``at_least`` where that is given."""
    least = more_than + 1 if at_least is None else at_least
    lists = F.transform(sentences(text), lambda s: F.filter(words(s, pattern), lambda w: ~w.rlike("^[0-9]+$")))
    return F.filter(lists, lambda ws: F.size(ws) >= least)


def shingles(tokens: Column, k: int = 5) -> Column:
    """The set of k-token runs; a shorter list gives its suffixes."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        whole = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))
        tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array_distinct(tails)).otherwise(F.array_distinct(whole))

    return let(tokens, runs)


def ngrams(tokens: Column, n: int) -> Column:
    """All n-token runs in order."""
    return let(
        tokens,
        lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))),
    )


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def parse_bool(text: Column, yes: tuple[str, ...] = ("true", "1", "yes", "y")) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*yes), F.lit(False))


def slug(text: Column, fallback: str = "unknown") -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(cleaned == "", F.lit(fallback)).otherwise(cleaned)


def prefix_key(name: Column) -> Column:
    """A file name without its document suffixes, in lower case."""
    return F.lower(F.regexp_replace(name, r"(?i)(\.(txt|html?|pdf))+$", ""))


def split_list(cell: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def first_year(text: Column) -> Column:
    """The first four digits that stand alone."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:^|[^0-9A-Za-z_])([0-9]{4})(?:[^0-9A-Za-z_]|$)", 1).try_cast("int")


def acronym(agency: Column) -> Column:
    """Six capitals at most where there are two; else the first four letters of one word, or the initials of five."""
    name = F.trim(F.coalesce(agency, F.lit("")))
    capitals = F.regexp_replace(name, "[^A-Z]", "")
    parts = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    initials = F.array_join(F.transform(F.slice(parts, 1, 5), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(F.length(capitals) >= 2, F.substring(capitals, 1, 6)).when(F.size(parts) == 1, F.upper(F.substring(parts[0], 1, 4))).otherwise(initials)


def topics(text: Column, kind: Column) -> Column:
    """The first six parts between ; : - and bullets, then the kind, each once."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;:•-]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.concat(F.slice(parts, 1, 6), F.when(kind.isNotNull() & (kind != ""), F.array(kind)).otherwise(F.array().cast("array<string>"))))


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts), F.lit("Q"), F.quarter(ts))


def half_label(ts: Column) -> Column:
    return F.concat(F.year(ts), F.when(F.month(ts) <= 6, "H1").otherwise("H2"))


def parse_posted(text: Column) -> Column:
    """A timestamp without its trailing Z; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", ""))


def sanitize_date(text: Column) -> Column:
    """The day of an ISO date or time; any other text as it is, an empty one null."""
    value = blank_to_null(text)
    iso = value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+([+-][0-9:]+|Z)?)?$")
    return F.when(iso, F.coalesce(F.substring(value, 1, 10).try_cast("date").cast("string"), value)).otherwise(value)


def before(text: Column, cutoff: str) -> Column:
    """Posted before the cutoff; unparsed dates are not."""
    return F.coalesce(parse_posted(text) < F.lit(cutoff).cast("timestamp"), F.lit(False))


def normalize_label(text: Column) -> Column:
    """yes or no at the start, else empty."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.regexp_extract(low, r"^(yes|no)(?:[^a-z0-9_]|$)", 1)


def pages(text: Column) -> Column:
    """(page, text) by the markers <<PAGE n>>; a text without markers is page 1."""
    body = F.coalesce(text, F.lit(""))
    numbers = F.regexp_extract_all(body, F.lit("<<PAGE ([0-9]+)>>"), F.lit(1))
    bodies = F.slice(F.split(body, "<<PAGE [0-9]+>>"), 2, F.greatest(F.size(numbers), F.lit(1)))
    marked = F.transform(F.arrays_zip(numbers.alias("n"), bodies.alias("b")), lambda z: F.struct(z["n"].cast("int").alias("page"), F.trim(z["b"]).alias("text")))
    return F.when(F.size(numbers) == 0, F.array(F.struct(F.lit(1).alias("page"), F.trim(body).alias("text")))).otherwise(marked)


def page_class(text: Column, min_chars: int = 25, worst: float = 0.4) -> Column:
    """blank, gibberish (control or replacement characters) or ok."""
    n = F.greatest(F.length(text), F.lit(1))
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}]", ""))
    broken = F.length(text) - F.length(F.regexp_replace(text, "�", ""))
    return F.when(F.length(F.trim(text)) < min_chars, "blank").when(F.greatest(odd, broken) / n >= worst, "gibberish").otherwise("ok")


def snippet(text: Column, needle: str, reach: int = 100) -> Column:
    """What stands around the first place of ``needle``, with dots where it is cut; null where it is not found."""
    at = F.locate(needle.lower(), F.lower(text))
    begin = F.greatest(at - reach, F.lit(1))
    end = F.least(at + len(needle) - 1 + reach, F.length(text))
    cut = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(text, begin, end - begin + 1), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut)


def canonical_text(parts: Column) -> Column:
    """Non-empty parts, each under its marker, joined by empty lines."""
    kept = F.filter(F.transform(parts, lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != "")
    return F.array_join(F.transform(kept, lambda p, i: F.concat(F.lit("<<COMMENT "), (i + 1).cast("string"), F.lit(">>\n"), p)), "\n\n")


#: What is deleted from comments before comparison, in this order; the sign-off takes the rest with it.
COMMENT_NOISE = (
    r"\f",
    r"(?i)<<(?:page|part|comment) [0-9]+>>",
    r"(?i)see attached(?: file(?:\(s\))?)?",
    r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
    r"(?i)https?://\S+|www\.\S+",
    r"(?i)\bdoi:\s*\S+",
    r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december) [0-9]{1,2}, [0-9]{4}\b",
    r"(?i)\bdocket (?:no\.?|number|id)[: ]*\S+",
    r"(?im)^re:.*$",
    r"(?im)^via .*$",
    r"(?im)^dear [^\n]*$",
    r"(?i)\b[0-9]+ (?:fr|cfr) [0-9.]+",
    r"(?is)\b(?:sincerely|respectfully submitted|best regards|yours truly)\b.*$",
)


def preprocess_comment(text: Column) -> Column:
    """Join broken words, delete the noise in order, collapse spaces, lower-case."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"-\n", "")
    for pattern in COMMENT_NOISE:
        out = F.regexp_replace(out, pattern, " ")
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token lists as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def text_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar; a null part is empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
