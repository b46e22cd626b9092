"""Terms, tokens, cues and other column functions of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOPWORDS = tuple(
    """
    a an the this that these those it its
    is are was were be been being am
    do does did done doing have has had having
    of in on at by to for from with without into onto over under
    and or but nor so yet if then than as
    what which who whom whose when where why how
    i you he she they we me him her them us
    my your his their our not no yes
    during about after before between while
    """.split()
)
#: Token patterns of the binder, the dense encoder and BM25.
TERM, ENCODER_TOKEN, LEXICAL_TOKEN = r"[a-z0-9][a-z0-9'\-]*", r"[a-z0-9']+", r"[a-z0-9]+"
#: Cues of adjacency and of generalisation.
CUE_AFTER = r"(?i)\b(?:right|just|immediately|straight)\s+(?:after|following)\b|\bwhat\s+(?:came|happened)\s+next\b"
CUE_BEFORE = r"(?i)\b(?:right|just|immediately|straight)\s+before\b|\bwhat\s+(?:came|happened)\s+(?:just\s+)?before\b"
CUE_GENERIC = r"(?i)\b(?:usually|typically|generally|normally|habitually|most often|most of the time|tend(?:s)? to|in general|on average|for the most part|mostly)\b"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def content_terms(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Terms in order, repeats kept, without stopwords and single characters but digits."""
    return F.filter(_all(text, TERM), lambda w: ~w.isin(*stopwords) & ((F.length(w) > 1) | w.rlike("^[0-9]$")))


def lexical_tokens(text: Column) -> Column:
    return _all(text, LEXICAL_TOKEN)


def encoder_tokens(text: Column) -> Column:
    return _all(text, ENCODER_TOKEN)


def official_tokens(text: Column) -> Column:
    """Case-sensitive split at each space; empty tokens stay."""
    return F.split(text, " ", -1)


def direction(text: Column) -> Column:
    """1 for a question about what came right after, -1 for right before, else 0; after is looked for first."""
    return F.when(text.rlike(CUE_AFTER), 1).when(text.rlike(CUE_BEFORE), -1).otherwise(0)


def is_generic(text: Column) -> Column:
    return text.rlike(CUE_GENERIC)


def label(text: Column) -> Column:
    """The first six words, with dots if there are more."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(words, 1, 6), " "), F.when(F.size(words) > 6, "...").otherwise(""))


def split_of(key: Column) -> Column:
    """dev for a fifth of the keys, by SHA-1 modulo 5 (16 is 1 modulo 5, so digits add up), else test."""
    digits = F.split(F.sha1(key.cast("string")), "")
    total = F.aggregate(F.transform(digits, lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1), F.lit(0), lambda t, x: t + x)
    return F.when(total % 5 == 0, "dev").otherwise("test")


def content_key(text: Column) -> Column:
    return F.md5(text)


def stripped(turn_id: Column) -> Column:
    """The id without its last part."""
    return F.regexp_replace(turn_id, "_[^_]*$", "")


def hit(text: Column, needle: Column) -> Column:
    """Does the needle stand in the text as whole words, in either case?  An empty needle does not."""
    quoted = F.concat(F.lit(r"(?i)\b\Q"), needle, F.lit(r"\E\b"))
    return (needle != "") & F.call_function("rlike", text, quoted)


def parse_time(text: Column) -> Column:
    """Epoch seconds of either date format; 0 for anything else."""
    plain = F.regexp_replace(text, r"\s*\([A-Za-z]+\)", "")
    stamp = F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(text, F.lit("h:mm a 'on' d MMMM, yyyy")))
    return F.coalesce(stamp.cast("double"), F.lit(0.0))
