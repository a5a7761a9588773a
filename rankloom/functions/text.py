"""Text functions as Column expressions: tokenisers, phrases, containment, name and phone normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SLUGS


def tokens(text: Column, letters: str = "a-z0-9_", least: int = 3) -> Column:
    """Lower-cased runs of the given ASCII characters, of at least ``least``; null text gives none.

    This equals putting a blank for every other character, splitting at white space and
    leaving out short words, in one pass of one regular expression.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))


def hyphen_tokens(text: Column) -> Column:
    return tokens(text, "a-z0-9-", 2)


def plain_tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    found = tokens(text, "a-z0-9", 2)
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def phrases(query: Column, longest: int = 3) -> Column:
    """Runs of 2 to ``longest`` of the query's white-space words longer than two characters, punctuation kept."""
    words = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: F.length(w) > 2)

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*[runs(n) for n in range(2, longest + 1)])


def count_contained(terms: Column, text: Column) -> Column:
    """How many of the terms occur in the text."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def contains_either_way(a: Column, b: Column) -> Column:
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.contains(a, b) | F.contains(b, a)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def normalise_name(name: Column) -> Column:
    """Without a leading title, lower-cased, single spaces."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"^(dr|mr|mrs|ms|miss|prof|professor)\.?\s+", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def strip_titles(name: Column) -> Column:
    """Without titles wherever they stand."""
    bare = F.regexp_replace(F.lower(name), r"\b(dr|mr|mrs|ms|miss|prof|professor)\b\.?", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def normalise_phone(phone: Column) -> Column:
    digits = F.regexp_replace(phone, r"[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit("+"), digits))


def strip_quotes(text: Column, deepest: int = 20) -> Column:
    """Without the pairs of straight or curly quotes around it, however nested (up to ``deepest``)."""
    pair = r"(?s)^(?:\"(.*)\"|'(.*)'|“(.*)”|‘(.*)’)$"
    return F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), F.trim(text), lambda acc, i: F.trim(F.regexp_replace(acc, pair, "$1$2$3$4")))


def strip_fences(text: Column) -> Column:
    """A JSON text without the Markdown fence around it."""
    return F.trim(F.regexp_replace(text, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


def specialty_slug(name: Column) -> Column:
    """A specialty's short name, else its name with hyphens, ten characters at most."""
    low = F.lower(F.coalesce(name, F.lit("")))
    made = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"\s*&\s*", "-and-"), r"\s+", "-"), r"[^a-z0-9-]", ""), 1, 10)
    for full, short in SLUGS.items():
        made = F.when(low == full, F.lit(short)).otherwise(made)
    return made


def iso_day(stamp: Column) -> Column:
    """The UTC day of an ISO time stamp; null for other forms."""
    return F.to_date(F.substring(F.date_format(F.try_to_timestamp(stamp), "yyyy-MM-dd"), 1, 10))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def normalise_specialty(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "))


def whole_number_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def chat_day(stamp: Column) -> Column:
    """The day of ``M/D/YY, H:MM:SS``; null for other forms."""
    part = lambda i: F.regexp_extract(stamp, r"^(\d{1,2})/(\d{1,2})/(\d{2}),", i)
    day = F.make_date(F.try_to_number(part(3), F.lit("99")).cast("int") + 2000, F.try_to_number(part(1), F.lit("99")).cast("int"), F.try_to_number(part(2), F.lit("99")).cast("int"))
    return F.when(part(1) != "", day)
