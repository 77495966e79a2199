"""Text functions as column expressions; Java's regular expressions with Unicode classes where white space matters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squish(x: Column) -> Column:
    """White space, no-break spaces too, as single spaces, and none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def printable(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[^\p{Print}]", " ")


def sentence_case(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))


def decimal_places(x: Column) -> Column:
    """Characters after the first point; 0 without one."""
    return F.coalesce(F.length(F.get(F.split(x, r"\."), F.lit(1))), F.lit(0))


def keep_allowed(x: Column) -> Column:
    """Only lower-case letters, digits and the marks that statistics are made of."""
    return F.regexp_replace(x, r"[^a-z0-9| .·%–\-±/:=!]", "")


def space_brackets(x: Column) -> Column:
    return F.regexp_replace(x, r"[(),]", " (")


def add_percent(x: Column) -> Column:
    """'12 (34.5)' as '12 (34.5%)'; one bounded look-behind."""
    return F.regexp_replace(x, r"(?<=[0-9]\s\([0-9]{1,3}(?:.[0-9]{1,2})?)\)", "%)")


MEDIAN_FORM = r"[0-9]\s?\([0-9]{1,2}\.?[0-9]?\s?(to|\p{Pd}|,)\s?[0-9]{1,2}\.?[0-9]{0,5}\)"


def flag_median(x: Column) -> Column:
    """Brackets of 'a (b-c)' as a mark of three exclamation points."""
    return F.when(x.rlike(MEDIAN_FORM), F.regexp_replace(x, r"\(", " !!! ")).otherwise(x)


def sample_size_in(x: Column) -> Column:
    """The last 'n = number' of a column heading."""
    clean = squish(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9|= ]", " "))
    found = F.regexp_extract_all(clean, F.lit(r"n\s?=?\s?([0-9]{1,7})"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).try_cast("double"))


#: Repairs of numbers in running text, in order.
REPAIRS = [
    (r"<break/>", ""),
    (r"(?<=\(\d{1,5}),(?=\d+\))", " "),
    (r"(?<=\(\d{1,5})-(?=\d+\))", " "),
    (r",(?=\d{3,})", ""),
    (r"(?U)(?<=\d)\W(?=000)", ""),
    ("·", "."),
    ("−", "-"),
    ("N/A|n/a", " "),
    (' toggle="yes"', ""),
    (r"</?(?:italic|bold|sup|sub)>", ""),
]
HYPHEN_GAP = (r"(?U)-\W(?=\d)", " ")


def repair_numbers(x: Column) -> Column:
    """Thousands separators, points, minus signs and 'not available' made plain; then dates as day numbers; then hyphen gaps."""
    x = reduce(lambda c, r: F.regexp_replace(c, *r), REPAIRS, x)
    return F.regexp_replace(dates_to_numbers(x), *HYPHEN_GAP)


def parse_date(x: Column) -> Column:
    """A date in numbers, month first if that is possible, else day first; else year first. Two-digit years are from 1969 to 2068."""
    formats = ["M/d/yyyy", "d/M/yyyy", "yyyy/M/d"]
    plain = F.regexp_replace(F.trim(x), "-", "/")
    plain = F.regexp_replace(plain, r"/(0[0-9]|[1-5][0-9]|6[0-8])$", "/20$1")
    plain = F.regexp_replace(plain, r"/(69|[7-9][0-9])$", "/19$1")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)).cast("date") for f in formats])


def dates_to_numbers(x: Column) -> Column:
    """Dates that stand alone, d/m/y or m/d/y, as days since 1970; texts are cut at dates and joined again."""
    day, month, year = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:[0-9]{4}|[0-9]{2})"
    form = rf"(?<=\s)(?:{day}/{month}/{year}|{day}-{month}-{year})(?=\s)"
    found = F.regexp_extract_all(x, F.lit(f"({form})"), F.lit(1))
    parts = F.split(x, form)
    number = F.transform(found, lambda d: F.coalesce(F.unix_date(parse_date(d)).cast("string"), d))
    joined = F.array_join(F.zip_with(parts, F.concat(number, F.array(F.lit(""))), lambda p, n: F.concat(p, n)), "")
    return F.when(F.size(found) > 0, joined).otherwise(x)


def publication_date(year: Column, month: Column, day: Column) -> Column:
    """A date with June and the 15th where month and day are missing; null if there is no such day."""
    text = F.format_string("%04d-%02d-%02d", year, F.coalesce(month, F.lit(6)), F.coalesce(day, F.lit(15)))
    return F.when(year.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


_NAMES = {
    "Brazil": ["Brasil"],
    "Netherlands": ["The Netherlands", "the Netherlands"],
    "USA": ["California", "New York", "U.S", "U.S.", "U.S.A.", "United States"],
    "UK": ["England", "Northern Ireland", "Scotland", "United Kingdom", "Wales"],
    "South Korea": ["Korea", "Korea (Republic of)"],
}


def country_name(affiliation: Column) -> Column:
    """What follows the last comma, in one spelling."""
    last = squish(F.regexp_replace(affiliation, r"\s*.*,", ""))
    out = F.when(last.contains("China"), "China")
    for name, others in _NAMES.items():
        out = out.when(last.isin(others), name)
    return out.otherwise(last)


def roman(n: int) -> str:
    out = ""
    for value, letters in ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + letters, n - value
    return out


#: Names that a look-up may have; it becomes one pattern in the plan.
LOOKUP_ROWS = 20_000


def _vocabulary(lookup: DataFrame, word: str, result: str | None = None) -> dict[str, str]:
    """A look-up as a dictionary; of a word that is there twice the least result."""
    rows = lookup.select(F.col(word).alias("w"), (F.col(result) if result else F.lit("")).alias("r")).filter("w IS NOT NULL").groupBy("w").agg(F.min("r").alias("r")).limit(LOOKUP_ROWS + 1).collect()
    if len(rows) > LOOKUP_ROWS:
        raise ValueError(f"a look-up of more than {LOOKUP_ROWS} names should be joined")
    return {r.w: r.r for r in rows}


def _first_of(x: Column, words: dict[str, str], whole: bool = False) -> Column:
    """The result of the leftmost word in a text, of several there the longest; null without one."""
    if not words:
        return F.lit(None).cast("string")
    some = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    found = F.nullif(F.regexp_extract(x, rf"\b({some})\b" if whole else f"({some})", 1), F.lit(""))
    return F.create_map(*[F.lit(v) for kv in sorted(words.items()) for v in kv])[found]


def find_country(papers: DataFrame, key: str, text: str, countries: DataFrame, tlds: DataFrame, states: DataFrame, capitals: DataFrame, tag: str | None = None) -> DataFrame:
    """(key, country) of affiliations: by tag, else by the first country named, the e-mail's domain, a state of the USA, or a capital.

    Look-ups are lists of names of bounded length, which become patterns:
    countries(country), tlds(tld, country), states(state), capitals(city,
    country). The leftmost match wins, and of several there the longest; states
    and capitals are whole words.
    """
    t = F.col(text)
    country, state = _vocabulary(countries, "country"), _vocabulary(states, "state")
    domain = F.regexp_extract(F.lower(t), r"@[a-z0-9.\-]+\.([a-z]{2,6})", 1)
    tld = _vocabulary(tlds, "tld", "country")
    by_domain = F.create_map(*[F.lit(v) for kv in sorted(tld.items()) for v in kv])[domain] if tld else F.lit(None).cast("string")
    found = F.coalesce(
        F.col(tag) if tag else F.lit(None).cast("string"),
        _first_of(t, {c: c for c in country}),
        by_domain,
        _first_of(t, dict.fromkeys(state, "USA"), whole=True),
        _first_of(t, _vocabulary(capitals, "city", "country"), whole=True),
    )
    return papers.select(key, found.alias("country"))
