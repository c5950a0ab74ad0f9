"""Scalar functions on columns, all built-in expressions but for numeric character references."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of every kind, also for DuckDB's regular expressions.
SPACES = r"[\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]+"

# The named character references that titles hold; no others are decoded.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_REFERENCE = re.compile("&(?:(lt|gt|quot|apos|amp)|#([0-9]+)|#[xX]([0-9A-Fa-f]+));")


def _character(m: re.Match) -> str:
    """What a reference stands for; one that is no character stays as it is."""
    if m[1]:
        return ENTITIES[m[0]]
    code = int(m[2]) if m[2] else int(m[3], 16)
    return chr(code) if code < 0xD800 or 0xE000 <= code <= 0x10FFFF else m[0]


def unescape_title(text: Column) -> Column:
    """Decode the five named references and all decimal and hexadecimal ones, each once.

    ``&amp;`` comes last where only names occur; a text with a numeric
    reference, and no other, is read by a pattern in Python batches.
    """

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _REFERENCE.sub(_character, t), na_action="ignore")

    named = text
    for entity, char in ENTITIES.items():
        named = F.replace(named, F.lit(entity), F.lit(char))
    return F.when(text.contains("&#"), decode(text)).otherwise(named)


def normalize_title(title: Column) -> Column:
    """Decoded, white space collapsed, trimmed, lower case; '' for null and blank."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(unescape_title(title), SPACES, " "))), F.lit(""))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | text.rlike(rf"^({SPACES})?$")


def first_present(*cols: Column) -> Column:
    """The first value that is not null; '' and 0 are present."""
    return F.coalesce(*cols)


def tri_state(value: Column) -> Column:
    """Null stays null; true, 1 and '1' are true; everything else is false.

    The text "true" is false, so a string column is compared with '1' only.
    """
    return F.when(value.isNull(), F.lit(None).cast("boolean")).otherwise(value.cast("string") == "1")


def first_truthy(a: Column, b: Column) -> Column:
    """``a`` where it is true, else ``b`` whatever it is; neither OR nor coalesce."""
    return F.when(a, F.lit(True)).otherwise(b)


def decimal_comma(text: Column) -> Column:
    """Every comma a decimal point, then the number at the start; 0 for garbage, null for null."""
    head = F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"^\s*([+-]?\d+(\.\d+)?([eE][+-]?\d+)?)", 1)
    return F.when(text.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(head.try_cast("double"), F.lit(0.0)))


def leading_int(text: Column) -> Column:
    """The integer at the start; 0 for null and garbage."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def leading_number(value: Column) -> Column:
    """The number at the start of a text, or the number itself; 0 for null and garbage."""
    head = F.regexp_extract(value.cast("string"), r"^\s*([+-]?\d+(\.\d+)?([eE][+-]?\d+)?)", 1)
    return F.coalesce(head.try_cast("double"), F.lit(0.0))


def first_digits(text: Column) -> Column:
    """The first group of digits, or null."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))


def matched_or(text: Column, pattern: str, default: str) -> Column:
    """The first group of a pattern, upper case, or a default."""
    return F.coalesce(F.upper(F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))), F.lit(default))


def localized(key: Column, locale: Column, labels: Mapping[str, Mapping[str, str]], fallback: str, **values: Column) -> Column:
    """The label of a key in a locale, else in the fallback locale, else the key; ``%{name}`` takes a value.

    ``labels`` is a small literal table of locale to key to label.
    """
    pairs = [x for lang, words in labels.items() for k, v in words.items() for x in (F.lit(f"{lang}\t{k}"), F.lit(v))]
    table = F.create_map(*pairs)
    found = lambda lang: F.try_element_at(table, F.concat(lang, F.lit("\t"), key))
    text = F.coalesce(found(locale), found(F.lit(fallback)), key)
    for name, value in values.items():
        text = F.replace(text, F.lit("%{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def escape_html(text: Column) -> Column:
    """The five markup characters as references, ``&`` first."""
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def thousands(number: Column) -> Column:
    """A comma before every third character from the end, long fractions included."""
    backwards = F.regexp_replace(F.reverse(number.cast("string")), r"(\d{3})(?=\d)", "$1,")
    return F.reverse(backwards)


# Words that give no initial.
INITIAL_STOPS = ("of", "the", "and", "in", "for", "on", "a", "an", "to", "with")


def initials(title: Column) -> Column:
    """Up to six initials of the words that count; else the first two characters; '?' for blank."""
    words = F.filter(
        F.split(title, r"[\s\-/]+"),
        lambda w: w.rlike("^[A-Za-z]") & ~F.lower(w).isin(*INITIAL_STOPS),
    )
    short = F.array_join(F.slice(F.transform(words, lambda w: F.upper(F.left(w, F.lit(1)))), 1, 6), "")
    return F.when(is_blank(title), F.lit("?")).when(short != "", short).otherwise(F.upper(F.left(title, F.lit(2))))


def truncated(text: Column, most: int, mark: str = "…", mark_counts: bool = False) -> Column:
    """The text, or its start with a mark; the mark counts towards ``most`` if so told."""
    keep = most - len(mark) if mark_counts else most
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(keep)), F.lit(mark))).otherwise(text)


def bare_url(url: Column) -> Column:
    """A URL without its scheme and closing slash."""
    return F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"/$", "")


def absolute_url(url: Column, base: str) -> Column:
    """The URL itself if it is absolute, else with the base before it."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(base), url))


def fill_template(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace ``{{key}}`` in one pass, so that a value is never read as a template.

    Unknown keys and null values vanish. Two commas or two dashes in a row
    become one, and commas, dashes and white space go at the ends of each line;
    whatever else is left dangling stays.
    """
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))))
    pieces = F.regexp_extract_all(template, F.lit(r"(\{\{\w+\}\}|[^{]+|\{)"), F.lit(1))
    key = lambda x: F.substring(x, 3, F.length(x) - 4)
    filled = F.transform(
        pieces,
        lambda x: F.when(x.rlike(r"^\{\{\w+\}\}$"), F.coalesce(F.try_element_at(table, key(x)), F.lit(""))).otherwise(x),
    )
    text = F.array_join(filled, "")
    text = F.regexp_replace(F.regexp_replace(text, r",\s*,", ","), r"\s*-\s*-", " -")
    return F.regexp_replace(F.regexp_replace(text, r"(?dm)^[,\s-]+|[,\s-]+$", ""), r"^\s+|\s+$", "")


def split_setting(text: Column) -> Column:
    """A list setting split on commas and bars, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, r"[,|]"), lambda x: F.trim(x)), lambda x: x != "")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def axis_label(value: Column) -> Column:
    """Millions with one decimal, thousands from 10,000 whole and below with one; whole numbers plain; else one decimal.

    Letters stand for millions (M) and thousands (K); a half is rounded away
    from zero before a letter and to the even digit without one.
    """
    size, v = F.abs(value), value.cast("double")
    return (
        F.when(size >= 1_000_000, F.concat(F.format_string("%.1f", v / 1_000_000.0), F.lit("M")))
        .when(size >= 10_000, F.concat(F.format_string("%.0f", v / 1_000.0), F.lit("K")))
        .when(size >= 1_000, F.concat(F.format_string("%.1f", v / 1_000.0), F.lit("K")))
        .when(value == F.floor(value), F.floor(value).cast("string"))
        .otherwise(F.format_string("%.1f", F.when(v * 4 == F.floor(v * 4), F.bround(v, 1)).otherwise(v)))
    )


def eta_text(seconds: Column) -> Column:
    """A duration in its two largest units: 45s, 1m, 2m5s, 1h2m; '' for none."""
    s = seconds.cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint")
    rest = s % 60
    return (
        F.when(s.isNull() | (s <= 0), F.lit(""))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(m.cast("string"), F.lit("m"), F.when(rest > 0, F.concat(rest.cast("string"), F.lit("s"))).otherwise("")))
        .otherwise(F.concat(h.cast("string"), F.lit("h"), F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))).otherwise("")))
    )


def iso8601(ts: Column) -> Column:
    """A UTC timestamp without zone as ISO-8601 text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clean_tag(text: Column) -> Column:
    """Trimmed, lower case, spaces as hyphens; null for blank. Our definition of the host's cleaner."""
    tag = F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-")
    return F.nullif(tag, F.lit(""))


def contains_first(text: Column, names: Sequence[str]) -> Column:
    """The first of a fixed list of names that the text contains, whatever the case; else null."""
    low = F.lower(text)
    hits = F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(low, F.lower(n)))
    return F.get(hits, F.lit(0))


def digest_features(text: Column, palettes: int, icons: int) -> dict[str, Column]:
    """Numbers drawn from a SHA-256 digest: a palette, an icon and a mirrored 5 x 5 grid."""
    hexed = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substring(hexed, 2 * i + 1, 2), 16, 10).cast("bigint")
    bits = byte(3) * 256 + byte(4)
    cell = lambda r, c: F.shiftright(bits, r * 3 + min(c, 4 - c)).bitwiseAND(F.lit(1))
    rows = [F.concat(*(cell(r, c).cast("string") for c in range(5))) for r in range(5)]
    return {
        "palette": byte(0) % palettes,
        "icon": (byte(1) * 256 + byte(2)) % icons,
        "grid": F.concat_ws("/", *rows),
    }


def url_record_id(path: Column) -> Column:
    """The numeric id in a path such as /t/some-title/123."""
    return F.regexp_extract(path, r"(?i)/t/[^/]+/(\d+)", 1).try_cast("bigint")
