"""Row-level rules for journal titles: reading one and comparing two. Pure Python."""

from __future__ import annotations

import re

from shelfmark.llm.name_rules import ascii_fold, bounded, plain, within_one

STOP = frozenset(
    "the of in on for and de di da do des du la le les der die das dem und fur i y e et a an to en el los o os as og w".split()
)
_PARTS = re.compile(r"[=/|]|(?<![^\s])[:—](?![^\s])")
_SERIES = re.compile(r"\b(?:series|serie|ser|part|section|sect)\b[\W_]+([a-z]|[ivx]{1,4}|\d{1,3})(?![^\W_])")
_SERIES_MISSPELT = re.compile(r"[:,-]\s*([a-z]{5,7})\s+([a-z]|\d{1,2})(?![^\W_])")
# Abbreviations too short to show what they stand for.
SHORT = {"j.": "journal", "jl.": "journal", "jnl.": "journal", "z.": "zeitschrift", "q.": "quarterly"}
_POSSESSIVE = re.compile(r"['’]s(?![^\W_])")
_TOKEN = re.compile(r"([^\W_]+)(\.?)")


def read_title(title: str | None) -> list[dict]:
    """The parts of a parallel title, each with its tokens and series mark.

    Tokens are folded words without stop words; an abbreviated one keeps its
    dot. A subtitle after a colon is left out. Blank titles have no parts.
    """
    if not title:
        return []
    text = _POSSESSIVE.sub("", ascii_fold(plain(title)).replace("_", " "))
    out = []
    for part in _PARTS.split(text):
        series = ""
        if m := _SERIES.search(part):
            series = m.group(1)
            part = part[: m.start()] + ": " + part[m.end() :].lstrip(" :,.-")
        elif (m := _SERIES_MISSPELT.search(part)) and within_one(m.group(1), "series"):
            series = m.group(2)
            part = part[: m.start()] + ": " + part[m.end() :].lstrip(" :,.-")
        part = re.split(r":(?:\s|$)", part.strip(" :"))[0]
        tokens = [SHORT.get(w + dot, w + dot) for w, dot in _TOKEN.findall(part) if w not in STOP]
        if tokens:
            out.append({"tokens": bounded(tokens), "series": series})
    return out


def same_word(a: str, b: str, df_a: int, df_b: int) -> bool:
    """Equal, one abbreviating the other, or a misspelling of a word in use."""
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return True
    dot_a, dot_b = a.endswith("."), b.endswith(".")
    if dot_b and not dot_a:
        x, y, dot_a, dot_b, df_a, df_b = y, x, dot_b, dot_a, df_b, df_a
    if dot_a and len(x) < len(y):
        if y.startswith(x):
            return True
        if len(x) >= 4 and any(within_one(x, y[:n]) for n in (len(x) - 1, len(x), len(x) + 1)):
            return True
    if dot_a and dot_b and min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x)):
        return True
    if min(len(x), len(y)) >= 3 and max(len(x), len(y)) >= 4 and within_one(x, y):
        low, high = sorted((df_a, df_b))
        return low <= 2 or low * 5 <= high
    return False


def same_title(a: list[str], b: list[str], dfs_a: list[int], dfs_b: list[int]) -> bool:
    """Whether the main parts of two titles have the same words in the same order."""
    return len(a) == len(b) and all(same_word(x, y, p, q) for x, y, p, q in zip(a, b, dfs_a, dfs_b, strict=True))
