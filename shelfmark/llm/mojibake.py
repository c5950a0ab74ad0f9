"""Text that was decoded with the wrong character encoding: finding and restoring it.

Every character is mapped back to the byte that a legacy character set gives
it. A byte-structure automaton, compiled to one regular expression per legacy
set, finds the maximal spans of such bytes that are well-formed UTF-8, of two to
four bytes a character and of any script; only those spans are decoded, again
and again while more are found, as some text was garbled twice. A span is taken
by its evidence: how many of its characters hardly stand beside letters in
proper text. Two-byte Chinese text that was read as Latin letters has its own
automaton over pairs of high bytes.

Between two single-byte sets there is no byte structure. Readings of that kind
are operators of their own (``OTHER_READINGS``), tried where the automaton finds
nothing: there a span is decoded if the result has the letter frequencies of
the language and the text as it stands has not.

Defined cases
-------------
* null and empty texts are never affected and stay as they are;
* what cannot be restored (replacement characters, lost bytes) stays; the
  document still counts as affected;
* texts are processed whole, however long; repeated rows are treated alike.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Legacy sets that UTF-8 was read with, in the order in which ties are settled.
LEGACY = ("cp1252", "cp1250", "mac_roman", "cp437", "cp1251", "koi8_r", "cp866", "cp850")
_NO_CONTROLS = {"mac_roman", "cp437", "koi8_r", "cp866", "cp850"}


def legacy_bytes(encoding: str) -> dict[str, int]:
    """The high bytes of a legacy set by character; undefined ones stand for themselves."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(encoding), b)
        except UnicodeDecodeError:
            if encoding not in _NO_CONTROLS:
                out.setdefault(chr(b), b)
    if encoding == "cp1252":  # Latin-1 readers keep these bytes as control characters
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def common(char: str) -> bool:
    """Whether a decoded character is in common use in the corpus's scripts."""
    o = ord(char)
    return (
        0x80 <= o <= 0x17F  # the control characters are bytes of text garbled twice
        or o in (0x192, 0x2C6, 0x2DC)
        or 0x2010 <= o <= 0x2026
        or o in (0x2030, 0x2032, 0x2033, 0x2039, 0x203A, 0x20AC, 0x2116, 0x2122)
        or 0x391 <= o <= 0x3C9
        or 0x400 <= o <= 0x45F
        or o in (0x490, 0x491)
        or 0x3000 <= o <= 0x30FF
        or 0x4E00 <= o <= 0x9FFF
        or 0xFF00 <= o <= 0xFFEF
    )


def _class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


@lru_cache(maxsize=None)
def automaton(encoding: str) -> tuple[re.Pattern, dict[str, int]]:
    """The automaton of well-formed UTF-8, two to four bytes long, over a legacy set's characters."""
    to_byte = legacy_bytes(encoding)
    chars: dict[int, list[str]] = {}
    for c, b in to_byte.items():
        chars.setdefault(b, []).append(c)

    def any_of(low: int, high: int) -> str | None:
        found = [c for b in range(low, high + 1) for c in chars.get(b, [])]
        return _class(found) if found else None

    tail = any_of(0x80, 0xBF)
    # Well-formed UTF-8: leads and what may follow them.
    shapes = (
        (0xC2, 0xDF, ()), (0xE0, 0xE0, (0xA0, 0xBF)), (0xE1, 0xEC, (0x80, 0xBF)), (0xED, 0xED, (0x80, 0x9F)), (0xEE, 0xEF, (0x80, 0xBF)),
        (0xF0, 0xF0, (0x90, 0xBF)), (0xF1, 0xF3, (0x80, 0xBF)), (0xF4, 0xF4, (0x80, 0x8F)),
    )
    branches = []
    for low, high, second in shapes:
        lead = any_of(low, high)
        middle = any_of(*second) if second else ""
        if lead and middle is not None and tail:
            branches.append(lead + middle + tail * (1 if low < 0xF0 else 2))
    return re.compile("(?:" + "|".join(branches) + ")+"), to_byte


# What may well stand beside a letter in proper text, and letters by name that hardly do.
_ORDINARY = frozenset("»«…–—”“‘’„‚‹›№°§\xa0")
_ODD_LETTERS = frozenset("ªºµƒˆ")
_SINGLE_BYTE_LATIN = frozenset(("cp1252", "cp1250", "mac_roman", "cp437", "cp850"))


@lru_cache(maxsize=100_000)
def _odd(char: str) -> bool:
    return char in _ODD_LETTERS or not (char.isalnum() or char in _ORDINARY)


def _wide(decoded: str) -> bool:
    """Whether a span decodes to characters beyond the common ones, all of them assigned."""
    wide = [c for c in decoded if not common(c)]
    return bool(wide) and not any(unicodedata.category(c) in ("Cn", "Co", "Cc") for c in wide)


def _evident(encoding: str, spans: list[tuple[str, str]]) -> bool:
    """Whether a text's spans that decode to other than common characters are more than chance.

    A lone two-byte character is no evidence; two of one block in a row are, and longer ones.
    """

    def strong(decoded: str) -> bool:
        wide = [ord(c) for c in decoded if not common(c)]
        return max(wide) >= 0x800 or any(a >> 8 == b >> 8 for a, b in itertools.pairwise(wide))

    spans = [x for x in spans if strong(x[1])]
    odd = sum(_odd(c) for span, _ in spans for c in span)
    wide = [c for _, decoded in spans for c in decoded if not common(c)]
    if encoding not in _SINGLE_BYTE_LATIN:
        # Letters of such sets look like bytes of every kind; one script and many odd characters tell.
        return len(wide) >= 3 and odd >= 3 and len({ord(c) >> 8 for c in wide}) <= 2
    return odd >= 2 or odd >= 1 and any(ord(c) > 0xFFFF for c in wide)


def _pieces(span: str, decoded: str, evident: bool) -> Iterator[tuple[int, int, str]]:
    """The parts of a well-formed span to look at: all of it, or its runs of common characters.

    A span of letters only is never more than chance.
    """
    if all(map(common, decoded)) or evident and _wide(decoded) and not span.isalpha():
        yield 0, len(span), decoded
        return
    at = start = 0
    run = ""
    for c in decoded:
        size = len(c.encode("utf-8"))
        if common(c):
            start = start if run else at
            run += c
        elif run:
            yield start, at, run
            run = ""
        at += size
    if run:
        yield start, at, run


_CYRILLIC = re.compile(r"[а-яё]", re.I)
# Two characters that proper text may hold side by side though they look like a span.
_PROPER_PAIR = re.compile(r"[РС][»…–—”’“№ё\xa0°«]")
# Pairs that proper Russian never has.
_GARBLED_PAIR = re.compile(r"[РС][Ђ-ЏђѓєѕіїјљњћќўџҐґµ±¶·¤¦§©®‚„†‡€‰‹›™¬•]")
_PROPER_LATIN = re.compile(r"[À-ÖØ-Þ][”“’‘—–…»«]")


def _acceptable(encoding: str, span: str, text: str, start: int, end: int) -> bool:
    """Whether a well-formed span is evidence, seen with the legacy set's own alphabet."""
    if encoding == "cp1251":
        if len(span) != 2:
            return True
        if _PROPER_PAIR.fullmatch(span):
            # Alone it is proper Russian; in garbled text the neighbours are garbled too.
            return bool(_GARBLED_PAIR.search(text[max(0, start - 6) : start]) or _GARBLED_PAIR.search(text[end : end + 6]))
        if span[0] in "РС" or not re.fullmatch(r"[А-ЯЁЂ-Џа-яёђ-џ]{2}", span):
            return True
        # Two Cyrillic letters inside a Latin word.
        return bool(re.search(r"[A-Za-z]$", text[max(0, start - 1) : start]) or re.match(r"[A-Za-z]", text[end : end + 1]))
    if encoding in ("koi8_r", "cp866"):
        if encoding == "cp866" and re.search(r"тА[А-Я]", span):
            return True
        return bool(re.search(r"[─-◿≈≤≥√÷⌠⌡■∙]", span))
    if encoding == "cp850":
        return bool(re.search(r"[─-◿]", span)) or span.startswith("ÔÇ")
    if encoding == "cp437":
        return bool(re.search(r"[─-◿ΓπΣ]", span))
    if encoding == "mac_roman":
        return len(span) > 2 or span[0] in "√¬≈ƒ–—" and not re.fullmatch(r"[–—][«»“”‘’…]", span)
    if encoding in ("cp1252", "cp1250") and len(span) == 2 and _PROPER_LATIN.fullmatch(span):
        # An upper-case word that ends in an accented letter before a quotation mark or dash.
        return not re.search(r"[^\W\d_a-zà-ÿ]$", text[max(0, start - 1) : start])
    return True


# Characters without one of which a legacy set cannot have been at work.
_BOX = frozenset(chr(c) for c in range(0x2500, 0x2600)) | frozenset("≈≤≥√÷⌠⌡∙")
_NEEDED = {"koi8_r": _BOX, "cp866": _BOX | {"т"}, "cp850": _BOX | {"Ô"}, "cp437": _BOX | set("ΓπΣ"), "mac_roman": frozenset("√¬‚≈ƒ–—„‰∫π∑∏∂")}


@lru_cache(maxsize=None)
def _leads(encoding: str) -> frozenset[str]:
    """The characters that a multi-byte sequence can begin with."""
    return frozenset(c for c, b in legacy_bytes(encoding).items() if 0xC2 <= b <= 0xF4)


def _spans(text: str, encoding: str, chars: set[str]) -> list[tuple[int, int, str]]:
    if chars.isdisjoint(_leads(encoding)) or encoding in _NEEDED and chars.isdisjoint(_NEEDED[encoding]):
        return []
    if encoding == "cp866" and chars.isdisjoint(_BOX) and not re.search(r"тА[А-Я]", text):
        return []
    pattern, to_byte = automaton(encoding)
    out = []
    found = [(m.start(), m.group(), bytes(to_byte[c] for c in m.group()).decode("utf-8")) for m in pattern.finditer(text)]
    evident = _evident(encoding, [(span, new) for _, span, new in found if _wide(new)])
    for at, span, decoded in found:
        for start, end, new in _pieces(span, decoded, evident):
            a, b = at + start, at + end
            if not all(map(common, new)) or _acceptable(encoding, span[start:end], text, a, b):
                out.append((a, b, new))
    return out


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    at, out = 0, []
    for start, end, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


# --- UTF-8 or GBK bytes read as two-byte sets -------------------------------------

_EAST_CHARS = "⺀-鿿-豈-﫿︰-﹯＀-￯€①-㋿▲◎●○★◆□■△▼◇※─-◿ˉˊˋˇ˙"
_EAST = re.compile(f"[{_EAST_CHARS}][{_EAST_CHARS}0-9A-Za-z%]*")
_UTF8 = re.compile(rb"(?:[\xc3-\xc5\xd0\xd1][\x80-\xbf]|[\xe2-\xe9\xef][\x80-\xbf]{2})+")


def _level1(text: str, encoding: str = "gb2312") -> float:
    """The share of CJK characters that are among the 3755 most common ones, or punctuation."""
    good = n = 0
    for c in text:
        if ord(c) < 0x2E80:
            continue
        n += 1
        try:
            b = c.encode(encoding)
        except UnicodeEncodeError:
            continue
        good += len(b) == 2 and (0xB0 <= b[0] <= 0xD7 or b[0] in (0xA1, 0xA3))
    return good / n if n else 0.0


def _two_byte(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _EAST.finditer(text):
        run = m.group()
        done = False
        if _level1(run) >= 0.9:
            continue
        raw = run.encode("gb18030", "replace")
        pieces = list(_UTF8.finditer(raw))
        kept = sum(x.end() - x.start() for x in pieces)
        if len(raw) >= 5 and kept >= 0.6 * len(raw):
            new = raw.decode("utf-8", "replace")
            if _level1(new) >= 0.6 or not _EAST.search(new):
                out.append((m.start(), m.end(), new))
                done = True
        if not done and len(re.findall(f"[{_EAST_CHARS}]", run)) >= 4:
            raw = run.encode("big5hkscs", "replace")
            new = raw.decode("gbk", "replace")
            if _level1(new) >= 0.75 and _level1(run) < 0.6:
                out.append((m.start(), m.end(), new))
    return out


def _gbk_as_latin(text: str, least: int = 4) -> list[tuple[int, int, str]]:
    """Runs of high Latin characters whose pairs are common Chinese characters."""
    runs = list(re.finditer(rf"[\xa1-\xfe]{{{least},}}", text))
    joined = "".join(m.group() for m in runs)
    # Single-byte letters lie above the range in which half of all second bytes lie.
    if not runs or sum(c < "\xc0" for c in joined) < 0.08 * len(joined):
        return []
    out, good, size = [], 0.0, 0
    for m in runs:
        run = m.group()
        size += len(run)
        for shift in (0, 1):
            part = run[shift : len(run) - (len(run) - shift) % 2]
            if len(part) < least:
                continue
            new = part.encode("latin-1").decode("gbk", "replace")
            share = _level1(new)
            if share >= 0.8:
                good += share * len(part)
                out.append((m.start() + shift, m.start() + shift + len(part), new))
                break
    return out if good >= 0.6 * size else []


def _mostly_gbk(text: str) -> bool:
    """Whether long runs of high Latin characters make up most of what is not ASCII."""
    high = len(re.findall(r"[^\x00-\x7f]", text))
    long = sum(len(m.group()) for m in re.finditer(r"[\xa1-\xfe]{6,}", text))
    return long >= 0.4 * high


# --- one single-byte set read as another ------------------------------------------

# How often each letter occurs in Russian text, in per mille.
RUSSIAN = dict(
    zip(
        "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
        [110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4, 0.4],
        strict=True,
    )
)
_LOG = {c: math.log(v / 1000) for c, v in RUSSIAN.items()}


def _russian(word: str) -> float:
    """Mean log frequency of a word's letters, less for cases that words don't have."""
    letters = word.casefold()
    score = sum(_LOG.get(c, -9.0) for c in letters) / len(letters)
    if not (word.islower() or word.isupper() or word[0].isupper() and word[1:].islower()):
        score -= 1.5
    elif word.isupper():
        score -= 0.1
    return score


_CYRILLIC_PAIRS = (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("koi8_r", "cp866"), ("cp866", "koi8_r"), ("mac_cyrillic", "cp1251"))
_LATIN_PAIRS = (("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1252", "iso8859_5"), ("mac_roman", "cp1251"), ("cp1250", "cp1251"))
_WORD = re.compile(r"[^\W\d_]{3,}")


@lru_cache(maxsize=None)
def _reread(wrong: str, right: str) -> dict[int, str]:
    """Character by character: what a text read as ``wrong`` says when read as ``right``."""
    out = {}
    for c, b in legacy_bytes(wrong).items():
        try:
            out[ord(c)] = bytes([b]).decode(right)
        except UnicodeDecodeError:
            continue
    return out


_PLAIN_RUSSIAN = -3.4  # proper sentences lie above, garbled ones hardly ever


def _sentence(part: str, known: tuple[str, str] | None) -> tuple[str, tuple[str, str]] | None:
    """What a sentence says between two single-byte sets; ``known`` is the text's pair, if found."""
    cyrillic = len(re.findall(r"[Ѐ-џҐґ─-◿]", part))
    latin = len(re.findall(r"[\xa8\xb8\xc0-\xff]", part))
    pairs = _CYRILLIC_PAIRS if cyrillic >= 4 else _LATIN_PAIRS if latin >= 4 else ()
    words = [w for w in _WORD.findall(part.translate(_BOXES)) if not w.isascii()]
    if not pairs or not words:
        return None
    weight = sum(map(len, words))
    now = sum(_russian(w) * len(w) for w in words) / weight if pairs is _CYRILLIC_PAIRS else -9.0
    if pairs is _LATIN_PAIRS:
        high = sum(not c.isascii() for w in words for c in w)
        if high < 0.85 * weight or max(len(w) for w in words) < 4:
            return None
    elif not known and now >= _PLAIN_RUSSIAN:
        return None
    best, found = now + (0.0 if known else 0.7 if weight >= 8 else 1.2), None
    for pair in [known] if known in pairs else pairs:
        new = part.translate(_reread(*pair))
        after = [w for w in _WORD.findall(new) if not w.isascii()]
        size = sum(map(len, after))
        if size < 0.7 * weight:
            continue
        score = sum(_russian(w) * len(w) for w in after) / size
        if score > best and score > -4.0:
            best, found = score, (new, pair)
    return found


# Letters of one set may be box drawings in another.
_BOXES = str.maketrans(dict.fromkeys("═║╒╓╔╕╖╗╘╙╚╛╜╝╞╟╠╡╢╣╤╥╦╧╨╩╪╫╬", "х"))


def _single_byte(text: str) -> list[tuple[int, int, str]]:
    """Russian text between two single-byte sets, sentence by sentence."""
    if not re.search(r"[\xa8\xb8\xc0-\xff]{4}|[Ѐ-џҐґ─-◿]{2}", text):
        return []
    parts = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\n.!]+[.!]*", text)]
    found = [_sentence(p, None) for _, _, p in parts]
    pairs = Counter(f[1] for f in found if f)
    if not pairs:
        return []
    known = pairs.most_common(1)[0][0]
    found = [_sentence(p, known) or f for f, (_, _, p) in zip(found, parts, strict=True)]
    return [(a, b, f[0]) for f, (a, b, p) in zip(found, parts, strict=True) if f and f[0] != p]


# Polish letters of cp1250 or Latin-2 read as Western European ones.
_POLISH = re.compile(
    r"(?<=[a-zA-Zóêæñ])[³¹¿\x9c\x9f±¶¼](?=[a-zóêæñ³¹¿\x9c\x9fœŸ±¶¼])"
    r"|(?<=[a-zóêæñ]{2})[³¹±](?![\w²³])"
    r"|(?<![\w.,;!?…)»”])[¿\x9c\x9f\x8c\x8f¶¼¯£](?=[a-zóêæñ]{2,})(?<!¿)"
    r"|(?<=[a-z])[œŸ][æñêw](?=[a-zê])|(?<=[a-z])œæ\b|[\x8c\x8f][a-zóêæñ³]"
)
_LATIN2_ONLY = re.compile(r"(?<=[a-zA-Zóêæñ])[±¶¼]|[¶¼](?=[a-z])")


def _polish(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in re.finditer(r"[^\n]+", text):
        part = m.group()
        if not _POLISH.search(part):
            continue
        right = "iso8859_2" if len(_LATIN2_ONLY.findall(part)) > len(re.findall(r"[¹\x9c\x9fœŸ]", part)) else "cp1250"
        new = part.translate(_reread("cp1252", right))
        if new != part:
            out.append((m.start(), m.end(), new))
    return out


_POLISH_CHARS = frozenset("³¹¿\x9c\x9f±¶¼\x8c\x8f¯£œŸ")


def _step(text: str) -> tuple[str, int, str]:
    """Decode with the legacy set that explains most characters; the number of spans and the reading.

    The characters that occur decide which readings are tried at all.
    """
    chars = {c for c in set(text) if c > "\x7f"}
    latin = sum("\xa1" <= c <= "\xfe" for c in chars)
    if latin >= 3 and _mostly_gbk(text):
        # UTF-8 letters look like pairs too, but pairs hardly ever like UTF-8.
        utf8 = sum(end - start for start, end, _ in _spans(text, "cp1252", chars))
        if utf8 < 0.5 * len(re.findall(r"[^\x00-\x7f]", text)) and (spans := _gbk_as_latin(text, 2)):
            return _replace(text, spans), len(spans), "gbk_as_latin"
    best, best_size = [], 0
    for encoding in LEGACY:
        spans = _spans(text, encoding, chars)
        size = sum(end - start for start, end, _ in spans)
        if size > best_size:
            best, best_size = spans, size
    if best:
        return _replace(text, best), len(best), "utf8"
    for name, (needed, find) in OTHER_READINGS.items():
        if needed(chars, latin) and (spans := find(text)):
            return _replace(text, spans), len(spans), name
    return text, 0, ""


# Readings without the byte structure of UTF-8: which texts each is tried on, and how it finds spans.
OTHER_READINGS = {
    "gbk_as_latin": (lambda chars, latin: latin >= 3, _gbk_as_latin),
    "two_byte": (lambda chars, latin: any(c >= "\u2e80" or "\u2460" <= c <= "\u25ff" for c in chars), _two_byte),
    "single_byte": (lambda chars, latin: latin >= 3 or any("\u0400" <= c <= "\u0491" or "\u2500" <= c <= "\u25ff" for c in chars), _single_byte),
    "polish": (lambda chars, latin: not chars.isdisjoint(_POLISH_CHARS), _polish),
}


def repair_by(text: str) -> tuple[str, int, bool, list[str]]:
    """The restored text, the spans decoded, whether the text was affected, and by which readings in turn.

    A reading is ``utf8`` (the automaton), one of ``OTHER_READINGS``, or
    ``lost`` where replacement characters were there to begin with. It goes on
    until nothing more is found or a text comes back that was there before.
    """
    if text.isascii():
        return text, 0, False, []
    by = ["lost"] if "�" in text else []
    spans, seen = 0, {text}
    while True:
        new, n, name = _step(text)
        if not n or new in seen:
            break
        seen.add(new)
        text, spans = new, spans + n
        by.append(name)
    return text, spans, bool(by), by


def repair(text: str) -> tuple[str, int, bool]:
    """The restored text, the number of spans decoded, and whether the text was affected."""
    return repair_by(text)[:3]


def repaired(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The affected documents: id, ``restored`` text, ``spans`` decoded, ``readings``, ``complete``.

    ``readings`` names what restored the text, in turn (see :func:`repair_by`). ``complete`` is false where replacement characters are left. Texts that
    are plain ASCII never leave the JVM.
    """

    @F.pandas_udf("restored string, spans int, affected boolean, readings array<string>")
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [repair_by(t) for t in texts]
            yield pd.DataFrame(found, columns=["restored", "spans", "affected", "readings"])

    some = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        F.col("text").rlike(r"[^\x00-\x7f]")
    )
    out = some.select("doc_id", fix("text").alias("x")).where("x.affected")
    return out.select("doc_id", "x.restored", "x.spans", "x.readings", (~F.col("x.restored").contains("�")).alias("complete"))


def affected(documents: DataFrame) -> DataFrame:
    """The ids of documents with characters from a wrong encoding."""
    return repaired(documents).select("doc_id").distinct()
