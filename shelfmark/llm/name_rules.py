"""Row-level rules for organisation names: reading a spelling and comparing two.

Pure Python, without Spark, so the same functions serve the pandas UDFs and
the brute-force tests.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from functools import lru_cache

# Strings that stand for "no name given".
FILLERS = frozenset(
    ["-", "--", "---", "?", "??", ".", "n/a", "n.a.", "none", "(none)", "null", "nil", "not set", "not available"]
    + ["unknown", "unknown publisher", "tbd", "tba", "[s.n.]", "s.n.", "undefined", "未知", "无", "xx", "zz"]
)

# A value cut off by its source ends with one of these marks.
CUT_MARK = r"(\.\.\.|…|\[\.\.\.\]|\[…\]|\(cut\)|\(truncated\))\s*$"
_CUT = re.compile(CUT_MARK, re.I)

# Words for kinds of organisation in several languages.
CONCEPTS = {
    "university": "university univ universidad universidade universitaires universitaire universite universitat uni",
    "press": "press pr presses editorial presse prensa",
    "institute": "institute inst institut instituto istituto",
    "academy": "academy acad akademie academia academie",
    "society": "society soc sociedad sociedade societe gesellschaft association assoc",
    "publishing": "publishing publishers publisher publ pub publications",
    "house": "house",
    "scientific": "scientific sci sc wissenschaftlicher",
    "verlag": "verlag verl",
    "sons": "sons son",
    "group": "group",
    "legal": "gmbh ltd limited inc co corp llc ag bv sa company",
}
CONCEPT_OF = {w: c for c, ws in CONCEPTS.items() for w in ws.split()}
# Words that hold two concepts at once.
COMPOUNDS = {"wissenschaftsverlag": ("scientific", "verlag"), "up": ("university", "press")}

# Given names and their short forms.
GIVEN = {
    "robert": "robt rob bob bobby bert",
    "william": "wm will bill billy",
    "margaret": "marg peggy maggie meg greta",
    "elizabeth": "eliz betty liz lizzie beth",
    "katharina": "kath kathe kate kathi katrin",
    "johannes": "joh hans johann jan",
    "francisco": "fco paco pancho frank",
    "alexander": "alex sandy sascha alec",
    "thomas": "thos tom tommy",
    "charles": "chas charlie chuck",
    "richard": "rich dick rick",
    "james": "jas jim jimmy",
    "joseph": "jos joe pepe jose",
    "edward": "edw ed ted",
    "george": "geo",
    "michael": "mich mike",
    "henry": "hy harry hank",
    "john": "jno jack",
    "friedrich": "friedr fritz fred",
    "heinrich": "heinr heinz",
}
GIVEN_OF = {w: g for g, ws in GIVEN.items() for w in [g, *ws.split()]}

STOP = frozenset("the of for de la le les du des der die das dem den von fur y and et und in a an e do da".split())

# Country names that sources append in brackets.
COUNTRY_WORDS = frozenset(
    """argentina austria brazil chile china colombia czechia egypt finland france germany hungary india
    indonesia italy japan malaysia mexico netherlands norway poland portugal romania spain sweden switzerland
    turkey turkiye ukraine uk usa us canada australia belgium denmark ireland israel greece russia iran iraq
    pakistan nigeria kenya vietnam thailand singapore taiwan peru cuba serbia croatia slovakia slovenia
    bulgaria""".split()
    + [
        "south korea", "korea republic of", "south africa", "united kingdom", "united states",
        "united states of america", "czech republic", "peoples republic of china", "the netherlands",
        "new zealand", "saudi arabia", "hong kong", "russian federation",
    ]
)


def plain(text: str) -> str:
    """Decoded, compatibility-folded text without invisible characters."""
    text = html.unescape(unicodedata.normalize("NFKC", text))
    return "".join(c for c in text if unicodedata.category(c) != "Cf")


def ascii_fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.casefold())
    text = "".join(c for c in text if unicodedata.category(c) != "Mn")
    return text.replace("ł", "l").replace("ß", "ss").replace("ø", "o")


def is_filled(value: str | None) -> bool:
    """False for null, blank and filler values and for values marked as cut off."""
    if value is None:
        return False
    text = plain(value).strip()
    if not text or text.casefold() in FILLERS or _CUT.search(text):
        return False
    return any(c.isalnum() for c in text)


def within_one(a: str, b: str) -> bool:
    """Equal but for one inserted, dropped, replaced or swapped character."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    la, lb = len(a), len(b)
    if lb - la > 1:
        return False
    i = 0
    while i < la and a[i] == b[i]:
        i += 1
    if la < lb:
        return a[i:] == b[i + 1 :]
    if a[i + 1 :] == b[i + 1 :]:
        return True
    return i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]


@lru_cache(maxsize=200_000)
def concept_near(word: str) -> str | None:
    """The kind word that a misspelt word stands for, if any."""
    if not 4 <= len(word) <= MOST_LETTERS:
        return None
    for known, concept in CONCEPT_OF.items():
        if len(known) >= 4 and within_one(word, known):
            return concept
    for known in COMPOUNDS:
        if len(known) > 6 and within_one(word, known):
            return "verlag"
    return None


@lru_cache(maxsize=200_000)
def given_near(word: str) -> str | None:
    if len(word) < 4:
        return None
    for known, given in GIVEN_OF.items():
        if len(known) >= 4 and within_one(word, known):
            return given
    return None


# A name of more words, or a word of more letters, is compared as a whole only.
MOST_WORDS = 48
MOST_LETTERS = 48


def bounded(tokens: list[str]) -> list[str]:
    """Tokens as they are, but overlong words, and overlong lists of words, as one digest each."""
    out = [t if len(t) <= MOST_LETTERS else "#" + hashlib.sha1(t.encode("utf-8", "replace")).hexdigest() for t in tokens]
    if len(out) > MOST_WORDS:
        out = ["#" + hashlib.sha1(" ".join(out).encode("utf-8", "replace")).hexdigest()]
    return out


_ACRONYM = re.compile(r"[A-Z]{3,6}")
_BRAND = re.compile(r"([A-Z][a-z]{2,})([A-Z][a-z]{1,})([A-Z][a-z]*)")


def read_name(name: str | None) -> dict | None:
    """What a spelling says: kind, content tokens, given name and alias.

    Returns None for values that are no names. ``tokens`` are the words that
    are neither stop words nor kind words, in their order, each with a dot
    kept at its end if it was abbreviated. ``alias`` is an acronym, a coined
    short form or the stem of a "... Group"; ``alias_only`` tells that the
    string has nothing else.
    """
    if not is_filled(name):
        return None
    text = " ".join(plain(name).split())
    out = {"kind": "", "tokens": [], "given": "", "alias": "", "alias_only": ""}
    bracketed = re.findall(r"\(([^()]*)\)", text)
    for inner in bracketed:
        folded = " ".join(re.findall(r"\w+", ascii_fold(inner).replace("'", "")))
        if _ACRONYM.fullmatch(inner.strip()) and inner.strip() != text.strip("()"):
            out["alias"] = inner.strip()
            text = text.replace(f"({inner})", " ")
        elif folded in COUNTRY_WORDS:
            text = text.replace(f"({inner})", " ")
    bare = text.strip(" .,;")
    if _ACRONYM.fullmatch(bare) and len(bare) <= 5:
        return out | {"alias": bare, "alias_only": "acronym"}
    if m := _BRAND.fullmatch(bare):
        return out | {"alias": bare, "alias_only": "brand", "tokens": [x.lower() for x in m.groups()]}

    found, kinds = [], set()
    words = re.findall(r"([^\W_]+)(\.?)", ascii_fold(text).replace("’", "'"))
    for word, dot in words:
        if word in STOP:
            continue
        if word in COMPOUNDS:
            kinds.update(COMPOUNDS[word])
        elif word in CONCEPT_OF:
            kinds.add(CONCEPT_OF[word])
        elif word in GIVEN_OF:
            out["given"] = GIVEN_OF[word]
        else:
            found.append((word, dot))
    # Misspelt kind words; short ones only where no kind word is spelt right.
    least = 4 if not kinds - {"legal", "house", "press", "academy"} else 6
    kept = []
    for word, dot in found:
        concept = concept_near(word) if len(word) >= least else None
        if concept:
            kinds.add(concept)
        else:
            kept.append((word, dot))
    if kept:
        found = kept
    if not out["given"] and "sons" in kinds:
        # The longest word is the family's; only another one can be a given name.
        for word, dot in sorted(found, key=lambda x: len(x[0]))[:-1]:
            if given := given_near(word):
                out["given"] = given
                found.remove((word, dot))
                break
    if "sons" in kinds and not out["given"]:
        initial = [w for w, _ in found if len(w) == 1]
        if initial and len(found) > 1:
            out["given"] = initial[0]
            found = [x for x in found if len(x[0]) > 1]
    if kinds - {"legal", "house"} == {"scientific"} and not any(w.startswith(("sci", "wis")) for w, _ in words):
        kinds.discard("scientific")  # "Sc." alone may as well be a society
    if "group" in kinds and len(found) == 1 and not kinds - {"group", "legal"}:
        return out | {"alias": found[0][0], "alias_only": "group"}
    if "sons" in kinds:
        kind = "sons"
    elif kinds & {"institute", "academy"}:
        kind = "institute"
    elif "university" in kinds:
        kind = "university"
    elif "society" in kinds:
        kind = "society"
    elif kinds & {"scientific", "verlag"}:
        kind = "scientific"
    elif "publishing" in kinds:
        kind = "publishing"
    elif len(found) == 2 and not out["given"] and re.search(r"\w\s*(&|/|\+|-)\s*\w|\band\b", ascii_fold(text)):
        kind = "publishing"  # two partners' names and nothing else
    else:
        kind = ""
    out["kind"] = kind
    out["tokens"] = bounded([w + ("." if d else "") for w, d in found if len(w) > 1 or not w.isascii()])
    return out


SMALL = STOP | set(CONCEPT_OF)


@lru_cache(maxsize=200_000)
def _near_small_word(token: str) -> bool:
    word = token.rstrip(".")
    return any(within_one(word, known) for known in SMALL if len(known) >= 2)


def same_token(a: str, b: str, df_a: int = 1, df_b: int = 1) -> float:
    """Similarity of two content tokens: 1 equal, 0.95 abbreviation, 0.9 one edit, else 0.

    Two spellings that are both in common use are different words: one edit
    counts only if one of them is much rarer than the other.
    """
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return 1.0
    dot_a, dot_b = a[-1] == ".", b[-1] == "."
    if dot_a and len(x) < len(y) and len(x) >= 2:
        if y.startswith(x) or (len(x) >= 4 and within_one(x, y[: len(x)])):
            return 0.95
    if dot_b and len(y) < len(x) and len(y) >= 2:
        if x.startswith(y) or (len(y) >= 4 and within_one(y, x[: len(y)])):
            return 0.95
    if min(len(x), len(y)) >= 3 and max(len(x), len(y)) >= 4 and within_one(x, y):
        low, high = sorted((df_a, df_b))
        if low <= 2 or low * 5 <= high:
            return 0.9
    return 0.0


def compare(a: dict, b: dict, df: dict[str, int] | None = None, weight=None) -> float:
    """Soft weighted token similarity of two read names; 0 where they conflict.

    Every token takes its best partner; a token weighs more the rarer it is.
    Different kinds and different given names are conflicts, and so are words
    left over on both sides. Words left over on one side only are accepted if
    the other side abbreviates.
    """
    df = df or {}
    weight = weight or (lambda t: 1.0)
    if a["kind"] and b["kind"] and a["kind"] != b["kind"]:
        return 0.0
    ga, gb = a["given"], b["given"]
    if ga and gb and ga != gb and not (min(len(ga), len(gb)) == 1 and ga[0] == gb[0]):
        return 0.0
    ta, tb = list(a["tokens"]), list(b["tokens"])
    if not ta or not tb:
        return 0.0
    free = list(range(len(tb)))
    matched = total = 0.0
    left_a, abbreviated_a, abbreviated_b = [], False, False
    order = sorted(range(len(ta)), key=lambda i: -weight(ta[i]))
    for i in order:
        best, at = 0.0, -1
        for j in free:
            s = same_token(ta[i], tb[j], df.get(ta[i], 1), df.get(tb[j], 1))
            if s > best:
                best, at = s, j
        if at < 0:
            left_a.append(ta[i])
            total += weight(ta[i])
            continue
        free.remove(at)
        x, y = ta[i].rstrip("."), tb[at].rstrip(".")
        if best == 0.95:
            if len(x) < len(y):
                abbreviated_a = True
            else:
                abbreviated_b = True
        w = max(weight(ta[i]), weight(tb[at]))
        matched += best * w
        total += w
    left_b = [tb[j] for j in free]
    total += sum(weight(t) for t in left_b)
    if left_a and left_b:
        # One word split in two by a stray space, or the reverse, is no conflict.
        if "".join(t.rstrip(".") for t in ta) == "".join(t.rstrip(".") for t in tb):
            return 0.95
        return 0.0
    if left_a or left_b:
        # A misspelt stop or kind word says nothing.
        if all(_near_small_word(t) for t in left_a or left_b):
            return 0.9
        if left_a and not abbreviated_b or left_b and not abbreviated_a:
            return 0.0
    if not a["kind"] and not b["kind"] and len(ta) < 2:
        return 0.0
    return matched / total if total else 0.0


def alias_fits(alias: str, alias_kind: str, tokens: list[str]) -> bool:
    """Whether a short form can stand for a name with these content tokens."""
    words = [t.rstrip(".") for t in tokens]
    if alias_kind == "group":
        return any(w == alias or (len(w) > 4 and within_one(w, alias)) for w in words)
    if alias_kind == "brand":
        m = _BRAND.fullmatch(alias)
        if not m:
            return False
        head, _, tail = (x.lower() for x in m.groups())
        joined = "".join(words)
        for i, w in enumerate(words):
            if w.startswith(head):
                rest = w[len(head) :] or "".join(words[i + 1 :])
                return rest.startswith(tail) or any(x.startswith(tail) for x in words) or tail in joined
        return False
    letters = alias.lower()
    for i, w in enumerate(words):
        if w[:1] == letters[:1]:
            rest = "".join(words[i:])[1:]
            at, hit = 0, 0
            for c in letters[1:]:
                k = rest.find(c, at)
                if k < 0:
                    break
                at, hit = k + 1, hit + 1
            if hit >= len(letters) - 2:
                return True
    return False
