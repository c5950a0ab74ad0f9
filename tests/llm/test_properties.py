"""Properties on random inputs."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import format_duplicates as fd
from shelfmark.llm import leakage, packing
from shelfmark.llm.name_rules import within_one

LETTERS = st.text(alphabet="abcdéñüßŁżд中", min_size=1, max_size=8)
NAME = st.lists(LETTERS, min_size=1, max_size=5)


def decorate(words, rng):
    """The same name with other case, spaces, punctuation and width."""
    out = []
    for w in words:
        w = rng.choice([w, w.upper() if w.upper().casefold() == w.casefold() else w, w + rng.choice([",", ".", "", "!"])])
        out.append("".join(c + rng.choice(["", "", "", "​"]) for c in w))
    return rng.choice(["", "(", "«", " "]) + rng.choice([" ", "  ", "_", "　", "-"]).join(out) + rng.choice(["", ")", " ."])


@settings(max_examples=150, deadline=None)
@given(NAME, st.integers(0, 10**6))
def test_decorated_names_are_the_same(words, seed):
    rng = random.Random(seed)
    a, b = " ".join(words), decorate(words, rng)
    table = fd.Folding()
    ka, kb = fd.name_keys([a, b], table)
    assert ka[0] == kb[0] and fd.same_name(a, b)


@settings(max_examples=150, deadline=None)
@given(NAME, NAME)
def test_hash_and_comparison_agree(a, b):
    x, y = " ".join(a), " ".join(b)
    kx, ky = fd.name_keys([x, y], fd.Folding())
    assert (kx[0] == ky[0]) == fd.same_name(x, y)


@settings(max_examples=80, deadline=None)
@given(st.lists(NAME.map(" ".join), min_size=1, max_size=4, unique_by=fd.canonical), st.randoms())
def test_parts_in_any_order(parts, rng):
    other = parts[:]
    rng.shuffle(other)
    a, b = " = ".join(parts), rng.choice([" / ", " = ", "|", " — "]).join(other)
    ka, kb = fd.name_keys([a, b], fd.Folding())
    assert ka[0] == kb[0] and fd.same_name(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=0, max_size=7), st.text("abc", min_size=0, max_size=7))
def test_within_one_is_the_edit_distance(a, b):
    edits = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))}
    edits |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"}
    edits |= {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    assert within_one(a, b) == (b in edits)


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 300), st.sampled_from([None, "a", "b"]), st.integers(0, 5)), max_size=60),
    st.integers(1, 120),
)
def test_packing_places_everything(items, capacity):
    rows = packing.pack([(i, *x) for i, x in enumerate(items)], capacity)
    load, total = {}, {}
    for b, doc, _, _, size in rows:
        load[b] = load.get(b, 0) + size
        total[doc] = total.get(doc, 0) + size
    assert all(v <= capacity for v in load.values())
    assert total == {i: x[0] for i, x in enumerate(items)}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 60), st.integers(0, 60))
def test_whole_item_is_found_anywhere(seed, before, after):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    item = [rng.choice(vocabulary) for _ in range(60)]
    text = " ".join([rng.choice(vocabulary) for _ in range(before)] + item + [rng.choice(vocabulary) for _ in range(after)])
    index = leakage.Index([(1, " ".join(item)), (2, " ".join(reversed(item)))], set())
    found = {n: share for n, share, _ in leakage.leaks_in(text, index, leakage.Hasher())}
    assert found.get(1, 0) == 1.0 and 2 not in found
