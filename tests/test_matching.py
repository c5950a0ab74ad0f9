"""The match scenario worked out by hand, the plan that follows and its invariants."""

import random

from pyspark.sql import functions as F

from shelfmark.operators import apply, attributes, match, plan

LEFT = [
    (1, "Alpha Letters", "1111-1111"), (2, "Old Alpha", "1111-1111"), (3, "Beta &amp; Co", None), (4, "Gamma", None),
    (5, "Gamma", None), (6, "Delta", None), (7, "Eps", None), (8, "Eps", None), (9, "Only Left", None),
    (10, "   ", "2222-2222"), (11, "Zeta Old", "3333-3333"),
]
RIGHT = [
    (101, "Alpha Letters", "1111-1111"), (102, "BETA & co", None), (103, "gamma", None), (104, "Delta", None),
    (105, "delta", "4444-4444"), (106, "Eps", None), (107, "EPS", None), (108, "eps", None), (109, "Only Right", None),
    (110, "only right", None), (111, "", "5555-5555"), (112, "Theta", "5555-5555"), (113, "Theta Again", "5555-5555"),
    (114, "Blank Match", "2222-2222"), (115, "Zeta", "3333-3333"),
]


def matched(spark, left, right):
    a = spark.createDataFrame(left, "id bigint, title string, key string")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(right)], "pos int, id bigint, title string, key string")
    cols = [F.col("id"), F.col("title"), F.col("key")]
    return match.two_phase(match.side(a, *cols, [F.col("id")]), match.side(b, *cols, [F.col("pos")]))


def test_scenario_classes(spark):
    counts = {r["class"]: r["n_groups"] for r in match.class_counts(matched(spark, LEFT, RIGHT).groups).collect()}
    assert counts == dict(zip(match.CLASSES, (2, 1, 2, 1, 1, 3), strict=True))


def test_scenario_plan(spark):
    rows = plan.action_plan(matched(spark, LEFT, RIGHT)).collect()
    updates = {r["right_id"]: r["left_id"] for r in rows if r["action"] == "update"}
    assert updates == {101: 1, 102: 3, 103: 4, 104: 6, 106: 7, 107: 8, 115: 11}
    assert sorted(r["right_id"] for r in rows if r["action"] == "create") == [105, 108, 109, 112, 114]
    assert sorted(r["left_id"] for r in rows if r["action"] == "delete") == [2, 5, 9]


def test_scenario_plan_with_all_created(spark):
    rows = plan.action_plan(matched(spark, LEFT, RIGHT), create_all=True).collect()
    assert 110 in [r["right_id"] for r in rows if r["action"] == "create"]


def test_plan_uses_every_id_once(spark):
    rng = random.Random(7)
    title = lambda: rng.choice("abcdefgh")
    key = lambda: rng.choice([None, None, "k1", "k2", "k3", "k4"])
    left = [(i, title(), key()) for i in range(40)]
    right = [(100 + i, title(), key()) for i in range(40)]
    g = matched(spark, left, right)
    rows = plan.action_plan(g, create_all=True).collect()
    used_left = sorted(r["left_id"] for r in rows if r["left_id"] is not None)
    used_right = sorted(r["right_id"] for r in rows if r["right_id"] is not None)
    assert used_left == sorted(i for i, _, _ in left)
    seen, kept = set(), []
    for i, _, k in right:
        if k is None or k not in seen:
            kept.append(i)
        seen.add(k)
    assert used_right == sorted(kept)


def test_empty_sides(spark):
    counts = match.class_counts(matched(spark, [(1, None, None)], [(2, " ", "k")]).groups).collect()
    assert [r["n_groups"] for r in counts] == [0] * 6


def test_upsert_twice_is_upsert_once(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "B", None), (3, "c", 3)], "id int, name string, n int")
    once = apply.upsert(stored, new, "id", keep_null=("n",))
    assert {(r.id, r.name, r.n, r.outcome) for r in once.collect()} == {(1, "a", 1, "kept"), (2, "B", 2, "updated"), (3, "c", 3, "created")}
    twice = apply.upsert(once.drop("outcome"), new, "id", keep_null=("n",))
    assert {(r.id, r.outcome) for r in twice.collect()} == {(1, "kept"), (2, "unchanged"), (3, "unchanged")}


def test_last_wins_with_null_values(spark):
    rows = spark.createDataFrame([(1, 7, "a", "x"), (2, 7, "a", None), (3, 8, "a", "y")], "id int, topic_id int, name string, value string")
    got = {(r.topic_id, r.value) for r in attributes.last_wins(rows, "topic_id").collect()}
    assert got == {(7, None), (8, "y")}


def test_changed_only(spark):
    want = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", " "), (1, "d", "z")], "id int, name string, value string")
    have = spark.createDataFrame([(1, "a", "x"), (1, "b", "old"), (1, "c", "kept")], "id int, name string, value string")
    got = {(r.name, r.change) for r in attributes.changed_only(want, have, "id").collect()}
    assert got == {("b", "replace"), ("d", "insert")}


def test_pages_count_from_one(spark):
    rows = spark.range(10).toDF("id")
    assert [r.id for r in plan.page(rows, [F.col("id")], 2, 4).collect()] == [4, 5, 6, 7]
    try:
        plan.page(rows, [F.col("id")], 0, 4)
    except ValueError:
        return
    raise AssertionError("page 0 was accepted")


def test_chunks_are_full_but_the_last(spark):
    rows = plan.chunks(spark.range(0, 1003, 1, 7).toDF("id"), [F.col("id")], 100)
    sizes = [r["count"] for r in rows.groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [100] * 10 + [3]


def test_numbering_of_a_hot_group(spark):
    from shelfmark.operators.ranking import numbered

    rows = spark.range(0, 5000, 1, 9).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id")
    got = numbered(rows, ["k"], [F.desc("id")])
    places = {}
    for r in got.collect():
        places.setdefault(r.k, []).append((r.pos, r.id))
    for v in places.values():
        v.sort()
        assert [p for p, _ in v] == list(range(1, len(v) + 1))
        assert [i for _, i in v] == sorted((i for _, i in v), reverse=True)
    nulls = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "k string, id int")
    assert {(r.k, r.id, r.pos) for r in numbered(nulls, ["k"], [F.col("id")]).collect()} == {(None, 1, 1), (None, 2, 2), ("a", 1, 1)}
