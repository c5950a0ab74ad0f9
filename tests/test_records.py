"""Canonical records, related items and series on small fixtures."""

import json
import re
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators import derive, normalize, related, tags

CATALOG = """struct<unified: struct<id: bigint, canonical_name: string, issn_l: string, openalex_is_oa: boolean, crossref_publisher: string>,
sources: struct<openalex: struct<main: struct<is_oa: boolean>, counts_by_year: array<struct<year: int, works_count: bigint, cited_by_count: bigint>>>,
jcr: struct<main: struct<year: int, impact_factor: string>, all_years: array<struct<year: int, impact_factor: string, if_quartile: string>>>,
fqb: struct<main: struct<top: string>, all_years: array<struct<year: int, major_quartile: string, subcategory_1: string, subcategory_2: string, subcategory_2_quartile: string>>>,
crossref: struct<main: struct<counts_total_dois: bigint>, coverage_types: array<struct<type_name: string, abstracts: double, orcids: double>>>>>"""


def record(spark, row):
    schema = T.StructType([T.StructField("body", T.StringType())])
    raw = spark.createDataFrame([(json.dumps(row),)], schema)
    parsed = raw.select(F.from_json("body", CATALOG).alias("r")).select("r.*")
    return normalize.canonical_record(parsed).first()


def test_histories(spark):
    counts = [{"year": 2000 + i, "works_count": i, "cited_by_count": None} for i in range(17)] + [{"year": None, "works_count": 1}]
    r = record(
        spark,
        {
            "unified": {"id": 1, "openalex_is_oa": False},
            "sources": {
                "openalex": {"main": {"is_oa": True}, "counts_by_year": counts},
                "jcr": {"main": {"year": 2020, "impact_factor": "1.5"}, "all_years": []},
                "fqb": {"main": {"top": "是"}, "all_years": [{"year": 2021, "major_quartile": "2区", "subcategory_1": " ", "subcategory_2": "X", "subcategory_2_quartile": "1区"}]},
                "crossref": {"main": {"counts_total_dois": 5}, "coverage_types": [{"type_name": "all", "abstracts": 0.125, "orcids": 0.0}]},
            },
        },
    )
    years = [y.year for y in r.metrics.counts_by_year]
    assert years == list(range(2016, 2001, -1)) and r.metrics.counts_by_year[0].cited_by_count == 0
    assert [(y.year, y.impact_factor) for y in r.jcr] == [(2020, "1.5")]
    assert r.scimago is None and r.warning is None and r.scirev is None
    assert [(m.category, m.quartile) for m in r.cas_partition[0].minor_categories] == [("X", "1区")]
    assert r.crossref_quality.coverage == {"abstracts": 13}
    assert r.open_access.is_oa is True


def test_empty_payload(spark):
    r = record(spark, {"unified": {"id": 2}})
    assert r.unified_id == 2 and r.jcr is None and r.crossref_quality is None and r.metrics.counts_by_year == []


def test_tags_of_a_record(spark, data):
    from shelfmark.plans.derived import records

    rows = tags.tag_assignments(records(spark, data)).select("tag_group").distinct().collect()
    assert {r.tag_group for r in rows} <= set(tags.TAG_GROUPS)


ITEMS = [(1, "P", "C", 9), (2, "x", "y", 8), (3, "P", "y", 7), (4, "P", "C", 6), (5, "x", "C", 5), (6, "x", "y", 4), (7, "x", "y", 3)]
TAGS = [(1, "t1"), (1, "t2"), (2, "t1"), (2, "t2"), (3, "t1"), (7, "t1"), (7, "t2")]


def test_related_scenario(spark):
    items = spark.createDataFrame(ITEMS, "id bigint, publisher string, country string, recency int")
    labels = spark.createDataFrame(TAGS, "id bigint, tag string")
    got = related.related_to_one(items, labels, 1, k=3, criteria=("tags", "publisher", "country"), visible=F.col("id") != 7)
    assert [(r.other_id, r.score) for r in got.collect()] == [(2, 6), (3, 5), (4, 3)]


def test_related_all_equals_one_by_one(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "id bigint, publisher string, country string, recency int")
    labels = spark.createDataFrame(TAGS, "id bigint, tag string")
    features = labels.select("id", F.concat(F.lit("t"), "tag").alias("feature"), F.lit(3).alias("points")).unionByName(
        items.select("id", F.concat(F.lit("p"), "publisher").alias("feature"), F.lit(2).alias("points"))
    )
    for most in (10, 0):
        monkeypatch.setattr(related, "MOST_FEATURES", most)
        every = {}
        for r in related.related_to_all(items, features, k=3).orderBy("id", "place").collect():
            every.setdefault(r.id, []).append((r.other_id, r.score))
        for i, *_ in ITEMS:
            one = [(r.other_id, r.score) for r in related.related_to_one(items, labels, i, k=3).collect()]
            assert every.get(i, []) == one


def test_related_all_with_one_rich_item(spark):
    """One item with eleven features; the others still meet by combinations."""
    items = [(i, None, None, i % 5) for i in range(30)]
    labels = [(0, f"t{j}") for j in range(11)] + [(i, f"t{(i * j) % 13}") for i in range(1, 30) for j in range(1, 1 + i % 6)]
    it = spark.createDataFrame(items, "id bigint, publisher string, country string, recency int")
    tg = spark.createDataFrame(sorted(set(labels)), "id bigint, tag string")
    features = tg.select("id", F.concat(F.lit("t"), "tag").alias("feature"), F.lit(3).alias("points"))
    every = {}
    for r in related.related_to_all(it, features, k=4).orderBy("id", "place").collect():
        every.setdefault(r.id, []).append((r.other_id, r.score))
    of = {i: {t for n, t in labels if n == i} for i in range(30)}
    for i in range(30):
        want = sorted(((j, 3 * len(of[i] & of[j])) for j in range(30) if j != i and of[i] & of[j]), key=lambda x: (-x[1], -(x[0] % 5), x[0]))[:4]
        assert every.get(i, []) == want


def test_related_all_keeps_pairs_of_rich_items_out_of_exchanges(spark, monkeypatch):
    """Every two of 160 items with over ten features meet; blocks of a few items give what one pass over all pairs gives."""
    for name in ("ASKING", "BLOCK"):
        monkeypatch.setattr(related, name, 1000, raising=False)
    of = {i: {(f"t{j}", 3) for j in range(20) if (i * 7 + j * j) % 5 or j < 6} | {(f"p{i % 9}", 2), (f"own{i}", 1)} for i in range(160)}
    of |= {i: {(f"t{i % 20}", 3), (f"p{i % 9}", 2)} for i in range(160, 200)}
    recency = {i: None if i % 6 == 0 else i % 11 for i in of}
    it = spark.createDataFrame([(i, recency[i]) for i in of], "id bigint, recency int")
    ft = spark.createDataFrame([(i, f, n) for i, fs in of.items() for f, n in sorted(fs)] + [(200, f"t{i}", 3) for i in range(12)], "id bigint, feature string, points int")

    found = related.related_to_all(it, ft, k=4)
    # A join of rich profiles on their features makes a row of each pair and feature.
    assert not re.search(r"Join Inner, \(feature#", found._jdf.queryExecution().optimizedPlan().toString())
    got = {}
    for r in found.orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.other_id, r.score))
    newest = lambda j: -1 if recency[j] is None else recency[j]
    for i in of:
        scores = {j: sum(n for _, n in of[i] & of[j]) for j in of if j != i}
        assert got.get(i, []) == [(j, scores[j]) for j in sorted((j for j in scores if scores[j]), key=lambda j: (-scores[j], -newest(j), j))[:4]]
    assert 200 not in got


def test_json_ld_leaves_out_what_is_unknown(spark, data):
    from shelfmark.plans.derived import records

    docs = [json.loads(r.json_ld) for r in derive.json_ld(records(spark, data)).collect()]
    assert docs and all(d["@type"] == "Periodical" and None not in d.values() for d in docs)


def test_excerpts_are_short(spark, data):
    from shelfmark.plans.derived import records

    assert derive.seo_excerpt(records(spark, data)).where("length(excerpt) > 300").count() == 0


def test_thinned_ticks(spark):
    rows = spark.range(30).select(F.lit("s").alias("s"), F.col("id").alias("m"))
    kept = sorted(r.i for r in derive.thinned_ticks(rows, "s", "m").collect())
    assert kept == [0, 5, 10, 15, 20, 29]  # 25 is less than a step of five before the last


def test_ticks_of_every_length(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1, 60).select(F.col("id").alias("s")).select("s", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("step"))
    kept = {}
    for r in derive.thinned_ticks(rows, "s", "step").collect():
        kept.setdefault(r.s, []).append(r.i)
    for n in range(1, 60):
        step = 1 if n <= 8 else 2 if n <= 15 else 3 if n <= 25 else -(-n // 7)
        want = [i for i in range(n) if i % step == 0]
        if want[-1] != n - 1:
            want.append(n - 1)
            if want[-1] - want[-2] < step:
                del want[-2]
        assert sorted(kept[n]) == want


def test_range_of_an_axis(spark):
    rows = spark.createDataFrame([("neg", 1, -5), ("neg", 2, -1), ("zero", 1, 0), ("zero", 2, 0), ("pos", 1, 2), ("pos", 2, 4)], "s string, t int, n int")
    got = {(r.s, r.t): r.y for r in derive.chart_points(rows, "s", "t", "n").collect()}
    assert got == {("neg", 1): 100.0, ("neg", 2): 20.0, ("zero", 1): 100.0, ("zero", 2): 100.0, ("pos", 1): 50.0, ("pos", 2): 0.0}


def test_panels_of_a_record(spark):
    from shelfmark.operators import cards

    rows = spark.sql(
        "select 1L as unified_id, named_struct('first_review_months', '2.5', 'total_handling_months', null, 'overall_rating', '3.26', 'avg_review_rounds', '2',"
        " 'avg_review_reports', '', 'report_difficulty', null, 'review_count', '7') as scirev,"
        " named_struct('indexed_in', array('A', 'B'), 'languages', array('en'), 'editors', cast(array() as array<string>), 'coden', 'X', 'inception', ' ', 'frequency', '—') as wikidata_meta,"
        " named_struct('preservation_services', array('P'), 'deposit_services', cast(array() as array<string>)) as preservation"
    )
    long = lambda df: {(r.label, r.value) for r in df.collect()}
    assert long(cards.peer_review(rows)) == {("first_decision", "2.5"), ("rating", "3.3/5"), ("rounds", "2"), ("reviews", "7")}
    assert long(cards.indexing_panel(rows)) == {("indexed_in", "A, B"), ("preserved_by", "P"), ("languages", "en"), ("coden", "X")}
    full = spark.range(1).select(*(cards.stars(F.lit(x)).alias(f"s{i}") for i, x in enumerate((3.26, None, 9.0, -1.0)))).first()
    assert list(full) == [[100, 100, 100, 26, 0], [0] * 5, [100] * 5, [0] * 5]


def test_donut_coverage_and_warnings(spark):
    from pyspark.sql import functions as F

    rows = spark.sql(
        "select 1L as unified_id, named_struct('topic_shares', array(named_struct('name', 'a', 'value', 1.0D),"
        " named_struct('name', 'b', 'value', 3.0D))) as subjects_topics,"
        " named_struct('coverage', map('orcids', 40)) as crossref_quality,"
        " array(named_struct('year', 2022L, 'level', '高', 'reason', 'r'), named_struct('year', 2020L, 'level', '低', 'reason', 'r')) as warning"
    )
    assert [(r.topic, r.percent, r.offset) for r in derive.topic_donut(rows).collect()] == [("a", 25.0, 0.0), ("b", 75.0, 25.0)]
    assert [(r.part, r.percent) for r in derive.coverage_bars(rows).collect()] == [("orcids", 40)]
    assert [(r.year, r.severity) for r in derive.warning_timeline(rows).collect()] == [(2020, "low"), (2022, "high")]
    names = spark.createDataFrame([(["x", "scie", "jcr:q1", "ccf:a", "sjr:q1"],), (None,)], "n array<string>")
    assert [r[0] for r in names.select(tags.highlighted(F.col("n"))).collect()] == [["scie", "jcr:q1", "ccf:a"], None]


def brute_tags(r):
    """The tags of a canonical record by plain rules."""
    first = lambda rows: rows[0] if rows else None
    clean = lambda t: re.sub(r"\s+", "-", t.strip(" ").lower()) or None if t is not None else None
    blank = lambda t: t is None or not t.strip()
    quartile = lambda q, p: f"{p}:{q.lower()}" if q and q.upper() in ("Q1", "Q2", "Q3", "Q4") else None
    jcr, sjr, cas, warn, pub, oa = first(r.jcr), first(r.scimago), first(r.cas_partition), first(r.warning), r.publication, r.open_access
    digits = re.search("[0-9]+", (cas and cas.major_quartile) or "")
    index = ((cas and cas.web_of_science) or "").strip(" ").lower()
    rank = re.sub(r"\s+", "", ((r.ccf and r.ccf.rank) or "").upper())
    house = next((p for p in tags.MAJOR_PUBLISHERS if p.lower() in (pub.publisher_name or "").lower()), None)
    found = {
        "jcr_quartile": quartile(jcr and jcr.quartile, "jcr"),
        "sjr_quartile": quartile(sjr and sjr.best_quartile, "sjr"),
        "cas_zone": f"中科院:{digits[0]}区" if digits and 1 <= int(digits[0]) <= 4 else None,
        "cas_top": "中科院:top" if cas and cas.top in ("true", "是", "yes", "1") else None,
        "ccf_rank": f"ccf:{rank.lower()}" if rank in ("A", "B", "C") else None,
        "wos_index": index if index in tags.WOS_INDEXES else None,
        "oa_status": "diamond-oa" if oa.diamond_oa else {True: "oa", False: "非oa", None: None}[oa.is_oa],
        "doaj": "doaj收录" if oa.is_in_doaj else None,
        "warning": clean("预警:" + warn.level.strip(" ")) if warn and not blank(warn.level) else None,
        "subject": clean(cas.major_category) if cas else None,
        "country": clean(pub.country_code if blank(pub.country_name) else pub.country_name),
        "publisher": tags.PUBLISHER_TAGS.get(house, clean(house)),
    }
    return [(r.unified_id, g, t) for g, t in found.items() if t is not None]


def test_tags_of_all_groups_against_brute_force(spark, data):
    from shelfmark.plans import derived

    got = Counter(tuple(r) for r in derived.queries()["tag_assignments"](spark, data).collect())
    assert got == Counter(t for r in derived.records(spark, data).collect() for t in brute_tags(r))
    assert len({g for _, g, _ in got}) > 5


def test_all_leaves_against_brute_force(spark, data):
    from shelfmark.plans import derived

    def filled(value, path=""):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from filled(v, f"{path}.{k}" if path else k)
        elif value is not None and value not in ("", "—", []):
            yield path

    want = Counter()
    for r in spark.read.parquet(f"{data}/catalogue.parquet").collect():
        want.update(set(filled({k: v for k, v in r.asDict(recursive=True).items() if k not in ("page", "pos", "fetched_at")})))
    got = {r.path: r.n_rows for r in derived.queries()["leaf_audit"](spark, data).collect()}
    assert {p: n for p, n in got.items() if n} == dict(want) and len(got) > 5
