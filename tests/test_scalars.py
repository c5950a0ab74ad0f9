"""Truth tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import scalars as s
from shelfmark.operators import tags


def evaluate(spark, column, kind, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v")).alias("r")).collect()]


@pytest.mark.parametrize(
    ("function", "kind", "pairs"),
    [
        (s.tri_state, "string", [("1", True), ("0", False), ("true", False), (None, None), ("", False)]),
        (s.decimal_comma, "string", [("0,532", 0.532), ("1,234", 1.234), ("1.2.3", 1.2), ("abc", 0.0), (None, None), ("5", 5.0)]),
        (s.thousands, "string", [("1234567", "1,234,567"), ("12", "12"), ("1234.5678", "1,234.5,678"), (None, None)]),
        (s.leading_int, "string", [("12ab", 12), ("ab", 0), (None, 0), (" -3", -3)]),
        (s.initials, "string", [("Journal of the Royal-Society", "JRS"), ("", "?"), (None, "?"), ("of the", "OF")]),
        (s.axis_label, "double", [(1500000.0, "1.5M"), (1500.0, "1.5K"), (7.0, "7"), (7.26, "7.3"), (7.25, "7.2"), (7.75, "7.8"), (9999.0, "10.0K"), (10000.0, "10K"), (15499.0, "15K"), (-20500.0, "-21K"), (0.0, "0")]),
        (s.eta_text, "bigint", [(0, ""), (45, "45s"), (60, "1m"), (125, "2m5s"), (3600, "1h"), (3720, "1h2m"), (None, "")]),
        (s.normalize_title, "string", [(" A　 &amp;amp; B ", "a &amp; b"), (None, ""), ("\t", "")]),
        (s.unescape_title, "string", [
            ("&#233;t&eacute;", "ét&eacute;"), ("plain", "plain"), (None, None), ("&#xE9;&#Xe9;", "éé"), ("&amp;#227;", "&#227;"), ("&#38;lt;", "&lt;"),
            ("&#1114112;&#55296;&#;&#x;", "&#1114112;&#55296;&#;&#x;"), ("a &lt;b&gt; &quot;&apos;&nbsp;", "a <b> \"'&nbsp;"),
        ]),
        (s.leading_number, "string", [("1.5x", 1.5), ("-2e2", -200.0), ("1,234", 1.0), ("x", 0.0), (None, 0.0)]),
        (s.is_blank, "string", [(None, True), ("", True), ("　﻿", True), (" x", False)]),
        (s.bare_url, "string", [("https://a.example/", "a.example"), ("http://b", "b")]),
        (s.url_record_id, "string", [("/t/some-title/123", 123), ("/x/1", None)]),
        (tags.zone_tag, "string", [("2区", "中科院:2区"), ("5区", None), ("x", None), ("01", "中科院:01区"), (None, None)]),
        (tags.publisher_tag, "string", [("Elsevier BV", "elsevier"), ("Pharmacmed", "acm"), ("Unknown", None), ("oxford university press", "oxford-univ-press"), (None, None)]),
        (tags.rank_tag, "string", [(" a ", "ccf:a"), ("D", None), (None, None)]),
    ],
)
def test_scalar(spark, function, kind, pairs):
    assert evaluate(spark, function, kind, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_templates(spark):
    fill = lambda t: s.fill_template(t, {"a": F.lit("A"), "b": F.lit("{{a}}"), "n": F.lit(None)})
    pairs = [
        ("{{a}}, {{x}}, {{b}} - {{n}} - z", "A, {{a}} - z"), ("  {{a}}  ;  {{n}}", "A  ;"), ("{{{a}}}", "{A}"), ("{{a}}\n- {{n}},\n{{a}}", "A\nA"),
        ("{{ a }}", "{{ a }}"), ("", ""), (None, None), ("- , -", ""),
    ]
    assert evaluate(spark, fill, "string", [a for a, _ in pairs]) == [b for _, b in pairs]


def test_localized(spark):
    labels = {"en": {"if": "IF %{value}", "x": "X"}, "zh": {"if": "影响因子 %{value}"}}
    rows = spark.createDataFrame([("if", "zh"), ("x", "zh"), ("no", "en"), ("if", "fr")], "k string, l string")
    got = [r[0] for r in rows.select(s.localized(F.col("k"), F.col("l"), labels, "en", value=F.lit(3))).collect()]
    assert got == ["影响因子 3", "X", "no", "IF 3"]


def test_first_truthy(spark):
    table = [(True, None, True), (False, None, None), (None, False, False), (False, True, True), (False, False, False), (None, None, None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(table)], "i int, a boolean, b boolean")
    got = [r[0] for r in rows.orderBy("i").select(s.first_truthy(F.col("a"), F.col("b"))).collect()]
    assert got == [c for _, _, c in table]


def test_oa_tag(spark):
    table = [(True, None, "diamond-oa"), (False, True, "oa"), (None, False, "非oa"), (None, None, None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(table)], "i int, a boolean, b boolean")
    got = [r[0] for r in rows.orderBy("i").select(tags.oa_tag(F.col("a"), F.col("b"))).collect()]
    assert got == [c for _, _, c in table]


def test_split_setting(spark):
    assert evaluate(spark, s.split_setting, "string", ["a, b|| c ,"]) == [["a", "b", "c"]]


def test_truncated_with_counting_mark(spark):
    got = evaluate(spark, lambda c: s.truncated(c, 10, "...", mark_counts=True), "string", ["abcdefghijk", "short", None])
    assert got == ["abcdefg...", "short", None]
