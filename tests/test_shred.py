"""Nested records against a plain reading of each body, and defined cases."""

import json
from collections import Counter

from shelfmark.operators.shred import COLUMNS, _text, children, flat_table, shred, shred_body


def inner(v):
    while isinstance(v, str):
        try:
            w = json.loads(v.removeprefix("\ufeff"))
        except ValueError:
            return v
        if not isinstance(w, dict | list | str):
            return v
        v = w
    return v


def kids(value, key):
    value = inner(value)
    if isinstance(value, dict):
        if key in value:
            yield value
            return
        if "items" in value:
            value = inner(value["items"])
        else:
            for label, x in value.items():
                x = inner(x)
                if isinstance(x, dict):
                    yield x if key in x else x if label.isdigit() and len(label) < 4 else {key: label}
            return
    if isinstance(value, list):
        for x in map(inner, value):
            if isinstance(x, dict):
                yield x
            elif isinstance(x, str):
                yield {key: x}


def brute(rows):
    out = set()
    for rid, body in rows:
        try:
            j = inner(json.loads(body.removeprefix("\ufeff")))
        except (ValueError, AttributeError):
            continue
        found = [j]
        if isinstance(j, dict) and "success" in j:
            found = (inner(j.get("data")) or {}).get("rows") or []
        for x in found if isinstance(found, list) else [found]:
            u = inner(x.get("unified")) if isinstance(x, dict) else None
            if not isinstance(u, dict) or u.get("id") is None:
                continue
            uid, s, pairs = int(u["id"]), inner(x.get("sources")), []
            if isinstance(s, dict):
                pairs = list(s.items())
            elif isinstance(s, list):
                pairs = [(y.get("source"), {k: v for k, v in y.items() if k != "source"}) for y in s if isinstance(y, dict)]
            for name, v in pairs:
                v = inner(v)
                if not v:
                    continue
                out.add((rid, uid, "sources", name))
                if name == "openalex":
                    out |= {(rid, uid, "topics", y["display_name"]) for y in kids(v.get("topics"), "display_name") if y.get("display_name")}
                    out |= {(rid, uid, "counts_by_year", str(int(y["year"]))) for y in kids(v.get("counts_by_year"), "year") if y.get("year")}
            out |= {(rid, uid, "issn_details", y["issn"]) for y in kids(x.get("issn_details"), "issn") if y.get("issn")}
    return out


def test_whole_table_against_brute_force(spark, data):
    raw = spark.read.parquet(f"{data}/raw_records.parquet")
    got = {tuple(r) for r in children(raw).collect()}
    assert got == brute([(r.record_id, r.body) for r in raw.collect()]) and got


def run(spark, bodies):
    rows = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "record_id bigint, body string, label string")
    return {tuple(r) for r in children(rows).collect()}


def test_bodies_without_rows(spark):
    assert run(spark, [None, "", " ", "null", "[]", "{", '{"unified": {"id": 1}, "sou', "12", '"text"', "[" * 5000]) == set()
    assert run(spark, ['{"success": false, "error": "busy"}', '{"unified": null, "sources": {"jcr": {"main": 1}}}']) == set()


def test_shapes(spark):
    row = {
        "unified": {"id": "7"},
        "issn_details": {"0": {"issn": "1111-1111"}, "1": None},
        "sources": json.dumps(
            [
                {"source": "openalex", "topics": {"items": [{"display_name": "T"}, {"note": 1}], "total": 2}, "counts_by_year": {"2014": {"works_count": 1}, "2015": {}}},
                {"source": "jcr"},
                None,
            ]
        ),
    }
    got = run(spark, [json.dumps(json.dumps(row)), json.dumps({"success": True, "data": {"rows": [row, row]}})])
    want = {("issn_details", "1111-1111"), ("sources", "openalex"), ("topics", "T"), ("counts_by_year", "2014"), ("counts_by_year", "2015")}
    assert got == {(i, 7, *w) for i in (0, 1) for w in want}


def test_byte_order_marks(spark):
    row = {"unified": {"id": 7}, "issn_details": "\ufeff[{\"issn\": \"1111-1111\"}]", "sources": {"jcr": {"main": 1}}}
    body = json.dumps(row, ensure_ascii=False)
    bodies = ["\ufeff" + body, json.dumps("\ufeff" + body), "\ufeff", "\ufeff{", "\ufeff null"]
    assert run(spark, bodies) == {(i, 7, *w) for i in (0, 1) for w in [("issn_details", "1111-1111"), ("sources", "jcr")]}


def test_children_named_like_other_parts_of_a_source(spark):
    """Topics, years and sources that bear the name of a part that holds no children."""
    from shelfmark.operators.shred import LEAVE

    topics = {name: {"count": 1} for name in LEAVE}
    sources = {"openalex": {"topics": topics, "main": {"x": 1}}} | {name: {"y": 1} for name in LEAVE}
    got = run(spark, [json.dumps({"unified": {"id": 1}, "sources": sources})])
    want = {("topics", n) for n in LEAVE} | {("sources", n) for n in ("openalex", *LEAVE)}
    assert got == {(0, 1, *w) for w in want}


def test_adjacency_links_every_node_to_its_parent():
    body = json.dumps({"unified": {"id": 1, "a": [1, {"b": None}]}, "x": "[2]"})
    rows = list(shred_body(body, "unified"))
    nodes = {r[1] for r in rows}
    assert all(r[2] in nodes or r[1] == r[0] for r in rows)
    assert [(r[3], r[5], r[6]) for r in rows if r[5] == "scalar"] == [("id", "scalar", "1"), ("[]", "scalar", "1"), ("[]", "scalar", "2")]


def test_long_body_and_empty_table(spark):
    long = json.dumps({"unified": {"id": 3}, "issn_details": [{"issn": "x" * 300_000}]})
    assert len(run(spark, [long])) == 1
    none = spark.createDataFrame([], "record_id bigint, body string")
    assert children(none).count() == 0 and shred(none).count() == 0


def leaves(value, path=""):
    value = inner(value)
    if isinstance(value, dict | list):
        pairs = value.items() if isinstance(value, dict) else ((f"[{i}]", x) for i, x in enumerate(value))
        for label, x in pairs:
            yield from leaves(x, f"{path}.{label}" if path else label)
    else:
        yield path, value


def test_flat_tables_hold_the_children_of_the_whole_table(spark, data):
    raw = spark.read.parquet(f"{data}/raw_records.parquet")
    want = children(raw).collect()
    for child in COLUMNS:
        rows = flat_table(raw, child).collect()
        assert {(r.record_id, r.unified_id, r.key) for r in rows} == {tuple(r)[:2] + (r.child_key,) for r in want if r.child == child}
        assert len({(r.record_id, r.node) for r in rows}) == len(rows) and rows


def test_flat_sources_hold_every_value_of_the_whole_table(spark, data):
    raw = spark.read.parquet(f"{data}/raw_records.parquet")
    got, want = Counter(), Counter()
    for r in flat_table(raw, "sources").collect():
        got.update((r.record_id, r.unified_id, r.key, v.path, v.value) for v in r["values"])
    for rid, body in [(r.record_id, r.body) for r in raw.collect()]:
        try:
            j = inner(json.loads(body.removeprefix("\ufeff")))
        except (ValueError, TypeError):
            continue
        found = (inner(j.get("data")) or {}).get("rows") or [] if isinstance(j, dict) and "success" in j else j if isinstance(j, list) else [j]
        for x in found:
            u, s = (inner(x.get(k)) if isinstance(x, dict) else None for k in ("unified", "sources"))
            if isinstance(u, dict) and u.get("id") is not None:
                pairs = s.items() if isinstance(s, dict) else [(y["source"], y) for y in s or [] if isinstance(y, dict) and len(y) > 1]
                for name, v in pairs:
                    v = inner(v)
                    if v:
                        want.update((rid, int(u["id"]), name, p, _text(z)) for p, z in leaves(v))
    assert got == want and got


def test_flat_tables_keep_values_siblings_and_links(spark):
    topic = {"display_name": "T", "count": 3, "score": 0.5, "field_display_name": "F", "domain_display_name": "D", "x": {"y": ["z"]}}
    row = {
        "unified": {"id": 7},
        "issn_details": ["1111-1111", {"issn": "2222-2222", "note": "print"}],
        "sources": {
            "openalex": {
                "main": {"h": 1},
                "topics": [topic, topic],
                "counts_by_year": {"2014": {"works_count": "1", "oa_works_count": None, "cited_by_count": 9}, "2015": 4},
            }
        },
    }
    rows = spark.createDataFrame([(1, json.dumps(row))], "record_id bigint, body string")
    flat = {child: flat_table(rows, child).orderBy("node").collect() for child in COLUMNS}
    (source,) = flat["sources"]
    at = {v.path: v.node for v in source["values"]}
    topics, years, issns = flat["topics"], flat["counts_by_year"], flat["issn_details"]
    assert source.key == "openalex" and at["main.h"] and at["topics.[1].x.y.[0]"]
    assert [(t.key, t.ordinal, t["count"], t.score, t.field, t.domain) for t in topics] == [("T", i, 3, 0.5, "F", "D") for i in (0, 1)]
    assert topics[0].parent == topics[1].parent and topics[0].node != topics[1].node
    assert {t.source_node for t in topics + years} == {source.node} and {i.row_node for i in issns} == {source.row_node}
    assert [(v.path, v.value) for v in topics[1]["values"]][-1] == ("x.y.[0]", "z")
    assert [(y.key, y.works_count, y.oa_works_count, y.cited_by_count) for y in years] == [("2014", 1, None, 9), ("2015", None, None, None)]
    assert [(v.path, v.value) for v in years[1]["values"]] == [("", "4")]
    assert [(i.key, [(v.path, v.value) for v in i["values"]]) for i in issns] == [
        ("1111-1111", [("", "1111-1111")]),
        ("2222-2222", [("issn", "2222-2222"), ("note", "print")]),
    ]
