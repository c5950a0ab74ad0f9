"""Small catalogue and topic tables with the real schemas."""

from __future__ import annotations

CATALOGUE = """page int, pos int, fetched_at timestamp_ntz,
unified struct<id: bigint, canonical_name: string, issn_l: string, crossref_publisher: string, doaj_publisher: string,
openalex_country: string, doaj_country: string, wikidata_country: string, scimago_country: string>,
issn_details array<struct<issn: string>>,
sources struct<openalex: struct<main: struct<host_organization_name: string>>>, node string, key string"""


def catalogue(spark, rows):
    """Rows as dicts of unified's fields, with host, issns and at (seconds) besides."""
    import datetime as dt

    names = ["id", "canonical_name", "issn_l", "crossref_publisher", "doaj_publisher", "openalex_country", "doaj_country", "wikidata_country", "scimago_country"]
    out = []
    for i, r in enumerate(rows):
        if r is None:
            out.append((1, i, None, None, None, None, None, None))
            continue
        at = None if r.get("at") is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r["at"])
        issns = None if "issns" not in r else [None if x is None else (x,) for x in r["issns"]]
        host = ((r["host"],),) if "host" in r else None
        out.append((1, i, at, tuple(r.get(n) for n in names), issns, (host,) if host else None, "n", "k"))
    return spark.createDataFrame(out, CATALOGUE)


def topics(spark, titles):
    """Topics from (id, title)."""
    return spark.createDataFrame([(i, t, 12, "x") for i, t in titles], "topic_id bigint, title string, category_id int, cluster string")


def fields(spark, rows):
    """Attributes from (topic_id, name, value)."""
    return spark.createDataFrame([(n, *r, 1) for n, r in enumerate(rows)], "id bigint, topic_id bigint, name string, value string, n int")


DOCUMENTS = "doc_id bigint, text string, source string, block int, tokens int, key string, x int, item_id int"


def documents(spark, rows):
    """Documents from (id, text) or (id, text, source), with columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 1, 1, "k", 1, 1) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)
