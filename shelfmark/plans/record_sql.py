"""SQL for DuckDB that derives canonical records by itself, for the queries that are built on them.

Constants are written out here and not taken from the library.
"""

from __future__ import annotations

_NUM = r"^\s*([+-]?\d+(\.\d+)?([eE][+-]?\d+)?)"


def _number(text: str) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract({text}, '{_NUM}', 1), '') AS DOUBLE), 0.0::DOUBLE)"


def _blank(text: str) -> str:
    return rf"({text} IS NULL OR regexp_matches({text}, '^[\s\x{{00A0}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{3000}}\x{{FEFF}}]*$'))"


def _years(source: str) -> str:
    """The rows of a source with a year, the latest first."""
    return (
        f"list_sort(list_transform(list_filter(coalesce(s.{source}.all_years, []), lambda y: y.year IS NOT NULL),"
        " lambda y, i: {'y': -y.year, 'i': i, 'q': y.quartile, 'v': y.value}))"
    )


def _has(source: str) -> str:
    return f"len(list_filter(coalesce(s.{source}.all_years, []), lambda y: y IS NOT NULL)) > 0"


RECORDS = f"""
r0 AS (SELECT unified.id AS uid, unified AS u, cover, issn_details, sources AS s FROM catalogue WHERE unified.id IS NOT NULL),
r AS (SELECT uid, u.canonical_name AS title, u.issn_l AS issn_l, cover.cover_url AS cover_url,
  coalesce(s.wikidata.main.iso4_abbreviation, s.openalex.alternate_titles[1].title) AS abbreviation,
  list_transform(list_filter(coalesce(issn_details, []), lambda x: x IS NOT NULL), lambda x: x.issn) AS issns,
  list_filter(list_transform(coalesce(s.openalex.alternate_titles, []), lambda x: x.title), lambda x: x IS NOT NULL) AS alts,
  coalesce(u.openalex_type, s.openalex.main.type) AS oa_type,
  coalesce(s.openalex.main.homepage_url, s.wikidata.websites[1].url) AS homepage,
  coalesce(u.crossref_publisher, u.doaj_publisher, s.openalex.main.host_organization_name) AS publisher,
  s.openalex.main.host_organization AS publisher_id,
  coalesce(u.openalex_country, u.doaj_country, s.openalex.main.country_code) AS cc,
  coalesce(u.wikidata_country, u.scimago_country, s.wikidata.main.country_label) AS cn,
  s.openalex.main.first_publication_year AS fy, s.openalex.main.last_publication_year AS ly,
  coalesce(u.openalex_works_count, s.openalex.main.works_count) AS works,
  coalesce(u.openalex_cited_by_count, s.openalex.main.cited_by_count) AS cited,
  u.openalex_h_index::BIGINT AS h, u.openalex_i10_index::BIGINT AS i10, u.openalex_2yr_mean_citedness AS citedness,
  CASE WHEN {_has("jcr")} THEN {_years("jcr")} WHEN s.jcr.main IS NULL THEN NULL
    WHEN s.jcr.main.year IS NULL THEN [] ELSE [{{'y': -s.jcr.main.year, 'i': 1, 'q': NULL, 'v': s.jcr.main.value}}] END AS jcr,
  CASE WHEN {_has("scimago")} THEN {_years("scimago")} WHEN s.scimago.main IS NOT NULL THEN [] END AS sjr,
  CASE WHEN {_has("fqb")} THEN {_years("fqb")} WHEN s.fqb.main IS NOT NULL THEN [] END AS cas,
  CASE WHEN {_has("gjqk")} THEN list_transform({_years("gjqk")}, lambda x: {{'y': x.y, 'level': NULL::VARCHAR}}) WHEN s.gjqk.main IS NULL THEN NULL
    WHEN s.gjqk.main.year IS NULL THEN [] ELSE [{{'y': -s.gjqk.main.year, 'level': s.gjqk.main.level}}] END AS warn,
  CASE WHEN u.openalex_is_oa THEN true ELSE s.openalex.main.is_oa END AS is_oa,
  CASE WHEN u.doaj_is_in_doaj THEN true END AS in_doaj,
  CASE WHEN u.doaj_has_apc THEN true ELSE s.doaj.main.apc_has_apc END AS has_apc,
  s.scimago.main.open_access_diamond AS diamond, s.doaj.main.boai AS boai, s.doaj.main.publication_time_weeks AS weeks,
  s.fqb.main.review AS cas_review, s.fqb.main.oaj AS cas_oaj, s.fqb.main.top AS cas_top,
  list_filter(coalesce(s.openalex.topics, []), lambda t: t.display_name IS NOT NULL)[1:8] AS topics,
  list_filter(list_transform(coalesce(s.doaj.keywords, []), lambda x: x.keyword), lambda x: x IS NOT NULL) AS keywords,
  list_filter(list_transform(coalesce(s.doaj.subjects, []), lambda x: coalesce(x.term, x.code)), lambda x: x IS NOT NULL) AS subjects,
  list_transform(list_sort(list_transform(list_filter(coalesce(s.openalex.counts_by_year, []), lambda y: y.year IS NOT NULL AND y.works_count IS NOT NULL),
    lambda y, i: {{'y': -y.year, 'i': i, 'w': y.works_count, 'o': coalesce(y.oa_works_count, 0), 'c': coalesce(y.cited_by_count, 0)}}))[1:15], lambda x: x) AS counts,
  list_sort(list_transform(list_filter(coalesce(s.crossref.dois_by_year, []), lambda y: y.year IS NOT NULL AND y.count IS NOT NULL),
    lambda y, i: {{'y': -y.year, 'i': i, 'n': y.count}}))[1:15] AS dois,
  s.crossref IS NOT NULL AS has_crossref, s.scirev.main IS NOT NULL AS has_scirev, s.scirev.main.overall_rating AS rating,
  s.ccf.main IS NOT NULL AS has_ccf, s.ccf.main.rank AS ccf_rank, s.wikidata.main IS NOT NULL AS has_wiki,
  s.wikidata.main.inception AS inception, s.wikidata.main.frequency_label AS frequency
FROM r0)"""

_PUBLISHERS = (
    "Elsevier|Springer Nature|Wiley|Taylor & Francis|SAGE|Oxford University Press|Cambridge University Press|IEEE|ACM|MDPI|Frontiers|PLOS|BMJ|"
    "Wolters Kluwer|American Chemical Society|Royal Society of Chemistry|De Gruyter|Emerald|IOP Publishing|Nature Publishing Group"
)
_SHORT = {
    "Oxford University Press": "oxford-univ-press", "Cambridge University Press": "cambridge-univ-press", "American Chemical Society": "acs",
    "Royal Society of Chemistry": "rsc", "Nature Publishing Group": "nature-pub-group",
}


def _house(name: str) -> str:
    whens = " ".join(f"WHEN contains(lower({name}), '{p.lower()}') THEN '{p}'" for p in _PUBLISHERS.split("|"))
    return f"CASE {whens} END"


def _clean(text: str) -> str:
    return rf"nullif(regexp_replace(lower(trim({text})), '\s+', '-', 'g'), '')"


_ZONE = r"nullif(regexp_extract(cas[1].q, '(\d+)', 1), '')"


def _tag_rows() -> str:
    house = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SHORT.items())
    rules = {
        "jcr_quartile": "CASE WHEN upper(jcr[1].q) IN ('Q1', 'Q2', 'Q3', 'Q4') THEN 'jcr:' || lower(jcr[1].q) END",
        "sjr_quartile": "CASE WHEN upper(sjr[1].q) IN ('Q1', 'Q2', 'Q3', 'Q4') THEN 'sjr:' || lower(sjr[1].q) END",
        "cas_zone": f"CASE WHEN try_cast({_ZONE} AS INTEGER) BETWEEN 1 AND 4 THEN '中科院:' || {_ZONE} || '区' END",
        "ccf_rank": r"CASE WHEN upper(regexp_replace(ccf_rank, '\s+', '', 'g')) IN ('A', 'B', 'C') THEN 'ccf:' || lower(regexp_replace(ccf_rank, '\s+', '', 'g')) END",
        "oa_status": "CASE WHEN diamond THEN 'diamond-oa' WHEN is_oa THEN 'oa' WHEN NOT is_oa THEN '非oa' END",
        "doaj": "CASE WHEN in_doaj THEN 'doaj收录' END",
        "warning": f"CASE WHEN NOT {_blank('warn[1].level')} THEN {_clean(chr(39) + '预警:' + chr(39) + ' || trim(warn[1].level)')} END",
        "country": _clean(f"CASE WHEN NOT {_blank('cn')} THEN cn ELSE cc END"),
        "publisher": f"CASE house {house} ELSE {_clean('house')} END",
    }
    parts = [f"SELECT uid AS unified_id, '{g}' AS tag_group, {e} AS tag FROM (SELECT *, {_house('publisher')} AS house FROM r)" for g, e in rules.items()]
    return f"tg AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE tag IS NOT NULL)"


TAGS = f"{RECORDS}, {_tag_rows()}"

_CHARTS = {
    "sjr": ("sjr", "sjr", _number("replace(x.v, ',', '.')")),
    **{c: ("sjr", f, "0.0::DOUBLE") for c, f in (("total_docs", "total_docs_year"), ("cites_per_doc", "citations_per_doc_2years"), ("female_pct", "female_pct"), ("refs_per_doc", "ref_per_doc"), ("policy_docs", "overton"), ("sdg_docs", "sdg"))},
    "annual_citations": ("counts", "cited_by_count", "x.c::DOUBLE"),
    "works_vs_oa/a": ("counts", "works_count", "x.w::DOUBLE"),
    "works_vs_oa/b": ("counts", "oa_works_count", "x.o::DOUBLE"),
    "total_citations_wide": ("counts", "cited_by_count", "x.c::DOUBLE"),
    "dois_by_year": ("dois", "count", "x.n::DOUBLE"),
    "oa_works_trend": ("counts", "oa_works_count", "x.o::DOUBLE"),
    "jcr_if": ("jfs", "impact_factor", _number("x.v")),
}


def _charts() -> str:
    parts = [
        f"SELECT uid AS unified_id, '{c.split('/')[0]}' AS chart, '{f}' AS field, (len(l) - i + 1)::INTEGER AS place, -x.y::BIGINT AS year, {v} AS value"
        f" FROM (SELECT uid, l, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT uid, {src} AS l FROM rr WHERE len({src}) >= 2))"
        for c, (src, f, v) in _CHARTS.items()
    ]
    return f"rr AS (SELECT *, list_filter(jcr, lambda x: x.v IS NOT NULL) AS jfs FROM r), ch AS ({' UNION ALL '.join(parts)})"


_LINE = (
    "concat_ws(' | ', title, 'ISSN-L: ' || coalesce(issn_l, ''), 'Publisher: ' || publisher,"
    " 'IF: ' || jcr[1].v || ' (' || coalesce((-jcr[1].y)::VARCHAR, '') || ')', 'Works: ' || works, 'Cited by: ' || cited)"
)
_JIF = "jcr[1].v || ' (' || (-jcr[1].y) || ')'"
_SJR = f"CASE WHEN sjr[1].v IS NOT NULL THEN {_number('replace(sjr[1].v, chr(44), chr(46))')} END"


def _comma(number: str) -> str:
    return f"format('{{:,}}', {number}::BIGINT)"


def _excerpt() -> str:
    head = f"concat_ws(', ', coalesce(title, 'Unknown journal'), CASE WHEN NOT {_blank('publisher')} THEN 'published by ' || publisher END, CASE WHEN NOT {_blank('issn_l')} THEN 'ISSN: ' || issn_l END)"
    ranks = f"nullif(concat_ws(', ', 'Impact factor ' || {_JIF}, 'SJR ' || sjr[1].q), '')"
    stats = f"nullif(concat_ws(', ', {_comma('works')} || ' works', {_comma('cited')} || ' citations', 'h-index ' || h), '')"
    text = f"regexp_replace(concat_ws('. ', {head}, {ranks}, {stats}, CASE WHEN is_oa THEN 'Open access' END), '^[\\s\\v]+|[\\s\\v]+$', '', 'g')"
    dotted = f"(SELECT uid, CASE WHEN ends_with(t, '.') THEN t ELSE t || '.' END AS t FROM (SELECT uid, {text} AS t FROM r))"
    return f"WITH {RECORDS} SELECT uid AS unified_id, CASE WHEN length(t) > 300 THEN left(t, 297) || '...' ELSE t END AS excerpt FROM {dotted}"


def _narrative() -> str:
    volume = f"'It has published ' || {_comma('works')} || ' works with ' || {_comma('cited')} || ' citations.'"
    years = "'Years ' || fy || ' to ' || ly || '.'"
    access = "CASE WHEN is_oa THEN 'It is open access' ELSE 'It is not open access' END || CASE WHEN in_doaj THEN ' and listed in DOAJ.' ELSE ' and not listed in DOAJ.' END"
    impact = "'Impact factor ' || jcr[1].v || ' in ' || (-jcr[1].y) || coalesce(', ' || jcr[1].q, '') || '.'"
    rank = f"'SJR ' || printf('%.3f', {_SJR}) || coalesce(', ' || sjr[1].q, '') || '.'"
    return f"WITH {RECORDS} SELECT uid AS unified_id, concat_ws(' ', {volume}, {years}, {access}, {impact}, {rank}, 'Zone ' || {_ZONE} || '.') AS narrative FROM r"


def _long(values: dict[str, dict[str, str]], table: str = "r") -> str:
    parts = [
        f"SELECT uid AS unified_id, '{g}' AS card_group, '{n}' AS label, ({e})::VARCHAR AS value FROM {table}" for g, cards in values.items() for n, e in cards.items()
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE NOT {_blank('value')} AND value <> '—'"


def _first(items: str) -> str:
    """A list with each value once, where it comes first."""
    return f"list_transform(list_filter(list_transform({items}, lambda x, i: {{'x': x, 'i': i}}), lambda e: list_position({items}, e.x) = e.i), lambda e: e.x)"


_FIELDS = "list_filter(list_transform(topics, lambda t: concat_ws(' > ', t.field_display_name, t.domain_display_name)), lambda x: x <> '')"
_SITE = "regexp_replace(regexp_replace(homepage, '^https?://', ''), '/$', '')"
CARDS = {
    "basic": {
        "issn_l": "issn_l", "issns": "array_to_string(issns, ', ')", "aliases": f"array_to_string({_first('alts')}[1:5], ', ')", "abbreviation": "abbreviation",
        "homepage": _SITE, "type": "oa_type", "publisher": "publisher", "country": "coalesce(cn, cc)", "works": _comma("works"), "cited_by": _comma("cited"),
        "h_index": _comma("h"), "i10_index": _comma("i10"), "two_year_citedness": "printf('%.3f', citedness)", "first_year": "fy", "last_year": "ly",
    },
    "access": {"publication_time_weeks": "weeks"},
    "keywords": {
        "keywords": "array_to_string(keywords, ', ')", "subjects": "array_to_string(subjects, ', ')", "topic_fields": f"array_to_string({_first(_FIELDS)}, ', ')",
    },
}


def _metric_cards() -> str:
    level = lambda q: f"coalesce(nullif(regexp_extract({q}, '(?i)Q(\\d)', 1), ''), '1')"
    impact = "coalesce(jcr[1].v, '')"
    parts = [
        f"SELECT uid AS unified_id, 'jcr' AS card, coalesce(jcr[1].q, '') AS tier, {impact} AS value, {level('jcr[1].q')} AS level, NULL::VARCHAR AS warning FROM r WHERE len(jcr) > 0",
        f"SELECT uid, 'sjr', coalesce(sjr[1].q, ''), coalesce(printf('%.3f', {_SJR}), '—'), {level('sjr[1].q')}, NULL FROM r WHERE len(sjr) > 0",
        f"SELECT uid, 'cas', coalesce({_ZONE}, '—'), CASE WHEN len(jcr) > 0 THEN {impact} ELSE '—' END, coalesce({_ZONE}, ''), CASE WHEN NOT {_blank('warn[1].level')} THEN warn[1].level END FROM r WHERE len(cas) > 0",
        "SELECT uid, 'ccf', coalesce(ccf_rank, ''), '', coalesce(upper(nullif(regexp_extract(ccf_rank, '(?i)([ABC])', 1), '')), '?'), NULL FROM r WHERE has_ccf",
    ]
    return f"WITH {RECORDS} " + " UNION ALL ".join(parts)


def _flags() -> str:
    yes = lambda c: f"CASE WHEN NOT {_blank(c)} THEN trim({c}) = '是' END"
    flags = {"is_oa": "is_oa", "is_in_doaj": "in_doaj", "diamond_oa": "diamond", "has_apc": "has_apc", "boai": "boai", "cas_review": yes("cas_review"), "cas_top": yes("cas_top")}
    parts = [f"SELECT uid AS unified_id, '{n}' AS flag, {e} AS value FROM r" for n, e in flags.items()]
    return f"WITH {RECORDS} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL"


def _jsonld() -> str:
    numbers = "nullif(concat_ws(', ', 'Works: ' || works, 'Citations: ' || cited, 'H-Index: ' || h), '')"
    place = f"CASE WHEN NOT {_blank('cn')} THEN cn WHEN NOT {_blank('cc')} THEN cc END"
    there = lambda c: f"CASE WHEN NOT {_blank(c)} THEN {c} END"
    return (
        f"WITH {RECORDS} SELECT uid AS unified_id, title AS name, 'https://journals.example/t/' || uid AS url, {there('issn_l')} AS issn, {there('publisher')} AS publisher,"
        f" {there('cover_url')} AS image, NULL::VARCHAR AS keywords, {place} AS \"countryOfOrigin\", NULL::VARCHAR AS \"dateCreated\", NULL::VARCHAR AS \"dateModified\","
        f" CASE WHEN uid % 2 = 0 AND NOT {_blank(chr(39) + 'About ' + chr(39) + ' || title')} THEN 'About ' || title || coalesce('. ' || {numbers}, '') END AS description,"
        f" {there('abbreviation')} AS \"alternateName\", fy::VARCHAR AS \"startDate\", CASE WHEN is_oa THEN 'true' END AS \"isAccessibleForFree\","
        " 'Impact Factor: ' || jcr[1].v || ' (' || (-jcr[1].y) || ')' AS award,"
        " CASE WHEN len(subjects) > 0 THEN array_to_string(list_transform(subjects[1:5], lambda x: 'Thing:' || x), '|') END AS about FROM r"
    )


def _audit() -> str:
    """Every leaf of the catalogue; the list of leaves is that of TESTDATA and the tables."""
    text = {
        "unified": "canonical_name issn_l openalex_id openalex_type wikidata_qid crossref_publisher doaj_publisher openalex_country doaj_country wikidata_country scimago_country",
        "cover": "cover_url original_url",
        "sources.openalex.main": "type homepage_url host_organization_name host_organization country_code",
        "sources.wikidata.main": "iso4_abbreviation country_label inception frequency_label",
        "sources.jcr.main": "value", "sources.fqb.main": "review oaj top", "sources.gjqk.main": "level", "sources.letpub.main": "score", "sources.ccf.main": "rank category",
    }
    other = {
        "unified": "id openalex_works_count openalex_cited_by_count openalex_h_index openalex_i10_index openalex_2yr_mean_citedness openalex_is_oa doaj_is_in_doaj doaj_has_apc",
        "sources.crossref.main": "counts_total_dois counts_current_dois",
        "sources.openalex.main": "first_publication_year last_publication_year works_count cited_by_count apc_usd is_oa",
        "sources.doaj.main": "apc_has_apc boai publication_time_weeks", "sources.scimago.main": "open_access_diamond", "sources.jcr.main": "year",
        "sources.gjqk.main": "year", "sources.scirev.main": "first_round_weeks overall_rating",
    }
    lists = "issn_details sources.crossref.dois_by_year sources.openalex.alternate_titles sources.openalex.topics sources.openalex.counts_by_year sources.doaj.keywords sources.doaj.subjects sources.wikidata.websites sources.scimago.all_years sources.jcr.all_years sources.fqb.all_years sources.gjqk.all_years"
    rows = [f"('{p}.{n}', count(*) FILTER (WHERE {p}.{n} NOT IN ('', '—')))" for p, ns in text.items() for n in ns.split()]
    rows += [f"('{p}.{n}', count({p}.{n}))" for p, ns in other.items() for n in ns.split()]
    rows += [f"('{p}', count(*) FILTER (WHERE len({p}) > 0))" for p in lists.split()]
    pairs = ", ".join(f"{{'path': {r[1:].split(', ', 1)[0]}, 'n': {r[1:-1].split(', ', 1)[1]}}}" for r in rows)
    return f"SELECT x.path AS path, x.n AS n_rows FROM (SELECT unnest([{pairs}]) AS x FROM catalogue)"


def oracle_sql() -> dict[str, str]:
    presence = {
        "jcr": "jcr IS NOT NULL", "scimago": "sjr IS NOT NULL", "cas_partition": "cas IS NOT NULL", "warning": "warn IS NOT NULL",
        "crossref_quality": "has_crossref", "scirev": "has_scirev", "ccf": "has_ccf", "wikidata_meta": "has_wiki",
    }
    shown = "starts_with(t, 'jcr:') OR starts_with(t, 'sjr:') OR starts_with(t, 'ccf:') OR starts_with(t, '中科院:') OR t IN ('scie', 'ssci', 'esci', 'ahci')"
    nulls = ", ".join(f"NULL::VARCHAR AS {c}" for c in ("h_index", "total_docs_year", "total_docs_3years", "total_refs", "total_citations_3years", "citable_docs_3years", "overton", "sdg", "categories"))
    doubles = ", ".join(f"NULL::DOUBLE AS {c}" for c in ("citations_per_doc_2years", "ref_per_doc", "female_pct"))
    names = "SELECT page, pos, unnest([unified.crossref_publisher, unified.doaj_publisher, sources.openalex.main.host_organization_name]) AS name FROM catalogue"
    return {
        "section_presence": " UNION ALL ".join(f"SELECT '{n}' AS section, count(*) FILTER (WHERE {e}) AS n_records FROM r" for n, e in presence.items()).replace("SELECT", f"WITH {RECORDS} SELECT", 1),
        "section_scimago": f"WITH {RECORDS} SELECT uid AS unified_id, -y.y::BIGINT AS year, CASE WHEN y.v IS NOT NULL THEN {_number('replace(y.v, chr(44), chr(46))')} END AS sjr, y.q AS best_quartile, {nulls}, {doubles} FROM (SELECT uid, unnest(sjr) AS y FROM r)",
        "section_jcr_latest": f"WITH {RECORDS} SELECT uid AS unified_id, (-jcr[1].y)::BIGINT AS year, jcr[1].v AS impact_factor, jcr[1].q AS quartile, NULL::VARCHAR AS rank, NULL::VARCHAR AS category, len(jcr) AS n_years FROM r WHERE jcr IS NOT NULL",
        "section_open_access": f"WITH {RECORDS} SELECT uid AS unified_id, is_oa, in_doaj AS is_in_doaj, has_apc, diamond AS diamond_oa, boai, weeks::BIGINT AS publication_time_weeks, cas_review, cas_oaj, cas_top FROM r",
        "history_top15": f"WITH {RECORDS} SELECT uid AS unified_id, i - 1 AS rank, -x.y::BIGINT AS year, x.w AS works_count, x.c AS cited_by_count FROM (SELECT uid, unnest(counts) AS x, generate_subscripts(counts, 1) AS i FROM r)",
        "tag_assignments": f"WITH {TAGS} SELECT unified_id, tag_group, tag FROM tg",
        "tag_group_counts": f"WITH {TAGS} SELECT tag_group, count(*) AS n_tags, count(DISTINCT unified_id) AS n_records FROM tg GROUP BY 1",
        "tag_memberships_missing": f"WITH {TAGS} SELECT DISTINCT tag_group, tag FROM tg EXCEPT SELECT tag_group, tag FROM tg WHERE unified_id % 2 = 0",
        "tag_lists": f"WITH {TAGS} SELECT unified_id, array_to_string(list_sort(list_distinct(list(tag))), ', ') AS tags FROM tg GROUP BY 1",
        "tags_replaced": f"WITH {TAGS} SELECT DISTINCT unified_id, CASE WHEN unified_id % 2 = 0 THEN 'old-' || tag ELSE tag END AS tag FROM tg",
        "tag_highlights": f"WITH {TAGS}, ls AS (SELECT unified_id, list_filter(list_sort(list_distinct(list(tag))), lambda t: {shown})[1:3] AS l FROM tg GROUP BY 1) SELECT unified_id, array_to_string(l, '|') AS shown FROM ls WHERE len(l) > 0",
        "retired_groups": "SELECT name, count(*) AS n_rows FROM (SELECT ['JCR Quartile', 'SJR Quartile', '中科院分区', '中科院Top', 'CCF Rank', 'WoS Index', 'Open Access', 'DOAJ', '期刊预警', '学科分类', '国家/地区', '出版商', '影响因子', 'H指数', 'SJR值', '篇均被引', '审稿速度', '年发文量'][p_partkey % 18 + 1] AS name FROM part) WHERE name NOT IN ('影响因子', 'H指数', 'SJR值', '篇均被引', '审稿速度', '年发文量') GROUP BY 1",
        "contains_first_match": f"SELECT page, pos, name, {_house('name')} AS found FROM ({names}) WHERE name IS NOT NULL",
        "record_text": f"WITH {RECORDS} SELECT uid AS unified_id, {_LINE} AS plain_text FROM r",
        "record_excerpt": _excerpt(),
        "record_narrative": _narrative(),
        "record_flags": _flags(),
        "record_charts": f"WITH {RECORDS}, {_charts()} SELECT unified_id, chart, field, place, year, value FROM ch",
        "record_chart_table": f"WITH {RECORDS}, {_charts()}, g AS (SELECT unified_id, chart, field, year, value, place, count(*) AS n FROM ch GROUP BY ALL) SELECT unified_id, chart, field, row_number() OVER (PARTITION BY unified_id, chart, field ORDER BY year DESC, place, value)::INTEGER AS row, year, value, n FROM g",
        "record_warnings": f"WITH {RECORDS} SELECT uid AS unified_id, (len(warn) - i)::INTEGER AS place, -w.y::BIGINT AS year, w.level AS level, CASE w.level WHEN '高' THEN 'high' WHEN '中' THEN 'med' ELSE 'low' END AS severity FROM (SELECT uid, warn, unnest(warn) AS w, generate_subscripts(warn, 1) AS i FROM r)",
        "record_cards": f"WITH {RECORDS} {_long(CARDS)}",
        "record_indexing": f"WITH {RECORDS} " + _long({"indexing": {"inception": "inception", "frequency": "frequency"}}),
        "record_metric_cards": _metric_cards(),
        "record_hero": f"WITH {RECORDS} SELECT uid AS unified_id, coalesce(CASE WHEN NOT {_blank('title')} THEN title END, 'Unknown journal') AS title, publisher || CASE WHEN NOT {_blank('publisher_id')} THEN ' (' || publisher_id || ')' ELSE '' END AS subtitle, concat_ws(' | ', coalesce(CASE WHEN NOT {_blank('oa_type')} THEN oa_type END, 'journal'), CASE WHEN NOT {_blank('cc')} THEN cc END, CASE WHEN NOT {_blank('issn_l')} THEN 'ISSN-L ' || issn_l END) AS pills, {_SITE} AS homepage, CASE WHEN NOT {_blank('cn')} THEN cn WHEN NOT {_blank('cc')} THEN cc END AS country FROM r",
        "record_stars": f"WITH {RECORDS} SELECT uid AS unified_id, array_to_string([round(least(greatest(least(greatest(rating, 0), 5) - i, 0), 1) * 100)::INTEGER::VARCHAR FOR i IN range(0, 5)], '/') AS stars, round(least(greatest(rating * 20, 0), 100) / 100.0 * 200, 1) AS width FROM r WHERE rating IS NOT NULL",
        "jsonld": _jsonld(),
        "record_json": f"WITH {RECORDS} SELECT uid AS unified_id, title, publisher, h AS h_index, jcr[1].v AS impact_factor, topics[1].display_name AS topic, true AS keeps_nulls FROM r",
        "prepared_records": f"WITH {RECORDS} SELECT uid AS unified_id, title, {_LINE} AS raw_text, issn_l, publisher, cover_url, coalesce(cn, cc) AS country FROM r WHERE NOT {_blank('title')}",
        "leaf_audit": _audit(),
    }
