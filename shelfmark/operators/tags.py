"""Rule-based tags of canonical records, and the tag tables that they go to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalars import clean_tag, contains_first, first_digits, is_blank

# The publishers that get a tag, in the order in which they are tried.
MAJOR_PUBLISHERS = (
    "Elsevier",
    "Springer Nature",
    "Wiley",
    "Taylor & Francis",
    "SAGE",
    "Oxford University Press",
    "Cambridge University Press",
    "IEEE",
    "ACM",
    "MDPI",
    "Frontiers",
    "PLOS",
    "BMJ",
    "Wolters Kluwer",
    "American Chemical Society",
    "Royal Society of Chemistry",
    "De Gruyter",
    "Emerald",
    "IOP Publishing",
    "Nature Publishing Group",
)

# Publishers whose tag is not their name.
PUBLISHER_TAGS = {
    "Oxford University Press": "oxford-univ-press",
    "Cambridge University Press": "cambridge-univ-press",
    "American Chemical Society": "acs",
    "Royal Society of Chemistry": "rsc",
    "Nature Publishing Group": "nature-pub-group",
}

# Group keys and their names.
TAG_GROUPS = {
    "jcr_quartile": "JCR Quartile",
    "sjr_quartile": "SJR Quartile",
    "cas_zone": "中科院分区",
    "cas_top": "中科院Top",
    "ccf_rank": "CCF Rank",
    "wos_index": "WoS Index",
    "oa_status": "Open Access",
    "doaj": "DOAJ",
    "warning": "期刊预警",
    "subject": "学科分类",
    "country": "国家/地区",
    "publisher": "出版商",
}

# Groups of earlier versions that are cleaned up.
RETIRED_GROUPS = ("影响因子", "H指数", "SJR值", "篇均被引", "审稿速度", "年发文量")

WOS_INDEXES = ("scie", "ssci", "esci", "ahci")


# The tags that related items show, by prefix or as a whole, and how many.
HIGHLIGHT_PREFIXES = ("jcr:", "sjr:", "ccf:", "中科院:")
HIGHLIGHTS = 3


def highlighted(names: Column) -> Column:
    """The first tags of a list that are worth showing."""
    shown = lambda x: F.exists(F.array(*map(F.lit, HIGHLIGHT_PREFIXES)), lambda p: F.startswith(x, p)) | x.isin(*WOS_INDEXES)
    return F.slice(F.filter(names, shown), 1, HIGHLIGHTS)


def quartile_tag(quartile: Column, prefix: str) -> Column:
    """``prefix:qN`` for Q1 to Q4 in any case, else null."""
    return F.when(F.upper(quartile).isin("Q1", "Q2", "Q3", "Q4"), F.concat(F.lit(f"{prefix}:"), F.lower(quartile)))


def zone_tag(zone: Column) -> Column:
    """The first digits of a zone if they are 1 to 4; the digits are kept as written."""
    digits = first_digits(zone)
    return F.when(digits.try_cast("int").between(1, 4), F.concat(F.lit("中科院:"), digits, F.lit("区")))


def rank_tag(rank: Column) -> Column:
    letter = F.regexp_replace(F.upper(rank), r"\s+", "")
    return F.when(letter.isin("A", "B", "C"), F.concat(F.lit("ccf:"), F.lower(letter)))


def oa_tag(diamond: Column, is_oa: Column) -> Column:
    return F.when(diamond, "diamond-oa").when(is_oa, "oa").when(~is_oa, "非oa")


def publisher_tag(name: Column, publishers: Sequence[str] = MAJOR_PUBLISHERS) -> Column:
    """The tag of the first listed publisher that the name contains; substrings count."""
    found = contains_first(name, publishers)
    table = F.create_map(*(F.lit(x) for pair in PUBLISHER_TAGS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, found), clean_tag(found))


def tag_assignments(records: DataFrame, publishers: Sequence[str] = MAJOR_PUBLISHERS) -> DataFrame:
    """One row per tag of a canonical record: unified_id, tag_group, tag."""
    latest = lambda section: F.get(F.col(section), F.lit(0))
    jcr, sjr, cas, warn = (latest(s) for s in ("jcr", "scimago", "cas_partition", "warning"))
    pub = F.col("publication")
    place = F.when(~is_blank(pub["country_name"]), pub["country_name"]).otherwise(pub["country_code"])
    top = cas["top"].isin("true", "是", "yes", "1")
    level = F.when(~is_blank(warn["level"]), F.concat(F.lit("预警:"), F.trim(warn["level"])))
    index = F.lower(F.trim(cas["web_of_science"]))
    rules = {
        "jcr_quartile": quartile_tag(jcr["quartile"], "jcr"),
        "sjr_quartile": quartile_tag(sjr["best_quartile"], "sjr"),
        "cas_zone": zone_tag(cas["major_quartile"]),
        "cas_top": F.when(top, "中科院:top"),
        "ccf_rank": rank_tag(F.col("ccf.rank")),
        "wos_index": F.when(index.isin(*WOS_INDEXES), index),
        "oa_status": oa_tag(F.col("open_access.diamond_oa"), F.col("open_access.is_oa")),
        "doaj": F.when(F.col("open_access.is_in_doaj"), "doaj收录"),
        "warning": clean_tag(level),
        "subject": clean_tag(cas["major_category"]),
        "country": clean_tag(place),
        "publisher": publisher_tag(pub["publisher_name"], publishers),
    }
    rows = F.array_compact(
        F.array(*(F.when(tag.isNotNull(), F.struct(F.lit(g).alias("tag_group"), tag.alias("tag"))) for g, tag in rules.items()))
    )
    return records.select("unified_id", F.explode(rows).alias("x")).select("unified_id", "x.tag_group", "x.tag")


def replace_tags(current: DataFrame, assigned: DataFrame, id_col: str) -> DataFrame:
    """The tags after applying: records with new tags have just those, others keep theirs."""
    kept = current.join(assigned.select(id_col).distinct(), id_col, "left_anti")
    return kept.select(id_col, "tag").unionByName(assigned.select(id_col, "tag")).distinct()


def ensure_memberships(members: DataFrame, assigned: DataFrame) -> DataFrame:
    """The (tag_group, tag) pairs that have to be added to the memberships."""
    wanted = assigned.select("tag_group", "tag").distinct()
    return wanted.join(members.select("tag_group", "tag"), ["tag_group", "tag"], "left_anti")


def without_retired(groups: DataFrame, name: str = "name") -> DataFrame:
    """Tag groups without those of earlier versions."""
    return groups.where(~F.col(name).isin(*RETIRED_GROUPS))
