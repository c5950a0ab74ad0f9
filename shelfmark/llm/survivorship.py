"""The best representative of each group of duplicate records, field by field.

One aggregation per table: for every attribute the maximum of the composite
(source priority, timestamp, value) over the rows where the attribute is
really filled in. The aggregate is combined before the exchange, so a group
that holds a third of all rows costs one partial row per task.

Defined cases
-------------
* rows whose key is null belong to no group;
* null, blank and filler values and values marked as cut off are not filled
  in; a field with nothing filled in survives as null;
* a null timestamp is older than any other; of values with the same priority
  and timestamp the greater by code point survives, so repeated rows change
  nothing;
* an empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.name_rules import FILLERS

FIELDS = ("crossref_publisher", "openalex_country", "wikidata_country", "scimago_country")
_EDGE = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"
_CUT = r"(?i)(\.\.\.|…|\[\.\.\.\]|\[…\]|\(cut\)|\(truncated\))[\s\p{Z}]*$"


def filled(value: Column) -> Column:
    """Whether a string is really filled in; never null."""
    text = F.lower(F.regexp_replace(value, _EDGE, ""))
    return F.coalesce(
        text.rlike(r"[\p{L}\p{N}]") & ~text.isin(*sorted(FILLERS)) & ~value.rlike(_CUT), F.lit(False)
    )


def survivors(
    records: DataFrame,
    key: Column,
    attributes: Mapping[str, Sequence[tuple[Column, int]]],
    updated: Column,
) -> DataFrame:
    """One row per key: ``key``, ``n_rows`` and the surviving value of each attribute.

    ``attributes`` names each output field and the columns that it may come
    from, each with its priority; the highest priority wins, then the latest
    ``updated``.
    """
    inputs, best = [], []
    for name, sources in attributes.items():
        picks = []
        for i, (value, priority) in enumerate(sources):
            col = f"__{name}_{i}"
            inputs.append(
                F.when(
                    filled(value), F.struct(F.lit(priority).alias("p"), updated.alias("t"), value.alias("v"))
                ).alias(col)
            )
            picks.append(F.max(col))
        best.append((picks[0] if len(picks) == 1 else F.greatest(*picks)).getField("v").alias(name))
    rows = records.select(key.alias("key"), *inputs).where("key is not null")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), *best)


def best_values(catalogue: DataFrame) -> DataFrame:
    """The four fields of every ``unified.id`` that has two rows or more, in long form."""
    u = F.col("unified")
    one = survivors(
        catalogue,
        u.getField("id"),
        {f: [(u.getField(f), 0)] for f in FIELDS},
        F.col("fetched_at"),
    ).where("n_rows >= 2")
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("best_value")) for f in FIELDS))
    return (
        one.select(F.col("key").alias("unified_id"), F.explode(pairs).alias("x"))
        .select("unified_id", "x.field_name", "x.best_value")
        .where("best_value is not null")
    )


def surviving_records(catalogue: DataFrame) -> DataFrame:
    """One record per ``unified.id``: a name, a publisher and a country chosen over all sources.

    The publisher comes from crossref before openalex before doaj, the country
    from wikidata before scimago before openalex before doaj.
    """
    u = F.col("unified")
    host = F.col("sources.openalex.main.host_organization_name")
    return survivors(
        catalogue,
        u.getField("id"),
        {
            "canonical_name": [(u.getField("canonical_name"), 0)],
            "issn_l": [(u.getField("issn_l"), 0)],
            "publisher": [(u.getField("crossref_publisher"), 3), (host, 2), (u.getField("doaj_publisher"), 1)],
            "country": [
                (u.getField("wikidata_country"), 4),
                (u.getField("scimago_country"), 3),
                (u.getField("openalex_country"), 2),
                (u.getField("doaj_country"), 1),
            ],
        },
        F.col("fetched_at"),
    ).withColumnRenamed("key", "unified_id")
