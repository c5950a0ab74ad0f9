"""Variant spellings of organisation names, linked to the organisation they name.

Spellings are read once each into a kind of organisation, its content words, a
given name and a short form. Distinct readings are the records of a
set-similarity join: their sets are the q-grams of their content words, a gram
weighs more the rarer it is, and only the prefix of rarest grams of the smaller
set, which any similar set must touch, is joined with the larger one. Candidate pairs are verified by a soft
weighted token similarity that knows abbreviations, misspellings and
nicknames, and that turns a different kind or subject into a conflict.
Verified pairs are closed to components, one an organisation.

Short forms (acronyms, coined names, "... Group") share no words with the name
they stand for. They join the organisation that states them in brackets or
that they stand beside in the same record most often, if their letters fit.

Defined cases
-------------
* null, blank and filler values and values marked as cut off are no names;
* strings that differ only in formatting are variants of each other;
* a short form that fits no organisation, or two equally well, is decided by
  the number of records, then by the least component; one that fits none stays alone;
* repeated rows and extra columns change nothing; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.name_rules import alias_fits, compare, read_name
from shelfmark.llm.survivorship import filled
from shelfmark.operators.components import components
from shelfmark.session import stored

Q = 4  # letters in a gram
LEAST_OVERLAP = 0.25  # weighted share of a set's grams that a similar set has in common
LEAST_SIMILARITY = 0.7  # soft weighted token similarity of variants

# Strings that may be short forms; reading them decides.
_SHORT = r"^\W*([A-Z]{3,5}|[A-Z][a-z]{2,}[A-Z][a-z]+[A-Z][a-z]*)\W*$|(?i)\bgroup\b"


def _read(name: str) -> Column:
    @F.pandas_udf("kind string, given string, tokens array<string>, alias string, alias_only string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        none = {"kind": None, "given": None, "tokens": None, "alias": None, "alias_only": None}
        for names in batches:
            yield pd.DataFrame([read_name(n) or none for n in names], columns=list(none))

    return read(name)


def _grams(tokens: Column) -> Column:
    """The distinct q-grams of all tokens, each token with a mark before it."""
    padded = F.transform(tokens, lambda t: F.concat(F.lit("^"), F.regexp_replace(t, r"\.$", "")))
    parts = F.transform(
        padded,
        lambda t: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(t) - Q + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(Q))
        ),
    )
    return F.array_distinct(F.flatten(parts))


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs of readings whose weighted gram sets may overlap by LEAST_OVERLAP.

    ``nodes`` has node, kind, given, tokens, dfs. Returns both sides' columns
    with the suffixes _a and _b, once per pair.
    """
    grams = nodes.select("node", F.explode(_grams(F.col("tokens"))).alias("gram"))
    total = math.log(max(2, nodes.count()))
    # A gram of one set only cannot be shared; most are misspellings and would weigh most.
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Squared, so that rare grams outweigh the common ones of subjects.
    weighed = grams.join(df, "gram").withColumn("w", F.pow(F.lit(total + 0.1) - F.log("df"), 2))
    order = Window.partitionBy("node").orderBy(F.col("df"), F.col("gram"))
    whole = weighed.withColumn("all", F.sum("w").over(Window.partitionBy("node")))
    # What lies beyond the prefix is too little for the smaller set's share, so its prefix meets the larger set.
    prefix = whole.withColumn("before", F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where(
        F.col("before") <= (1 - LEAST_OVERLAP) * F.col("all")
    )
    kinds = nodes.select("node", "kind")
    small = prefix.join(kinds, "node").select("gram", *(F.col(c).alias(f"{c}_s") for c in ("node", "kind", "all")))
    large = whole.join(kinds, "node").select("gram", *(F.col(c).alias(f"{c}_l") for c in ("node", "kind", "all")))
    met = small.join(large, "gram").where(
        "(all_s < all_l or (all_s = all_l and node_s < node_l)) and (kind_s = kind_l or kind_s = '' or kind_l = '')"
    )
    pairs = met.select(F.least("node_s", "node_l").alias("node_a"), F.greatest("node_s", "node_l").alias("node_b")).distinct()
    sets = whole.groupBy("node").agg(F.any_value("all").alias("all"), F.collect_list(F.struct("gram", "w")).alias("grams"))
    side = sets.join(nodes, "node")
    for x in ("a", "b"):
        pairs = pairs.join(side.select(*(F.col(c).alias(f"{c}_{x}") for c in side.columns)), f"node_{x}")
    both = F.array_intersect("grams_a", "grams_b")
    pairs = pairs.withColumn("shared", F.aggregate(both, F.lit(0.0), lambda t, g: t + g["w"]))
    return pairs.where(F.col("shared") >= LEAST_OVERLAP * F.least("all_a", "all_b")).drop("grams_a", "grams_b")


def _similarity(n_nodes: int):
    @F.pandas_udf("double")
    def similar(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for x, y in zip(a.itertuples(index=False), b.itertuples(index=False), strict=True):
            df = dict(zip(x.tokens, x.dfs, strict=True)) | dict(zip(y.tokens, y.dfs, strict=True))
            out.append(
                compare(
                    {"kind": x.kind, "given": x.given, "tokens": list(x.tokens)},
                    {"kind": y.kind, "given": y.given, "tokens": list(y.tokens)},
                    df,
                    lambda t, df=df: math.log(1 + n_nodes / df.get(t, 1)),
                )
            )
        return pd.Series(out, dtype="float64")

    return similar


def readings(rows: DataFrame) -> DataFrame:
    """Each distinct name with its number of rows and its reading.

    ``rows`` has ``names``, the names that stand in one record.
    """
    each = rows.select(F.explode(F.array_distinct("names")).alias("name")).where(filled(F.col("name")))
    counted = each.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    read = counted.withColumn("r", _read("name")).where("r.alias_only is not null")
    return read.select(
        "name", "n", "r.kind", "r.given", "r.tokens", "r.alias", "r.alias_only",
        F.xxhash64("r.kind", "r.given", "r.tokens").alias("node"),
    )


def organisations(rows: DataFrame) -> DataFrame:
    """The organisation of every name: name, org, n.

    ``rows`` has ``names``, the names that stand in one record; names beside
    each other are evidence for short forms.
    """
    read = stored(readings(rows), "readings")
    full = read.where("alias_only = ''")
    plain = full.groupBy("node").agg(
        F.any_value("kind").alias("kind"), F.any_value("given").alias("given"), F.any_value("tokens").alias("tokens")
    )
    each = plain.select("node", F.posexplode("tokens").alias("pos", "token"))
    df = each.groupBy("token").agg(F.count_distinct("node").cast("int").alias("df"))
    dfs = (
        each.join(df, "token")
        .groupBy("node")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "df"))), lambda x: x["df"]).alias("dfs"))
    )
    nodes = stored(plain.join(dfs, "node"), "nodes")
    n_nodes = nodes.count()
    sides = [F.struct(*(F.col(f"{c}_{s}").alias(c) for c in ("kind", "given", "tokens", "dfs"))) for s in "ab"]
    linked = candidates(nodes).withColumn("sim", _similarity(n_nodes)(*sides)).where(F.col("sim") >= LEAST_SIMILARITY)
    labels = components(linked.select(F.col("node_a").alias("src"), F.col("node_b").alias("dst")))
    of_node = nodes.join(labels, "node", "left").select(
        "node", "tokens", F.coalesce("component", "node").alias("org")
    )
    named = full.join(of_node.select("node", "org"), "node").select("name", "n", "alias", "node", "org")
    named = stored(named, "named")
    short = _short_forms(rows, read.where("alias_only <> ''"), named, of_node)
    return named.select("name", "org", "n").unionByName(short)


def _fits(alias: str, kind: str, tokens: str) -> Column:
    @F.pandas_udf("boolean")
    def fits(alias: pd.Series, kind: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([alias_fits(a, k, list(t)) for a, k, t in zip(alias, kind, tokens, strict=True)], dtype=bool)

    return fits(alias, kind, tokens)


def _short_forms(rows: DataFrame, short: DataFrame, named: DataFrame, of_node: DataFrame) -> DataFrame:
    """The organisation of each short form: name, org, n."""
    short = short.select("name", "n", "alias", "alias_only")
    # Beside a name of the organisation in the same record.
    beside = (
        rows.where(F.exists("names", lambda x: x.rlike(_SHORT)))
        .select(F.array_distinct("names").alias("names"))
        .select(F.explode("names").alias("short_name"), "names")
        .where(F.col("short_name").rlike(_SHORT))
        .select("short_name", F.explode("names").alias("name"))
        .where("name <> short_name")
        .groupBy("short_name", "name")
        .agg(F.count(F.lit(1)).alias("beside"))
    )
    s = short.withColumnRenamed("name", "short_name").withColumnRenamed("n", "short_n")
    near = beside.join(named.select("name", "node", "org"), "name").join(s.select("short_name", "alias", "alias_only"), "short_name")
    near = near.join(of_node.select("node", "tokens"), "node").where(_fits("alias", "alias_only", "tokens"))
    near = near.groupBy("short_name", "org").agg((2.0 * F.sum("beside")).alias("score"))
    # Stated in brackets behind a name of the organisation.
    stated = (
        named.where("alias <> ''").groupBy("alias", "org").agg(F.sum("n").cast("double").alias("score"))
        .join(s.where("alias_only = 'acronym'").select("short_name", "alias"), "alias")
        .select("short_name", "org", "score")
    )
    # Its words begin alike; this decides only where there is nothing else.
    sizes = named.groupBy("org").agg(F.sum("n").alias("rows"))
    head = of_node.select("node", "org", "tokens", F.explode(F.array_distinct(F.transform("tokens", lambda t: F.left(t, F.lit(3))))).alias("head"))
    alike = (
        s.where("alias_only in ('brand', 'group')")
        .withColumn("head", F.lower(F.left("alias", F.lit(3))))
        .join(head, "head")
        .where(_fits("alias", "alias_only", "tokens"))
        .join(sizes, "org")
        .groupBy("short_name", "org")
        .agg((F.max("rows") / F.lit(1e12)).alias("score"))
    )
    scores = near.unionByName(stated).unionByName(alike).groupBy("short_name", "org").agg(F.sum("score").alias("score"))
    best = scores.groupBy("short_name").agg(F.min_by("org", F.struct(-F.col("score"), F.col("org"))).alias("org"))
    # One that fits none is an organisation of its own, as is its like in other writings.
    return s.join(best, "short_name", "left").select(
        F.col("short_name").alias("name"),
        F.coalesce("org", F.xxhash64("alias_only", "alias")).alias("org"),
        F.col("short_n").alias("n"),
    )


def publisher_rows(catalogue: DataFrame) -> DataFrame:
    """The three publisher fields of each catalogue row as ``names``."""
    names = F.array(
        "unified.crossref_publisher", "unified.doaj_publisher", "sources.openalex.main.host_organization_name"
    )
    return catalogue.select(F.array_compact(names).alias("names"))


def variant_pairs(catalogue: DataFrame) -> DataFrame:
    """Every pair of different strings that name the same organisation."""
    orgs = stored(organisations(publisher_rows(catalogue)).select("name", "org"), "orgs")
    a = orgs.select("org", F.col("name").alias("name_a"))
    b = orgs.select("org", F.col("name").alias("name_b"))
    return a.join(b, "org").where("name_a < name_b").select("name_a", "name_b")


def variants(catalogue: DataFrame) -> DataFrame:
    """One row per name: name, n (rows), the organisation's most frequent name and its number of names."""
    orgs = stored(organisations(publisher_rows(catalogue)), "orgs")
    per = orgs.groupBy("org").agg(
        F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("preferred_name"),
        F.count(F.lit(1)).alias("n_names"),
    )
    return orgs.join(per, "org").select("name", "n", "preferred_name", "n_names")
