"""Topics and catalogue rows that describe the same journal, matched without keys.

Collective linkage in five steps, each over the whole of both tables:

1. Titles are read once each into the words of their main part. Misspelt words
   are mapped to the frequent word one edit away, found through words with one
   letter deleted; the main part of a parallel title is the one with the rarest
   word.
2. Candidate graph: distinct readings meet under keys made of word beginnings, a
   shared key weighing more the rarer it is. Meta-blocking prunes it to the
   heaviest keys of each reading, enough that readings with one damaged word
   still share one, and drops the edges whose words lie too far apart to be
   equal. Edges that stay are compared word by word, and the equal ones are
   closed to title clusters.
3. Within a title cluster, records that share an identifier, a publisher in
   whatever spelling, or a country are joined, and what they share is propagated
   to the records joined to them until nothing changes. So namesakes with another
   publisher and country fall apart.
4. Where no two groups of a cluster prove to be namesakes by their countries, the
   cluster is one journal; records without attributes join it.
5. Confidence: the similarity of a record to its journal is how much the records of
   the other side support its attributes, each by its own similarity and rare
   attributes more; that is propagated between both sides until it is stable.

Every topic of a group is paired with every catalogue id of it.

Defined cases
-------------
* blank titles match nothing; a null id is no record;
* series of a journal differ, whatever else agrees; subtitles and parallel titles
  may be missing on either side;
* identifiers count only if their check digit is right; filler and cut values
  never count; all values of an attribute count alike;
* repeated rows change nothing; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.countries import country_code
from shelfmark.llm.name_rules import alias_fits, compare, read_name, within_one
from shelfmark.llm.survivorship import filled
from shelfmark.llm.title_rules import STOP, read_title, same_title
from shelfmark.operators.components import components
from shelfmark.session import Stored, stored

BEGINNING = 4  # letters of a word that a block key holds
MOST_PAIRED = 12  # words of a title of which all pairs are keys
COMMON = 32  # readings under a key from which on they also meet by a third word
SURE = 6  # letters of that word of which one may be damaged
RARER = 5  # a misspelling is so many times rarer than the word it stands for
CLEARER = 20  # the word it is mapped to is so many times more frequent than any other
SAME_PUBLISHER = 0.7  # soft token similarity of two spellings of one publisher


def _issn_letters(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"[^0-9Xx]", ""))


def _checked(s: Column) -> Column:
    """Eight characters if their check digit is right, else null."""
    digit = lambda i: F.substring(s, i, 1).try_cast("int")
    last = F.when(F.substring(s, 8, 1) == "X", 10).otherwise(digit(8))
    total = sum((digit(i) * (9 - i) for i in range(2, 8)), digit(1) * 8) + last
    return F.when((F.length(s) == 8) & (s != "00000000") & (total % 11 == 0), s)


def valid_issn(value: Column) -> Column:
    """The eight characters of an ISSN with a right check digit, else null."""
    return _checked(_issn_letters(value))


def titles(topics: DataFrame, catalogue: DataFrame) -> DataFrame:
    """side, id, title of every record with a title; equal titles of an id once."""
    t = topics.select(F.lit("t").alias("side"), F.col("topic_id").alias("id"), F.col("title").alias("title"))
    c = catalogue.select(
        F.lit("c").alias("side"), F.col("unified.id").alias("id"), F.col("unified.canonical_name").alias("title")
    )
    return t.unionByName(c).where("id is not null and title is not null").distinct()


def _read(title: str) -> Column:
    @F.pandas_udf("array<struct<tokens: array<string>, series: string>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([read_title(t) for t in batch])

    return read(title)


def _close(a: str, b: str) -> Column:
    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return close(a, b)


def corrections(vocabulary: DataFrame) -> DataFrame:
    """word to the far more frequent word one edit away: word, right, df."""
    words = vocabulary.where(F.length("word") >= 1)
    shorter = F.transform(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr(F.col("word"), i + 1)),
    )
    keys = words.select("word", "df", F.explode(F.array_distinct(F.concat(F.array("word"), shorter))).alias("key"))
    low = keys.select("key", "word", "df")
    high = keys.select("key", F.col("word").alias("right"), F.col("df").alias("right_df"))
    met = low.join(high, "key").where(f"df * {RARER} <= right_df and word <> right").select("word", "right", "right_df").distinct()
    # Short words stand for stop words only; one edit is too much for others.
    ok = (F.length("word") >= 4) | F.col("right").isin(*STOP) | (F.length("right") >= 4)
    near = met.where(ok).where(_close("word", "right"))
    best = near.groupBy("word").agg(
        F.max_by(F.struct("right", "right_df"), F.struct("right_df", "right")).alias("x"),
        F.sort_array(F.collect_list("right_df"), asc=False).alias("dfs"),
    )
    # A word that may as well stand for another stays as it is and is compared as it is.
    clear = F.coalesce(F.get("dfs", F.lit(1)) * CLEARER <= F.col("x.right_df"), F.lit(True))
    stop = F.col("x.right").isin(*STOP) & (F.length("word") <= BEGINNING)
    return best.where(clear | stop).select("word", "x.right", F.col("x.right_df").alias("df"))


def readings(named: DataFrame) -> DataFrame:
    """Each distinct title's main part: title, node, tokens, dfs, series.

    ``named`` has title; equal titles are read once.
    """
    read = named.select("title").distinct().withColumn("parts", _read("title")).where(F.size("parts") > 0)
    words = stored(
        # Titles that differ in formatting only count once towards a word's frequency.
        read.select("title", F.xxhash64("parts").alias("wording"), F.posexplode("parts").alias("part", "p")).select(
            "title", "wording", "part", "p.series", F.posexplode("p.tokens").alias("pos", "token")
        ),
        "title-words",
    )
    full = words.where(~F.col("token").endswith(".")).groupBy(F.col("token").alias("word")).agg(F.count_distinct("wording").alias("df"))
    n = words.select("wording").distinct().count()
    stops = words.sparkSession.createDataFrame([(w, n) for w in sorted(STOP) if len(w) > 1], "word string, df long")
    vocabulary = full.unionByName(stops)
    right = corrections(vocabulary)
    known = (
        full.join(right.withColumnRenamed("df", "right_df"), "word", "left")
        .select("word", F.coalesce("right", "word").alias("right"), F.coalesce("right_df", "df").alias("df"))
    )
    bare = F.regexp_replace("token", r"\.$", "")
    put = (
        words.withColumn("word", bare)
        .join(known, "word", "left")
        # A dot behind a word in full use is punctuation; behind another it abbreviates.
        .withColumn("full", F.col("df").isNotNull() & (~F.col("token").endswith(".") | (F.col("df") >= 3)))
        .select(
            "title", "part", "series", "pos",
            F.when(F.col("full"), F.col("right")).otherwise(F.col("token")).alias("token"),
            F.when(F.col("full"), F.col("df")).otherwise(F.lit(1)).alias("df"),
            "full",
        )
        .where(~F.col("token").isin(*STOP))
    )
    parts = put.groupBy("title", "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", "token", "df"))).alias("w"),
        F.any_value("series").alias("series"),
        F.min(F.when(F.col("full"), F.col("df"))).alias("rarest"),
    )
    first = parts.groupBy("title").agg(
        F.min_by(F.struct("w"), F.struct(F.coalesce("rarest", F.lit(2**40)), F.col("part"))).alias("m"),
        F.max("series").alias("series"),
    )
    return first.select(
        "title",
        F.transform("m.w", lambda x: x["token"]).alias("tokens"),
        F.transform("m.w", lambda x: x["df"]).alias("dfs"),
        "series",
    ).withColumn("node", F.xxhash64(F.col("tokens"), F.col("series")))


def _keys(tokens: Column) -> Column:
    """Keys of a reading: beginnings of two of its words, in order; of short titles words by themselves too.

    Beyond MOST_PAIRED words only words at most four apart are paired: those
    are enough keys that one damaged word spoils but a few of them.
    """
    stem = F.transform(tokens, lambda t: F.left(F.regexp_replace(t, r"\.$", ""), F.lit(BEGINNING)))
    n = F.size(stem)
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(
                F.sequence(i + 1, F.when(n > MOST_PAIRED, F.least(n, i + 4)).otherwise(n)),
                lambda j: F.concat_ws("\t", F.element_at(stem, i), F.element_at(stem, j)),
            ),
        )
    )
    # Of two words one may be damaged, so each is a key by itself with its place; one word is its own key.
    placed = F.transform(stem, lambda w, i: F.concat_ws("\t", i, w))
    return F.array_distinct(F.when(n == 1, placed).when(n == 2, F.concat(pairs, placed)).otherwise(pairs))


def _near(a: Column, b: Column) -> Column:
    """Whether the words of two readings may be equal, one by one.

    Words that are equal but for one edit or a cut end differ by two edits at
    most up to the end of the shorter one; whatever differs more is no edge.
    """
    bare = lambda t: F.regexp_replace(t, r"\.$", "")

    def close(x: Column, y: Column) -> Column:
        size = F.least(F.length(bare(x)), F.length(bare(y)))
        return F.levenshtein(F.left(bare(x), size), F.left(bare(y), size), 2) >= 0

    return F.forall(F.zip_with(a, b, lambda x, y: (x == y) | close(x, y)), lambda c: c)


def _spread(rows: DataFrame) -> DataFrame:
    """The rows of readings under keys with how they meet there: common, meets, short.

    Under a rare key all meet. Under a common one two meet if the word in the
    place where the readings under the key differ most may be equal: its first
    SURE letters without one of them are shared by all words that are equal but
    for one edit or a cut end. A word of fewer letters (short) meets every one.
    """
    common = rows.where(f"df > {COMMON}")
    places = common.select("key", F.posexplode(F.transform("tokens", lambda t: F.left(t, F.lit(BEGINNING)))).alias("at", "stem")).distinct()
    best = places.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("at", F.struct("n", -F.col("at"))).alias("at"))
    word = F.regexp_replace(F.get("tokens", F.col("at")), r"\.$", "")
    cut = F.transform(F.sequence(F.lit(1), F.lit(SURE)), lambda i: F.xxhash64(F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.lit(SURE) - i))))
    is_common, short = F.col("at").isNotNull(), F.col("at").isNotNull() & (F.length(word) < SURE)
    meets = F.when(~is_common, F.array(F.lit(0).cast("bigint"))).when(~short, F.array_distinct(cut))
    return rows.join(best, "key", "left").select(*rows.columns, is_common.alias("common"), short.alias("short"), meets.alias("meets"))


def title_clusters(named: DataFrame) -> DataFrame:
    """The cluster of every title: title, cluster."""
    read = stored(readings(named), "title-readings")
    nodes = stored(
        read.groupBy("node").agg(
            F.any_value("tokens").alias("tokens"), F.any_value("dfs").alias("dfs"), F.any_value("series").alias("series")
        ),
        "title-nodes",
    )
    some = nodes.where(F.size("tokens") >= 1)
    keys = some.select("node", "series", F.size("tokens").alias("n"), F.explode(_keys(F.col("tokens"))).alias("key"))
    keys = keys.withColumn("key", F.xxhash64("key", "series", "n")).drop("series")
    df = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    # A rare key weighs more, so the heaviest come first.
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "key"))
    # One damaged word spoils n - 1 keys; among the n heaviest one is left that both have.
    kept = keys.join(df, "key").withColumn("rank", rank).where("rank <= n and df > 1").select("node", "key", "df")
    side = stored(_spread(kept.join(nodes, "node")), "title-keys")
    cols = ("key", "meets", "short", *nodes.columns)
    a = side.select((1.0 / F.log2(F.col("df") + 1)).alias("w"), "common", *(F.col(c).alias(f"{c}_a") for c in cols))
    b = side.select(F.col("common").alias("common_b"), *(F.col(c).alias(f"{c}_b") for c in cols))
    pair = "key_a = key_b and node_a < node_b and series_a = series_b and size(tokens_a) = size(tokens_b)"
    long_a, long_b = (x.where(f"not short_{c}").withColumn(f"meet_{c}", F.explode(f"meets_{c}")) for c, x in (("a", a), ("b", b)))
    # Two may share several ways to meet under a key; the least of them counts.
    once = F.expr("meet_a = meet_b and meet_a = array_min(array_intersect(meets_a, meets_b))")
    ways = (
        long_a.join(long_b, F.expr(pair) & once).drop("meet_a", "meet_b"),
        a.where("short_a").join(b.where("common_b"), F.expr(pair)),
        a.where("common and not short_a").join(b.where("short_b"), F.expr(pair)),
    )
    met = ways[0].unionByName(ways[1]).unionByName(ways[2])
    met = met.where(_near(F.col("tokens_a"), F.col("tokens_b"))).groupBy("node_a", "node_b").agg(
        F.sum("w").alias("weight"), *(F.any_value(c).alias(c) for c in ("tokens_a", "tokens_b", "dfs_a", "dfs_b"))
    )

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([same_title(list(w), list(x), list(y), list(z)) for w, x, y, z in zip(a, b, p, q, strict=True)], dtype=bool)

    edges = stored(met.where(same("tokens_a", "tokens_b", "dfs_a", "dfs_b")), "title-edges")
    short = lambda c: F.exists(c, lambda t: t.endswith("."))
    # Titles in full first; an abbreviated one joins if it means one cluster of them.
    whole = edges.where(~short("tokens_a") & ~short("tokens_b"))
    labels = components(whole.select(F.col("node_a").alias("src"), F.col("node_b").alias("dst")))
    both = edges.select(F.col("node_a").alias("x"), F.col("node_b").alias("y"), short("tokens_a").alias("sx"), short("tokens_b").alias("sy"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("sy").alias("sx"), F.col("sx").alias("sy")))
    to = (
        both.where("sx and not sy")
        .join(labels.withColumnRenamed("node", "y"), "y", "left")
        .groupBy("x")
        .agg(F.min(F.coalesce("component", "y")).alias("lo"), F.max(F.coalesce("component", "y")).alias("hi"))
    )
    joined = to.where("lo = hi").select(F.col("x").alias("node"), F.col("lo").alias("component"))
    known = labels.unionByName(joined)
    # Abbreviated titles that equal each other only: with the least of their kind.
    lone = (
        both.where("sx and sy").join(to.select("x"), "x", "left_anti")
        .groupBy("x").agg(F.min("y").alias("y"))
        .select(F.col("x").alias("node"), F.least("x", "y").alias("component"))
    )
    known = known.unionByName(lone)
    return read.join(known, "node", "left").select("title", F.coalesce("component", "node").alias("cluster"))


def attributes(topics: DataFrame, fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The attributes of records in long form: side, id, attr, value, n (rows).

    attr is i (identifier), p (publisher as written) or c (country).
    """
    f = fields.where("topic_id is not null and name in ('issn_l', 'publisher', 'country')").where(filled(F.col("value")))
    t = f.select(
        F.lit("t").alias("side"),
        F.col("topic_id").alias("id"),
        F.when(F.col("name") == "issn_l", "i").when(F.col("name") == "publisher", "p").otherwise("c").alias("attr"),
        "value",
    )
    u = "unified."
    issns = F.array_distinct(
        F.concat(F.array(F.col(u + "issn_l")), F.coalesce(F.transform("issn_details", lambda x: x["issn"]), F.array().cast("array<string>")))
    )
    pubs = F.array(u + "crossref_publisher", u + "doaj_publisher", "sources.openalex.main.host_organization_name")
    lands = F.array(*(u + f"{s}_country" for s in ("openalex", "doaj", "wikidata", "scimago")))
    struct = lambda attr: lambda x: F.struct(F.lit(attr).alias("attr"), x.alias("value"))
    c = (
        catalogue.where("unified.id is not null")
        .select(
            F.col("unified.id").alias("id"),
            F.explode(
                F.concat(F.transform(issns, struct("i")), F.transform(pubs, struct("p")), F.transform(lands, struct("c")))
            ).alias("x"),
        )
        .where(filled(F.col("x.value")))
        .select(F.lit("c").alias("side"), "id", "x.attr", "x.value")
    )
    # The letters that count are made once; a filter on the result would make them again, so the nulls go in the explode.
    both = t.unionByName(c).withColumn("letters", F.when(F.col("attr") == "i", _issn_letters(F.col("value"))))
    value = F.when(F.col("attr") == "i", _checked(F.col("letters"))).when(F.col("attr") == "c", country_code(F.col("value"))).otherwise(F.col("value"))
    long = both.select("side", "id", "attr", F.explode(F.array_compact(F.array(value))).alias("value"))
    return long.groupBy("side", "id", "attr", "value").agg(F.count(F.lit(1)).alias("n"))


def _same_publisher(a: str, b: str) -> Column:
    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        read = lru_cache(maxsize=50_000)(read_name)

        def one(x: str, y: str) -> bool:
            p, q = read(x), read(y)
            if p is None or q is None:
                return False
            if p["alias_only"] and q["alias_only"]:
                return p["alias"] == q["alias"]
            if p["alias_only"]:
                p, q = q, p
            if q["alias_only"]:
                return p["alias"] == q["alias"] or alias_fits(q["alias"], q["alias_only"], p["tokens"])
            return compare(p, q) >= SAME_PUBLISHER

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return same(a, b)


def grouped(topics: DataFrame, fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The journal of every record: side, id, journal (null where undecided)."""
    named = stored(titles(topics, catalogue), "titles")
    clusters = title_clusters(named)
    # Where the rows of an id differ in title, the most frequent cluster is the id's.
    of = named.join(clusters, "title").groupBy("side", "id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    of = of.groupBy("side", "id").agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("cluster"))
    of = stored(of, "of-cluster")

    long = attributes(topics, fields, catalogue)
    held = stored(
        long.join(of, ["side", "id"]).select(
            "side", "id", "cluster", "attr", F.when(F.col("attr") == "p", F.col("value")).alias("publisher"),
            F.xxhash64("cluster", "attr", "value").alias("av"),
        ),
        "held",
    )
    # What stands in one record belongs together.
    least = held.groupBy("side", "id").agg(F.min("av").alias("least"))
    beside = held.join(least, ["side", "id"]).where("av <> least").select(F.col("least").alias("src"), F.col("av").alias("dst"))
    # Spellings of one publisher within a cluster of titles; spellings that any record holds beside
    # each other need no comparison, and there are few distinct ones to a cluster.
    names = held.where("attr = 'p'").select("cluster", "av", "publisher").distinct()
    pairs = names.alias("x").join(names.alias("y"), "cluster").where("x.av < y.av")
    spelt = pairs.where(_same_publisher("x.publisher", "y.publisher")).select(F.col("x.av").alias("src"), F.col("y.av").alias("dst"))
    labels = components(beside.unionByName(spelt))
    of_av = held.drop("publisher").join(labels.withColumnRenamed("node", "av"), "av", "left").withColumn("comp", F.coalesce("component", "av"))
    # What each component knows decides which may be one journal.
    comps = of_av.groupBy("cluster", "comp").agg(F.max(F.col("attr") == "c").alias("c"))
    per = comps.groupBy("cluster").agg(
        F.count_if("c").alias("n_c"), F.min(F.when(F.col("c"), F.col("comp"))).alias("anchor"), F.min("comp").alias("any_comp")
    )
    # Namesakes differ in publisher and country: without a second country there is no proof of one.
    per = per.select("cluster", (F.col("n_c") <= 1).alias("one"), F.coalesce("anchor", "any_comp").alias("sole"))
    of_record = of_av.groupBy("side", "id").agg(F.min("comp").alias("comp"))
    joined = of.join(of_record, ["side", "id"], "left").join(per, "cluster", "left")
    journal = F.when(F.col("one").isNull(), F.col("cluster")).when(F.col("one"), F.col("sole")).otherwise(F.col("comp"))
    return joined.select("side", "id", F.struct("cluster", journal.alias("journal")).alias("journal")).where(
        "journal.journal is not null"
    )


def matches(topics: DataFrame, fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every pair of a topic and a catalogue id that mean one journal."""
    g = stored(grouped(topics, fields, catalogue), "journals")
    t = g.where("side = 't'").select("journal", F.col("id").alias("topic_id"))
    c = g.where("side = 'c'").select("journal", F.col("id").alias("unified_id"))
    return t.join(c, "journal").select("topic_id", "unified_id")


STABLE = 0.005  # the change of similarity below which propagation ends; confidences have two digits
MOST_ROUNDS = 40  # it ends here at the latest; as half of the old value stays, a change of one shrinks to STABLE in eight


def similarities(pairs: DataFrame, topics: DataFrame, fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """How well each paired record agrees with the other side of its journal: side, id, sim between 0 and 1.

    A record's similarity is the mean support of its attribute values, rare
    ones weighing more. A value's support is the share of similarity that those
    records of the other side have that hold it, among those that hold any value
    of the attribute. Both sides are recomputed from each other, half of the old
    value staying, until nothing changes by more than STABLE. Values of which
    the other side knows nothing don't count; a record without any has 0.
    """
    # All pairs of a journal are there, so its least catalogue id names it.
    of_t = pairs.groupBy("topic_id").agg(F.min("unified_id").alias("journal"))
    of_c = pairs.join(of_t, "topic_id").groupBy("unified_id").agg(F.min("journal").alias("journal"))
    members = of_t.select(F.lit("t").alias("side"), F.col("topic_id").alias("id"), "journal").unionByName(
        of_c.select(F.lit("c").alias("side"), F.col("unified_id").alias("id"), "journal")
    )
    letters = F.lower(F.regexp_replace("value", r"[^\p{L}\p{N}]+", ""))
    long = attributes(topics, fields, catalogue).withColumn("value", F.when(F.col("attr") == "p", letters).otherwise(F.col("value")))
    long = long.select("side", "id", "attr", F.xxhash64("attr", "value").alias("v")).distinct()
    rare = long.groupBy("v").agg((1.0 / F.log2(F.count(F.lit(1)) + 1)).alias("w"))
    held = long.join(members, ["side", "id"]).join(rare, "v")
    # Only values on whose attribute both sides of the journal say something.
    both = held.groupBy("journal", "attr").agg(F.count_distinct("side").alias("n")).where("n = 2").drop("n")
    held = stored(held.join(both, ["journal", "attr"]), "held-values")
    other = F.when(F.col("side") == "t", "c").otherwise("t")
    now = Stored(held.select("side", "id").distinct().withColumn("sim", F.lit(1.0)), "similarity")
    for _ in range(MOST_ROUNDS):
        # Distinct records for the whole of an attribute, as one may hold several values of it.
        known = held.join(now.df, ["side", "id"])
        whole = known.groupBy("journal", "side", "attr", "id").agg(F.max("sim").alias("sim")).groupBy("journal", "side", "attr").agg(F.sum("sim").alias("whole"))
        value = known.groupBy("journal", "side", "attr", "v").agg(F.sum("sim").alias("part")).withColumn("side", other)
        support = held.join(value, ["journal", "side", "attr", "v"], "left").join(whole.withColumn("side", other), ["journal", "side", "attr"])
        share = F.when(F.col("whole") > 0, F.coalesce("part", F.lit(0.0)) / F.col("whole")).otherwise(0.0)
        # Of an attribute the best supported value counts: the others may be older ones.
        best = support.groupBy("side", "id", "attr").agg(F.max(share).alias("share"), F.max("w").alias("w"))
        new = best.groupBy("side", "id").agg((F.sum(F.col("share") * F.col("w")) / F.sum("w")).alias("new"))
        step = now.df.join(new, ["side", "id"]).select("side", "id", ((F.col("sim") + F.col("new")) / 2).alias("sim"), F.abs(F.col("new") - F.col("sim")).alias("change"))
        after = Stored(step, "similarity")
        change = after.df.agg(F.max("change")).first()[0] or 0.0
        now.drop()
        now = Stored(after.df.select("side", "id", "sim"), "similarity")
        after.drop()
        if change <= STABLE:
            break
    return now.df


def confident(pairs: DataFrame, topics: DataFrame, fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Pairs with a confidence between 0.5 and 1.

    Half of it is for the title, the other half the geometric mean of the
    propagated similarities of both records to their journal.
    """
    pairs = stored(pairs, "pairs")
    sims = similarities(pairs, topics, fields, catalogue)
    t = sims.where("side = 't'").select(F.col("id").alias("topic_id"), F.col("sim").alias("sim_t"))
    c = sims.where("side = 'c'").select(F.col("id").alias("unified_id"), F.col("sim").alias("sim_c"))
    both = pairs.join(t, "topic_id", "left").join(c, "unified_id", "left")
    mean = F.sqrt(F.coalesce("sim_t", F.lit(0.0)) * F.coalesce("sim_c", F.lit(0.0)))
    return both.select("topic_id", "unified_id", F.round(F.lit(0.5) + 0.5 * mean, 2).alias("confidence"))
