"""Deeply nested JSON records into an adjacency table and flat entity tables.

A body is shredded once, record by record, into one row per node: its number,
its parent's number, its label, its place among its siblings and, for leaves,
its scalar. Object nodes are then joined with their scalar children and
pivoted into entity tables that keep the record and the catalogue row they
came from. The rows of one record are brought together once, by record; all
later groups are parts of a record and need no further exchange.

Defined cases
-------------
* null, empty, broken or incomplete bodies and bodies that are no JSON: no rows;
* a string that itself holds a JSON object or array is read as that value, the
  body included, at any depth; a byte-order mark before it is no part of it;
* an empty input table gives empty tables; extra columns are ignored;
* a body delivered again is shredded again under its own record id;
* repeated members of one object: the last one counts;
* children whose key is absent, null or blank, and null or empty sources: no rows.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ADJACENCY = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("row_node", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("scalar", T.StringType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("nodes", T.ArrayType(T.IntegerType())),
    ]
)

_ARROW = pa.schema(
    [
        ("record_id", pa.int64()),
        ("row_node", pa.int32()),
        ("node", pa.int32()),
        ("parent", pa.int32()),
        ("label", pa.string()),
        ("ordinal", pa.int32()),
        ("kind", pa.string()),
        ("scalar", pa.string()),
        ("size", pa.int32()),
        ("path", pa.list_(pa.string())),
        ("nodes", pa.list_(pa.int32())),
    ]
)

ELEMENT = "[]"  # the label of an array's elements
SOURCE_WRAPPERS = ("items", "data", "rows", "results")  # members of ``sources`` that hold the sources


MARK = "\ufeff"  # the byte-order mark


def _parsed(text: str):
    """The value of a JSON text, read again while it is a string; None if broken."""
    value = text
    while isinstance(value, str):  # every reading is shorter than the text it was read from
        value = value.lstrip(MARK)
        if not value.strip():
            return None
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _inner(value):
    """A string that holds an object or array becomes that value."""
    if isinstance(value, str):
        head = value.lstrip(MARK).lstrip()[:1]
        if head in ("{", "["):
            try:
                inner = json.loads(value.lstrip(MARK))
            except (ValueError, RecursionError):
                return value
            if isinstance(inner, dict | list):
                return inner
    return value


def _text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value == value and abs(value) < 1e15 and value == int(value):
        return str(int(value))
    return str(value)


def _at_source(path: tuple) -> bool:
    """Whether a path leads to a source itself: below ``sources``, or below a wrapper in it."""
    if len(path) < 2 or path[0] != "sources":
        return False
    return len(path) == (3 if path[1] in SOURCE_WRAPPERS else 2)


def shred_body(
    body: str | None,
    row_member: str,
    roots: frozenset[str] | None = None,
    labels: frozenset[str] | None = None,
    leave: frozenset[str] = frozenset(),
    numbered: bool = False,
) -> Iterator[tuple]:
    """The nodes of one body inside its catalogue rows, in document order.

    A catalogue row is an object with the member ``row_member``. Yields
    (row_node, node, parent, label, ordinal, kind, scalar, size, path, nodes),
    with the number of members and the labels and numbers of the nodes from
    below the row to the node. Only members in ``roots`` of a row are entered
    and only scalars with one of ``labels`` are kept, if given; elements of
    arrays and members named by a year always are. Members in ``leave`` of a
    source itself are not entered; they still count towards the number of
    members, and their names mean nothing anywhere else. With ``numbered``
    the paths hold the places of array elements, such as ``[3]`` for ``[]``.
    """
    root = _parsed(body) if body else None
    if root is None:
        return
    count = 0
    # value, parent, label, ordinal, row node, path, nodes
    stack = [(root, -1, "", 0, None, (), ())]
    while stack:
        value, parent, label, ordinal, row, path, nodes = stack.pop()
        if isinstance(value, str):
            value = _inner(value)
        node, count = count, count + 1
        if isinstance(value, dict):
            kind, children = "object", value.items()
        elif isinstance(value, list):
            kind, children = "array", [(ELEMENT, x) for x in value]
        else:
            kind, children = ("null" if value is None else "scalar"), ()
        if kind == "object" and row_member in value:
            row, path, nodes = node, (), ()
            yield row, node, parent, label, ordinal, kind, None, len(children), [], []
            entered = [(k, v) for k, v in children if roots is None or k in roots]
        else:
            if row is not None:
                path, nodes = (*path, f"[{ordinal}]" if numbered and label == ELEMENT else label), (*nodes, node)
                if kind in ("object", "array"):
                    yield row, node, parent, label, ordinal, kind, None, len(children), path, nodes
                elif labels is None or label in labels or label == ELEMENT or (len(label) == 4 and label.isdigit()):
                    yield row, node, parent, label, ordinal, kind, _text(value), 0, path, nodes
            entered = list(children)
        is_source = bool(leave) and kind == "object" and row is not None and _at_source(path)
        for i in range(len(entered) - 1, -1, -1):
            if is_source and entered[i][0] in leave:
                continue
            stack.append((entered[i][1], node, entered[i][0], i, row, path, nodes))


def shred(
    records: DataFrame,
    id_col: str = "record_id",
    body_col: str = "body",
    row_member: str = "unified",
    roots: Collection[str] | None = None,
    labels: Collection[str] | None = None,
    leave: Collection[str] = (),
    numbered: bool = False,
) -> DataFrame:
    """The adjacency table of all bodies; see :func:`shred_body` for its columns."""
    leave = frozenset(leave)
    roots = None if roots is None else frozenset(roots)
    labels = None if labels is None else frozenset(labels)

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.extend((rid, *row) for row in shred_body(body, row_member, roots, labels, leave, numbered))
                if len(rows) >= 50_000:
                    yield batch_of([list(c) for c in zip(*rows, strict=True)])
                    rows = []
        if rows:
            yield batch_of([list(c) for c in zip(*rows, strict=True)])

    picked = records.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(body_col).cast("string").alias("body"))
    return picked.where("body is not null and record_id is not null").mapInArrow(run, ADJACENCY)


def _filled(col: Column) -> Column:
    return F.when(F.length(F.trim(col)) > 0, col)


# Members of wrapped lists that are no children themselves.
_WRAPPERS = ("items", "total", "count", "data", "rows", "results", "values", "note", "next", "page")


# What p2_found is made from; the flat tables keep all values of their entities.
ROOTS = ("unified", "sources", "issn_details")
LABELS = ("id", "issn", "display_name", "year", "source")
# Parts of sources that hold none of the children.
LEAVE = ("main", "dois_by_year", "all_years", "alternate_titles", "keywords", "subjects", "websites")


def entities(adjacency: DataFrame) -> DataFrame:
    """Object nodes joined with their scalar children, one row per object or array.

    Columns: record_id, row_node, object, label, kind, path, nodes, members
    (how many the object has besides its own name) and the scalar children
    issn, display_name, year, source and id. One exchange by record; the join
    is a group of a node with its children.
    """
    own = F.col("kind").isin("object", "array")
    parts = (
        adjacency.where(F.get("path", F.lit(0)).isin(*ROOTS))
        .withColumn("object", F.when(own, F.col("node")).otherwise(F.col("parent")))
        .repartition("record_id")
    )

    def scalar(label: str) -> Column:
        return F.max(F.when((F.col("kind") == "scalar") & (F.col("label") == label), _filled(F.col("scalar"))))

    out = parts.groupBy("record_id", "row_node", "object").agg(
        F.max(F.when(own, F.col("label"))).alias("label"),
        F.max(F.when(own, F.col("kind"))).alias("kind"),
        F.max(F.when(own, F.col("path"))).alias("path"),
        F.max(F.when(own, F.col("nodes"))).alias("nodes"),
        F.max(F.when(own, F.col("size"))).alias("size"),
        scalar("issn").alias("issn"),
        scalar("display_name").alias("display_name"),
        scalar("year").alias("year"),
        scalar("source").alias("source"),
        scalar("id").alias("id"),
        # Plain values in an array, such as a list of ISSNs.
        F.collect_set(F.when((F.col("kind") == "scalar") & (F.col("label") == ELEMENT), _filled(F.col("scalar")))).alias("plain"),
        # Members that are keyed by a year and hold a plain value.
        F.collect_set(F.when((F.col("kind") == "scalar") & F.col("label").rlike(r"^\d{4}$"), F.col("label"))).alias("year_labels"),
    )
    return out.withColumn("members", F.col("size") - F.col("source").isNotNull().cast("int"))


def _source_name(path: Column, own: Column) -> Column:
    label = F.get(path, F.lit(1))
    named = F.when(~label.rlike(r"^(\[\d*\]|\d+)$") & ~label.isin(*_WRAPPERS), label)
    return F.coalesce(named, own)


def _located(e: DataFrame) -> DataFrame:
    """Entities with the catalogue row, source and container that they belong to.

    Adds unified_id, source_node, source_name, is_source, container, first (the
    depth of the container), below (0: the container itself; 1: its elements;
    2: those of a wrapper) and own_key, the key of an object in a container.
    """
    row = Window.partitionBy("record_id", "row_node")
    depth = F.size("path")
    in_sources = F.get("path", F.lit(0)) == "sources"
    # The node of the source that a node belongs to: below a wrapper if there is one.
    wrapped = in_sources & F.get("path", F.lit(1)).isin(*SOURCE_WRAPPERS)
    level = F.when(wrapped, F.lit(2)).otherwise(F.lit(1))
    e = e.withColumn("source_node", F.when(in_sources, F.get(F.col("nodes"), level)))
    e = e.withColumn("is_source", in_sources & (F.col("object") == F.col("source_node")) & (F.col("kind") == "object"))
    of_source = Window.partitionBy("record_id", "row_node", "source_node")
    e = e.withColumn("unified_text", F.max(F.when((depth == 1) & (F.get("path", F.lit(0)) == "unified"), F.col("id"))).over(row))
    e = e.withColumn("unified_id", F.expr("try_cast(regexp_extract(unified_text, '^\\\\s*(-?[0-9]+)\\\\s*$', 1) as bigint)"))
    e = e.withColumn("source_name", F.max(F.when(F.col("is_source"), _source_name(F.col("path"), F.col("source")))).over(of_source))
    container = F.when(F.get("path", F.lit(0)) == "issn_details", F.lit("issn_details")).when(
        in_sources & (F.col("source_name") == "openalex"), F.get(F.col("path"), level + 1)
    )
    e = e.withColumn("container", F.when(container.isin("issn_details", "topics", "counts_by_year"), container))
    first = F.when(F.col("container") == "issn_details", F.lit(1)).otherwise(level + 2)
    e = e.withColumn("first", first).withColumn("below", depth - F.col("first"))
    below = F.col("below")
    label_key = F.when(
        (F.col("kind") == "object") & below.between(1, 2),
        F.when((F.col("container") == "counts_by_year") & F.col("label").rlike(r"^\d{4}$"), F.col("label"))
        .when((F.col("container") == "issn_details") & F.col("label").rlike(r"^\d{4}-?\d{3}[\dXx]$"), F.col("label"))
        .when(
            (F.col("container") == "topics")
            & ~F.col("label").rlike(r"^(\[\]|\d+)$")
            & ~F.col("label").isin(*_WRAPPERS),
            F.col("label"),
        ),
    )
    year = F.when(
        F.col("year").rlike(r"^\s*\d+(\.0+)?\s*$"), F.regexp_extract("year", r"^\s*(\d+)", 1)
    )
    own_key = (
        F.when(F.col("container") == "issn_details", F.col("issn"))
        .when(F.col("container") == "topics", F.col("display_name"))
        .when(F.col("container") == "counts_by_year", year)
    )
    return e.withColumn("own_key", F.coalesce(own_key, label_key))


def children(records: DataFrame, id_col: str = "record_id", body_col: str = "body") -> DataFrame:
    """One distinct row per child of each catalogue row in a body.

    Returns record_id, unified_id, child, child_key as TESTDATA defines them
    for ``p2_found``.
    """
    e = _located(entities(shred(records, id_col, body_col, roots=ROOTS, labels=LABELS, leave=LEAVE)))
    below = F.col("below")
    inside = F.col("container").isNotNull() & below.between(0, 2)
    many = F.when(
        inside,
        F.concat(
            F.array_compact(F.array("own_key")),
            F.when((F.col("kind") == "array") & (F.col("container") != "counts_by_year"), F.col("plain")).otherwise(
                F.filter(F.col("plain"), lambda x: x.rlike(r"^\d{4}$"))
            ),
            F.when((F.col("container") == "counts_by_year") & (below <= 1) & F.col("year").isNull(), F.col("year_labels")).otherwise(
                F.array().cast("array<string>")
            ),
        ),
    )
    sources = F.when(
        F.col("is_source") & (F.col("members") > 0) & F.col("source_name").isNotNull(), F.array(F.col("source_name"))
    )
    out = e.where("unified_id is not null").select(
        "record_id",
        "unified_id",
        F.explode(
            F.concat(
                F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda k: F.struct(F.lit("sources").alias("child"), k.alias("child_key"))),
                F.transform(
                    F.coalesce(many, F.array().cast("array<string>")),
                    lambda k: F.struct(F.col("container").alias("child"), k.alias("child_key")),
                ),
            )
        ).alias("x"),
    )
    return out.select("record_id", "unified_id", "x.child", "x.child_key").where("length(trim(child_key)) > 0").distinct()


# Scalar children of an entity that get a column of their own: column, label, type.
COLUMNS = {
    "sources": (),
    "issn_details": (),
    "topics": (
        ("count", "count", "bigint"),
        ("score", "score", "double"),
        ("field", "field_display_name", "string"),
        ("domain", "domain_display_name", "string"),
    ),
    "counts_by_year": (
        ("works_count", "works_count", "bigint"),
        ("oa_works_count", "oa_works_count", "bigint"),
        ("cited_by_count", "cited_by_count", "bigint"),
    ),
}


def _described(adjacency: DataFrame, child: str) -> DataFrame:
    """Every node below a catalogue row that may be a child, with all values below it.

    The columns of :func:`entities` that place a node, for leaves too; besides
    them parent, ordinal, scalar, direct (the scalar children by label) and
    values. ``adjacency`` is uncut, with numbered paths.
    """
    root = "issn_details" if child == "issn_details" else "sources"
    depth = F.size("path")
    # A child lies under its container, which is below a source or the wrapper of one.
    needed = F.get("path", F.lit(0)).isin("unified", root)
    if child == "issn_details":
        under = F.col("at") < 4
    elif child == "sources":
        under = F.col("at").isin(1, 2)
    else:
        container = F.coalesce((F.get("path", F.lit(2)) == child) | (F.get("path", F.lit(3)) == child), F.lit(False))
        under = container & F.col("at").between(2, 7)
        # Besides the containers: the ids of rows, and sources with their names.
        needed = needed & (container | (depth <= 3) | ((depth == 4) & (F.col("label") == "source")))
    parts = (
        adjacency.where(needed)
        .repartition("record_id")
        .select("*", F.posexplode("nodes").alias("at", "object"))
        .withColumn("under", under)
        .where((F.col("at") >= depth - 2) | F.col("under"))
    )
    own, near = F.col("object") == F.col("node"), F.col("at") == depth - 2
    leaf = F.col("kind").isin("scalar", "null")

    def of_own(name: str) -> Column:
        return F.max(F.when(own, F.col(name))).alias(name)

    def scalar(label: str) -> Column:
        return F.max(F.when(near & (F.col("kind") == "scalar") & (F.col("label") == label), _filled(F.col("scalar")))).alias(label)

    value = F.struct(
        "node", "parent", F.array_join(F.slice("path", F.col("at") + 2, depth), ".").alias("path"), F.col("scalar").alias("value")
    )
    columns = [label for _, label, _ in COLUMNS[child]]
    return (
        parts.groupBy("record_id", "row_node", "object")
        .agg(
            *map(of_own, ("label", "kind", "path", "nodes", "size", "parent", "ordinal", "scalar")),
            *map(scalar, ("issn", "display_name", "year", "source", "id", *columns)),
            F.array_sort(F.collect_list(F.when(leaf & F.col("under"), value))).alias("values"),
        )
        .withColumn("members", F.col("size") - F.col("source").isNotNull().cast("int"))
    )


def flat_table(records: DataFrame, child: str, id_col: str = "record_id", body_col: str = "body") -> DataFrame:
    """One of the flat tables: ``sources``, ``issn_details``, ``topics`` or ``counts_by_year``.

    One row per child as it stands in a body, so that repeated siblings stay
    apart. Returns record_id, unified_id, row_node (the catalogue row),
    source_node (the source that it is or lies in; null for issn_details),
    node, parent, ordinal, key, the columns of ``COLUMNS`` and values: every
    scalar at any depth below the child, or the child itself if it is one, as
    (node, parent, path, value) in document order. Nodes are numbered within a
    record; a value that doesn't fit its column's type is in values only.
    """
    e = _located(_described(shred(records, id_col, body_col, numbered=True), child))
    if child == "sources":
        e = e.withColumn("key", F.when(F.col("is_source") & (F.col("members") > 0), F.col("source_name")))
    else:
        below, text = F.col("below"), _filled(F.col("scalar"))
        siblings = Window.partitionBy("record_id", "row_node", "parent")
        year_beside = F.max(F.when((F.col("kind") == "scalar") & (F.col("label") == "year"), text)).over(siblings)
        e = e.withColumn("year_beside", year_beside)
        year = F.lit(child == "counts_by_year")
        key = (
            F.when(F.col("kind").isin("object", "array") & below.between(0, 2), F.col("own_key"))
            # A plain value in an array.
            .when(
                (F.col("kind") == "scalar") & (F.col("label") == ELEMENT) & below.between(1, 3),
                F.when(~year | text.rlike(r"^\d{4}$"), text),
            )
            # A plain value named by its year.
            .when(
                (F.col("kind") == "scalar") & year & below.between(1, 2) & F.col("label").rlike(r"^\d{4}$") & F.col("year_beside").isNull(),
                F.col("label"),
            )
        )
        # Parts of an element that names itself are no children.
        name = F.col({"topics": "display_name", "counts_by_year": "year", "issn_details": "issn"}[child])

        def named(level: int) -> Column:
            """Whether the node's ancestor at ``below`` = level has a key of its own."""
            group = Window.partitionBy("record_id", "row_node", F.get("nodes", F.col("first") + (level - 1)))
            found = F.max(F.when((F.col("kind") == "object") & (below == level) & name.isNotNull(), F.lit(True))).over(group)
            return F.coalesce(found, F.lit(False)) & (below > level)

        wrapped = F.coalesce(F.get("path", F.col("first")).isin(*_WRAPPERS), F.lit(False))
        e = e.withColumn("inside", named(1) | (named(0) & ~wrapped))
        e = e.withColumn("key", F.when((F.col("container") == child) & ~F.col("inside"), key))
    return e.where("unified_id is not null and length(trim(key)) > 0").select(
        "record_id",
        "unified_id",
        "row_node",
        "source_node",
        F.col("object").alias("node"),
        "parent",
        "ordinal",
        "key",
        *(F.col(label).try_cast(kind).alias(name) for name, label, kind in COLUMNS[child]),
        "values",
    )
