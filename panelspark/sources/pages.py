"""Web pages to rows.

Only the tokenising of one page runs in Python (Arrow batches, folded a few pages at a time);
pages are spread by Spark, and everything after the tables are cut out is Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import to_number
from ..functions.snapshots import is_snapshot_id
from ..functions.text import country_of_link, join_key, split_place, squash
from ..operators.headers import header_index_expr
from ..operators.items import unit_system_of
from ..vocab import NO_SELECTION_TEXTS, THIN_DATA_TEXT, UNKNOWN_ENTITY_TEXT
from . import html_reader

TABLE_TYPE = (
    "struct<id:string,classes:array<string>,header:array<string>,rows:array<array<string>>>"
)


#: The same type as Arrow has it.
_STRINGS = pa.list_(pa.string())
ARROW_TABLES = pa.list_(pa.struct([
    ("id", pa.string()), ("classes", _STRINGS), ("header", _STRINGS), ("rows", pa.list_(_STRINGS))]))
#: Pages whose cells a worker holds as Python objects at once, whatever the length of an Arrow batch.
PAGES_AT_ONCE = 32

# Tasks receive these functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(html_reader)


def _page_batches(keep: list[str], want_text: bool, want_tables: bool):
    to_marks, to_words, to_tables = html_reader.page_marks, html_reader.visible_words, html_reader.page_tables
    at_once, tables_type = PAGES_AT_ONCE, ARROW_TABLES

    def fold(html):
        # A page's marks are dropped before the next page is read.
        marks = to_marks(html)
        return to_words(marks) if want_text else None, to_tables(marks) if want_tables else None

    def read(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                part = batch.slice(first, at_once)
                folded = [fold(html) for html in part.column("html").to_pylist()]
                yield pa.record_batch(
                    [*(part.column(name) for name in keep), pa.array([text for text, _ in folded], pa.string()),
                     pa.array([tables for _, tables in folded], tables_type)], names=[*keep, "text", "tables"])

    return read


def read_pages(pages: DataFrame, *, want_text: bool = True, want_tables: bool = True) -> DataFrame:
    """Replaces ``html`` by ``text`` (visible) and ``tables``.

    One pass over each page yields both, and the page itself does not travel back
    from the Python side.
    """
    keep = [f for f in pages.schema.fields if f.name != "html"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    schema += f"text string, tables array<{TABLE_TYPE}>"
    names = [f.name for f in keep]
    return pages.select(*names, "html").mapInArrow(_page_batches(names, want_text, want_tables), schema)


def visible_text(pages: DataFrame) -> DataFrame:
    return read_pages(pages, want_tables=False).drop("tables")


def html_tables(pages: DataFrame) -> DataFrame:
    """One row per (page, table), in the order the tables are closed."""
    read = read_pages(pages, want_text=False)
    rest = [c for c in pages.columns if c != "html"]
    return read.select(*rest, F.posexplode("tables").alias("table_no", "t")).select(*rest, "table_no", "t.*")


def first_table(tables: Column, *, table_id: str = "", css_class: str = "") -> Column:
    """The first table with that id or class; NULL when there is none."""

    def wanted(t: Column) -> Column:
        hit = F.lit(False)
        if table_id:
            hit = hit | (t["id"] == table_id)
        if css_class:
            hit = hit | F.array_contains(t["classes"], css_class)
        return hit

    return F.get(F.filter(tables, wanted), F.lit(0))


def ranking_status(table: Column, text: Column) -> Column:
    """Why a ranking page has no rows to give: two causes with two remedies."""
    unknown, nothing = NO_SELECTION_TEXTS
    no_selection = F.contains(text, F.lit(unknown)) | F.contains(F.lower(text), F.lit(nothing))
    return (
        F.when(table.isNull() & no_selection, "no_such_selection")
        .when(table.isNull() | (F.size(table["header"]) == 0), "layout_changed")
        .otherwise("ok")
    )


def price_status(table: Column, text: Column) -> Column:
    return (
        F.when(F.contains(text, F.lit(UNKNOWN_ENTITY_TEXT)), "unknown_entity")
        .when(F.contains(text, F.lit(THIN_DATA_TEXT)), "thin_data")
        .when(table.isNull(), "layout_changed")
        .otherwise("ok")
    )


def triage(pages: DataFrame, *, kind: str = "ranking") -> DataFrame:
    """Pages with their table and ``page_status``; one bad page never stops the rest.

    ``has_page`` is false where the read itself failed (``html`` is NULL); price
    pages also get ``country``, taken from the page's own link.
    """
    marked = pages.withColumn("has_page", F.col("html").isNotNull())
    if kind == "ranking":
        table, status = first_table(F.col("tables"), table_id="t2"), ranking_status
    else:
        marked = marked.withColumn("country", country_of_link(F.col("html")))
        table, status = first_table(F.col("tables"), css_class="data_wide_table"), price_status
    found = read_pages(marked).withColumn("table", table)
    return found.withColumn("page_status", status(F.col("table"), F.col("text"))).drop("tables", "text")


def _layout(header: Column) -> tuple[Column, Callable[[Column], Column]]:
    """Position of the place column, and of the metric columns behind it with their labels."""
    found = header_index_expr(header, "City", "Country")
    place_at = F.coalesce(F.nullif(found, F.lit(0)), F.lit(1))
    metrics_at = lambda at: F.filter(
        F.transform(header, lambda h, i: F.struct(i.alias("i"), h.alias("name"))),
        # Of equal labels the last column counts: a map holds a label once.
        lambda e: (e["i"] > at) & (F.lower(e["name"]) != "rank") & ~F.array_contains(
            F.slice(header, e["i"] + 2, F.size(header)), e["name"]),
    )
    return place_at, metrics_at


def page_headers(triaged: DataFrame, carry: list[str]) -> DataFrame:
    """``(carry..., columns, bytes)`` per good ranking page, also one without rows: its labels in page order, its size."""
    place_at, metrics_at = _layout(F.col("table.header"))
    placed = triaged.filter("page_status = 'ok'").withColumn("place_at", place_at)
    labels = F.transform(metrics_at(F.col("place_at")), lambda e: e["name"])
    return placed.select(*carry, labels.alias("columns"), F.octet_length(F.to_json("table")).cast("bigint").alias("bytes"))


def ranking_rows(triaged: DataFrame, carry: list[str]) -> DataFrame:
    """Panel rows of good ranking pages.

    ``rank`` is the position among all body rows, also unreadable ones; ``row_no``
    counts the kept rows.  A place column found at position 0 is read as 1, the
    way the pages are laid out (the first cell is the empty rank cell).
    """
    place_at, metrics_at = _layout(F.col("table.header"))
    good = triaged.filter("page_status = 'ok'").withColumn("place_at", place_at)
    numbered = good.select(
        *carry, "place_at", metrics_at(F.col("place_at")).alias("metrics_at"),
        F.filter(
            F.transform(F.col("table.rows"), lambda r, i: F.struct((i + 1).alias("rank"), r.alias("cells"))),
            lambda e: F.coalesce(F.get(e["cells"], F.col("place_at")), F.lit("")) != "",
        ).alias("rows"),
    )
    rows = numbered.select(*carry, "place_at", "metrics_at", F.posexplode("rows").alias("_at", "row"))
    cells = F.col("row.cells")
    metrics = F.map_from_entries(F.transform(
        F.col("metrics_at"), lambda e: F.struct(e["name"], to_number(F.get(cells, e["i"])))
    ))
    parts = split_place(F.get(cells, F.col("place_at")))
    return rows.select(
        *carry, F.col("row.rank").cast("int").alias("rank"), (F.col("_at") + 1).cast("int").alias("row_no"),
        parts.alias("_parts"), metrics.alias("metrics"),
        F.transform("metrics_at", lambda e: e["name"]).alias("columns"),
    ).select(
        *carry, "rank", "row_no", "_parts.*", "metrics", join_key(F.col("_parts.place")).alias("place_key"), "columns"
    )


def item_rows(triaged: DataFrame, entity: str = "entity") -> DataFrame:
    """Label and value cells of good price pages; rows of one cell carry no price."""
    good = triaged.filter("page_status = 'ok'")
    rows = good.select(
        F.col(entity).alias("entity"), "country", F.posexplode("table.rows").alias("pos", "cells")
    )
    return rows.filter(F.size("cells") >= 2).select(
        "entity", "country", "pos", squash(F.get("cells", F.lit(0))).alias("label"),
        squash(F.get("cells", F.lit(1))).alias("value_text"),
    )


def price_page_facts(triaged: DataFrame, entity: str = "entity") -> DataFrame:
    """``(entity, country, measurement_system)`` of every good price page, also one without a price.

    The unit system is read off all first cells in a row, also those of rows that carry no price.
    """
    first = F.transform(F.filter("table.rows", lambda cells: F.size(cells) > 0), lambda cells: squash(F.get(cells, F.lit(0))))
    return triaged.filter("page_status = 'ok'").select(
        F.col(entity).alias("entity"), "country", unit_system_of(F.array_join(first, " ")).alias("measurement_system"))


def error_records(triaged: DataFrame, entity: str = "entity") -> DataFrame:
    """Failed pages in the shape of a price record's error columns."""
    unread = ~F.col("has_page")
    kind = F.when(unread, "source_unavailable").otherwise(F.col("page_status"))
    remedy = (
        F.when(unread, "read the page again")
        .when(F.col("page_status") == "unknown_entity", "check the spelling of the slug")
        .when(F.col("page_status") == "thin_data", "pick a larger nearby entity")
        .otherwise("the page layout changed; the reader needs an update")
    )
    bad = triaged.filter("page_status <> 'ok'")
    return bad.select(
        F.col(entity).alias("entity"), kind.alias("kind"),
        F.concat(F.lit("page of '"), F.col(entity), F.lit("': "), kind).alias("error"),
        remedy.alias("remedy"),
    )


def run_failed(triaged: DataFrame) -> DataFrame:
    """One row: a sweep failed only when every page did."""
    return triaged.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("page_status") != "ok").alias("failed"),
        F.coalesce(F.bool_and(F.col("page_status") != "ok"), F.lit(True)).alias("run_failed"),
    )


def snapshot_options(pages: DataFrame, carry: list[str]) -> DataFrame:
    """Snapshot ids offered by a page's <option> list, in page order."""
    values = F.regexp_extract_all("html", F.lit(r'<option[^>]+value="([^"]+)"[^>]*>'), 1)
    ids = F.filter(values, lambda v: is_snapshot_id(v))
    return pages.select(*carry, F.posexplode(ids).alias("pos", "snapshot"))


def decode_pages(files: DataFrame, content_type: Column | None = None) -> DataFrame:
    """``binaryFile`` rows to text: UTF-8 (mark stripped), else the declared charset, else lenient.

    Valid UTF-8 is decoded in the JVM; only the other pages hand their bytes to
    Python, which knows every charset a page may declare.
    """
    text = F.col("content").cast("string")
    plain = F.is_valid_utf8(text)
    charset = F.lit(None).cast("string")
    if content_type is not None:
        declared = F.regexp_extract(F.lower(content_type), "charset=([^;]*)", 1)
        charset = F.nullif(F.trim(declared), F.lit(""))
    decode = html_reader.decode_declared

    @F.pandas_udf("string")
    def other(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([decode(c, n) for c, n in zip(content, name)], dtype=object)

    odd = other(F.when(~plain, F.col("content")), charset)
    stripped = F.regexp_replace(text, r"^\x{FEFF}", "")
    return files.withColumn("html", F.when(plain, stripped).otherwise(odd))
