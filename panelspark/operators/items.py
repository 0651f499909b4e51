"""Price items: labels to keys, units, and what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import parse_value
from ..functions.text import squash
from ..vocab import CONVERSION_NOTES, IMPERIAL_MARKERS, IMPERIAL_TO_METRIC, ITEM_KEYS, ITEM_SPELLINGS


def candidate_keys(label: Column, spellings: Sequence[tuple[str, str]] = ITEM_SPELLINGS) -> Column:
    """Item keys whose spelling occurs in the label, in declared order, each once."""
    hits = F.array(*[F.when(F.contains(label, F.lit(s)), F.lit(k)) for s, k in spellings])
    return F.array_distinct(F.array_compact(hits))


def keyed_items(items: DataFrame, spellings: Sequence[tuple[str, str]] = ITEM_SPELLINGS) -> DataFrame:
    """``(entity, key, pos, label, value_text, value)``: each row takes its first free key.

    Rows are taken in page order, and a row whose keys are all taken is dropped.
    Of the rows with one and the same list of keys only as many as the list is
    long can ever take a key, so all later ones go before the shuffle (the limit
    on ``row_number`` runs on the map side); what is gathered per entity is
    bounded by the vocabulary, however many rows an entity has.
    """
    longest = len({k for _, k in spellings})
    labelled = items.select(
        "entity", "pos", squash(F.col("label")).alias("label"), squash(F.col("value_text")).alias("value_text")
    )
    # Rows without any key stay (at most ``longest`` of them) and take nothing below:
    # a filter on the keys would work them out a second time.
    matched = labelled.withColumn("keys", candidate_keys(F.col("label"), spellings))
    in_order = Window.partitionBy("entity", "keys").orderBy("pos")
    contenders = matched.withColumn("_n", F.row_number().over(in_order)).filter(F.col("_n") <= longest)
    lists = contenders.groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct("pos", "keys", "label", "value_text"))).alias("rows")
    )
    nothing = F.struct(
        F.array().cast("array<string>").alias("taken"),
        F.array().cast("array<struct<key:string,pos:int,label:string,value_text:string>>").alias("picks"),
    )

    def take(acc: Column, row: Column) -> Column:
        key = F.get(F.array_except(row["keys"], acc["taken"]), F.lit(0))
        pick = F.struct(
            key.alias("key"), row["pos"].cast("int").alias("pos"),
            row["label"].alias("label"), row["value_text"].alias("value_text"),
        )
        grown = F.struct(
            F.array_append(acc["taken"], key).alias("taken"), F.array_append(acc["picks"], pick).alias("picks")
        )
        return F.when(key.isNull(), acc).otherwise(grown)

    folded = F.aggregate("rows", nothing, take)
    picks = lists.select("entity", F.inline(folded["picks"]))
    return picks.withColumn("value", parse_value(F.col("value_text")))


def unit_system_of(labels: Column) -> Column:
    """``imperial`` if the labels show a marker, else ``metric``."""
    marked = F.lit(False)
    for marker in IMPERIAL_MARKERS:
        marked = marked | F.contains(labels, F.lit(marker))
    return F.when(F.coalesce(marked, F.lit(False)), "imperial").otherwise("metric")


def unit_system(items: DataFrame) -> DataFrame:
    """``(entity, measurement_system)``: imperial as soon as one label shows a marker."""
    system = F.min(unit_system_of(squash(F.col("label"))))  # of both words the one of the marker comes first
    return items.groupBy("entity").agg(F.max("country").alias("country"), system.alias("measurement_system"))


def price_records(
    items: DataFrame, *, pages: DataFrame | None = None, units: str = "metric",
    spellings: Sequence[tuple[str, str]] = ITEM_SPELLINGS,
) -> DataFrame:
    """One row per entity: values, raw texts, seen labels, and what was converted.

    ``units="source"`` keeps whatever system the page was rendered in.  With ``pages(entity, country,
    measurement_system)`` every page has its record, also one without a price; without, the
    entities and their systems are those of the items.
    """
    if units not in ("metric", "source"):
        raise ValueError(f"unknown units '{units}', one of: metric, source")
    per_entity = keyed_items(items, spellings).groupBy("entity").agg(
        F.collect_list(F.struct("key", "value", "value_text", "label")).alias("k")
    )
    # Both sides carry one row per entity, so no key is hot here.
    base = (unit_system(items) if pages is None else pages).join(per_entity, "entity", "left")
    k = F.coalesce(
        F.col("k"),
        F.array().cast("array<struct<key:string,value:double,value_text:string,label:string>>"),
    )
    imperial = (F.col("measurement_system") == "imperial") & F.lit(units == "metric")

    def scaled(e: Column) -> Column:
        factor = F.lit(None).cast("double")
        for key, f in IMPERIAL_TO_METRIC.items():
            factor = F.when(e["key"] == key, F.lit(f)).otherwise(factor)
        return F.when(imperial & factor.isNotNull(), F.round(e["value"] * factor, 4)).otherwise(e["value"])

    notes = F.create_map(*[F.lit(x) for pair in CONVERSION_NOTES.items() for x in pair])
    convertible = F.filter(k, lambda e: imperial & e["value"].isNotNull() & e["key"].isin(*IMPERIAL_TO_METRIC))

    def as_map(entries: Column, value) -> Column:
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], value(e))))

    return base.select(
        "entity", "country", "measurement_system", F.lit(units).alias("output_units"),
        as_map(k, scaled).alias("values"),
        as_map(k, lambda e: e["value_text"]).alias("raw"),
        as_map(k, lambda e: e["label"]).alias("seen"),
        as_map(convertible, lambda e: F.try_element_at(notes, e["key"])).alias("converted"),
    )


def missing_report(records: DataFrame, keys: Sequence[str] = ITEM_KEYS) -> DataFrame:
    """Two absences kept apart: ``unmatched`` never had a row, ``blank`` had no figure.

    A record that carries an error reports neither.
    """
    every = F.array(*[F.lit(k) for k in sorted(keys)])
    seen = F.map_keys("seen")
    unmatched = F.array_except(every, seen)
    blank = F.filter(
        every, lambda k: F.array_contains(seen, k) & F.try_element_at(F.col("values"), k).isNull()
    )
    if "error" in records.columns:
        none = F.array().cast("array<string>")
        unmatched = F.when(F.col("error").isNull(), unmatched).otherwise(none)
        blank = F.when(F.col("error").isNull(), blank).otherwise(none)
    return records.select("entity", unmatched.alias("unmatched"), blank.alias("blank"))
