"""Panels, price items, pages and a corpus, derived by Spark from the given tables.

Every view is a plan over the tables, so its size follows theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.operators.panels import as_panel, with_ranks
from panelspark.vocab import ITEM_KEYS, ITEM_SPELLINGS

METRICS = ["Order Revenue", "Order Count", "Max Order"]
MONEY = "decimal(18,2)"
PAGE_ROWS = 100


# The given tables' columns; naming them spares a footer-reading job per scan.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------- customer panel


def _years(years: Sequence[int] | None) -> Column | None:
    """Ranges on the date itself, so the scan can skip row groups."""
    if years is None:
        return None
    date = F.col("o_orderdate")
    any_year = F.lit(False)
    for y in years:
        any_year = any_year | (
            (date >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (date < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))
        )
    return any_year


def customer_figures(
    spark: SparkSession, sf_dir: str, years: Sequence[int] | None = None, keep: Column | None = None
) -> DataFrame:
    """Orders summed per customer and year before they meet the customer's label."""
    orders = load(spark, sf_dir, "orders")
    for condition in (_years(years), keep):
        if condition is not None:
            orders = orders.filter(condition)
    figures = orders.groupBy("o_custkey", F.year("o_orderdate").cast("string").alias("snapshot")).agg(
        F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("revenue"),
        F.count(F.lit(1)).cast("double").alias("orders_n"),
        F.max("o_totalprice").alias("top_order"),
    )
    labels = (
        load(spark, sf_dir, "customer")
        .join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.concat_ws(", ", "c_name", "n_name", "r_name").alias("label"))
    )
    return figures.join(labels, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


def customer_panel(
    spark: SparkSession, sf_dir: str, years: Sequence[int] | None = None, *,
    ranked: bool = False, keep: Column | None = None,
) -> DataFrame:
    """Customers by order year; ranked by revenue when ranks are asked for."""
    figures = customer_figures(spark, sf_dir, years, keep)
    panel = as_panel(
        figures, label=F.col("label"), snapshot=F.col("snapshot"),
        metrics={"Order Revenue": F.col("revenue"), "Order Count": F.col("orders_n"), "Max Order": F.col("top_order")},
    )
    if not ranked:
        return panel
    return with_ranks(panel, [F.try_element_at("metrics", F.lit("Order Revenue")).desc(), F.col("place").asc()])


def slice_of(panel: DataFrame, snapshot: str) -> DataFrame:
    return panel.filter(F.col("snapshot") == snapshot)


def copied_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with its 1997 table also stored under two more ids."""
    panel = customer_panel(spark, sf_dir, ranked=True)
    out = panel
    for copy in ("2003", "2004-mid"):
        out = out.unionByName(slice_of(panel, "1997").withColumn("snapshot", F.lit(copy)))
    return out


# ----------------------------------------------------------------- part panel


def part_panels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping part lists whose labels repeat; one label normalises to nothing."""
    label = F.when(F.col("p_size") == 50, F.lit("--")).otherwise(F.concat_ws(", ", "p_name", "p_brand"))
    parts = load(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_retailprice", label.alias("label"),
        F.when(F.col("p_size") <= 30, F.lit("2001")).alias("a"),
        F.when(F.col("p_size") >= 29, F.lit("2002")).alias("b"),
    )
    both = parts.select("*", F.explode(F.array_compact(F.array("a", "b"))).alias("snapshot"))
    price = F.when(F.col("snapshot") == "2002", F.col("p_retailprice") + F.col("p_size")).otherwise(
        F.col("p_retailprice")
    )
    panel = as_panel(
        both, label=F.col("label"), snapshot=F.col("snapshot"),
        metrics={"Retail Price": price, "Part Key": F.col("p_partkey")},
    )
    panel = with_ranks(panel, [F.try_element_at("metrics", F.lit("Part Key")).asc()])
    return slice_of(panel, "2001"), slice_of(panel, "2002")


# ---------------------------------------------------------------- price items

def _labels(pick: int) -> dict[str, str]:
    """A label of our own for each item key, around its first (0) or last (-1) known spelling."""
    spelled: dict[str, list[str]] = {}
    for spelling, key in ITEM_SPELLINGS:
        spelled.setdefault(key, []).append(spelling)
    return {key: f"{spelled[key][pick]}, as listed" for key in ITEM_KEYS}


#: Where two spellings differ by unit, the imperial one comes first.
METRIC_LABELS, IMPERIAL_LABELS = _labels(-1), _labels(0)


def price_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as an entity; a part's key picks the item, rare rows have no price."""
    texts = lambda table: F.array(*[F.lit(table[k]) for k in ITEM_KEYS])
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice")
    parts = load(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") % len(ITEM_KEYS)).cast("int").alias("item"),
        F.when(F.col("p_size") > 25, 1).otherwise(0).alias("again"),
    )
    priced = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "item", "again")
        .agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").cast(MONEY).alias("top"))
    )
    who = load(spark, sf_dir, "supplier").join(
        load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select("s_suppkey", F.replace("s_name", F.lit("#"), F.lit("-")).alias("entity"), F.col("n_name").alias("country"),
             "s_nationkey")
    imperial = F.col("s_nationkey") % 3 == 0
    label = F.when(imperial, F.get(texts(IMPERIAL_LABELS), F.col("item"))).otherwise(
        F.get(texts(METRIC_LABELS), F.col("item"))
    )
    return priced.join(who, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "entity", "country", (F.col("item") * 2 + F.col("again")).alias("pos"), label.alias("label"),
        F.when(F.col("n") < 10, F.lit("?")).otherwise(F.concat(F.lit("$"), F.col("top").cast("string"))).alias("value_text"),
    )


def control_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An independent figure per supplier, missing for the ones in debt."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("total"), F.count(F.lit(1)).alias("n")
    )
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    local = F.round(F.col("total") / F.col("n") * 35 * (1 + F.col("s_nationkey") / F.lit(10.0)), 2)
    return supplier.join(lines, F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.replace("s_name", F.lit("#"), F.lit("-")).alias("entity"),
        F.when(F.col("s_acctbal") >= 0, local).alias("local"),
    )


# --------------------------------------------------------------------- corpus

NOW = "2024-02-15 00:00:00"
CORPUS_FAMILIES = ("click", "error", "purchase", "signup", "view")
CORPUS_TAG = "panel-2"
MAX_AGE = 21 * 86_400
LIST_MAX_AGE = 17 * 86_400


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events grouped by family and snapshot id (two ids per day pair: a year and its middle)."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    half = F.when(day % 2 == 1, F.lit("-mid")).otherwise(F.lit(""))
    snapshot = F.concat((F.lit(2010) + F.floor(day / 2)).cast("string"), half)
    return load(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("vertical"), snapshot.alias("snapshot")
    ).agg(
        F.count(F.lit(1)).cast("int").alias("n_events"), F.max("ts").cast("timestamp").alias("last_ts"), F.min("ts").cast("timestamp").alias("first_ts"),
        F.max("value").alias("top_value"), F.max("event_id").alias("last_id"),
        F.sum(F.length("props")).cast("bigint").alias("bytes"),
    )


def event_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored inventory with every kind of fault, decided by the events themselves."""
    e = event_entries(spark, sf_dir).filter("top_value > 60")
    last = F.col("last_id")
    fingerprint = F.when(F.col("n_events") % 9 == 0, F.lit("")).otherwise(
        F.concat(F.col("vertical"), F.lit("/"), (F.col("n_events") % 17).cast("string"))
    )
    return e.select(
        "vertical", "snapshot",
        F.when(last % 11 == 0, F.lit("panel-1")).otherwise(F.lit(CORPUS_TAG)).alias("schema_tag"),
        F.when(last % 13 != 0, F.col("first_ts")).alias("fetched_at"), F.col("last_ts").alias("file_mtime"),
        (last % 17 != 0).alias("readable"), (last % 5 == 0).alias("moved"), (last % 4 == 0).alias("keep"),
        fingerprint.alias("fingerprint"), F.col("n_events").alias("n_rows"), "bytes",
    )


def event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family's own id list: at most as long as the days the events cover."""
    e = event_entries(spark, sf_dir)
    ids = F.array_sort(F.collect_list("snapshot"))
    return e.groupBy("vertical").agg(
        F.when(F.col("vertical") == "signup", F.array(F.lit("latest")).cast("array<string>"))
        .otherwise(F.concat(ids, F.array(F.lit("201x")))).alias("ids"),
        F.max("last_ts").alias("file_mtime"),
    ).select(
        "vertical", "ids", "file_mtime", F.lit(True).alias("readable"),
        F.when(F.col("vertical") == "view", F.lit("panel-1")).otherwise(F.lit(CORPUS_TAG)).alias("schema_tag"),
    )


# ------------------------------------------------------------ entities, events


def customer_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "customer")
        .join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("slug"), F.col("c_name").alias("name"),
            F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("cost_usd"),
            (F.col("c_custkey") % 97).cast("double").alias("internet_mbps"),
            (F.col("c_nationkey") * 4).cast("double").alias("safety"),
            (F.col("c_nationkey") - 5).cast("double").alias("temperature_c"),
            F.col("c_mktsegment").alias("_segment"),
        )
    )


def supplier_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as discovered entities: some without a name, some that no page knows."""
    s = load(spark, sf_dir, "supplier").join(
        load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    name = F.replace("s_name", F.lit("#"), F.lit(" "))
    country = F.replace("n_name", F.lit("_"), F.lit(" "))
    tail = F.replace(F.lower(country), F.lit(" "), F.lit("-"))
    return s.select(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 4 == 0, F.lit("")).when(F.col("s_acctbal") < 0, F.concat(F.lit("O'"), name))
        .otherwise(name).alias("name"),
        F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit("-"), tail).alias("slug"),
        country.alias("country"),
    )


def event_meetups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("city"),
        F.concat(F.lit("C"), (F.col("user_id") % 5).cast("string")).alias("country"), "value",
    )


# ---------------------------------------------------------------------- pages


def ranking_pages(spark: SparkSession, sf_dir: str, years: Sequence[int] | None = None) -> DataFrame:
    """Ranking pages of at most PAGE_ROWS entities, written from the customer panel.

    A page's rank cells are empty, some labels are blank, single orders show '?'.
    """
    panel = customer_panel(spark, sf_dir, years, ranked=True)
    value = lambda name: F.try_element_at("metrics", F.lit(name))
    label = F.when(value("Order Count") == 5, F.lit(" ")).otherwise(F.col("place"))
    count = F.when(value("Order Count") == 1, F.lit("?")).otherwise(value("Order Count").cast("int").cast("string"))
    row = F.concat(
        F.lit("<tr><td></td><td><a href='#'>"), label, F.lit("</a></td><td>"),
        F.format_number(value("Order Revenue"), 2), F.lit("</td><td> "), count, F.lit("</td></tr>\n"),
    )
    block = F.floor((F.col("rank") - 1) / PAGE_ROWS).cast("int")
    # At most PAGE_ROWS rows per group, by the block number itself.
    pages = panel.select("snapshot", block.alias("block"), "rank", row.alias("row")).groupBy("snapshot", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row"))), lambda r: r["row"]), "").alias("body")
    )
    head = (
        "<html><head><style>td{}</style></head><body><table id=\"nav\"><tr><td>x</td></tr></table>"
        "<select><option value=\"USD\">USD</option><option value=\"1996\">1996</option>"
        "<option selected value=\"1997-mid\">1997 Mid</option></select>"
        "<table id=\"t2\" class=\"stripe\"><tr><th>Rank</th><th>City</th><th>Order<br>Revenue</th><th>Order Count</th></tr>"
    )
    html = (
        F.when(F.col("block") % 7 == 3, F.lit("<html><body><p>Cannot find   that table</p></body></html>"))
        .when(F.col("block") % 7 == 5, F.lit("<html><body><table id='t9'><tr><td>1</td></tr></table></body></html>"))
        .otherwise(F.concat(F.lit(head), "body", F.lit("</table></body></html>")))
    )
    return pages.select("snapshot", "block", html.alias("html"))


def price_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price page per supplier; a page has at most two rows per item key."""
    row = F.concat(
        F.lit("<tr><td>"), F.replace("label", F.lit(" "), F.lit("\n ")), F.lit("</td><td>&nbsp;"), "value_text",
        F.lit("</td></tr>"),
    )
    pages = price_items(spark, sf_dir).withColumn("row", row).groupBy("entity", "country").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda r: r["row"]), "").alias("body")
    )
    number = F.right("entity", F.lit(3)).cast("int")
    html = (
        F.when(number % 10 == 7, F.lit("<p>Cannot find city id for that</p>"))
        .when(number % 10 == 8, F.lit("<p>We don't have enough data</p>"))
        .when(number % 10 == 9, F.lit("<table class='other'></table>"))
        .otherwise(F.concat(
            F.lit('<a href="/list?country='), F.replace("country", F.lit("_0"), F.lit("+")),
            F.lit("\">c</a><table class='data_wide_table x'><tr><th>Item</th><th>Price</th></tr>"
                  "<tr><td>only one cell</td></tr>"),
            "body", F.lit("</table>"),
        ))
    )
    return pages.select("entity", html.alias("html"))


def result_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool answers over customers, fifty to an envelope; some broken, some refused."""
    block = F.floor(F.regexp_extract("slug", "([0-9]+)$", 1).cast("bigint") / 50)
    city = F.struct("slug", "name", "country", "region", F.col("safety").alias("overall_score"), "cost_usd")
    grouped = customer_entities(spark, sf_dir).groupBy(block.alias("block")).agg(F.collect_list(city).alias("cities"))
    text = F.to_json(F.struct(
        (F.size("cities") * 3).alias("total_matching"), F.size("cities").alias("returned"), "cities",
        F.lit("test data").alias("attribution"),
    ))
    text = F.when(F.col("block") % 5 == 3, F.substring(text, F.lit(1), F.length(text) - 20)).otherwise(text)
    text = F.when(F.col("block") % 11 == 4, F.lit("")).otherwise(text)
    blocks = F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
                     F.struct(F.lit("text").alias("type"), text.alias("text")))
    answer = F.to_json(F.struct((F.col("block") % 7 == 6).alias("isError"), blocks.alias("content")))
    return grouped.select("block", answer.alias("answer"))
