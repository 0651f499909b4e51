"""Pages into the panel and the corpus, as one batch or as a stream.

``ingest_batch`` works on any batch of pages.  ``ingest_stream`` runs two queries over new files: the
first reads pages, stores their rows and notes what it saw of each; the second keeps, as state
keyed by slice, what each slice was last seen with, whether its table ever changed, and which page
still has to be taken up.  A page that cannot be read stands in the way of its own slice alone.

Every run first sends the pages that wait, with their text, through again, so an
improved reader settles them without new files; and a run that leaves a page of another layout
behind raises ``IngestStopped`` once everything else is stored and reported.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import snapshots as snap
from ..operators.corpus import grade
from ..operators.fingerprints import distinct_tables, panel_fingerprints, repeated_anywhere
from ..operators.panels import write_panel
from ..session import one_row, written
from ..sources.corpus_store import ENTRY, scan_corpus, stored_count, write_entries
from ..sources.pages import page_headers, ranking_rows, triage

PAGE_SCHEMA = "vertical string, view string, region string, snapshot string, item_no bigint, html string"
VERSION = [*ENTRY, "item_no"]
OPEN = ("failed", "unresolved")

SEEN_SCHEMA = (
    "vertical string, view string, region string, snapshot string, item_no bigint, outcome string, page_status string, "
    "fingerprint string, n_rows int, bytes bigint, columns array<string>, html string"
)
KEPT_SCHEMA = (
    "vertical string, view string, region string, snapshot string, item_no bigint, outcome string, tries int, "
    "stored boolean, fingerprint string, n_rows int, bytes bigint, columns array<string>, moved boolean"
)
STATE = "slice"

#: Pages that are sent again carry their number less this, so that any page that has come in since counts as later.
AGAIN = 1 << 62


def outcomes(triaged: DataFrame) -> DataFrame:
    """``(…, outcome)`` per page.

    ``ok`` and ``empty`` (no such table: a permanent answer) are settled; ``unresolved``
    is a page of another layout, and a missing page text a failed read.
    """
    return triaged.withColumn(
        "outcome",
        F.when(~F.col("has_page"), "failed")
        .when(F.col("page_status") == "layout_changed", "unresolved")
        .when(F.col("page_status") == "no_such_selection", "empty")
        .otherwise("ok"),
    )


def run_report(seen: DataFrame) -> DataFrame:
    """One row; ok + empty + failed + unresolved always adds up to attempted, and attempted to planned."""
    of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return seen.agg(
        F.count(F.lit(1)).alias("planned"), *[of(n) for n in ("ok", "empty", "failed", "unresolved")],
        F.count_if(F.col("outcome").isNotNull()).alias("attempted"),
        F.min(F.when(F.col("outcome") == "unresolved", F.struct("item_no", *ENTRY))).alias("aborted_at"),
    ).withColumns({"aborted": F.col("aborted_at").isNotNull(), "executed": F.lit(True)})


def with_completeness(report: DataFrame) -> DataFrame:
    """Complete only when all was attempted, nothing failed or repeats, and all ok tables are stored."""
    complete = (
        ~F.col("aborted") & (F.col("failed") == 0) & (F.col("repeated_verticals") == 0)
        & (F.col("attempted") == F.col("planned")) & (F.col("stored") == F.col("ok"))
    )
    return report.withColumn("complete", complete)


def observations(judged: DataFrame) -> DataFrame:
    """What each page of a batch showed: outcome, digest and number of its rows, header; the text of open ones."""
    good = judged.filter("outcome = 'ok'")
    prints = panel_fingerprints(ranking_rows(good.select(*VERSION, "page_status", "table"), VERSION), VERSION)
    shown = page_headers(good, VERSION).join(prints, VERSION, "left").select(
        *VERSION, F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "bytes", "columns")
    return judged.join(shown, VERSION, "left").select(
        *VERSION, "outcome", "page_status", "fingerprint", "n_rows", "bytes", "columns",
        F.when(F.col("outcome").isin(*OPEN), F.col("html")).alias("html"))


def _judge(pages: DataFrame) -> DataFrame:
    """The pages with their outcome, fixed once, since triage runs the page reader; texts stay beside them."""
    page = pages.withColumns({"region": F.coalesce("region", F.lit("")), "_html": F.col("html")})
    return written(outcomes(triage(page)).withColumnRenamed("_html", "html"))


def latest_entries(seen: DataFrame) -> DataFrame:
    """One entry per slice of a batch that may hold several versions of it.

    The last version is kept; ``changed`` tells whether a table that had rows was
    followed by a different one inside the batch.
    """
    real = F.col("fingerprint") != ""
    first_real = F.min(F.when(real, F.col("item_no")))
    last_blank = F.max(F.when(~real, F.col("item_no")))
    return seen.filter("outcome = 'ok'").groupBy(*ENTRY).agg(
        F.max("item_no").alias("item_no"),
        F.max_by(F.struct("fingerprint", "n_rows", "bytes", "columns"), "item_no").alias("last"),
        F.min_by("fingerprint", "item_no").alias("first_fingerprint"),
        ((F.count_distinct(F.when(real, F.col("fingerprint"))) > 1)
         | F.coalesce(first_real < last_blank, F.lit(False))).alias("changed"),
    ).select(*ENTRY, "item_no", "first_fingerprint", "changed", "last.*")


def with_sticky_moved(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """``moved`` once an entry's table differs from the stored one, and for good."""
    before = stored.select(*ENTRY, F.col("fingerprint").alias("_was"), F.col("moved").alias("_moved"))
    joined = entries.join(before, ENTRY, "left")
    differs = F.coalesce((F.col("_was") != "") & (F.col("_was") != F.col("first_fingerprint")), F.lit(False))
    moved = differs | F.col("changed") | F.coalesce(F.col("_moved"), F.lit(False))
    return joined.withColumn("moved", moved).drop("_was", "_moved", "first_fingerprint", "changed")


def _entry_rows(merged: DataFrame, schema_tag: str, now: Column) -> DataFrame:
    """``merged`` as rows of the corpus."""
    return merged.select(
        *ENTRY, F.lit(schema_tag).alias("schema_tag"), now.alias("fetched_at"),
        F.current_timestamp().alias("written_at"), "bytes", F.lit(True).alias("readable"), "moved",
        snap.is_archival(F.col("snapshot"), now, F.col("moved")).alias("keep"), "fingerprint", "n_rows", "columns")


def _store_rows(judged: DataFrame, panel_path: str) -> None:
    """The rows of the last good page of each slice."""
    good = judged.filter("outcome = 'ok'")
    last = good.groupBy(*ENTRY).agg(F.max("item_no").alias("item_no"))
    current = good.select(*VERSION, "page_status", "table").join(last, VERSION, "left_semi")
    write_panel(ranking_rows(current, ENTRY).drop("columns"), panel_path)


def graded_report(spark: SparkSession, seen: DataFrame, corpus_path: str, schema_tag: str) -> DataFrame:
    """One row: what a run saw, what of it the store holds, and which families repeat a table."""
    good = seen.filter("outcome = 'ok'")
    stored = one_row(stored_count(spark, corpus_path, good, schema_tag))
    on_disk = scan_corpus(spark, corpus_path).filter(F.col("readable") & (F.col("schema_tag") == schema_tag))
    family = ["vertical", "view", "region"]
    alarm = repeated_anywhere(distinct_tables(good.dropDuplicates([*ENTRY, "fingerprint"]), family), distinct_tables(on_disk, family))
    repeated = one_row(alarm.agg(F.count(F.lit(1)).alias("repeated_verticals")))
    return grade(with_completeness(run_report(seen).crossJoin(stored).crossJoin(repeated)))


def ingest_batch(
    pages: DataFrame, *, panel_path: str, corpus_path: str, schema_tag: str, now: Column,
) -> DataFrame:
    """Parse, digest, merge, write and read back one batch; returns its one-row report."""
    spark = pages.sparkSession
    judged = _judge(pages)
    seen = written(observations(judged))
    merged = with_sticky_moved(latest_entries(seen), scan_corpus(spark, corpus_path))
    # Fixed once, so that the overwrite below does not read what it replaces twice.
    entries = written(_entry_rows(merged, schema_tag, now))
    _store_rows(judged, panel_path)
    write_entries(entries, corpus_path)
    last = seen.filter("outcome = 'ok'").groupBy(*ENTRY).agg(F.max("item_no").alias("item_no"))
    # The alarm looks at what the batch leaves behind, not at versions it has replaced itself.
    kept = seen.filter("outcome <> 'ok'").unionByName(seen.join(last, VERSION, "left_semi"))
    report = graded_report(spark, kept, corpus_path, schema_tag)
    counts = run_report(seen)
    extra = [c for c in report.columns if c not in counts.columns and c not in ("stored", "complete", "exit")]
    stored = one_row(stored_count(spark, corpus_path, seen.filter("outcome = 'ok'"), schema_tag))
    return grade(with_completeness(counts.crossJoin(stored).crossJoin(one_row(report.select(*extra)))))


class IngestStopped(RuntimeError):
    """The run has met pages of another layout; everything else is stored, and these wait in the state."""


class SliceKeeper(StatefulProcessor):
    """What is known of one slice from run to run."""

    state_schema = (
        "item_no bigint, outcome string, tries int, fingerprint string, moved boolean, html string"
    )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slice = handle.getValueState(STATE, self.state_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        _, _, tries, fingerprint, moved, _ = self.slice.get() if self.slice.exists() else (None, None, 0, None, False, None)
        last = good = None
        for row in sorted(rows, key=lambda row: row["item_no"]):
            last, tries = row, tries + 1
            if row["outcome"] == "ok":
                good = row
                moved = moved or bool(fingerprint and fingerprint != row["fingerprint"])
                fingerprint = row["fingerprint"]
        if last["outcome"] in ("ok", "empty"):
            tries = 0
        self.slice.update((last["item_no"], last["outcome"], tries, fingerprint, moved, last["html"]))
        shown = good or Row(fingerprint=None, n_rows=None, bytes=None, columns=None)
        yield Row(
            vertical=key[0], view=key[1], region=key[2], snapshot=key[3], item_no=last["item_no"], outcome=last["outcome"],
            tries=tries, stored=good is not None, fingerprint=shown["fingerprint"], n_rows=shown["n_rows"],
            bytes=shown["bytes"], columns=shown["columns"], moved=moved)

    def close(self) -> None:
        pass


def slice_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of every slice: outcome of its last page, tries since the last settled one, digest, ``moved``."""
    kept = spark.read.format("statestore").option("stateVarName", STATE).load(f"{checkpoint}/slices")
    first = F.when(F.col("item_no") < 0, F.col("item_no") + AGAIN).otherwise(F.col("item_no"))
    return kept.select("key.*", "value.*").withColumn("item_no", first)


def open_pages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Slices whose last page was not settled, with its text if there was one."""
    return slice_state(spark, checkpoint).filter(F.col("outcome").isin(*OPEN))


def _has_run(spark: SparkSession, checkpoint: str) -> bool:
    commits = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/slices/commits/0")
    return commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(commits)


def ingest_stream(
    spark: SparkSession,
    source: str,
    *,
    panel_path: str,
    corpus_path: str,
    report_path: str,
    checkpoint: str,
    schema_tag: str,
    now: Column,
    max_files: int = 64,
) -> DataFrame:
    """New page files in ``source`` (parquet), and the pages that wait, flow into the panel and the corpus.

    Runs until all of them are dealt with and returns the run's one-row report, which is also
    stored below ``report_path``, one folder a run.  ``IngestStopped`` is raised after that if a page
    of another layout is left.  What was seen of each page is kept below ``checkpoint``.
    """
    # The package may be missing on the executors; the keeper of a slice goes there by value.
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    again, seen_path = f"{checkpoint}/again", f"{checkpoint}/seen"
    names = [part.strip().split(" ")[0] for part in PAGE_SCHEMA.split(",")]
    if _has_run(spark, checkpoint):
        waiting = open_pages(spark, checkpoint).filter("html IS NOT NULL").withColumn(
            "item_no", F.col("item_no") - AGAIN).select(*names)
    else:
        waiting = spark.createDataFrame([], PAGE_SCHEMA)
        spark.createDataFrame([], SEEN_SCHEMA).write.mode("append").parquet(f"{seen_path}/batch=-1")
    waiting.write.mode("append").parquet(again)
    batches: list[int] = []

    def read_pages(batch: DataFrame, batch_id: int) -> None:
        judged = _judge(batch)
        _store_rows(judged, panel_path)
        # One folder per batch id: a batch that is run again replaces what it saw itself.
        observations(judged).write.mode("overwrite").parquet(f"{seen_path}/batch={batch_id}")
        batches.append(batch_id)

    def store_entries(kept: DataFrame, batch_id: int) -> None:
        write_entries(written(_entry_rows(kept.filter("stored"), schema_tag, now)), corpus_path)

    def files(path: str) -> DataFrame:
        return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)

    (
        files(source).unionByName(files(again)).writeStream.foreachBatch(read_pages)
        .option("checkpointLocation", f"{checkpoint}/pages").trigger(availableNow=True).start().awaitTermination()
    )
    seen = spark.readStream.schema(SEEN_SCHEMA).option("maxFilesPerTrigger", max(1000, max_files)).parquet(f"{seen_path}/batch=*")
    (
        seen.groupBy(*ENTRY).transformWithState(SliceKeeper(), KEPT_SCHEMA, "Update", "None")
        .writeStream.foreachBatch(store_entries).outputMode("update")
        .option("checkpointLocation", f"{checkpoint}/slices").trigger(availableNow=True).start().awaitTermination()
    )
    run = spark.read.schema(SEEN_SCHEMA).parquet(*[f"{seen_path}/batch={i}" for i in batches]) if batches else (
        spark.createDataFrame([], SEEN_SCHEMA))
    # A page that a later one of its slice has replaced in this very run is no fault of the run.
    last = run.groupBy(*ENTRY).agg(F.max("item_no").alias("_last"))
    run = run.join(last, ENTRY).filter(~F.col("outcome").isin(*OPEN) | (F.col("item_no") == F.col("_last"))).drop("_last")
    report = graded_report(spark, run, corpus_path, schema_tag).withColumn("aborted_at", F.to_json("aborted_at"))
    written_to = f"{report_path}/run={max(batches, default=-1)}"
    if batches:
        report.write.mode("overwrite").parquet(written_to)
        report = spark.read.parquet(written_to)
    done = report.first()  # one row
    if done["aborted"]:
        raise IngestStopped(f"{done['unresolved']} page(s) of another layout, first {done['aborted_at']}")
    return report
