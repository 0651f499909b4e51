import os

from helpers import panel
from pyspark.sql import functions as F

from panelspark.operators import panels
from panelspark.sources.corpus_store import scan_corpus, write_entries


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def families(spark, n, rows):
    base = panel(spark, {"2014": rows})
    number = spark.range(n).select(F.concat(F.lit("family-"), F.col("id").cast("string")).alias("vertical"))
    return base.drop("vertical").crossJoin(number).select(*base.columns)


def test_files_of_a_panel_do_not_grow_with_its_families(spark, tmp_path):
    path = str(tmp_path / "panel")
    panels.write_panel(families(spark, 300, [("A, X", {"m": 1.0})]), path)
    assert len(files(path)) <= panels.FOLDERS
    panels.write_panel(families(spark, 2, [("B, X", {"m": 2.0}), ("C, X", {"m": None})]), path)
    stored = panels.read_panel(spark, path)
    assert stored.count() == 302 and stored.filter("place = 'A, X'").count() == 298
    assert {r.vertical for r in stored.filter("place <> 'A, X'").collect()} == {"family-0", "family-1"}
    assert len(files(path)) <= panels.FOLDERS


def test_slices_with_unknown_parts_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "panel")
    one = families(spark, 1, [("A, X", {"m": 1.0})]).withColumns({"region": F.lit(None).cast("string"), "snapshot": F.lit(None).cast("string")})
    panels.write_panel(one.unionByName(one.withColumn("vertical", F.lit(None).cast("string"))), path)
    panels.write_panel(one.withColumn("place", F.lit("B, X")), path)
    got = sorted((str(r.vertical), r.place) for r in panels.read_panel(spark, path).collect())
    assert got == [("None", "A, X"), ("family-0", "B, X")]


def test_files_of_a_corpus_do_not_grow_with_its_families(spark, tmp_path):
    path = str(tmp_path / "corpus")

    def entries(n, n_rows):
        return spark.range(n).select(
            F.concat(F.lit("family-"), F.col("id").cast("string")).alias("vertical"), F.lit("city").alias("view"),
            F.lit("").alias("region"), F.lit("2014").alias("snapshot"), F.lit("t").alias("schema_tag"),
            F.current_timestamp().alias("fetched_at"), F.current_timestamp().alias("written_at"), F.lit(1).cast("bigint").alias("bytes"),
            F.lit(True).alias("readable"), F.lit(False).alias("moved"), F.lit(False).alias("keep"), F.lit("f").alias("fingerprint"),
            F.lit(n_rows).alias("n_rows"), F.array(F.lit("m")).alias("columns"))

    write_entries(entries(300, 1), path)
    write_entries(entries(3, 7), path)
    assert len(files(path)) <= panels.FOLDERS
    stored = scan_corpus(spark, path)
    assert stored.count() == 300 and stored.filter("n_rows = 7").count() == 3
