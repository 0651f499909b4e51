import os
from hashlib import md5

import pytest

from workload import odd_queries
from workload.odd_queries import charset_pages


def test_charset_pages_are_written_by_one_job(spark, tmp_path):
    htmls = ["a é", "b é", "c é", "d é", "e 中", "f 中", "g 中", None]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string").coalesce(1).write.parquet(
        str(tmp_path / "pages.parquet"))
    spark.sparkContext.setJobGroup("charset", "")
    try:
        got = {r.page_id: r.digest for r in charset_pages(spark, str(tmp_path)).collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("charset")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    shown = ["a é\n", "b é€\n", "c é€\n", "d é�\n", "e 中\n", "f 中\n", "g 中\n", "\n"]
    assert got == {i: md5(text.encode()).hexdigest() for i, text in enumerate(shown)}
    assert len(jobs) <= 3  # the shuffle, the files, the answer; one more for each charset before


@pytest.mark.parametrize("by_tasks", [True, False])
def test_charset_pages_need_no_folder_a_page(spark, tmp_path, monkeypatch, by_tasks):
    # Page 1 has two rows, page 5 has them in two charsets, one page has no number.
    rows = [(i, f"page {i} é") for i in range(40)] + [(1, "page 1 é"), (5, "中"), (None, "lost")]
    spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    root = tmp_path / "files"
    monkeypatch.setattr(odd_queries, "scratch_path", lambda spark, name: str(root))
    if not by_tasks:  # a store that tasks cannot open
        monkeypatch.setattr(odd_queries, "written_by_tasks", lambda spark, rows, root: False)
    got = sorted((r.page_id, r.digest) for r in charset_pages(spark, str(tmp_path)).collect())
    ends = {0: "\n", 1: "€\n", 2: "€\n", 3: "\ufffd\n"}
    shown = [(i, f"page {i} é{ends[i % 4]}" * (2 if i == 1 else 1)) for i in range(40)] + [(5, "中\n")]
    assert got == sorted((i, md5(text.encode()).hexdigest()) for i, text in shown)
    folders = [folder for _, inner, _ in os.walk(root) for folder in inner]
    assert len(folders) == 4 if by_tasks else len(folders) > 40
    assert not [name for _, _, names in os.walk(root) for name in names if by_tasks and not name.startswith("page_id=")]


def test_charset_pages_of_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert charset_pages(spark, str(tmp_path)).collect() == []
