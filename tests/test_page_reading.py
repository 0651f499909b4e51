import pyarrow as pa

from panelspark.sources import pages as src


def test_pages_are_folded_a_few_at_a_time():
    html = "<table id='t2'><tr><td>x</td></tr></table>"
    batch = pa.record_batch([pa.array(range(200), pa.int64()), pa.array([html, None] * 100)], names=["page_id", "html"])
    parts = list(src._page_batches(["page_id"], True, True)(iter([batch])))
    assert max(part.num_rows for part in parts) <= src.PAGES_AT_ONCE
    assert [i for part in parts for i in part.column("page_id").to_pylist()] == list(range(200))
    assert parts[0].column("tables").to_pylist()[:2] == [
        [{"id": "t2", "classes": [], "header": [], "rows": [["x"]]}], []]
