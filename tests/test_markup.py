from __future__ import annotations

from moundwork.sources import landing, markup


def test_pages_go_through_workers_in_small_pieces(spark):
    cell = "<table><tr><th>a</th></tr><tr><td>n{0}</td><td>P</td><td>x</td><td>y</td></tr></table>"
    pages = spark.createDataFrame([(i, "u", cell.format(i)) for i in range(700)], "page_id long, url string, html string").coalesce(1)
    rows = landing.injury_table_rows(pages)
    assert sorted(r.cells[0] for r in rows.collect()) == sorted(f"n{i}" for i in range(700))
    sizes = markup.page_parts(pages).mapInArrow(lambda batches: batches, markup.SCHEMA)
    assert sizes.where("kind = 'row'").count() == 1400 and {r.kind for r in sizes.select("kind").distinct().collect()} == {"row", "text", "table"}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= markup.PAGES_AT_ONCE
    assert {r.kind for r in markup.page_parts(pages, ("row",)).collect()} == {"row"}
