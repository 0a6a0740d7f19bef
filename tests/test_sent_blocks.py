"""Blocks of files on their way from Python."""

import pytest

from collatio import plans
from conftest import SF
from test_queries import rows


@pytest.mark.parametrize("name", ["docx_order_blocks", "docx_styles", "html_order_blocks"])
def test_scanned_files_equal_sql(spark, duck, name):
    assert rows(plans.queries()[name](spark, SF).toPandas()) == rows(duck.sql(plans.oracle_sql()[name]).df())


def test_blocks_of_files_go_out_together():
    from collatio.sources import html

    own = html.blocks("<p>one</p><table><tr><td>two<td>3</table>")
    found = list(html.sent([(k, own) for k in range(50)], with_runs=False))
    assert [b.num_rows for b in found] == [150] and "runs" not in found[0].schema.names
    assert found[0].column("text").to_pylist()[:3] == ["one", "two", "3"] and found[0].column("doc_id").to_pylist()[-1] == 49
    whole = list(html.sent([(7, own)]))[0].to_pylist()
    assert whole == [{"doc_id": 7} | b for b in own]
