"""Row keys and slots of table cells, by windows over one table row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_row_key, visible
from ..functions.tokens import is_single_number


def with_slots(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds row_key (the row's first visible cell), row_slot (place among visible cells) and numeric_slot."""
    seen = F.col("table_cell") & F.col("table").isNotNull() & visible(F.col("text"))
    marked = blocks.withColumn("_seen", F.coalesce(seen, F.lit(False)))
    marked = marked.withColumn("_number", F.when(F.col("_seen"), F.coalesce(is_single_number(F.col("text")), F.lit(False))))
    # visible cells of a row stand apart from the others, which get nulls
    w = Window.partitionBy(doc, "table", "row", "_seen").orderBy("col", "order")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slotted = marked.withColumn("row_slot", F.when(F.col("_seen"), F.row_number().over(w) - 1))
    slotted = slotted.withColumn("numeric_slot", F.when(F.col("_number"), F.sum(F.col("_number").cast("int")).over(upto).cast("int") - 1))
    # the key is made once a row, of its first cell
    slotted = slotted.withColumn("_key", F.when(F.col("row_slot") == 0, normalize_row_key(F.col("text"))))
    key = F.first("_key").over(whole)
    return slotted.withColumn("row_key", F.when(key != "", key)).drop("_seen", "_number", "_key")
