"""Row identity and storage shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

__all__ = ["ID", "ROW", "materialize", "plain_id", "rows_of", "site"]

# A row is known by its id and its whole text, so repeated ids with other texts stay apart
# and a repeated row gets the same answer twice.  Neither column is ever null.
ROW, ID = "_row", "_id"
_NO_ID = -(2**63)


def rows_of(docs: DataFrame, *columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row``, ``_id``, the text as ``_text`` (null: empty) and the wanted columns, nothing else."""
    return docs.select(
        F.xxhash64(id_col, text_col).alias(ROW),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias(ID),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        *columns,
    )


def plain_id() -> Column:
    """The id as it was, null included."""
    return F.when(F.col(ID) != _NO_ID, F.col(ID))


def site(col: str) -> Column:
    """A site as a text that is never null; a missing site is a site of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(col)), F.lit("-"))
