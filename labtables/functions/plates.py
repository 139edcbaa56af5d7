"""Well positions and per-well ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labtables import schemas as S
from labtables.functions._cols import ColumnOrName, as_col


def well_row(well: ColumnOrName) -> Column:
    """0-based row of a well id such as ``C7``; null outside A-P."""
    row = F.ascii(F.substring(as_col(well), 1, 1)) - 65
    return F.when(row.between(0, S.PLATE_ROWS - 1), row)


def well_column(well: ColumnOrName) -> Column:
    """0-based column of a well id such as ``C7``; null outside 1-24."""
    number = F.regexp_extract(as_col(well), r"^[A-Z]([0-9]{1,2})$", 1)
    column = number.try_cast("int") - 1
    return F.when(column.between(0, S.PLATE_COLUMNS - 1), column)


def well_index(well: ColumnOrName) -> Column:
    """Row-major position 0-383 of a well id."""
    return well_row(well) * S.PLATE_COLUMNS + well_column(well)


def well_id(index: ColumnOrName) -> Column:
    """Inverse of :func:`well_index`."""
    index = as_col(index)
    row = F.char(F.lit(65) + F.floor(index / S.PLATE_COLUMNS))
    return F.concat(row, (F.pmod(index, F.lit(S.PLATE_COLUMNS)) + 1).cast("int").cast("string"))


def sequenced_reads(umi: ColumnOrName, non_tagged: ColumnOrName) -> Column:
    return (as_col(non_tagged) + as_col(umi)) / 2


def umi_percent(umi: ColumnOrName, non_tagged: ColumnOrName) -> Column:
    """Share of tagged fragments in percent; null when there are none at all."""
    umi = as_col(umi)
    return F.try_divide(umi, as_col(non_tagged) + umi) * 100
