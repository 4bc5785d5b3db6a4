"""Columns over tables given as arrays of rows, the first row being the header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import as_column


def header(grid: Column | str) -> Column:
    """The first row; empty for an empty table."""
    return F.coalesce(F.try_element_at(as_column(grid), F.lit(1)), F.array().cast("array<string>"))


def row_count(grid: Column | str) -> Column:
    """Rows with the header."""
    return F.coalesce(F.greatest(F.size(as_column(grid)), F.lit(0)), F.lit(0))


def column_count(grid: Column | str) -> Column:
    return F.size(header(grid))


def csv(grid: Column | str) -> Column:
    """Comma-separated lines; null cells are empty, cells with commas, quotes or line ends are quoted."""
    quoted = lambda c: F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda row: F.array_join(F.transform(row, lambda c: quoted(F.coalesce(c, F.lit("")))), ",")
    return F.array_join(F.transform(as_column(grid), line), "\n")


def row_maps(grid: Column | str) -> Column:
    """Each row below the header as a map from header to cell; a header cell that repeats keeps its last cell."""
    grid = as_column(grid)
    names = header(grid)
    last = F.filter(F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))), lambda i: ~F.array_contains(F.coalesce(F.slice(names, i + 1, F.size(names)), F.array().cast("array<string>")), F.get(names, i - 1)))
    row = lambda cells: F.map_from_entries(F.transform(last, lambda i: F.struct(F.coalesce(F.get(names, i - 1), F.lit("")), F.get(cells, i - 1))))
    return F.when(F.size(grid) > 1, F.transform(F.slice(grid, F.lit(2), F.size(grid)), row)).otherwise(F.array().cast("array<map<string,string>>"))


def as_json(page: Column | str, grid: Column | str) -> Column:
    grid = as_column(grid)
    return F.to_json(F.struct(as_column(page).alias("page"), row_count(grid).alias("rows"), column_count(grid).alias("cols"), grid.alias("data")))
