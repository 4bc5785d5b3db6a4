"""Extracted fields spread into a matrix, and its condensed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct keys of one matrix; more than that is a fault of the data, not a wider table.
MOST_KEYS = 2000


def keys(papers: DataFrame, data: str = "data") -> list[str]:
    """The keys that occur in the maps, in code-point order. Only names come back, MOST_KEYS at most."""
    found = papers.select(F.explode(F.map_keys(data)).alias("k")).groupBy("k").count().select("k").limit(MOST_KEYS + 1).collect()
    if len(found) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    return sorted(r[0] for r in found)


def pivot(papers: DataFrame, base: list[str], data: str = "data", names: list[str] | None = None) -> DataFrame:
    """base columns, then one column per key of the maps; a missing key is an empty text.

    One projection over the maps, no shuffle: the keys come from ``names`` or one pass before. A key that
    clashes with a base column is set apart by the prefix data_.
    """
    names = keys(papers, data) if names is None else names
    low = {b.lower() for b in base}
    # As in SQL, names that differ in case only would be the same column.
    taken: dict[str, int] = {}
    columns = []
    for name in names:
        alias = f"data_{name}" if name.lower() in low else name
        taken[alias.lower()] = taken.get(alias.lower(), 0) + 1
        if taken[alias.lower()] > 1:
            alias = f"{alias}_{taken[alias.lower()]}"
        columns.append(F.coalesce(F.try_element_at(F.col(data), F.lit(name)), F.lit("")).alias(alias))
    return papers.select(*base, *columns)


def typed(papers: DataFrame, base: list[str], declared: dict[str, str], data: str = "data") -> DataFrame:
    """base columns, then the declared keys in their types; what can't be cast is null.

    integer: the value as a number without its fraction; float: double; else text.
    """
    columns = []
    for name, kind in declared.items():
        cell = F.try_element_at(F.col(data), F.lit(name))
        number = F.trim(cell).try_cast("double")
        value = {"integer": F.when(F.abs(number) < 2.0**62, number).cast("bigint"), "float": number}.get(kind, cell)
        columns.append(value.alias(name))
    return papers.select(*base, *columns)


def _first(column: str, other: str, n: int) -> Column:
    return F.coalesce(F.col(column), F.substring(F.coalesce(F.col(other), F.lit("")), 1, n))


def condensed_parts() -> dict[str, Column]:
    """The condensed texts of a paper by column, else the beginnings of the longer ones."""
    return {
        "authors": F.coalesce("authors", F.lit("Unknown")), "year": F.coalesce(F.col("year").cast("string"), F.lit("n.d.")),
        "condensed_says": _first("condensed_says", "contribution", 150), "condensed_theory_data": _first("condensed_theory_data", "context", 100),
        "condensed_estimation": _first("condensed_estimation", "method", 150), "condensed_result": _first("condensed_result", "results", 100),
    }


def condensed(papers: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """paper, theory_data, estimation, results."""
    part = condensed_parts()
    paper = F.concat(part["authors"], F.lit(" ("), part["year"], F.lit(") says "), part["condensed_says"])
    return papers.select(*(keep or []), paper.alias("paper"), part["condensed_theory_data"].alias("theory_data"), part["condensed_estimation"].alias("estimation"), part["condensed_result"].alias("results"))
