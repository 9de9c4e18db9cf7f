"""Lead rows as export cells and CSV lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields whose missing value is UNKNOWN; any other's is NOT_FOUND.
SIZE_FIELDS = ("employee_count", "employee_range", "company_size_status")


def safe_cell(value: Column, missing: str = "NOT_FOUND") -> Column:
    """A cell that no spreadsheet takes for a formula."""
    text = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(missing))
    return F.when(text.rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cell(text: Column) -> Column:
    """A cell quoted where commas, quotes or line ends ask for it."""
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def lines(leads: DataFrame, fields: list[str], empty: bool = False) -> DataFrame:
    """One line of CSV for each lead; times are UTC."""
    cells = []
    for f in fields:
        kind = leads.schema[f].dataType.typeName()
        value = F.concat(F.date_format(f, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")) if kind.startswith("timestamp") else F.col(f)
        cells.append(csv_cell(safe_cell(value, "" if empty else "UNKNOWN" if f in SIZE_FIELDS else "NOT_FOUND")))
    return leads.select(F.concat_ws(",", *cells).alias("line"))


def write_csv(leads: DataFrame, fields: list[str], path: str) -> None:
    """Write lines with CRLF ends; the executors write, one file for each partition."""
    lines(leads, fields).write.option("lineSep", "\r\n").text(path)
