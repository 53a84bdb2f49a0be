"""Settings tables, which the driver reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

#: Rows that a settings table may have.
SETTINGS_ROWS = 1000


def settings_rows(settings: DataFrame) -> list[Row]:
    """The distinct rows of a settings table; one with more than :data:`SETTINGS_ROWS` is an error, not cut."""
    found = settings.distinct().limit(SETTINGS_ROWS + 1).collect()
    if len(found) > SETTINGS_ROWS:
        raise ValueError(f"a settings table has at most {SETTINGS_ROWS} rows")
    return found
