"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_row_number(
    rows: DataFrame,
    group: str,
    sections: Sequence[str | Column],
    rest: Sequence[str | Column],
    section_keys: Sequence[str],
    name: str,
) -> DataFrame:
    """0-based row number per ``group`` in the order (sections, rest), as column ``name``.

    A plain window would sort a hot group in one task. Here rows are numbered
    within (group, section), and the sizes of the sections before it are added;
    only one row per section meets in a window over the group. ``section_keys``
    are the columns that make up a section, ``sections`` the same with their
    sort direction. ``rows`` is used twice: pass a stored table, or rows that
    are already partitioned by the section, so that the exchange is reused. The
    sections may be nearly as many as the rows, and Spark guesses them small where
    ``rows`` come from a blow-up: a merge join keeps them off the driver.
    """
    keys = [group, *section_keys]
    before = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("in_section"))
        .select(
            *keys,
            F.coalesce(
                F.sum("in_section").over(
                    Window.partitionBy(group)
                    .orderBy(*sections)
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("before_section"),
        )
    )
    within = Window.partitionBy(*keys).orderBy(*rest)
    return (
        rows.withColumn(name, F.row_number().over(within) - 1)
        .join(before.hint("merge"), keys)
        .withColumn(name, F.col("before_section") + F.col(name))
        .drop("before_section")
    )
