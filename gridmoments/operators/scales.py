"""Schedules of many grids at once: a table's rows of grid numbers become rows of scales."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T


def scheduled(grids: DataFrame, schedule: Callable[[Row], Iterable[tuple]], form: str) -> DataFrame:
    """(grids' columns, form) of what a function of schedules.py gives for each row; it runs where the rows are.

    A row that has no scales gives no rows. The function gets the row's values by name.
    """
    names = [f.strip().split(" ")[0] for f in form.split(",")]
    schema = T.StructType([*grids.schema.fields, *T.DataType.fromDDL(form).fields])
    own = grids.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*r, *found) for r in frame.itertuples(index=False, name=None) for found in schedule(Row(*own)(*r))]
            yield pd.DataFrame(rows, columns=[*own, *names])

    return grids.mapInPandas(run, schema)
