"""Transforms with an explicit change of the schema, on columns or on pandas batches."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, types as T

from rowfeed.schema import Field


@dataclass(frozen=True)
class Transform:
    """edited: new or changed fields, which go to the end; removed: dropped; selected: what stays, in that order.

    columns: name -> column expression, evaluated by Spark. func: a function of a pandas frame (of one row if by_row gives
    dicts), which must return the output's columns. Without either, only the schema changes. Removed and selected exclude
    each other. All paths project to the declared output.
    """

    columns: Mapping[str, Column] = field(default_factory=dict)
    func: Callable | None = None
    edited: Sequence[Field] = ()
    removed: Sequence[str] = ()
    selected: Sequence[str] | None = None
    by_row: bool = False

    def __post_init__(self) -> None:
        if self.removed and self.selected is not None:
            raise ValueError("removed and selected fields exclude each other")

    def names(self, before: Sequence[str]) -> list[str]:
        """Output names in order."""
        edited = list(dict.fromkeys([*(f.name for f in self.edited), *self.columns]))
        out = [n for n in before if n not in edited] + edited
        if unknown := set(self.removed) - set(out):
            warnings.warn(f"removed fields {sorted(unknown)} don't exist", stacklevel=3)
        if self.selected is not None:
            if unknown := set(self.selected) - set(out):
                warnings.warn(f"selected fields {sorted(unknown)} don't exist", stacklevel=3)
            return [n for n in self.selected if n in out]
        return [n for n in out if n not in self.removed]

    def apply(self, df: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
        """The transformed rows. `carried` columns go past the transform and come after it; a function must then keep rows in number and order."""
        before = [n for n in df.columns if n not in carried]
        names = self.names(before)
        if self.columns:
            df = df.withColumns(dict(self.columns))
        if self.func is None:
            return df.select(*[f"`{n}`" for n in [*names, *carried]])
        edited = {f.name: f.spark() for f in self.edited}
        schema = T.StructType([edited.get(n) or df.schema[n] for n in [*names, *carried]])
        func, by_row, carried = self.func, self.by_row, list(carried)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                beside, frame = frame[carried], frame.drop(columns=carried)
                if by_row:
                    rows = [func(r) for r in frame.to_dict("records")]
                    out = pd.DataFrame([{n: r[n] for n in names} for r in rows], columns=names)
                else:
                    out = func(frame)
                    if set(out.columns) - set(self.removed) != set(names) and self.selected is None:
                        raise ValueError(f"the transform gave columns {sorted(out.columns)}, declared are {sorted(names)}")
                if carried and len(out) != len(beside):
                    raise ValueError(f"the transform gave {len(out)} rows for {len(beside)}; before windows it must keep each")
                out = ravel(out[names], edited)
                yield pd.concat([out.reset_index(drop=True), beside.reset_index(drop=True)], axis=1) if carried else out

        return df.mapInPandas(run, schema)


def ravel(frame: pd.DataFrame, edited: Mapping[str, T.StructField]) -> pd.DataFrame:
    """Arrays of more than one dimension as flat lists; their shape is in the schema."""
    for n in frame.columns:
        if n in edited and isinstance(edited[n].dataType, T.ArrayType):
            frame = frame.assign(**{n: [None if v is None else v.ravel().tolist() if hasattr(v, "ravel") else v for v in frame[n]]})
    return frame
