"""Named transforms that others add: run in a pipeline by name, or on what is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Transform = Callable[[DataFrame], DataFrame]
TRANSFORMS: dict[str, Transform] = {}
ON_WRITE: list[str] = []


def transform(name: str, on_write: bool = False):
    """Registers a transform; one ``on_write`` also runs, in order of registration, on every frame that passes written()."""

    def add(f: Transform) -> Transform:
        if name in TRANSFORMS:
            raise ValueError(f"there is a transform named {name}")
        TRANSFORMS[name] = f
        if on_write:
            ON_WRITE.append(name)
        return f

    return add


def remove(name: str) -> None:
    TRANSFORMS.pop(name, None)
    if name in ON_WRITE:
        ON_WRITE.remove(name)


def apply(df: DataFrame, *names: str) -> DataFrame:
    """The transforms of these names, one after the other."""
    for name in names:
        if name not in TRANSFORMS:
            raise KeyError(f"no transform named {name}")
        df = TRANSFORMS[name](df)
    return df


def written(df: DataFrame) -> DataFrame:
    return apply(df, *ON_WRITE)
