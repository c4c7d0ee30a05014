"""Hierarchical JSON configuration and ablation grids, on the driver."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MISSING = object()


def merged(base: dict, over: dict, cast: bool = False, in_place: bool = False) -> dict:
    """base with over laid on it, dict by dict; cast: give a value the type of the one it replaces (so bool("false") is True)."""
    out = base if in_place else copy.deepcopy(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            merged(out[k], v, cast, in_place=True)
        elif cast and out.get(k) is not None and not isinstance(v, dict):
            out[k] = type(out[k])(v)
        else:
            out[k] = copy.deepcopy(v)
    return out


def nested(flat: dict[str, object], separator: str = ":") -> dict:
    """{"a:b": 1} as {"a": {"b": 1}}."""
    out: dict = {}
    for key, v in flat.items():
        *path, last = key.split(separator)
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = v
    return out


def read_grid(path: str | Path) -> list[dict]:
    """Rows of a grid file (a header row, then value rows) as flat dicts."""
    header, *rows = json.loads(Path(path).read_text())
    return [dict(zip(header, r, strict=True)) for r in rows]


def grid_row(path: str | Path, number: int) -> dict:
    rows = read_grid(path)
    if not 0 <= number < len(rows):
        raise ValueError(f"the grid has {len(rows)} rows, there is no {number}")
    return nested(rows[number])


def grid_frame(spark: SparkSession, path: str | Path) -> DataFrame:
    """The grid as a DataFrame of overrides, to join a sweep with."""
    header, *rows = json.loads(Path(path).read_text())
    return spark.createDataFrame([tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) and h != "seed" else v for h, v in zip(header, r)) for r in rows], header)


def load(task: str | Path, model: str | Path | None = None, grid: str | Path | None = None, row: int | None = None, args: dict | None = None) -> dict:
    """Task, model, grid row and arguments, later ones winning; arguments that are None do not count."""
    if grid is not None and row is None:
        raise ValueError("a grid needs the number of a row")
    out: dict = {}
    for path in (task, model):
        if path is not None:
            out = merged(out, json.loads(Path(path).read_text()))
    if grid is not None:
        out = merged(out, grid_row(grid, row))
    return merged(out, {k: v for k, v in (args or {}).items() if v is not None}, cast=True)


def difference(a: dict, b: dict) -> dict:
    """{key: (in a, in b)} of what differs, nested where both are dicts; MISSING stands for no value."""
    out = {}
    for k in [*a, *(x for x in b if x not in a)]:
        x, y = a.get(k, MISSING), b.get(k, MISSING)
        if isinstance(x, dict) and isinstance(y, dict):
            if inner := difference(x, y):
                out[k] = inner
        elif x is MISSING or y is MISSING or x != y:
            out[k] = (x, y)
    return out


class Registry:
    """Callables by name."""

    def __init__(self):
        self.known: dict[str, Callable] = {}

    def register(self, f: Callable) -> Callable:
        self.known[f.__name__] = f
        return f

    def build(self, name: str, **kwargs):
        if name not in self.known:
            raise ValueError(f"unknown name {name}; known are {sorted(self.known)}")
        return self.known[name](**kwargs)


def sweep(rows: list[dict], f: Callable[[dict], object]) -> Iterator[tuple[dict, object]]:
    """f of each row; an error becomes the row's result, and the sweep goes on."""
    for r in rows:
        try:
            yield r, f(r)
        except Exception as e:  # noqa: BLE001
            yield r, e
