"""Registration of queries with their output columns and SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.catalog.domain import SQL_FRAMES, Domain

# Output kinds: Spark type, SQL type. Days leave as ISO text, measures rounded.
KINDS = {
    "int": ("int", "INTEGER"),
    "big": ("bigint", "BIGINT"),
    "str": ("string", "VARCHAR"),
    "iso": ("string", "VARCHAR"),
    "bit": ("int", "INTEGER"),
}


@dataclass(frozen=True)
class Entry:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Domain], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Domain(spark, sf_dir))
        return df.select(*[_spark_cell(name, kind) for name, kind in self.columns])

    def statement(self) -> str | None:
        if self.sql is None:
            return None
        frames = ",\n".join(f"{n} AS (\n{SQL_FRAMES[n]}\n)" for n in _needed(self.sql))
        cells = ",\n  ".join(_sql_cell(name, kind) for name, kind in self.columns)
        head = f"WITH {frames}\n" if frames else ""
        return f"{head}SELECT\n  {cells}\nFROM (\n{self.sql.strip()}\n) AS result"


ENTRIES: dict[str, Entry] = {}


def query(name: str, out: str, sql: str | None = None):
    """Register ``fn(domain) -> DataFrame`` under ``name``.

    ``out`` lists ``column kind`` pairs; a kind ``numK`` is a double rounded to
    K digits, ``num`` to 6.
    """
    columns = tuple(tuple(part.split()) for part in out.split(","))

    def register(fn: Callable[[Domain], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, columns, fn, sql)
        return fn

    return register


def _digits(kind: str) -> int:
    return int(kind[3:] or 6)


def _spark_cell(name: str, kind: str):
    if kind.startswith("num"):
        return F.round(F.col(name).cast("double"), _digits(kind)).alias(name)
    return F.col(name).cast(KINDS[kind][0]).alias(name)


def _sql_cell(name: str, kind: str) -> str:
    if kind.startswith("num"):
        r = f"round(CAST({name} AS DOUBLE), {_digits(kind)})"
        return f"CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END AS {name}"
    return f"CAST({name} AS {KINDS[kind][1]}) AS {name}"


def _needed(sql: str) -> list[str]:
    """Frames named in the statement, directly or through another frame."""
    wanted, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name, body in SQL_FRAMES.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                todo.append(body)
    return [n for n in SQL_FRAMES if n in wanted]
