"""Cases dealt over the rows of a table: the values a query is given, and those it should give.

Classifiers are asked about values that the given tables hardly hold. A row of a table gets the
values of one case, by its key modulo the number of cases; the SQL a query is checked against
gives what was worked out by hand for that case. Where real is given every other run of rows
has what its own columns hold instead, and the SQL works the answer out from those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.session import table


def literal(v) -> str:
    """A value in the SQL of both engines."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def dealt(key: str, values: list, kind: str = "", real: str | None = None) -> str:
    """SQL of both engines: the value of the case of a key, or, for half of the keys, of real."""
    cases = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values))
    out = f"CASE {key} % {len(values)} {cases} END" if real is None else f"CASE {key} % {2 * len(values)} {cases} ELSE {real} END"
    return f"CAST({out} AS {kind})" if kind else out


def given(spark: SparkSession, sf_dir: str, name: str, key: str, columns: dict[str, list], kinds: dict[str, str] | None = None, real: dict[str, str] | None = None) -> DataFrame:
    """The key of each row of a table, and columns with the values of its case (real: SQL of both
    engines over the row's own columns, by column; those without one are null there).

    Rows are dealt by key: what is asked of a row takes long, and a table of millions of rows may be one file
    of a few megabytes, which one task would read and judge alone."""
    kinds, own = kinds or {}, (lambda c: None) if real is None else (lambda c: real.get(c, "NULL"))
    escaped = {c: [v.replace("\\", "\\\\") if isinstance(v, str) else v for v in vs] for c, vs in columns.items()}
    return table(spark, sf_dir, name).selectExpr(key, *[f"{dealt(key, v, kinds.get(c, ''), own(c))} AS {c}" for c, v in escaped.items()]).repartition(key)


def expected(name: str, key: str, columns: dict[str, list], kinds: dict[str, str] | None = None, real: dict[str, str] | None = None) -> str:
    """DuckDB SQL of the answers."""
    kinds, own = kinds or {}, (lambda c: None) if real is None else (lambda c: real.get(c, "NULL"))
    return f"SELECT {key}, " + ", ".join(f"{dealt(key, v, kinds.get(c, ''), own(c))} AS {c}" for c, v in columns.items()) + f" FROM {name}"


def columns(names: str, rows: list[tuple]) -> dict[str, list]:
    """Rows of cases as columns."""
    return {n: [r[i] for r in rows] for i, n in enumerate(names.split())}
