"""Compare registered queries with their DuckDB text on the driver's tables."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda t: tuple((c is None, c or "") for c in t))


def compare(df, sql: str, con) -> list[str]:
    """Differences between a Spark result and the DuckDB result; empty means equal."""
    problems = []
    rel = con.sql(sql)
    theirs = dict(zip(rel.columns, (str(t) for t in rel.types)))
    ours = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} != {sorted(theirs)}"]
    for name, kind in ours.items():
        if _TYPES.get(kind, kind) != theirs[name]:
            problems.append(f"type of {name}: {kind} vs {theirs[name]}")
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    right = _rows(rel.columns, rel.fetchall())
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    differing = [(a, b) for a, b in zip(left, right) if a != b]
    if differing:
        problems.append(f"{len(differing)} rows differ, first: {differing[0]}")
    return problems


def run(spark, sf_dir: str, names=None, verbose: bool = True) -> dict[str, list[str]]:
    from kontor.catalog.base import ORACLES, QUERIES

    con = connect(sf_dir)
    failures = {}
    for name, build in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in ORACLES:
                problems = compare(df, ORACLES[name], con)
                note = "" if not problems else str(problems)[:900]
            else:
                problems, note = [], f"rows only: {df.count()}"
        except Exception as exc:  # report and go on with the next query
            problems = [f"{type(exc).__name__}: {str(exc)[:900]}"]
            note = problems[0]
        if problems:
            failures[name] = problems
        if verbose:
            print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s {note}", flush=True)
    return failures
