"""Compare a Spark result with a DuckDB result, order aside."""

from __future__ import annotations

import glob
import os

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def differences(df, con, sql: str) -> list[str]:
    """What differs; empty when the results are equal."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in found.description}
    if types != dict(df.dtypes):
        problems.append(f"types {dict(df.dtypes)} vs {types}")
    order = [names.index(c) for c in sorted(names)]
    theirs = sorted((tuple(row[i] for i in order) for row in found.fetchall()), key=repr)
    ours = sorted((tuple(row) for row in df.select(*sorted(names)).collect()), key=repr)
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} vs {len(theirs)}")
    if ours != theirs:
        wrong = [(a, b) for a, b in zip(ours, theirs) if a != b][:3]
        problems.append(f"values {wrong}")
    return problems
