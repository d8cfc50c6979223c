"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings query_metric page_metric city_event term_index index_change query_kind eval_item".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{'/*.parquet' if Path(sf, t + '.parquet').is_dir() else ''}'")
    return con


def normal(t: pa.Table) -> pd.DataFrame:
    def text(x: object) -> str:
        return "NULL" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)

    columns = {c: [text(x) for x in t.column(c).to_pylist()] for c in sorted(t.column_names)}
    df = pd.DataFrame(columns, dtype=object)
    return df.sort_values(list(df.columns)).reset_index(drop=True) if len(df) else df


def difference(con: duckdb.DuckDBPyConnection, got, sql: str) -> tuple[int, str]:
    """Rows of the query, and what differs from the SQL's."""
    types = dict(got.dtypes)
    rows = got.toArrow()
    want = con.sql(sql).to_arrow_table()
    if sorted(rows.column_names) != sorted(want.column_names):
        return rows.num_rows, f"columns differ: {sorted(set(rows.column_names) ^ set(want.column_names))[:10]}"
    a, b = normal(rows), normal(want)
    if not a.equals(b):
        if len(a) != len(b):
            return len(a), f"rows {len(a)} and {len(b)}"
        return len(a), f"first difference {[(c, a[c][i], b[c][i]) for c in a for i in [next((i for i in range(len(a)) if a[c][i] != b[c][i]), None)] if i is not None][:4]}"
    kinds = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    odd = [(c, types[c], kinds[c]) for c in types if c in kinds and TYPES.get(types[c], kinds[c]) != kinds[c]]
    return len(a), f"types differ: {odd[:4]}" if odd else ""
