"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    if isinstance(value, int):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "as_integer_ratio"):
        return float(value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def _close(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-6)
    return a == b


def compare(spark, con, name, query, sql, sf_dir):
    """'' when equal, else what differs."""
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows"
    cursor = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: {got[:3]} / {want[:3]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if not bad:
        return ""
    near = all(all(_close(x, y) for x, y in zip(a, b)) for a, b in bad)
    return f"{'near ' if near else ''}{len(bad)} of {len(got)} rows differ, e.g. {names}\n   {bad[0][0]}\n   {bad[0][1]}"


def main(sf_dir: str, only: list[str]) -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from conftest import session

    import __spark_entry__ as entry

    spark, con = session(), connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if not verdict else 'FAIL'} {name} {time.time() - start:.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
