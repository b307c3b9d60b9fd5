"""Run registered Spark queries and their DuckDB twins side by side and compare
(row count, column names, order-insensitive values with a float tolerance).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) for x in row)


TOL = float(os.environ.get("ORACLE_TOL", "1e-6"))


def compare(spark_rows, spark_cols, duck_rows, duck_cols, tol=None):
    tol = TOL if tol is None else tol
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: spark-only {sorted(set(spark_cols) - set(duck_cols))} duck-only {sorted(set(duck_cols) - set(spark_cols))}"
    if len(spark_rows) != len(duck_rows):
        return f"row count {len(spark_rows)} vs {len(duck_rows)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in spark_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in duck_rows), key=_key)
    for ra, rb in zip(a, b):
        for c, x, y in zip(order, ra, rb):
            if x is None and y is None:
                continue
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                if abs(float(x) - float(y)) <= tol * max(1.0, abs(float(x))):
                    continue
            if x != y:
                return f"value differs in {c}: {x!r} vs {y!r} (row {ra[:4]} vs {rb[:4]})"
    return None


SPARK_TO_DUCK = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "BooleanType": "BOOLEAN", "FloatType": "FLOAT", "ShortType": "SMALLINT", "ByteType": "TINYINT"}


def type_mismatches(schema, description) -> list[str]:
    duck = {d[0]: str(d[1]) for d in description}
    out = []
    for f in schema.fields:
        st = type(f.dataType).__name__
        want = SPARK_TO_DUCK.get(st)
        got = duck.get(f.name, "?")
        if st == "ArrayType":
            want = SPARK_TO_DUCK.get(type(f.dataType.elementType).__name__, "?") + "[]"
        if want and got.upper() != want:
            out.append(f"{f.name}:{want}/{got}")
    return out


def run(sf_dir: str, names: list[str] | None = None) -> dict:
    import __spark_entry__ as E
    from ebbflow.session import local_session
    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = f"rows-only ({len(rows)} rows)"
            print(f"{name}: {results[name]} {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            drows = cur.fetchall()
            dcols = [d[0] for d in cur.description]
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCK ERROR {str(e)[:300]}"
            print(name, results[name], flush=True)
            continue
        msg = compare(rows, cols, drows, dcols)
        tmis = type_mismatches(df.schema, cur.description)
        if tmis and not msg:
            msg = "TYPES " + ", ".join(tmis)
        results[name] = msg or "OK"
        print(f"{name}: {results[name]} ({len(rows)} rows, {ts:.1f}s)", flush=True)
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    res = run(sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("FAIL", k, v)
