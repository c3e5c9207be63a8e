"""Run registered queries on Spark and their oracle SQL on DuckDB, compare like the driver does.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from relq.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def table_digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    normed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256("\n".join(normed).encode()).hexdigest()
    return cols, len(rows), h, normed


_DUCK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "FLOAT": "float", "HUGEINT": "hugeint", "DECIMAL": "decimal"}


def _type_diff(spark_types: dict, duck_types: dict) -> dict:
    out = {}
    for c, t in spark_types.items():
        d = duck_types.get(c)
        if d is None:
            continue
        dn = _DUCK.get(d.split("(")[0], d.lower())
        if dn != t:
            out[c] = (t, d)
    return out


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def check(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        sdf = qs[name](spark, sf_dir)
        srows = [tuple(r) for r in sdf.collect()]
        scols = sdf.columns
        t1 = time.time()
        s = table_digest(scols, srows)
        if name not in orc:
            results[name] = {"rows": s[1], "oracle": None, "spark_sec": round(t1 - t0, 2)}
            if verbose:
                print(f"{name:28s} rows={s[1]:7d} (no oracle) {t1 - t0:.1f}s", flush=True)
            continue
        cur = con.execute(orc[name])
        ocols = [d[0] for d in cur.description]
        otypes = {d[0]: str(d[1]) for d in cur.description}
        orows = cur.fetchall()
        o = table_digest(ocols, orows)
        ok = s[0] == o[0] and s[1] == o[1] and s[2] == o[2]
        type_diff = _type_diff(dict(sdf.dtypes), otypes)
        results[name] = {"ok": ok, "cols": s[0] == o[0], "rows": (s[1], o[1]), "hash": s[2] == o[2],
                         "spark_sec": round(t1 - t0, 2), "type_diff": type_diff}
        if verbose and type_diff:
            print(f"   types differ: {type_diff}")
        if verbose:
            print(f"{name:28s} {'OK ' if ok else 'BAD'} rows={s[1]}/{o[1]} cols={s[0] == o[0]} hash={s[2] == o[2]} "
                  f"{t1 - t0:.1f}s", flush=True)
            if not ok:
                if s[0] != o[0]:
                    print("   spark cols", s[0], "\n   oracle cols", o[0])
                else:
                    a, b = set(s[3]), set(o[3])
                    for x in list(a - b)[:3]:
                        print("   spark only:", x[:400])
                    for x in list(b - a)[:3]:
                        print("   oracle only:", x[:400])
    return results


if __name__ == "__main__":
    from relq.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    res = check(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v.get("ok") is False]
    print("BAD:", bad)
