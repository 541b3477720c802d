"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

usage: python tools/check_oracles.py [sf_dir] [--plain] [name ...]

``--exact`` compares floats bit for bit (no re-rounding); ``--plain`` uses a
bare session (``local[*]``, 8 shuffle partitions, nothing
else set), as an outside caller of ``queries()`` would.
"""
from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from quarry.catalog import load_all  # noqa: E402
from quarry.session import build_session, drop_cuts  # noqa: E402
from quarry.sources.tables import TABLES  # noqa: E402


EXACT = "--exact" in sys.argv


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main():
    args = sys.argv[1:]
    plain = "--plain" in args
    args = [a for a in args if a not in ("--plain", "--exact")]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    reg = load_all()
    if plain:
        # exactly what the driver calls: the entry module's builders and SQL
        import importlib.util
        from types import SimpleNamespace

        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
        root = __file__.rsplit("/tools/", 1)[0]
        spec = importlib.util.spec_from_file_location("spark_entry", f"{root}/__spark_entry__.py")
        entry = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(entry)
        builders, sqls = entry.queries(), entry.oracle_sql()
        reg = {n: SimpleNamespace(build=builders[n], oracle=lambda n=n: sqls.get(n)) for n in builders}
    else:
        spark = build_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf)
            srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        drop_cuts(spark)
        sql = q.oracle()
        if sql is None:
            print(f"ROWS {name}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            t1 = time.time()
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
            td = time.time() - t1
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:800]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={scols} duckdb={dcols}")
            bad += 1
            continue
        order = [dcols.index(c) for c in scols]
        drows = [tuple(r[i] for i in order) for r in drows]
        key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
        ss, ds = sorted(srows, key=key), sorted(drows, key=key)
        if ss == ds:
            print(f"OK   {name}: {len(ss)} rows (spark {ts:.1f}s, duckdb {td:.1f}s)")
        else:
            bad += 1
            print(f"FAIL {name}: spark {len(ss)} rows vs duckdb {len(ds)} rows")
            sset, dset = set(ss), set(ds)
            only_s = [r for r in ss if r not in dset][:3]
            only_d = [r for r in ds if r not in sset][:3]
            print("   only spark :", [tuple(str(x)[:150] for x in r) for r in only_s])
            print("   only duckdb:", [tuple(str(x)[:150] for x in r) for r in only_d])
    print(f"done, {bad} failing")


if __name__ == "__main__":
    main()
