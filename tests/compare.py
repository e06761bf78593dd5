"""Run registered queries next to their SQL: python -m tests.compare [--sf DIR] [name or prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(cell(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False, name=None))


def compare(spark, con, name, sf_dir):
    from catalog import ORACLE, QUERIES

    t0 = time.time()
    got = QUERIES[name](spark, sf_dir).toPandas()
    t1 = time.time()
    if name not in ORACLE:
        return True, f"rows-only n={len(got)} {t1 - t0:.1f}s"
    want = con.execute(ORACLE[name]).df()
    t2 = time.time()
    gc, g = rows_of(got)
    wc, w = rows_of(want)
    note = f"n={len(g)}/{len(w)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s"
    if gc != wc:
        return False, f"columns {gc} != {wc} {note}"
    if g != w:
        only_g, only_w = sorted(set(g) - set(w)), sorted(set(w) - set(g))
        return False, f"{note} cols={gc} diff={len(only_g)}/{len(only_w)} spark={only_g[:2]} sql={only_w[:2]}"
    return len(g) > 0, note


def main(argv):
    from catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    names = [n for n in QUERIES if not argv or any(n == a or n.startswith(a) for a in argv)]
    spark, con = session(), duck(sf)
    bad = []
    for n in names:
        try:
            ok, note = compare(spark, con, n, sf)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", n, note, flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} ok; failed: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
