"""Registry plus the few helpers both sides of a check share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.derived import bars, fills  # noqa: F401

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir.rstrip("/"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# Rounding with the same double arithmetic on both sides.
def rnd(x, n: int = 4) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    v = x * float(10**n) + 0.5
    # Spark's floor is a long; from 2^53 on a double is whole anyway, as in the SQL.
    return F.when(F.abs(v) < 2.0**53, F.floor(v)).otherwise(v) / float(10**n)


def R(expr: str, n: int = 4) -> str:
    return f"floor(({expr})*1e{n}+0.5)/1e{n}"


def iso(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def ISO(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def out(df: DataFrame, *cols, **digits) -> DataFrame:
    """Plain columns (times as text), then the rounded ones: name=digits."""
    types = dict(df.dtypes)
    plain = []
    for c in cols:
        if types.get(c, "").startswith("timestamp"):
            plain.append(iso(c).alias(c))
        elif types.get(c) == "int":
            plain.append(F.col(c).cast("long").alias(c))
        else:
            plain.append(F.col(c))
    return df.select(*plain, *[rnd(c, n).alias(c) for c, n in digits.items()])


_KEY = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
TICKS = {
    "supp": f"SELECT 'S'||l_suppkey AS symbol, l_shipdate AS ts, 500+l_extendedprice/l_quantity/1000 AS px, l_quantity AS qty, {_KEY} AS k FROM lineitem",
    "lines": f"SELECT l_returnflag AS symbol, l_shipdate AS ts, 500+l_extendedprice/l_quantity/1000 AS px, l_quantity AS qty, {_KEY} AS k FROM lineitem",
    "ticks": f"SELECT l_returnflag AS symbol, l_shipdate + to_seconds((l_orderkey % 10800)*8 + l_linenumber) AS ts, 500+l_extendedprice/l_quantity/1000 AS px, l_quantity AS qty, {_KEY} AS k FROM lineitem",
    "orders": "SELECT o_orderpriority AS symbol, o_orderdate AS ts, 1000+o_totalprice/5000 AS px, 1.0::DOUBLE AS qty, o_orderkey AS k FROM orders",
    "events": "SELECT event_type AS symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, 100+value/20 AS px, 1.0::DOUBLE AS qty, (ts, event_id) AS k FROM events",
    "market": "SELECT 'ALL' AS symbol, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, 100+value/20 AS px, 1.0::DOUBLE AS qty, (ts, event_id) AS k FROM events",
}


def B(kind: str = "supp", recursive: bool = False, name: str = "b") -> str:
    """CTE text of a bar table `name` with positions; later CTEs follow after a comma."""
    return f"""WITH {'RECURSIVE ' if recursive else ''}{ctes(kind, name)}"""


def ctes(kind: str = "supp", name: str = "b") -> str:
    return f"""{name}_t AS ({TICKS[kind]}),
{name}_a AS (SELECT symbol, ts, min_by(px,k) AS open, max(px) AS high, min(px) AS low, max_by(px,k) AS close, sum(qty) AS volume FROM {name}_t GROUP BY symbol, ts),
{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts)-1 AS ord FROM {name}_a)"""


W_SQL = "WINDOW w AS (PARTITION BY symbol ORDER BY ord)"


def ROLL(agg: str, x: str, n: int, min_count: int | None = None, part: str = "symbol", order: str = "ord") -> str:
    frame = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {min_count or n} THEN {agg.format(x=x)} {frame} END"
