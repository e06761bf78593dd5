"""Long series: some 20 000 to 200 000 bars per symbol, cut into chunks that every operator here must cross."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ORACLE, B, bars, out, query
from tidemark.functions import indicators as ind
from tidemark.operators import drawdown as dd
from tidemark.operators import pnl
from tidemark.operators import returns as ret
from tidemark.operators import signals as sig
from tidemark.plans.series import chunks_of, on_chunks

C = F.col
#: At least four chunks per symbol at every scale factor from 0.01 on.
ROWS = 4096


def ticks(name: str, base: str):
    """Register `name` with the SQL of `base` on ticks; the plan is built with small chunks."""

    def add(fn):
        def run(spark, sf):
            with chunks_of(ROWS):
                return fn(bars(spark, sf, "ticks"))

        return query(name, ORACLE[base].replace(B(), B("ticks")))(run)

    return add


def gold(b):
    return sig.golden_cross(b, 20, 60)


@ticks("op_E1_sma_ticks", "op_E1_sma")
def _(b):
    d = on_chunks(b, lambda d, c: ind.add_moments(d, c, {f"sma{n}": ("close", n, "mean") for n in (20, 60)}), back=60)
    return out(d, "symbol", "ts", sma20=4, sma60=4)


@ticks("op_E20_compounding_ticks", "op_E20_compounding")
def _(b):
    d = ret.asset_returns(b).withColumn("h", C("r") / 2)
    return out(ret.compounded_growth(d, "h"), "symbol", "ts", growth=4)


@ticks("op_E21_running_drawdown_ticks", "op_E21_running_drawdown")
def _(b):
    return out(dd.running_drawdown(b, "close"), "symbol", "ts", peak=4, drawdown=6)


@ticks("op_E31_drawdown_episodes_ticks", "op_E31_drawdown_episodes")
def _(b):
    e = dd.drawdown_episodes(b, "close")
    e = e.withColumns({c: C(c).cast("double") for c in ("duration_days", "total_days")})
    return out(e, "symbol", "start_ts", "trough_ts", "recovery_ts", "bars", "duration_days", "total_days", depth=6)


@ticks("op_E33_streaks_ticks", "op_E33_streaks")
def _(b):
    return out(dd.streaks(b.withColumn("pnl", C("close") - C("open"))), "symbol", "sign", "start_ts", "length")


@ticks("op_G1_weight_returns_ticks", "op_G1_weight_returns")
def _(b):
    return out(pnl.weight_returns(gold(b)), "symbol", "ts", r=8, turnover=4)


@ticks("op_G2_next_open_returns_ticks", "op_G2_next_open_returns")
def _(b):
    return out(pnl.next_open_returns(gold(b), warmup=30), "symbol", "ts", "position", r=8)
