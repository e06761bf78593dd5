import datetime as dt

import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    return session(4)


@pytest.fixture(scope="session")
def make_bars(spark):
    """Daily bars from closes: open = close unless given, range of +-0.1 %."""

    def make(closes, symbol="AAA", start=dt.datetime(2020, 1, 1), opens=None, step=dt.timedelta(days=1)):
        rows = []
        for i, c in enumerate(closes):
            o = float(opens[i]) if opens is not None else float(c)
            rows.append((symbol, start + i * step, o, max(o, c) * 1.001, min(o, c) * 0.999, float(c), 1000.0, i))
        return spark.createDataFrame(
            rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, ord long"
        )

    return make
