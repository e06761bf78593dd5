"""Staged tables live in the shared folder until they are released."""

import os

from tidemark import session


def test_staged_tables_are_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "work_root", lambda _: str(tmp_path))
    was = dict(session._STAGED)
    try:
        df = session.staged_once(spark, ("t",), lambda: spark.range(5))
        assert df.count() == 5 and session.staged_once(spark, ("t",), lambda: 1 / 0) is df
        assert os.listdir(tmp_path) == [spark.sparkContext.applicationId]
        session.release(spark)
        assert not [f for f in os.listdir(tmp_path) if not f.startswith(".")]
        assert session.staged_once(spark, ("t",), lambda: spark.range(7)).count() == 7
        session.release(spark)
    finally:
        session._STAGED.clear()
        session._STAGED.update(was)
