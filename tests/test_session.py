"""Sessions: the bound of Arrow batches and the shared folder."""

from types import SimpleNamespace

import pytest

from coppice import session


def test_batches_are_bounded_in_sessions_with_defaults(spark):
    before = spark.conf.get(session._BATCH_CONF)
    try:
        spark.conf.unset(session._BATCH_CONF)
        session.ship(spark)
        assert spark.conf.get(session._BATCH_CONF) == f"{session.BATCH_BYTES}b"
        spark.conf.set(session._BATCH_CONF, "1m")
        session.ship(spark)
        assert spark.conf.get(session._BATCH_CONF) == "1m"
    finally:
        spark.conf.set(session._BATCH_CONF, before)


def test_no_local_folder_on_a_cluster():
    nothing = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: nothing, getCheckpointDir=lambda: None, master="spark://one:7077")
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=nothing, sparkContext=context))


def test_removed_folders_are_gone(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    session.removed(spark, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()
