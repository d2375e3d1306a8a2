import os

import pytest

from corpusloom.llm import common


class Session:
    """A session of a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"

        class _jsc:
            class sc:
                class getCheckpointDir:
                    isDefined = staticmethod(lambda: False)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session).startswith("/tmp/checkpoints/")


def test_the_session_names_the_folder():
    class Named(Session):
        class conf:
            get = staticmethod(lambda key, default=None: "file:///shared/x/")

    assert common.shared_dir(Named).startswith("file:///shared/x/corpusloom-")


def test_scratch_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"{tmp_path}/{len(os.listdir(tmp_path))}-{os.urandom(4).hex()}")
    with common.scratch() as outer:
        with common.scratch() as inner:
            gone = common.materialise(spark.range(3), "a")
            kept = inner.keep(common.materialise(spark.range(4), "b"))
        assert not os.path.exists(gone.table_path) and kept.count() == 4
        result = outer.keep(common.materialise(spark.range(5), "c"))
    assert result.count() == 5 and len(os.listdir(tmp_path)) == 1
    free = common.materialise(spark.range(1), "d")
    assert free.count() == 1
