"""Where checkpoints go."""

import pytest

from cohortmill.session import cut_lineage, ensure_checkpoint_dir


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, named=None):
        self.sparkContext, self.conf = Context(master), {"spark.checkpoint.dir": named}


def test_the_named_folder_is_used_on_a_cluster():
    session = Session("spark://host:7077", "hdfs:///shared/checkpoints")
    assert ensure_checkpoint_dir(session) == "hdfs:///shared/checkpoints"
    assert session.sparkContext.folder == "hdfs:///shared/checkpoints"


def test_a_cluster_without_folder_is_refused():
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session("yarn"))


def test_local_mode_may_use_a_temporary_folder():
    session = Session("local[4]")
    assert ensure_checkpoint_dir(session) == session.sparkContext.folder
    assert ensure_checkpoint_dir(session) == session.sparkContext.folder


def test_cut_lineage_keeps_rows_and_schema(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) as k")
    out = cut_lineage(df)
    assert out.schema == df.schema and sorted(out.collect()) == sorted(df.collect())
