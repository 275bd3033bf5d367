from types import SimpleNamespace

import pytest

from siltstone import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def other(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master, setCheckpointDir=lambda path: None))


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://https://h", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(other(master))
    assert session.shared_dir(other(master, **{"spark.checkpoint.dir": "hdfs://h/x/"})) == "hdfs://h/x"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_session_gets_a_folder(master):
    assert session.shared_dir(other(master)).startswith("file:///")


def test_tables_are_removed(spark):
    written = session.materialize(spark.range(5), "few")
    assert written.count() == 5
    fs, p = session._file_system(spark, session.own_tables(spark))
    assert len(fs.listStatus(p)) >= 1
    session.release(spark)
    assert not fs.exists(p)
    assert session.materialize(spark.range(3), "again").count() == 3
