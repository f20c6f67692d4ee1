import pytest
from pyspark.sql import functions as F

from chronotier import session


def test_a_cluster_without_a_shared_folder_raises(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        getConf = staticmethod(lambda: Conf)  # noqa: N815

    class Session:
        conf, sparkContext = Conf, Context

    for master in ("spark://a:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://a"):
        Context.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(Session)
    for master in ("local", "local[4]", "local[*]"):
        Context.master = master
        assert "chronotier-" in session.shared_dir(Session)
    Conf.get = staticmethod(lambda *a: "hdfs:///shared/")
    assert session.shared_dir(Session) == "hdfs:///shared"


def test_broadcasts_go_by_bytes(spark):
    narrow = session.stage(spark.range(1000).select("id"), "narrow")
    wide = session.stage(spark.range(1000).select("id", F.sequence(F.lit(0), F.lit(99)).alias("a"), F.repeat(F.lit("x"), 1000).alias("s")), "wide")
    assert session.memory_bytes(narrow) == 24_000
    assert session.memory_bytes(wide) == 1000 * (16 + 8 + 16 + 800 + 16 + 1000)
    assert session.memory_bytes(narrow.limit(0)) == 0
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(session.broadcast_if_small(narrow, 100_000)) and not hinted(session.broadcast_if_small(wide, 100_000))
    with pytest.raises(TypeError):
        session.memory_bytes(narrow.select(F.struct("id").alias("s")))
