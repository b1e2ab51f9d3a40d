import pytest

from tallyline.session import checkpoint_root, cluster_conf, materialize


def test_cluster_conf_sizes_partitions():
    big = cluster_conf(100 * 2**40, 1000, 8)
    assert big["spark.sql.shuffle.partitions"] == "409600"   # 256 MB each
    assert big["spark.sql.files.maxPartitionBytes"] == str(512 << 20)
    small = cluster_conf(10 * 2**30, 100, 4)
    assert small["spark.sql.shuffle.partitions"] == "800"   # two per task slot
    assert small["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "800"


def test_partitions_follow_the_widest_shuffle():
    conf = cluster_conf(100 * 2**40, 1000, 8, widest_shuffle_bytes=10 * 2**40)
    assert conf["spark.sql.shuffle.partitions"] == "40960"


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

        class _Conf:
            get = staticmethod(lambda key, default: default)

        getConf = staticmethod(lambda: Context._Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session)


def test_materialized_tables_can_be_dropped(spark):
    table = materialize(spark.range(5), "numbers")
    assert table.count() == 5
    assert table.inputFiles()[0].split("/tables/")[1].startswith(spark.sparkContext.applicationId)


def test_checkpoint_root_uses_session_setting(spark):
    root = checkpoint_root(spark)
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    assert root == configured if configured else spark.sparkContext.getCheckpointDir()
