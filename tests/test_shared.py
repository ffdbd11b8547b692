from types import SimpleNamespace

import pytest

from stratalog.shared import fresh_path, materialize, shared_dir


def test_tables_lie_in_the_folder_of_the_application(spark):
    where = shared_dir(spark)
    assert where.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir")) and where.endswith(spark.sparkContext.applicationId)
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
    df = materialize(spark.range(5).repartition(2), "t")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4] and all(where in f for f in df.inputFiles())


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    context = SimpleNamespace(master=master, getConf=lambda: {}, applicationId="a")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=context))
