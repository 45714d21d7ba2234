import pytest

from patronlens import session

from conftest import rows


def test_steps_keep_types_and_are_released(spark):
    df = spark.sql("SELECT 1 AS a, TIMESTAMP_NTZ '2018-01-01 10:00:00' AS t, array(struct(1.5D AS x)) AS s, CAST(NULL AS STRING) AS n")
    session.release_steps(spark)
    step = session.cut_lineage(df)
    assert step.dtypes == df.dtypes
    assert rows(step) == rows(df)
    assert session.release_steps(spark) == 1 and session.release_steps(spark) == 0


class Cluster:
    """A session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster)


def test_configured_folder_is_used(spark, tmp_path):
    named = []

    class Configured(Cluster):
        class conf:
            @staticmethod
            def get(key, default=None):
                return str(tmp_path) if key == "spark.checkpoint.dir" else default

        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getCheckpointDir():
                return named[-1] if named else None

            @staticmethod
            def setCheckpointDir(folder):
                named.append(folder)

    assert session.shared_folder(Configured) == str(tmp_path)
