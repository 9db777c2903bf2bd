import time

import pytest

from logprism import session


def test_package_is_shipped_once(spark):
    names = [n for n in spark.sparkContext._python_includes if n.startswith(session.ARCHIVE)]
    session.apply_settings(spark)
    again = [n for n in spark.sparkContext._python_includes if n.startswith(session.ARCHIVE)]
    assert len(names) == 1 and again == names


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = session.shared_dir(spark)
    assert folder == (configured or spark.sparkContext.getCheckpointDir())
    assert session.run_dir(spark, "x").startswith(folder)


def test_no_temporary_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_stored_and_pinned_frames_keep_their_rows(spark):
    df = spark.range(100)
    assert session.store(df, "kept").count() == session.pin(df).count() == 100


def test_shuffle_files_of_a_stored_table_go_with_release(spark):
    """At once after the job that wrote them: its plan is the last that the listeners saw."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    session.discard(session.store(spark.range(10), "before"))
    for _ in range(3):
        before = tracker.shuffleStatuses().size()
        kept = session.store(spark.range(1000).repartition(5, "id"), "kept")
        session.release(spark)
        until = time.time() + 5
        while tracker.shuffleStatuses().size() > before and time.time() < until:
            time.sleep(0.1)
        assert tracker.shuffleStatuses().size() <= before and kept.count() == 1000
