import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentryflow import staging


def test_batches_are_bounded_by_bytes(spark):
    df = staging.staged(spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("t")).coalesce(1))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    assert max(r.n for r in df.mapInArrow(sizes, "n long").collect()) < 2 * staging.BATCH_BYTES


def test_staged_tables_can_be_removed(spark):
    import glob

    staging.staged(spark.range(3))
    root = staging.shared_dir(spark).replace("file://", "")
    assert glob.glob(f"{root}/{staging.FOLDER}/{spark.sparkContext.applicationId}/stage-*")
    staging.remove_staged(spark)
    assert not glob.glob(f"{root}/{staging.FOLDER}/{spark.sparkContext.applicationId}/stage-*")


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        staging.shared_dir(Session())


def test_driver_collects_over_half_of_its_heap():
    from types import SimpleNamespace as Part

    from sentryflow.staging import release

    for total, want in ((400, []), (600, ["gc"])):
        did = []
        heap = Part(totalMemory=lambda total=total: total, maxMemory=lambda: 1000)
        system = Part(gc=lambda did=did: did.append("gc"))
        java = Part(lang=Part(Runtime=Part(getRuntime=lambda heap=heap: heap)))
        release(Part(_jvm=Part(java=java, System=system)))
        assert did == want
