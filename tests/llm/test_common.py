import pyarrow as pa
from pyspark.sql import functions as F

from tallyband.llm.common import BATCH_BYTES, mapped


def test_batches_are_bounded_by_bytes(spark):
    """Long texts come in batches of about BATCH_BYTES, all of them; a text over the bound is whole."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    rows = spark.range(0, 401, 1, 1).select(F.expr("repeat('x', if(id = 400, 20000000, 100000))").alias("text"))
    got = mapped(rows, sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 401 and sum(r.bytes for r in got) >= 60_000_000
    assert len(got) > 4 and all(r.bytes < 2 * BATCH_BYTES for r in got[:-1])
