"""What a task of Python holds at once, whatever the size of Spark's batches."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cadenza.operators import blocks as B
from cadenza.operators.band_views import _values


class Plain:
    """Stands for a DataFrame; gives what would run in a task."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, run, schema):
        return run


def test_rows_are_unpacked_and_handed_back_in_pieces(spark):
    values = pa.ListArray.from_arrays(np.arange(0, 4_000_001, 1000), np.arange(4e6))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), values], ["rec", "v"])
    run = B.by_rows(Plain(spark), "rec long, v array<double>, least double", lambda r: iter([(r.rec, r.v.tolist(), None if r.rec % 2 else r.v[0])]))
    got = []
    tracemalloc.start()
    for out in run(iter([batch])):
        assert out.num_rows * 1001 <= B.PIECE_CELLS + 1002
        got += zip(out.column(0).to_pylist(), (v[999].as_py() for v in out.column(1)), out.column(2).to_pylist(), strict=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(i, i * 1000.0 + 999, None if i % 2 else i * 1000.0) for i in range(4000)]
    # all rows at once would be 4 million numbers of 32 bytes
    assert most < 30_000_000


def test_segments_go_out_as_values(spark):
    x = spark.createDataFrame([("a", n, float(n)) for n in (2, 0, 1)], "rec string, n long, value double")
    found = _values(x, 10)
    assert dict(found.dtypes)["v"] == "array<double>" and found.first().v == [0.0, 1.0, 2.0]
