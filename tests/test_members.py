"""Vectors of a class as a task of Python gets them."""

import pyarrow as pa
import pytest

from cadenza.operators.comparison import _members


def test_members_are_a_matrix():
    kind = pa.list_(pa.struct([("id", pa.int64()), ("shape", pa.list_(pa.float64()))]))
    rows = pa.array([[{"id": 1, "shape": [1.0, 2.0]}], [{"id": 5, "shape": [3.0, 4.0]}, {"id": 4, "shape": [5.0, 6.0]}], [{"id": 1, "shape": [1.0]}, {"id": 2, "shape": [1.0, 2.0, 3.0]}]], kind)
    ids, x = _members(rows[1].values)
    assert ids.to_pylist() == [5, 4] and x.tolist() == [[3.0, 4.0], [5.0, 6.0]]
    with pytest.raises(ValueError, match="length"):
        _members(rows[2].values)
