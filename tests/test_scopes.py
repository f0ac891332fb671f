"""Queries that list most groups: right sets of queries, in memory far below a sort of all lists."""

import tracemalloc

import numpy as np
import pyarrow as pa

from paperloom.operators import similarity


def table(lists, kind):
    vectors = pa.array([[1.0, float(k)] for k in range(len(lists))], pa.list_(pa.float64()))
    return pa.table({"q": pa.array(range(len(lists))), "_v": vectors, "seen": pa.chunked_array([pa.array(lists, pa.list_(kind))])})


def test_lists_of_either_kind_give_the_same_queries(monkeypatch):
    monkeypatch.setattr(similarity, "MARKED_CELLS", 2)
    lists = [["a", "b", None, "a"], None, [], ["b"], ["c", "a", "b"], [None, "c", "b"], None]
    for more in (0, 40):  # groups that one query alone lists
        all_of = [*lists, [f"g{k}" for k in range(more)]]
        found = similarity._Questions(table(all_of, pa.string()), "q", "seen")
        assert {x.dtype == bool for x in found.allowed.values()} == {not more}
        for group in ["a", "b", "c", None, "g7", "none"]:
            want = [k for k, names in enumerate(all_of) if names is None or group in names]
            assert found.asking(group).tolist() == want, group
        assert found.groups() is None
    assert set(similarity._Questions(table([["a"], ["b", None]], pa.string()), "q", "seen").groups()) == {"a", "b", None}


def test_full_lists_need_little_memory():
    queries, groups = 8_000, 256
    offsets = np.arange(queries + 1, dtype=np.int32) * groups
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.tile(np.arange(groups, dtype=np.int32), queries)))
    given = table([None] * queries, pa.int32()).set_column(2, "seen", pa.chunked_array([lists]))
    tracemalloc.start()
    made = similarity._Questions(given, "q", "seen")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.asking(255).tolist() == list(range(queries))
    assert peak < 16 * queries * groups  # lists of 8 MB; 44 bytes for each listed group when all were sorted
