import numpy as np
import pyarrow as pa

from gaugeworks.llm import common, lm


def test_workers_give_memory_back_behind_the_last_batch(monkeypatch):
    called = []
    monkeypatch.setattr(common, "give_back", lambda: called.append(1))
    made = common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(made) == 2 and not called
    assert list(made) == [3] and called == [1]


def test_answers_give_memory_back_and_add_up_equal_hashes(monkeypatch):
    called = []
    monkeypatch.setattr(lm, "give_back", lambda: called.append(1))
    rows = [(7, False, [3, 5, 9], [1, 2, 0]), (8, True, [5, 9, 11], [4, 1, 2])]
    table = pa.Table.from_pylist([{"bucket": 0, "order": 1, "chunk": c, "fold": f, "hashes": lm.squeeze_sorted(np.array(h, np.uint64)), "counts": lm.squeeze(np.array(n, np.uint32))} for c, f, h, n in rows])
    out = {r["chunk"]: r for r in lm._answer(table).to_pylist()}
    assert lm.expand(out[7]["total"], np.uint64).tolist() == [1, 6, 1] and out[7]["deleted"] is None
    assert lm.expand(out[8]["total"], np.uint64).tolist() == [6, 1, 2] and lm.expand(out[8]["deleted"], np.uint64).tolist() == [4, 1, 2]
    assert (out[None]["n"], out[None]["v"], out[None]["n_fold"]) == (10, 4, 7)
    assert called
