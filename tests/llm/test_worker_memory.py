"""What Python workers keep between steps."""

from leafstack.llm import common


def test_a_step_without_tables_drops_what_others_kept(monkeypatch):
    """A worker that has encoded holds its vocabulary and pieces while it counts words."""
    given = []
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "worker_returns", lambda: given.append(dict(common._KEPT)))
    common.worker_keeps("pieces", dict)
    assert list(common.returning(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]
    assert common._KEPT == {"pieces": {}} and given == [{"pieces": {}}]
    assert list(common.returning(lambda batches: batches, keeps=False)(iter([1]))) == [1]
    assert common._KEPT == {} and given[1:] == [{}, {}]


def test_freed_memory_is_returned_when_a_step_ends_early(monkeypatch):
    given = []
    monkeypatch.setattr(common, "worker_returns", lambda: given.append(1))
    rows = common.returning(iter)(iter([1, 2]))
    next(rows)
    rows.close()
    assert given == [1]
