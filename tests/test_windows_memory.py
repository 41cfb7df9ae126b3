"""Count windows leave as they fill, whatever the length of a key."""

import pandas as pd

from basewise.streaming.windows import _FIELDS, _Windows


class _Handle:
    """State of one key."""

    def __init__(self):
        self.values = {}

    def getValueState(self, name, schema):  # noqa: N802
        return _Value(self.values, name)

    getListState = getValueState  # noqa: N815


class _Value:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values.get(self.name, [])

    def update(self, value):
        self.values[self.name] = value

    def put(self, rows):
        self.values[self.name] = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.values[self.name] = [*self.get(), *rows]

    def clear(self):
        self.values.pop(self.name, None)


def _frame(first, n, eos=False):
    rows = pd.DataFrame({c: [f"{c}{i}" for i in range(first, first + n)] for c in _FIELDS})
    return rows.assign(sample="s", eos=eos)


def _windows(processor, frames):
    return [(w["window"].iat[0], w["name"].tolist()) for w in processor.handleInputRows(("s", 0), iter(frames), None)]


def test_windows_leave_with_the_frame_that_fills_them():
    processor, taken = _Windows(10, None, lambda frame: frame, False), []
    processor.init(_Handle())

    def frames():
        for at in range(0, 1000, 25):
            taken.append(at)
            yield _frame(at, 25)

    out = processor.handleInputRows(("s", 0), frames(), None)
    next(out)
    assert len(taken) == 1  # a key of any length is never held whole
    assert len(list(out)) == 99


def test_windows_over_batches_keep_order_and_rest():
    processor = _Windows(10, None, lambda frame: frame, False)
    processor.init(_Handle())
    out = _windows(processor, [_frame(0, 4)])
    out += _windows(processor, [_frame(4, 3)])
    out += _windows(processor, [_frame(7, 2), _frame(9, 16)])
    out += _windows(processor, [_frame(25, 2), _frame(99, 1, eos=True)])
    out += _windows(processor, [_frame(27, 12)])
    assert [n for n, _ in out] == [0, 1, 2, 3, 4]
    assert [len(names) for _, names in out] == [10, 10, 7, 10, 2]
    assert [n for _, names in out for n in names] == [f"name{i}" for i in range(39)]
