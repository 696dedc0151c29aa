"""Batches become Python objects a few rows at a time."""

import pyarrow as pa

from quarryloom.functions import cjk
from quarryloom.operators import extract as E


def test_batches_are_sliced_by_rows_and_bytes():
    short = pa.RecordBatch.from_pydict({"n": list(range(1000))})
    long = pa.RecordBatch.from_pydict({"t": ["x" * (E.SLICE_BYTES // 2)] * 9})
    got = list(E.sliced(iter([short, long, short.slice(0, 0)])))
    assert max(b.num_rows for b in got) == E.SLICE_ROWS
    assert [b.num_rows for b in got if b.schema.names == ["t"]] == [1] * 9
    assert [n for b in got if b.schema.names == ["n"] for n in b.column(0).to_pylist()] == list(range(1000))


def test_a_batch_of_texts_is_normalised_in_slices(monkeypatch):
    seen = []
    listed = cjk.normalise_cjk
    monkeypatch.setattr(cjk, "normalise_cjk", lambda t: seen.append(t) or listed(t))
    texts = ["これは テスト です。", None, "ABC"] * 100
    assert cjk.cjk_normalised.func(pa.array(texts)).to_pylist() == ["これはテストです。", None, "ABC"] * 100
    assert seen == texts and cjk.SLICE_ROWS < len(texts)
    assert cjk.cjk_normalised.func(pa.array([], pa.string())).to_pylist() == []
