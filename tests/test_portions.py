"""Bodies that queries make are handed on in portions."""

from types import SimpleNamespace

import pyarrow as pa

from palimpsest.plans import catalogue


def test_a_batch_of_many_rows_gives_several_portions():
    told = {}
    rows = SimpleNamespace(mapInArrow=lambda work, schema: told.update(work=work))
    catalogue.made_bodies(rows, lambda i, text: text * (1 << 20), "key long, body binary")
    batches = [pa.record_batch([pa.array(range(40)), pa.array(["t"] * 39 + [None])], ["id", "text"]), pa.record_batch([pa.array([40]), pa.array(["t"])], ["id", "text"])]
    found = list(told["work"](iter(batches)))
    assert [k for b in found for k in b.column(0).to_pylist()] == list(range(41)) and max(b.num_rows for b in found) <= 5
    assert [len(x) for b in found for x in b.column(1).to_pylist()] == [1 << 20] * 39 + [0, 1 << 20]
