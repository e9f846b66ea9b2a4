import pyarrow as pa

from tidelog.llm.shared import sliced


def test_slices_keep_every_row_in_order():
    texts = [None, "", "a" * 9, "b", "c" * 30, None, "dé", "e" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["k", "t"])
    for most in (1, 5, 10, 1000):
        got = list(sliced([batch.slice(0, 0), batch.slice(1), batch], 1, most))
        assert [t for b in got for t in b.column(1).to_pylist()] == texts[1:] + texts
        assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= most for b in got)
    assert list(sliced([], 1)) == []
