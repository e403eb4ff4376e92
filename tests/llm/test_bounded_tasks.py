"""Memory and rows of single tasks stay in bounds (operators 4 and 13, the pipeline's packing)."""
import tracemalloc
import types
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickframe.llm import packing, phrases


def test_packing_holds_a_slice_of_texts_at_once(monkeypatch):
    """op4, the pipeline's packing: a worker's memory goes by its slices of texts, not by the batch; the pieces do not depend on them."""
    import public_tokenizers as T

    monkeypatch.setattr(packing, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 500)) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    run = packing._pack(T.path("byte_bpe_50k.json"), T.path("byte_bpe_50k.tiktoken"), T.PATTERN, packing.WINDOW, packing.OPEN_WINDOWS)
    list(run(iter([batch.slice(0, 10)])))  # imports
    tracemalloc.start()
    rows = 0
    for b in run(iter([batch])):
        rows += b.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 48 << 20
    some = lambda: [r for b in run(iter([batch.slice(0, 300)])) for r in b.to_pylist()]
    whole = some()
    monkeypatch.setattr(packing, "SLICE_BYTES", 5000)
    assert some() == whole


def test_tasks_hand_on_a_row_a_bucket_of_phrases():
    """op13: what a task hands on to the last count is a row a bucket, however many phrases are frequent; merged, nothing of any task is lost, and only whole counts decide."""

    class Sent:
        value = np.full(phrases.BITS >> 6, np.uint64(0xFFFFFFFFFFFFFFFF))

    tasks = [[("x" if i % 2 else None, " ".join(f"w{(t * i * j) % 97}" for j in range(60)) + ". both here") for i in range(20)] for t in (1, 2, 3)]
    plain, sent = Counter(), []
    for rows in tasks:
        batches = [pa.RecordBatch.from_pydict({"lang": pa.array([x for x, _ in rows[a : a + 7]], pa.string()), "text": [y for _, y in rows[a : a + 7]]}) for a in range(0, 20, 7)]
        for b in phrases._spelled(Sent)[0](iter(batches)):
            for r in b.to_pylist():
                plain[r["lang"], r["phrase"], r["k"]] += r["n"]
        got = pa.Table.from_batches(phrases._dealt(Sent, 4)[0](iter(batches)))
        assert sorted(got.column("bucket").to_pylist()) == [0, 1, 2, 3]
        sent.append(got)
    every = pa.concat_tables(sent)
    found = [r for k in range(4) for r in phrases._frequent(15)[0](every.filter(pc.equal(every.column("bucket"), k))).to_pylist()]
    assert {(r["lang"], r["phrase"], r["k"]): r["f"] for r in found} == {x: n for x, n in plain.items() if n >= 15}
    assert len(found) > 20 and plain["x", "both here", 2] == 30
