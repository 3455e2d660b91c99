"""What Python workers hold, and what leaves a task at once."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa

from plyspark.llm import jaccard
from plyspark.llm.common import prepare
from plyspark.llm.queries import tokenizer
from plyspark.llm.textkernel import SLICE_BYTES, family, slices
from plyspark.llm.token_records import read_token_records, token_records, write_token_records


def test_workers_give_freed_memory_back(spark):
    prepare(spark)

    def tell(batches):
        import os

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"pool": [pa.default_memory_pool().backend_name], "most": [os.environ.get("MALLOC_TRIM_THRESHOLD_")]})

    rows = spark.range(8).mapInArrow(tell, "pool string, most string").distinct().collect()
    assert [tuple(r) for r in rows] == [("system", str(8 << 20))]


def test_powers_of_few_families_are_kept():
    words = np.arange(100, dtype=np.uint64)
    tracemalloc.start()
    for seed, lower in itertools.product(range(900, 904), (False, True)):
        family(seed, lower).spans(words, np.arange(99), np.arange(1, 100))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40 << 20


def test_hashes_of_a_very_long_text():
    one, long = pa.array(["end"]), pa.array(["word " * (SLICE_BYTES // 4) + "end"])
    (a,), (b,) = ([w.hashes(11, lower=True) for _, _, w in slices(x)] for x in (one, long))
    assert a[0] == b[-1] and len(set(b.tolist())) == 2


def test_pairs_of_one_collection_leave_bit_by_bit():
    n = 400
    point = np.ones(jaccard.GROUPS, "<u2").tobytes()
    batch = pa.RecordBatch.from_pydict({
        "sig": [7] * n, "i": [0] * n, "j": [0] * n, "block": [0] * n, "node": list(range(n)), "comp": list(range(n)),
        "n": [jaccard.GROUPS] * n, "point": [point] * n, "sigs": [[7]] * n,
    })
    out = list(jaccard._cross_pairs(iter([batch])))
    assert max(b.num_rows for b in out) <= 20_000
    assert {p for b in out for p in zip(*(c.to_pylist() for c in b.columns))} == set(itertools.combinations(range(n), 2))


def test_records_are_read_without_rows_of_python_objects(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b c"), (1, None), (3, "a")], "doc_id long, text string")
    path, folder = tokenizer("word_bpe_49k.json"), tmp_path.as_uri()
    read = read_token_records(write_token_records(docs, folder, path), folder)
    assert "ExistingRDD" not in read._jdf.queryExecution().toString()
    rows = read.orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [1, 2, 3]
    assert [r.start for r in rows] == [0, rows[0].n_tokens, rows[0].n_tokens + rows[1].n_tokens]
    assert token_records(docs.limit(0), path).count() == 0
