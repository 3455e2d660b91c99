"""Benchmark decontamination: finds test items inside documents by containment of word shingles.

A document holds an item when at least 75 % of the item's distinct five-word shingles occur in it.
Items are partitioned by size.  In the partition of items with q shingles, an item's sketch is its bottom-k
MinHash signature, its k shingles of the smallest hashes, with k = q - ceil(0.75 q) + 1: a document that holds
75 % of the item misses at most k - 1 of its shingles, so it holds one of the k, and recall is 1.  The share of
the k that a document holds estimates the containment without bias, as the k are a random sample of the item;
a hit is then verified on exact shingle sets.  Signatures of the documents are of no use here: a 30-shingle
item in a 20,000-word document has a resemblance near 0.001, so the smallest hashes of such a document are
hardly ever the item's.  Documents are streamed past the index; those too small for a partition skip it.

Items are a stated query set: they are read in blocks of bounded size and each block is broadcast to one
pass over the documents, so any number of items works in the same memory.

Defined results: items of fewer than five words have no shingles and are found nowhere; null texts count
as empty; equal rows of either table each count; other columns are ignored; an empty table on either side
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, without, written
from .shingles import shingle_sets

#: A block of items: at most so many, and so many characters (one longer item is a block of its own).
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16 << 20
FOUND = "doc_id long, item_id long, n_shared int, n_item int, containment double"
_FILTER_BITS = 22


class Sketches:
    """The index of one block of items."""

    def __init__(self, ids: list[int | None], texts: list[str | None], percent: int):
        self.ids, self.percent = ids, percent
        sets = [(values[a:b]) for _, _, values, offsets in shingle_sets(pa.array(texts, pa.large_string()), False) for a, b in zip(offsets[:-1], offsets[1:])]
        self.sets = sets
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, own in enumerate(sets):
            if len(own):
                # Hashes ascend, so the first k are the bottom-k signature.
                by_size.setdefault(len(own).bit_length(), []).append((own[: len(own) - self.least(len(own)) + 1], item))
        # One size partition after another: (smallest number of shingles a holder has, hashes, items).
        self.partitions = []
        for _, members in sorted(by_size.items()):
            hashes = np.concatenate([h for h, _ in members])
            items = np.repeat([i for _, i in members], [len(h) for h, _ in members])
            order = np.argsort(hashes, kind="stable")
            self.partitions.append((min(self.least(len(sets[i])) for _, i in members), hashes[order], items[order]))
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        for _, hashes, _ in self.partitions:
            self.maybe[hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def least(self, size: int) -> int:
        return -(-size * self.percent // 100)

    def search(self, values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of verified pairs; values: each text's distinct shingles ascending."""
        sizes = np.diff(offsets)
        text = np.repeat(np.arange(len(sizes)), sizes)
        hit = np.flatnonzero(self.maybe[values >> np.uint64(64 - _FILTER_BITS)])
        found = set()
        for least, hashes, items in self.partitions:
            some = hit[sizes[text[hit]] >= least]
            low, high = np.searchsorted(hashes, values[some], "left"), np.searchsorted(hashes, values[some], "right")
            for i in np.flatnonzero(high > low).tolist():
                found.update((int(text[some[i]]), int(item)) for item in items[low[i] : high[i]])
        for t, item in sorted(found):
            own, theirs = self.sets[item], values[offsets[t] : offsets[t + 1]]
            at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
            shared = int((theirs[at] == own).sum())
            if shared * 100 >= self.percent * len(own):
                yield t, item, shared


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    ids, texts, chars = [], [], 0
    for item_id, text in benchmark.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or chars + len(text or "") > BLOCK_CHARS):
            yield ids, texts
            ids, texts, chars = [], [], 0
        ids.append(item_id)
        texts.append(text)
        chars += len(text or "")
    if ids:
        yield ids, texts


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document row and item row where the document holds the item (columns of FOUND)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for ids, texts in blocks(benchmark, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(Sketches(ids, texts, percent))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for low, _, values, offsets in shingle_sets(batch.column(1), False):
                    hits = list(index.search(values, offsets))
                    if hits:
                        n_item = [len(index.sets[i]) for _, i, _ in hits]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": batch.column(0).take(pa.array([low + t for t, _, _ in hits])),
                            "item_id": pa.array([index.ids[i] for _, i, _ in hits], pa.int64()),
                            "n_shared": pa.array([n for _, _, n in hits], pa.int32()),
                            "n_item": pa.array(n_item, pa.int32()),
                            "containment": pa.array([h[2] / n for h, n in zip(hits, n_item)], pa.float64()),
                        })

        parts.append(rows.mapInArrow(search, FOUND))
    if len(parts) > 1:
        parts = [written(p, "contained") for p in parts]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], FOUND)


def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item.  Only ids of the (few) holders travel; a null id is kept.

    Ids are what is dropped: rows that share an id with a holder go with it.
    """
    held = written(contained_items(docs, benchmark, percent, id_col, text_col).select(F.col("doc_id").alias("_held")).distinct(), "held")
    return without(docs, id_col, held, "_held")


CONTAINED_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, CAST(len(w) AS BIGINT) - 4)) AS i FROM w)),
v AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
b AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, CAST(len(w) AS BIGINT) - 4)) AS i FROM v)),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(any_value(n_item) AS INTEGER) AS n_item,
       CAST(count(*) AS DOUBLE) / any_value(n_item) AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n_item)
"""
