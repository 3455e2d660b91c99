"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is 20 consecutive words.  Its fingerprint is the smallest hash of the eight-word spans in it:
equal windows have equal fingerprints, and neighbouring windows mostly share one, so an index holds about
one fingerprint for seven windows.  (An entry for each window would take five times the disk of the texts.)
A batch of documents becomes a run: (fingerprint, document) sorted by fingerprint, written once and never
changed.  The run is merge-joined with the runs before it; windows whose fingerprint occurs elsewhere are
candidates, and only those are verified, by two independent 64-bit hashes of all their words.  Of equal
windows, all but the first (by document id, then start) are repeats.  When more than FANOUT runs have
gathered they are compacted into one sorted run.

Most repeats are found where they are read: a task remembers windows, and one that has met an equal window
with an earlier place is a repeat whatever else there is.  Only windows that might be first are dealt by
their hashes, so that a passage in a third of all documents sends a few rows of each task to one place.

Batches are to arrive in ascending order of document ids; history stays as it is, and only the batch's
documents are judged, against history and each other.

Defined results: null texts have no words, and the hash of the empty string; a null id sorts before all
others; rows that share an id count as one document: a start that is a repeat in one is in all; equal rows
each give a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prepare, shared_dir, split_by, written
from .textkernel import Words, distinct, slices

WINDOW, SPAN = 20, 8
#: Runs beyond this many are compacted.
FANOUT = 2
#: Windows that a task remembers, about 50 bytes each.
REMEMBERED = 300_000
SEEDS = (21, 22)
FIRST = -(1 << 63)  # stands for a null id
RUN = "fp long, doc_id long, again boolean"


def fingerprints(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window fingerprints, their text, their start; first span of each text), windows in order."""
    spans, _ = words.windows(SPAN, hashes, SEEDS[0])
    n = words.counts
    in_text = np.maximum(n - SPAN + 1, 0)
    first = np.concatenate([[0], np.cumsum(in_text)])
    number = np.maximum(n - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(n)), number)
    start = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    least, width = spans, 1
    wide = WINDOW - SPAN + 1
    while width * 2 <= wide:
        least = np.minimum(least[: len(least) - width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    rest = wide - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:]) if len(least) > rest else least[:0]
    return (least[first[text] + start] if len(text) else spans[:0]), text, start, spans


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, doc_id, again): each document's distinct fingerprints; again: its span stands there more than once."""
    wide = WINDOW - SPAN + 1
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for low, high, words in slices(batch.column(1)):
            fp, text, start, spans = fingerprints(words, words.hashes(SEEDS[0]))
            in_text = np.maximum(words.counts - SPAN + 1, 0)
            first = np.cumsum(in_text) - in_text
            at = first[text] + start
            chosen = np.zeros(len(spans), bool)
            for k in range(wide):  # spans that are the smallest of some window
                chosen[(at + k)[spans[at + k] == fp]] = True
            owner = np.repeat(np.arange(high - low), in_text)[chosen]
            values = spans[chosen]
            order = np.lexsort((values, owner))
            values, owner = values[order], owner[order]
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
            begins = np.flatnonzero(new)
            again = np.diff(np.append(begins, len(values))) > 1
            yield pa.RecordBatch.from_arrays([pa.array(values[begins].view(np.int64)), pa.array(ids[low + owner[begins]]), pa.array(again)], names=["fp", "doc_id", "again"])


class Firsts:
    """The earliest places of windows that a task has met, as far as it remembers."""

    def __init__(self, limit: int | None = None):
        self.limit = limit or REMEMBERED
        self.w1 = self.w2 = np.zeros(0, np.uint64)
        self.doc, self.start, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, w1: np.ndarray, w2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether an equal window with an earlier place has been met, here or before.  Windows that share one of
        their two hashes only are neither late nor remembered."""
        if not len(w1):
            return np.zeros(0, bool)
        place = np.unique(doc, return_inverse=True)[1].astype(np.int64) << 32 | start  # rows with one id are one document
        order = np.argsort(w1)
        a, b, at = w1[order], w2[order], place[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        late = at > np.minimum.reduceat(at, heads)[group]
        mixed = np.zeros(len(heads), bool)
        mixed[group[b != b[heads][group]]] = True
        least = np.flatnonzero(~late)
        least = least[np.concatenate([[True], group[least][1:] != group[least][:-1]])]  # a row of each group's first place
        spot = np.searchsorted(self.w1, a[heads])
        inside = np.minimum(spot, max(len(self.w1) - 1, 0))
        taken = self.w1[inside] == a[heads] if len(self.w1) else np.zeros(len(heads), bool)
        met = taken & (self.w2[inside] == b[heads]) & ~mixed if len(self.w1) else taken
        known, mine = spot[met], order[least[met]]
        before = (self.doc[known] < doc[mine]) | ((self.doc[known] == doc[mine]) & (self.start[known] < start[mine]))
        beaten = np.zeros(len(heads), bool)
        beaten[np.flatnonzero(met)[before]] = True
        late = (late | beaten[group]) & ~mixed[group]
        self.doc[known[~before]], self.start[known[~before]] = doc[mine[~before]], start[mine[~before]]
        self.hits[known] += 1
        fresh = ~taken & ~mixed
        spot, mine = spot[fresh], order[least[fresh]]
        self.w1, self.w2 = np.insert(self.w1, spot, w1[mine]), np.insert(self.w2, spot, w2[mine])
        self.doc, self.start, self.hits = np.insert(self.doc, spot, doc[mine]), np.insert(self.start, spot, start[mine]), np.insert(self.hits, spot, 0)
        if len(self.w1) > self.limit:
            self._forget()
        out = np.empty(len(late), bool)
        out[order] = late
        return out

    def _forget(self) -> None:
        """Keeps the windows met most often, a quarter of the room at most."""
        enough = max(1, int(np.sort(self.hits)[-self.limit // 4]))
        keep = self.hits > enough if (self.hits >= enough).sum() > self.limit // 2 else self.hits >= enough
        self.w1, self.w2, self.doc, self.start, self.hits = (x[keep] for x in (self.w1, self.w2, self.doc, self.start, self.hits))
        self.hits //= 2


CANDIDATE = "w1 long, w2 long, doc_id long, start int, starts array<int>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the windows whose fingerprint is listed for their document: (w1, w2, doc_id, start) of those that may be
    first, and a row with the starts of each document's windows that are not (start -1, w1 and w2 any)."""
    firsts = Firsts()
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(2)
        offsets, listed = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        for low, high, words in slices(batch.column(1)):
            hashes = words.hashes(SEEDS[0])
            fp, text, start, _ = fingerprints(words, hashes)
            part = listed[offsets[low] : offsets[high]]
            owner = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
            # Membership of (text, fp) pairs: one sorted array of both, equal neighbours meet.
            known, bounds = distinct(part, owner, high - low)
            keep = np.zeros(len(fp), bool)
            cuts = np.searchsorted(text, np.arange(high - low + 1))
            for t in range(high - low):
                own = known[bounds[t] : bounds[t + 1]]
                if len(own):
                    mine = fp[cuts[t] : cuts[t + 1]]
                    keep[cuts[t] : cuts[t + 1]] = own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine
            w1, w2 = (words.windows(WINDOW, words.hashes(seed) if seed != SEEDS[0] else hashes, seed)[0][keep] for seed in SEEDS)
            text, start = text[keep], start[keep]
            late = firsts.later(w1, w2, ids[low + text], start)
            n, first = int((~late).sum()), np.flatnonzero(~late)
            yield pa.RecordBatch.from_arrays([pa.array(w1[first].view(np.int64)), pa.array(w2[first].view(np.int64)), pa.array(ids[low + text[first]]), pa.array(start[first].astype(np.int32)), pa.nulls(n, pa.list_(pa.int32()))], names=_names(CANDIDATE))
            owners, cuts = np.unique(text[late], return_index=True)
            if len(owners):
                starts = pa.ListArray.from_arrays(pa.array(np.append(cuts, int(late.sum())).astype(np.int32)), pa.array(start[late].astype(np.int32)))
                doc = pa.array(ids[low + owners])
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.arange(len(owners))), doc, pa.array(np.full(len(owners), -1, np.int32)), starts], names=_names(CANDIDATE))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kept_words(text: str | None, starts: list[int] | None) -> tuple[int, list[bytes]]:
    """Number of words, and those outside all windows that begin at the starts."""
    words = (text or "").encode().split()  # bytes split at 0x20 and 0x09-0x0D
    if not starts:
        return len(words), words
    covered = np.zeros(len(words) + WINDOW + 1, np.int64)
    np.add.at(covered, np.asarray(starts), 1)
    np.add.at(covered, np.asarray(starts) + WINDOW, -1)
    gone = np.cumsum(covered)[: len(words)] > 0
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _result(with_text: bool):
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_words(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kept = [b" ".join(k) for _, k in rows]
            columns = {
                "doc_id": batch.column(0),
                "n_words": pa.array([n for n, _ in rows], pa.int64()),
                "n_removed": pa.array([n - len(k) for n, k in rows], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
            if with_text:
                columns["kept"] = pa.array([k.decode() for k in kept], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return give


class FingerprintIndex:
    """Sorted, immutable runs in a folder of the shared store; a run's documents are kept with the caller."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        prepare(spark)
        self.spark, self.folder, self.runs, self.made = spark, folder or shared_dir(spark, "fingerprints"), [], 0

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{self.made:05d}"
        self.made += 1
        rows.repartition("fp").sortWithinPartitions("fp", "doc_id").write.parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(path)

    def history(self) -> DataFrame | None:
        return reduce(DataFrame.unionAll, map(self._read, self.runs)) if self.runs else None

    def append(self, docs: DataFrame) -> DataFrame:
        """Adds a run for docs(doc_id, text); returns (doc_id, fps): for the documents of the batch and of history,
        the fingerprints that the batch has and that occur more than once."""
        run = self._read(self._write(docs.mapInArrow(_run, RUN)))
        old = self.history()
        met = run
        if old is not None:
            met = run.unionAll(old.join(run.select("fp").distinct(), "fp", "left_semi"))
        self.runs.append(f"{self.folder}/run-{self.made - 1:05d}")
        by = met.groupBy("fp").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("again").alias("again"))
        repeated = by.where("low < high or again").select("fp")
        return written(met.join(repeated, "fp", "left_semi").groupBy("doc_id").agg(F.collect_list("fp").alias("fps")), "candidates")

    def compact(self, fanout: int = FANOUT) -> None:
        """Merges all runs into one where there are more than fanout; the old ones stay for readers at work."""
        if len(self.runs) > fanout:
            self.runs = [self._write(self.history())]


def repeats(batch: DataFrame, everything: DataFrame, index: FingerprintIndex) -> DataFrame:
    """(doc_id, starts) of the batch's windows that are repeats; everything: documents of batch and history."""
    candidates = index.append(batch)
    some, _ = split_by(everything, "doc_id", candidates, "doc_id")
    listed = some.join(candidates, "doc_id").select("doc_id", "text", "fps")
    windows = listed.mapInArrow(_candidates, CANDIDATE)
    place = F.rank().over(W.partitionBy("w1", "w2", F.col("start") < 0).orderBy("doc_id", "start"))
    again = windows.withColumn("place", place).where("place > 1 or start < 0").select("doc_id", F.coalesce("starts", F.array("start")).alias("starts"))
    return written(again.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "repeats")


def remove_repeats(docs: DataFrame, batches: int = 3, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as batches by ascending id, each deduplicated against those before: columns of RESULT, and kept (text)."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("doc_id"), F.col(text_col).alias("text"))
    cuts = sorted({int(c) for c in docs.where(F.col("doc_id") > FIRST).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    bounds = [None, *cuts, None]
    schema = RESULT + (", kept string" if with_text else "")
    starts = []
    for low, high in zip(bounds, bounds[1:]):
        until = docs if high is None else docs.where(F.col("doc_id") <= high)
        batch = until if low is None else until.where(F.col("doc_id") > low)
        found = repeats(batch, until, index)
        starts.append(found if low is None else found.where(F.col("doc_id") > low))
        index.compact()
    marked = reduce(DataFrame.unionAll, starts)
    met, plain = split_by(docs, "doc_id", marked, "doc_id")
    met = met.join(marked, "doc_id", "left").select("doc_id", "text", "starts")
    plain = plain.select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))
    out = met.mapInArrow(_result(with_text), schema).unionAll(plain.mapInArrow(_result(with_text), schema))
    return out.withColumn("doc_id", F.when(F.col("doc_id") > FIRST, F.col("doc_id")))


#: The query in DuckDB, by the words of the windows themselves.
REPEATS_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT doc_id, i AS start, array_to_string(list_slice(w, i, i + 19), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, CAST(len(w) AS BIGINT) - 19)) AS i FROM w)),
f AS (SELECT doc_id, start, row_number() OVER (PARTITION BY s ORDER BY doc_id, start) AS nth FROM g),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(start, start + 19)) AS place FROM f WHERE nth > 1),
p AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, CAST(len(w) AS BIGINT))) AS place FROM w),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.place) AS kept, count(*) AS n FROM p ANTI JOIN r ON r.doc_id = p.doc_id AND r.place = p.place GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
