"""Quality classifier by co-training of two views.

The text view sees which words a document holds and how it is written (shares of capitals, digits, marks,
repeated words, word lengths); the metadata view sees its language, source and length.  Each is a logistic
regression.  Both begin with the labelled documents.  Then, over some rounds, each view scores all unlabelled
documents and gives labels to those it is sure of, and the other learns from them: what travels is not the
documents but, per feature, the gradient and a bound of the curvature of their loss, summed over all of them
in whole numbers.  A view teaches only while its sure answers are right on the gate rows.  Each view's logits
are calibrated on rows of their own, the calibrated views are combined by a fit to further rows, and the
combined model scores every document.

Labelled rows are dealt by the hash of their ids to training, gate, calibration, combination and report, so
that what the report says was used for nothing else.  The labelled sample has at most `max_labelled` rows, those
with the smallest hashes of their ids; everything else covers all documents and whole texts.

A document is good when its quality is 1 and it is not toxic.  Defined results: label rows with a null id or
quality are ignored, a null toxic counts as 0, of several labels for one id the worst holds; with labels of
one kind only, or none, every document gets that kind (good if none); null texts count as empty, null
metadata as a value of its own; rows with equal or null ids each give a row; other columns, whatever their
names, are kept by `good_documents` and ignored elsewhere; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .textkernel import Words, distinct, slices, text_column

MAX_LABELLED = 8000
ROUNDS, SURE, TRUST = 3, 0.98, 0.95
#: Sums over documents are of whole numbers, so that they do not depend on the order of tasks.
UNIT = 1 << 24
HASH_BITS = 22
#: Words enter the text view when they stand in so many sampled documents and their rates differ by so many standard errors.
MIN_DOCUMENTS, MIN_Z = 6, 4.0
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Everything that is not a letter separates the words of the text view.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_CLASSES = np.zeros(256, np.uint8)  # kinds of bytes
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 3, 4
_CLASSES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
_CLASSES[[44, 46, 39, 45, 63, 58, 59]] = 6
_CLASSES[10] = 7
STATS = 8


def style(words: Words, counts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """STATS numbers for each text; counts: its letter words, kinds: its distinct ones."""
    n = len(words.first) - 1
    text = np.repeat(np.arange(n), np.diff(words.bounds))
    by = np.bincount(text * 8 + _CLASSES[words.data], minlength=n * 8).reshape(n, 8).astype(float)
    letters = by[:, 1] + by[:, 2] + by[:, 4]
    size = np.maximum(by.sum(1), 1)
    return np.column_stack([
        by[:, 1] / np.maximum(letters, 1), by[:, 3] / size, by[:, 5] / size, by[:, 6] / size, by[:, 7] / size,
        letters / np.maximum(counts, 1), kinds / np.maximum(counts, 1) ** 0.8, letters / size,
    ])


def text_view(column: pa.Array):
    """(from row, to row, word numbers, offsets, style numbers) for row ranges of bounded bytes."""
    for low, high, words in slices(column, separators=NOT_LETTER):
        hashes = words.hashes(31, lower=True)
        text = np.repeat(np.arange(high - low), words.counts)
        numbers, offsets = distinct(hashes >> np.uint64(64 - HASH_BITS), text, high - low)
        yield low, high, numbers.astype(np.int64), offsets, style(words, words.counts, np.diff(offsets))


def metadata_keys(lang, source, size: int) -> list[str]:
    bucket = int(np.log2(size + 1) * 2)
    return [f"lang={lang}", f"source={source}", f"size={bucket}", f"lang={lang} size={bucket // 2}"]


@dataclass
class Rows:
    """Documents as the numbers of their features: those of row i are index[offsets[i] : offsets[i + 1]]."""

    index: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, lists: list) -> Rows:
        sizes = np.array([len(x) for x in lists], np.int64)
        return cls(np.concatenate([*map(np.asarray, lists), np.zeros(0)]).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.sizes)

    def take(self, which: np.ndarray) -> Rows:
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        at = np.repeat(self.offsets[which] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return Rows(self.index[at], np.concatenate([[0], ends]))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.index], len(self))


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Taught:
    """What unlabelled documents say to a view, as a bound of their loss around the weights `at`: gradient and
    curvature by feature (the bias last), and how many they are."""

    at: np.ndarray
    gradient: np.ndarray
    curve: np.ndarray
    n: float


@dataclass
class Logistic:
    """Regularised logistic regression over sparse binary features; the bias is the last weight."""

    weights: np.ndarray

    @classmethod
    def fitted(cls, rows: Rows, labels: np.ndarray, features: int, taught: Taught | None = None, penalty: float = 1.0, steps: int = 200) -> Logistic:
        w = np.zeros(features + 1) if taught is None else taught.at.copy()
        owner, g2 = rows.owner, np.full(features + 1, 1e-6)
        # However many teach, together they weigh no more than the labelled rows.
        share = min(1.0, len(rows) / taught.n) if taught is not None and taught.n else 0.0
        for _ in range(steps):
            error = chance(np.bincount(owner, w[rows.index], len(rows)) + w[-1]) - labels
            g = np.append(np.bincount(rows.index, error[owner], features) + penalty * w[:-1], error.sum())
            if share:
                g += share * (taught.gradient + taught.curve * (w - taught.at))
            g2 += g * g
            w -= 0.5 * g / np.sqrt(g2)
        return cls(w)

    def logits(self, rows: Rows) -> np.ndarray:
        return rows.dot(self.weights[:-1]) + self.weights[-1]


VIEWS = ("text", "metadata")


@dataclass
class Model:
    """Both views' features and weights, how each is calibrated, and how they combine."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # word numbers, ascending
    edges: np.ndarray = field(default_factory=lambda: np.zeros((STATS, len(QUANTILES))))
    keys: dict[str, int] = field(default_factory=dict)
    views: dict[str, Logistic] = field(default_factory=dict)
    calibration: dict[str, np.ndarray] = field(default_factory=dict)  # slope, shift
    mixing: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 30.0]))  # weights of the views, shift: all are good
    report: dict = field(default_factory=dict)

    @property
    def features(self) -> dict[str, int]:
        return {"text": len(self.words) + STATS * (len(QUANTILES) + 1), "metadata": len(self.keys)}

    def text_rows(self, numbers: np.ndarray, offsets: np.ndarray, stats: np.ndarray) -> Rows:
        """Known words of each text, and the bins of its style numbers."""
        at = np.searchsorted(self.words, numbers)
        known = self.words[np.minimum(at, len(self.words) - 1)] == numbers if len(self.words) else np.zeros(len(numbers), bool)
        cuts = np.concatenate([[0], np.cumsum(known)])[offsets]
        bins = len(self.words) + np.arange(STATS) * (len(QUANTILES) + 1) + np.array([np.searchsorted(e, x) for e, x in zip(self.edges, stats.T)]).T.reshape(-1, STATS)
        return Rows(np.insert(at[known], np.repeat(cuts[1:], STATS), bins.ravel()), cuts + STATS * np.arange(len(cuts)))

    def metadata_rows(self, keys: list[list[str]]) -> Rows:
        return Rows.of([[self.keys[k] for k in ks if k in self.keys] for ks in keys])

    def calibrated(self, view: str, rows: Rows) -> np.ndarray:
        slope, shift = self.calibration[view]
        return slope * np.clip(self.views[view].logits(rows), -20, 20) + shift

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Of calibrated logits."""
        a, b, c = self.mixing
        return chance(a * text + b * metadata + c)


def _telling_words(numbers: Rows, labels: np.ndarray) -> np.ndarray:
    every, where = np.unique(numbers.index, return_inverse=True)
    owner = labels[numbers.owner]
    good, bad = np.bincount(where[owner == 1], minlength=len(every)), np.bincount(where[owner == 0], minlength=len(every))
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    rate = (good + bad) / (n1 + n0)
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / n0))
    z = (good / n1 - bad / n0) / error
    return every[(good + bad >= MIN_DOCUMENTS) & (np.abs(z) >= MIN_Z)]


def _line(x: np.ndarray, y: np.ndarray, start: list[float]) -> np.ndarray:
    """Logistic weights of the columns of x, the last of which is 1, drawn to `start` as by one row each."""
    w, pull = np.array(start), np.append(np.ones(x.shape[1] - 1), 0.1)
    for _ in range(50):
        p = chance(x @ w)
        g = x.T @ (p - y) + pull * (w - start)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), g)
    return w


PARTS = ("train", "gate", "calibration", "combination", "report")


def parts(n: int) -> dict[str, np.ndarray]:
    """Row numbers of each part: of ten rows, six train and the others have one each."""
    by = np.arange(n) % 10
    return {"train": np.flatnonzero(by < 6), "gate": np.flatnonzero(by == 6), "calibration": np.flatnonzero(by == 7), "combination": np.flatnonzero(by == 8), "report": np.flatnonzero(by == 9)}


@dataclass
class Sample:
    """The labelled sample: word numbers, style numbers, metadata keys and labels of its rows, in the order of their hashes."""

    numbers: Rows
    stats: np.ndarray
    keys: list[list[str]]
    labels: np.ndarray


def co_train(sample: Sample, teach: Callable[[Model, dict[str, list[int]]], dict[str, Taught]] | None = None, rounds: int = ROUNDS) -> Model:
    """A model of the sample and of what unlabelled documents teach: teach(model, kinds that each view is trusted
    with) gives what each view learns from the other."""
    model, labels = Model(), sample.labels
    of = parts(len(labels))
    if len(np.unique(labels[of["train"]])) < 2:
        if len(labels) and not labels.any():
            model.mixing = np.array([0.0, 0.0, -30.0])
        if len(np.unique(labels)) < 2:
            return model
        of = dict.fromkeys(PARTS, np.arange(len(labels)))  # too few rows to keep apart
    train, y = of["train"], labels[of["train"]].astype(float)
    model.words = _telling_words(sample.numbers.take(train), labels[train])
    model.edges = np.quantile(sample.stats[train], QUANTILES, axis=0).T
    model.keys = {k: i for i, k in enumerate(sorted({k for i in train for k in sample.keys[i]}))}
    rows = {"text": model.text_rows(sample.numbers.index, sample.numbers.offsets, sample.stats), "metadata": model.metadata_rows(sample.keys)}
    model.views = {v: Logistic.fitted(rows[v].take(train), y, model.features[v]) for v in VIEWS}
    taught = {}
    for _ in range(rounds if teach else 0):
        trusted = {v: trusted_kinds(model.views[v].logits(rows[v].take(of["gate"])), labels[of["gate"]]) for v in VIEWS}
        taught = teach(model, trusted)
        model.views = {v: Logistic.fitted(rows[v].take(train), y, model.features[v], taught[v]) for v in VIEWS}
    at, told = of["calibration"], labels[of["calibration"]]
    for v in VIEWS:
        z = np.clip(model.views[v].logits(rows[v].take(at)), -20, 20)
        model.calibration[v] = _line(np.column_stack([z, np.ones(len(at))]), told, [1.0, 0.0])
    at, told = of["combination"], labels[of["combination"]]
    both = [model.calibrated(v, rows[v].take(at)) for v in VIEWS]
    model.mixing = _line(np.column_stack([*both, np.ones(len(at))]), told, [1.0, 0.0, 0.0])
    at, told = of["report"], labels[of["report"]] == 1
    t, m = (model.calibrated(v, rows[v].take(at)) for v in VIEWS)
    right = (model.scores(t, m) >= 0.5) == told
    model.report = {
        "rows": len(at), "accuracy": float(right.mean()), "good_kept": float(right[told].mean()), "bad_caught": float(right[~told].mean()), "words": len(model.words),
        "text_accuracy": float(((t > 0) == told).mean()), "metadata_accuracy": float(((m > 0) == told).mean()), "taught": {v: x.n for v, x in taught.items()},
    }
    return model


def trusted_kinds(logits: np.ndarray, labels: np.ndarray) -> list[int]:
    """The kinds (1 good, 0 not) that a view may teach: its sure answers of that kind are right on the gate rows."""
    sure = np.log(SURE / (1 - SURE))
    found = [(k, labels[s * logits > sure] == k) for k, s in ((1, 1), (0, -1))]
    return [k for k, right in found if len(right) >= 20 and right.mean() >= TRUST]


def lesson(model: Model, trusted: dict[str, list[int]], rows: dict[str, Rows]) -> Iterator[tuple[str, np.ndarray, np.ndarray, int]]:
    """(view, gradient, curvature, documents) that documents give each view, by the other's sure answers."""
    sure = np.log(SURE / (1 - SURE))
    logits = {v: model.views[v].logits(rows[v]) for v in VIEWS}
    for view, other in (VIEWS, VIEWS[::-1]):
        z = logits[other]
        kind = np.where(z > sure, 1, np.where(z < -sure, 0, -1))
        which = np.flatnonzero(np.isin(kind, trusted[other]))
        mine, features = rows[view].take(which), model.features[view]
        p, owner = chance(logits[view][which]), mine.owner
        error = p - kind[which]
        # Of a row with k features and a bias, k + 1 times the diagonal bounds the whole curvature.
        bend = p * (1 - p) * (mine.sizes + 1)
        yield view, np.append(np.bincount(mine.index, error[owner], features), error.sum()), np.append(np.bincount(mine.index, bend[owner], features), bend.sum()), len(which)


_SAMPLE = "doc_id long, label int, numbers array<int>, stats array<double>, lang string, source string, size long"
_LESSON = "view int, feature int, gradient long, curve long, n long"
_FEATURES = "doc_id long, text_features array<int>, metadata_features array<int>"


def _lists(rows: Rows) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows.offsets.astype(np.int32)), pa.array(rows.index.astype(np.int32)))


def _rows(column: pa.Array) -> Rows:
    offsets = column.offsets.to_numpy()
    return Rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), (offsets - offsets[0]).astype(np.int64))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, numbers, offsets, stats in text_view(batch.column(2)):
            n = high - low
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(low, n), batch.column(1).slice(low, n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(numbers.astype(np.int32))),
                pa.array(stats.tolist(), pa.list_(pa.float64())), batch.column(3).slice(low, n), batch.column(4).slice(low, n),
                pc.binary_length(text_column(batch.column(2)).slice(low, n)).cast(pa.int64()),
            ], names=[c.split()[0] for c in _SAMPLE.split(", ")])


def _views(model: Model, text: pa.Array, lang: pa.Array, source: pa.Array) -> Iterator[tuple[int, int, dict[str, Rows]]]:
    """(from row, to row, features of either view) for row ranges of bounded bytes."""
    sizes = pc.binary_length(text_column(text)).to_pylist()
    metadata = model.metadata_rows([metadata_keys(*k) for k in zip(lang.to_pylist(), source.to_pylist(), sizes)])
    for low, high, numbers, offsets, stats in text_view(text):
        yield low, high, {"text": model.text_rows(numbers, offsets, stats), "metadata": metadata.take(np.arange(low, high))}


def _unlabelled(docs: DataFrame, told: DataFrame, model: Model) -> DataFrame:
    """The features of all documents without a label, written once: only the words that tell, so little of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, rows in _views(shared.value, *batch.columns[1:]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), _lists(rows["text"]), _lists(rows["metadata"])], names=[c.split()[0] for c in _FEATURES.split(", ")])

    return written(docs.mapInArrow(give, _FEATURES).join(told, "doc_id", "left_anti"), "features")


def _taught(features: DataFrame, model: Model, trusted: dict[str, list[int]]) -> dict[str, Taught]:
    """What all unlabelled documents teach either view: one pass, a row for each feature that is met in a task."""
    shared = features.sparkSession.sparkContext.broadcast((model, trusted))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds = shared.value
        total = {v: [np.zeros(now.features[v] + 1, np.int64), np.zeros(now.features[v] + 1, np.int64), 0] for v in VIEWS}
        for batch in batches:
            for view, g, h, n in lesson(now, kinds, {"text": _rows(batch.column(0)), "metadata": _rows(batch.column(1))}):
                total[view][0] += np.round(g * UNIT).astype(np.int64)
                total[view][1] += np.round(h * UNIT).astype(np.int64)
                total[view][2] += n
        for i, view in enumerate(VIEWS):
            g, h, n = total[view]
            met = np.flatnonzero((g != 0) | (h != 0))
            at = np.append(met, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.append(g[met], 0)), pa.array(np.append(h[met], 0)), pa.array(np.append(np.zeros(len(met), np.int64), n))], names=[c.split()[0] for c in _LESSON.split(", ")])

    summed = features.select("text_features", "metadata_features").mapInArrow(sums, _LESSON).groupBy("view", "feature").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("gradient", "curve", "n")])
    out = {v: Taught(model.views[v].weights, np.zeros(model.features[v] + 1), np.zeros(model.features[v] + 1), 0.0) for v in VIEWS}
    for row in summed.collect():  # a row for each feature
        t = out[VIEWS[row.view]]
        if row.feature < 0:
            t.n = float(row.n)
        else:
            t.gradient[row.feature], t.curve[row.feature] = float(row.gradient) / UNIT, float(row.curve) / UNIT
    return out


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from docs(doc_id, text, lang, source) and labels(doc_id, quality, toxic)."""
    prepare(docs.sparkSession)
    docs = _columns(docs)
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    told = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("label"))
    chosen = written(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labelled")
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text", "lang", "source")  # max_labelled ids
    rows = list(texts.mapInArrow(_sampled, _SAMPLE).withColumn("chance", F.xxhash64("doc_id")).toLocalIterator())
    # Rows arrive in any order.
    rows.sort(key=lambda r: (r.chance, r.doc_id, np.array(r.numbers, np.int64).tobytes(), str(r.lang), str(r.source), r.size))
    sample = Sample(Rows.of([r.numbers for r in rows]), np.array([r.stats for r in rows]).reshape(-1, STATS), [metadata_keys(r.lang, r.source, r.size) for r in rows], np.array([r.label for r in rows], np.int64))
    kept: list[DataFrame] = []

    def teach(model: Model, trusted: dict[str, list[int]]) -> dict[str, Taught]:
        if not kept:
            kept.append(_unlabelled(docs, told, model))
        return _taught(kept[0], model, trusted)

    return co_train(sample, teach, rounds)


def _parts(model: Model, text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated logits of either view, and the score, of each row."""
    t, m = np.zeros(len(text)), np.zeros(len(text))
    if model.views:
        for low, high, rows in _views(model, text, lang, source):
            t[low:high], m[low:high] = (model.calibrated(v, rows[v]) for v in VIEWS)
    return t, m, model.scores(t, m)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_logit, metadata_logit, score, keep (score of 0.5 or more) of every document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m, s = _parts(shared.value, *batch.columns[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t), pa.array(m), pa.array(s), pa.array(s >= 0.5)], names=["doc_id", "text_logit", "metadata_logit", "score", "keep"])

    return _columns(docs).mapInArrow(rate, "doc_id long, text_logit double, metadata_logit double, score double, keep boolean")


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns; no join."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = dict(zip(batch.schema.names, batch.columns))
            yield batch.filter(pa.array(_parts(shared.value, by["text"], by["lang"], by["source"])[2] >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
