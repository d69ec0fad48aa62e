"""Quality classifier by co-training of two views.

The content view is hashed runs of three bytes; the metadata view is language, source and the measures of a page's form
(length, lines, words, shares of upper-case letters, digits and signs, repetition). Each view has a logistic model.
In each round both score all documents outside the labelled sample, and each hands those it is sure of (a calibrated
chance of `SURE` or more for their class) to the other as pseudo-labels; then both are fitted anew. Labelled documents
that were held back calibrate each view (a logistic curve over its score) and the sum of both, and set the cut: the
largest at which the wanted share of good documents is kept.

The fit uses at most `LABELLED` labelled documents, those with the least hash of their id; this is the only bound.
Pseudo-labelled documents are as many as the corpus has. They enter the fit as the means of `CELLS` cells of a class, by
a hash of the id, each weighing as many documents as it holds: a round is one pass whose sums are whole numbers, merged
by Spark, so that neither tasks nor their order change them, and the driver holds a fixed number of means, never texts.
Languages and sources are counted over the table: the `VALUES` most frequent have a feature each, all others share
`HASHED` features by a hash. Every document is scored, from its whole text.

Defined cases: a null text is the empty text; null language or source are values of their own; labels other than 0 and
1, or of unknown documents, are left out; equal labels of one document count once, contradictory ones once each; of rows
that repeat a labelled id the one with the least text is fitted; rows without id are never labelled and lie in one cell; with fewer than
`LEAST` labelled documents of either class nothing can be learned and all are kept with score 0.5; a round in which no
view is sure of any document changes nothing; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import text_or_empty, trimmed
from wearline.llm.tokens import forget

LABELLED = 4000
ROUNDS = 3
#: Chance of its class at which a view hands a document to the other.
SURE = 0.95
#: Means that stand for the pseudo-labelled documents of a class, and what they weigh against the labelled ones.
CELLS, HANDED_WEIGHT = 32, 0.5
#: Parts of one in the whole numbers that are summed.
UNIT = 2 ** 24
LEAST = 10
BUCKETS = 1024
#: Most frequent languages and sources that have a feature of their own, and features that the others share.
VALUES, HASHED = 32, 16
MEASURES = 11

_CLASS = np.full(256, 5, dtype=np.uint8)  # letters and bytes of other scripts
for _range, _name in (((65, 91), 0), ((48, 58), 1), ((9, 14), 3), ((32, 33), 3)):
    _CLASS[slice(*_range)] = _name
for _low, _high in ((33, 48), (58, 65), (91, 97), (123, 128)):
    _CLASS[_low:_high] = 2


def content(raw: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte triples."""
    if len(raw) < 3:
        return np.zeros(BUCKETS, dtype=np.float32)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return np.sqrt(np.bincount(h >> np.uint32(12) & np.uint32(BUCKETS - 1), minlength=BUCKETS) / len(h)).astype(np.float32)


def measures(raw: bytes) -> np.ndarray:
    """The form of a page."""
    n = max(len(raw), 1)
    upper, digit, sign, space, _, letter = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=6)
    lines, words = raw.split(b"\n"), raw.split()
    size = max(len(words), 1)
    return np.array([
        np.log1p(len(raw)), np.log1p(len(lines)), np.log1p(n / len(lines)), np.log1p(n / size), upper / n, digit / n,
        sign / n, space / n, letter / n, len(set(lines)) / len(lines), len(set(words)) / size], dtype=np.float32)


class Linear(NamedTuple):
    """Weights on raw features."""
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x * self.weights).sum(1) + self.bias  # row by row: the same whatever rows share the batch


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 150,
        measured: int | None = None) -> Linear:
    """Logistic regression by gradient steps of adaptive size from zero, on features standardised by the first
    `measured` rows (all by default)."""
    mean, spread = x[:measured].mean(0), x[:measured].std(0) + np.float32(1e-4)
    z = ((x - mean) / spread).astype(np.float32)
    z = np.hstack([z, np.ones((len(z), 1), dtype=np.float32)])
    weight = np.ones(len(y), dtype=np.float32) if weight is None else weight.astype(np.float32)
    weight = weight / weight.sum()
    w = np.zeros(z.shape[1], dtype=np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = (weight * (p - y)).astype(np.float32) @ z + np.float32(ridge) * w
        first = np.float32(0.9) * first + np.float32(0.1) * gradient
        second = np.float32(0.99) * second + np.float32(0.01) * gradient ** 2
        w = w - np.float32(0.03) * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + np.float32(1e-8))
        w = w.astype(np.float32)
    own = w[:-1] / spread
    return Linear(own.astype(np.float32), float(w[-1] - mean @ own))


class Model(NamedTuple):
    """Both views, their curves (slope, offset) to log odds, the cut on the summed log odds, and known values."""
    content: Linear
    form: Linear
    curves: tuple[tuple[float, float], tuple[float, float], tuple[float, float]]
    cut: float
    languages: tuple[str, ...]
    sources: tuple[str, ...]

    def form_features(self, form: np.ndarray, language: list, source: list) -> np.ndarray:
        return with_values(form, language, source, self.languages, self.sources)

    def odds(self, content_: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of being good by content, by form, and by both."""
        a = self.curves[0][0] * self.content.score(content_) + self.curves[0][1]
        b = self.curves[1][0] * self.form.score(form) + self.curves[1][1]
        return a, b, self.curves[2][0] * (a + b) + self.curves[2][1]


def form_width(languages: tuple, sources: tuple) -> int:
    return MEASURES + len(languages) + len(sources) + 2 * (1 + HASHED)


def with_values(form: np.ndarray, language: list, source: list, languages: tuple, sources: tuple) -> np.ndarray:
    """The measures, then per column the known values, null, and the hashed rest."""
    out = np.zeros((len(form), form_width(languages, sources)), dtype=np.float32)
    out[:, :MEASURES] = form
    for values, known, at in ((language, languages, MEASURES),
                              (source, sources, MEASURES + len(languages) + 1 + HASHED)):
        place = {v: k for k, v in enumerate((*known, None))}
        for k, v in enumerate(values):
            spot = place[v] if v in place else len(place) + crc32(v.encode("utf-8", "replace")) % HASHED
            out[k, at + spot] = 1
    return out


def _curve(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated log odds; the slope is never negative."""
    line = fit(score[:, None].astype(np.float32), y, ridge=1e-2, steps=400)
    return max(float(line.weights[0]), 1e-3), line.bias


class Handed(NamedTuple):
    """Pseudo-labelled documents of one view: sums of their features in units, and their number, by class and cell."""
    sums: np.ndarray
    counts: np.ndarray

    @staticmethod
    def none(width: int) -> Handed:
        return Handed(np.zeros((2, CELLS, width), dtype=np.int64), np.zeros((2, CELLS), dtype=np.int64))

    def add(self, x: np.ndarray, label: np.ndarray, cell: np.ndarray) -> None:
        """Count the rows whose label is 0 or 1."""
        got = label >= 0
        np.add.at(self.sums, (label[got], cell[got]), np.rint(x[got].astype(np.float64) * UNIT).astype(np.int64))
        np.add.at(self.counts, (label[got], cell[got]), 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means of the cells that hold documents, their labels and numbers."""
        label, cell = np.nonzero(self.counts)
        counts = self.counts[label, cell]
        return (self.sums[label, cell] / (counts[:, None] * float(UNIT))).astype(np.float32), label, counts


#: Gives what each view (content, form) is handed under two models and their curves.
Exchange = Callable[[tuple[Linear, Linear], tuple], tuple[Handed, Handed]]


def sure_labels(odds: np.ndarray) -> np.ndarray:
    """1 or 0 where the log odds are sure, else -1."""
    least = np.log(SURE / (1 - SURE))
    return np.where(odds >= least, 1, np.where(odds <= -least, 0, -1))


def exchanged(models: tuple[Linear, Linear], curves: tuple, content_: np.ndarray, form: np.ndarray, cell: np.ndarray,
              handed: tuple[Handed, Handed]) -> None:
    """Add to what each view is handed the rows that the other one is sure of."""
    views = (content_, form)
    for v in (0, 1):
        slope, offset = curves[v]
        handed[1 - v].add(views[1 - v], sure_labels(slope * models[v].score(views[v]) + offset), cell)


def co_train(content_l: np.ndarray, form_l: np.ndarray, y: np.ndarray, exchange: Exchange, languages: tuple,
             sources: tuple, keep_good: float, rounds: int = ROUNDS) -> Model:
    held = np.zeros(len(y), dtype=bool)
    for c in (0, 1):  # a third of each class is held back
        held[np.flatnonzero(y == c)[::3]] = True
    views = (content_l, form_l)
    own, share = y[~held], (1 - float(y[~held].mean()), float(y[~held].mean()))

    def fitted(handed: tuple[Handed, Handed] | None) -> tuple[tuple[Linear, Linear], list]:
        models = []
        for v, view in enumerate(views):
            x, target, weight = view[~held], own, np.ones(len(own))
            if handed is not None and (handed[v].counts.sum(1) > 0).all():
                means, label, counts = handed[v].rows()
                # Classes keep the labelled shares, however many documents of each a view is sure of.
                total = np.array([counts[label == c].sum() for c in (0, 1)])
                more = HANDED_WEIGHT * len(own) * np.array(share)[label] * counts / total[label]
                x, target, weight = (np.concatenate(p) for p in ((x, means), (target, label), (weight, more)))
            models.append(fit(x, target, weight, measured=len(own)))
        curves = [_curve(m.score(view[held]), y[held]) for m, view in zip(models, views)]
        return tuple(models), curves

    both, curves = fitted(None)
    for _ in range(rounds):
        both, curves = fitted(exchange(both, curves))
    a, b = (s * m.score(view[held]) + o for (s, o), m, view in zip(curves, both, views))
    curves.append(_curve(a + b, y[held]))
    total = curves[2][0] * (a + b) + curves[2][1]
    good = np.sort(total[y[held] == 1])
    cut = min(0.0, float(good[int((1 - keep_good) * len(good))]))
    return Model(both[0], both[1], tuple(curves), cut, languages, sources)


def _features(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raw = [t.encode("utf-8") for t in batch.column("_text").to_pylist()]
                yield pa.record_batch([
                    *(batch.column(c) for c in ("_lang", "_source", "_y")),
                    pa.array([content(r).tobytes() for r in raw], pa.binary()),
                    pa.array([measures(r).tobytes() for r in raw], pa.binary())],
                    ["lang", "source", "y", "content", "form"])

    return rows.select("_lang", "_source", "_y", "_text").mapInArrow(
        trimmed(run), "lang string, source string, y int, content binary, form binary")


def cell_of(id_column: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("cell"), F.col(id_column).cast("string")), F.lit(CELLS)).cast("int")


def _exchange(rows: DataFrame, languages: tuple, sources: tuple) -> Exchange:
    """One pass over `rows`: every task sums what its views hand over, Spark adds the sums."""
    widths = BUCKETS, form_width(languages, sources)

    def hand(models: tuple[Linear, Linear], curves: tuple) -> tuple[Handed, Handed]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            handed = tuple(map(Handed.none, widths))
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    raw = [t.encode("utf-8") for t in batch.column("_text").to_pylist()]
                    form = with_values(np.stack([measures(r) for r in raw]), batch.column("_lang").to_pylist(),
                                       batch.column("_source").to_pylist(), languages, sources)
                    exchanged(models, curves, np.stack([content(r) for r in raw]), form,
                              batch.column("_cell").to_numpy(), handed)
            for v, (sums, counts) in enumerate(handed):
                for label, cell in zip(*np.nonzero(counts)):
                    values = np.append(sums[label, cell], counts[label, cell])
                    yield pa.record_batch([pa.array([n], pa.int32()) for n in (v, label, cell)]
                                          + [pa.array([values], pa.list_(pa.int64()))], ["v", "y", "cell", "values"])

        parts = rows.select("_lang", "_source", "_cell", "_text").mapInArrow(
            trimmed(run), "v int, y int, cell int, values array<bigint>")
        keys = "v", "y", "cell"
        sums = (parts.select(*keys, F.posexplode("values").alias("at", "value"))
                .groupBy(*keys, "at").agg(F.sum("value").alias("value")).toPandas())
        out = tuple(map(Handed.none, widths))
        for v, (handed, width) in enumerate(zip(out, widths)):
            own = sums[sums["v"] == v]
            is_count = own["at"] == width
            for part, target in ((own[~is_count], handed.sums), (own[is_count], handed.counts)):
                spot = tuple(part[k].to_numpy() for k in ("y", "cell", "at")[:target.ndim])
                target[spot] = part["value"].to_numpy()
        return out

    return hand


def _columns(id_column: str, text: str, language: str, source: str) -> dict:
    return {"_id": F.col(id_column), "_text": text_or_empty(text), "_lang": F.col(language).cast("string"),
            "_source": F.col(source).cast("string")}


def _frequent(rows: DataFrame, column: str) -> tuple[str, ...]:
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).count()
    return tuple(r[0] for r in counts.orderBy(F.desc("count"), column).limit(VALUES).collect())


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", language: str = "lang",
          source: str = "source", label: str = "quality", keep_good: float = 0.998, labelled: int = LABELLED,
          rounds: int = ROUNDS) -> Model | None:
    """The fitted model, or None without enough labels. `labels` holds doc_id and the label, 1 for good."""
    rows = docs.select(*(c.alias(n) for n, c in _columns(id_column, text, language, source).items()))
    truth = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_of"), F.col(label).cast("int").alias("_y"))
    ids = rows.select("_id").where("_id is not null")
    order = F.xxhash64(F.lit("sample"), "_id")
    known = ids.join(truth, F.col("_id") == F.col("_of")).select("_id", "_y").distinct()
    # At most `labelled` rows by construction, brought here once: small enough for every task.
    chosen = docs.sparkSession.createDataFrame(
        known.orderBy(order, "_id", "_y").limit(labelled).toArrow())
    parts = "_text", "_lang", "_source"
    least = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min(F.struct(*parts)).alias("_row"))
    sample = _features(least.select("_y", *(F.col(f"_row.{c}").alias(c) for c in parts))).toPandas()
    y = sample["y"].to_numpy()
    if min((y == 0).sum(), (y == 1).sum()) < LEAST:
        return None
    sample = sample.iloc[np.lexsort((y, sample["form"].map(bytes), sample["content"].map(bytes)))]  # of no task's order
    y = sample["y"].to_numpy()
    c = np.stack([np.frombuffer(x, dtype=np.float32) for x in sample["content"]])
    f = np.stack([np.frombuffer(x, dtype=np.float32) for x in sample["form"]])
    common = _frequent(rows, "_lang"), _frequent(rows, "_source")
    form = with_values(f, sample["lang"].tolist(), sample["source"].tolist(), *common)
    taken = chosen.select(F.col("_id").alias("_of")).distinct()
    free = rows.join(F.broadcast(taken), F.col("_id") == F.col("_of"), "left_anti").withColumn("_cell", cell_of("_id"))
    return co_train(c, form, y, _exchange(free, *common), *common, keep_good, rounds)


def score_documents(docs: DataFrame, model: Model | None, text: str = "text", language: str = "lang",
                    source: str = "source") -> DataFrame:
    """The rows with content_score, form_score, quality_score (probabilities of being good) and accepted.

    Columns of `docs` that have these names are replaced.
    """
    made = ("content_score", "form_score", "quality_score", "accepted")
    docs = docs.drop(*made)
    if model is None:
        return docs.withColumns({**{n: F.lit(0.5) for n in made[:3]}, "accepted": F.lit(True)})
    kept = docs.columns
    inputs = {"_t": text_or_empty(text), "_l": F.col(language).cast("string"), "_s": F.col(source).cast("string")}
    rows = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(kept)), *(c.alias(n) for n, c in inputs.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raw = [t.encode("utf-8") for t in batch.column("_t").to_pylist()]
                form = model.form_features(np.stack([measures(r) for r in raw]), batch.column("_l").to_pylist(),
                                           batch.column("_s").to_pylist())
                odds = model.odds(np.stack([content(r) for r in raw]), form)
                chances = [pa.array(1 / (1 + np.exp(-np.clip(o.astype(np.float64), -30, 30)))) for o in odds]
                yield pa.record_batch([*(batch.column(k) for k in range(len(kept))), *chances,
                                       pa.array(odds[2] >= model.cut)], [*names, *made])

    names = [f"c{k}" for k in range(len(kept))]
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, kept)),
                        "content_score double, form_score double, quality_score double, accepted boolean"])
    return rows.mapInArrow(trimmed(run), schema).toDF(*kept, *made)
