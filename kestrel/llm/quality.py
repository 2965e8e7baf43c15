"""Quality classifier by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import keep, text_or_empty

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SPACES, HIGH = b"\t\n\v\f\r ", bytes(range(128, 256))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Token hashes remembered by a task.
CACHED_TOKENS = 100_000


def tokens(text: str) -> set[str]:
    """What the text view sees: which lower-case words, numbers' lengths and runs of marks occur."""
    return set(TOKEN.findall(text.lower()))


class TokenHashes(dict):
    """32-bit hashes of tokens, remembered; a number counts by its length only."""

    def __missing__(self, token: str) -> int:
        spelt = f"#{len(token)}" if token.isdigit() else token
        h = self[token] = xxhash.xxh32_intdigest(spelt)
        return h

    def of(self, some: set[str]) -> set[int]:
        if len(self) > CACHED_TOKENS:
            self.clear()
        return set(map(self.__getitem__, some))


def content_shape(text: str) -> list[float]:
    """How repetitive the wording is: the share of different words, and the share of the most frequent one."""
    words = text.split()
    if not words:
        return [0.0, 0.0, 0.0]
    counts = Counter(words)
    return [len(counts) / len(words), max(counts.values()) / len(words), np.log1p(len(words) / len(counts))]


def metadata(raw: bytes, lang: str | None, source: str | None, n_chars: int | None) -> tuple[list[int], list[float]]:
    """What the metadata view sees: 32-bit hashes of the names of language and source, length, lines and classes of characters; no words."""
    n = max(1, len(raw))
    left = lambda drop: (len(raw) - len(raw.translate(None, drop))) / n
    names = [xxhash.xxh32_intdigest(f"{kind}={name}") for kind, name in (("lang", lang), ("source", source))]
    lines = raw.count(b"\n") + 1
    measures = [
        np.log1p(max(0, n_chars if n_chars is not None else n)),
        np.log1p(len(raw)),
        np.log1p(lines),
        np.log1p(len(raw) / lines),
        left(UPPER) * 10,
        left(DIGITS) * 10,
        left(PUNCTUATION) * 10,
        left(SPACES) * 10,
        left(HIGH) * 10,
    ]
    return names, measures


MEASURES, SHAPES = 9, 3


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Rows:
    """Sparse 0/1 features in rows (flat places and row ends) next to dense measures."""

    places: np.ndarray
    ends: np.ndarray
    dense: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(self.ends, prepend=0))

    def take(self, rows: np.ndarray) -> Rows:
        begin = np.concatenate([[0], self.ends[:-1]])
        parts = [self.places[begin[r] : self.ends[r]] for r in rows]
        ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        return Rows(np.concatenate(parts) if parts else self.places[:0], ends, self.dense[rows])


@dataclass
class Evidence:
    """What all documents that the other view was sure of say: log-odds of features, and Gaussians of the measures.

    Sure good ones stand against sure bad ones; where the other view was sure of one class only, against all documents.
    """

    keys: np.ndarray
    odds: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    #: Documents that it comes from.
    taught: int = 0

    @classmethod
    def none(cls, measures: int) -> Evidence:
        return cls(np.zeros(0, np.uint32), np.zeros(0), np.zeros((2, measures)), np.ones((2, measures)))

    def of(self, rows: Rows, most: float = 30.0) -> np.ndarray:
        """Two columns: naive Bayes log-odds of a row's features and of its measures, cut at +-most."""
        if not self.taught:
            return np.zeros((len(rows.ends), 2))
        at, hit = _places_in(self.keys, rows.places)
        named = np.bincount(rows.row_of()[hit], self.odds[at[hit]], minlength=len(rows.ends))
        bad, good = (
            -0.5 * ((rows.dense - self.mean[k]) ** 2 / self.variance[k] + np.log(self.variance[k])).sum(1) for k in (0, 1)
        )
        return np.clip(np.column_stack([named, good - bad]), -most, most)


def _places_in(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where places stand among sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(places), np.int64), np.zeros(len(places), bool)
    at = np.minimum(np.searchsorted(keys, places), len(keys) - 1)
    return at, keys[at] == places


@dataclass
class View:
    """A logistic model over hashed features, measures and evidence, with its calibration."""

    keys: np.ndarray
    weights: np.ndarray
    dense_mean: np.ndarray
    dense_scale: np.ndarray
    dense_weights: np.ndarray
    bias: float
    evidence: Evidence
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: Rows) -> np.ndarray:
        at, hit = _places_in(self.keys, rows.places)
        sparse = np.bincount(rows.row_of()[hit], self.weights[at[hit]], minlength=len(rows.ends))
        dense = np.column_stack([rows.dense, self.evidence.of(rows)])
        return sparse + ((dense - self.dense_mean) / self.dense_scale) @ self.dense_weights + self.bias

    def logit(self, rows: Rows) -> np.ndarray:
        return self.slope * self.raw(rows) + self.shift


def choose(rows: Rows, y: np.ndarray, most: int, least_rows: int, least_chi: float = 10.0) -> np.ndarray:
    """The features, sorted, that part the classes best: chi-square of presence, in at least least_rows rows.

    A chi-square below least_chi is taken for chance.
    """
    keys, where = np.unique(rows.places, return_inverse=True)
    seen = np.bincount(where, minlength=len(keys)).astype(float)
    good = np.bincount(where, y[rows.row_of()], minlength=len(keys))
    n, p = len(y), y.mean()
    expected = seen * p
    chi = (good - expected) ** 2 / np.maximum(expected * (1 - p) * (1 - seen / n), 1e-9)
    chi[seen < least_rows] = -1
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(keys[best[chi[best] >= least_chi]])


def fit_view(
    rows: Rows, y: np.ndarray, evidence: Evidence, *, most: int, least_rows: int, rounds: int = 200, penalty: float = 1e-4
) -> View:
    """Fit by full-batch Adam on log loss, with the classes weighed alike at the square root of their imbalance."""
    keys = choose(rows, y, most, least_rows)
    at, hit = _places_in(keys, rows.places)
    at, row = at[hit], rows.row_of()[hit]
    dense = np.column_stack([rows.dense, evidence.of(rows)])
    mean, scale = dense.mean(0), dense.std(0) + 1e-6
    dense = (dense - mean) / scale
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, np.sqrt((1 - p) / p), np.sqrt(p / (1 - p)))
    weight /= weight.sum()
    w = np.zeros(len(keys) + dense.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    k = len(keys)
    for step in range(1, rounds + 1):
        z = np.bincount(row, w[at], minlength=len(y)) + dense @ w[k:-1] + w[-1]
        error = weight * (sigmoid(z) - y)
        grad = np.concatenate([np.bincount(at, error[row], minlength=k), dense.T @ error, [error.sum()]])
        grad[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return View(keys, w[:k], mean, scale, w[k:-1], float(w[-1]), evidence)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, penalty: float = 1e-3) -> np.ndarray:
    """A small dense logistic regression by Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


@dataclass
class QualityModel:
    """Both views and how their calibrated scores combine. Its size is bounded by the numbers of features."""

    text: View | None
    page: View | None
    combine: np.ndarray
    prior: float = 1.0
    #: How many documents taught the text view and the page view, in each round.
    added: list[tuple[int, int]] = field(default_factory=list)

    def score(self, text: Rows, page: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: combined, by text, by page."""
        if self.text is None or self.page is None:
            flat = np.full(len(text.ends), self.prior)
            return flat, flat, flat
        a, b = self.text.logit(text), self.page.logit(page)
        return sigmoid(a * self.combine[0] + b * self.combine[1] + self.combine[2]), sigmoid(a), sigmoid(b)


def fit_views(
    text: Rows, page: Rows, y: np.ndarray, evidence: tuple[Evidence, Evidence], *, features: int, least_rows: int, calibrate_every: int
) -> QualityModel:
    """Both views fitted on labelled rows, calibrated and combined on every calibrate_every-th of them, kept out of the fit."""
    prior = float(y.mean()) if len(y) else 1.0
    part = np.arange(len(y)) % calibrate_every == 0
    if min(len(np.unique(y[part])), len(np.unique(y[~part]))) < 2:
        return QualityModel(None, None, np.zeros(3), prior)
    rest, held = np.flatnonzero(~part), np.flatnonzero(part)
    views, scores = [], []
    for rows, told in ((text, evidence[0]), (page, evidence[1])):
        view = fit_view(rows.take(rest), y[rest], told, most=features, least_rows=least_rows)
        kept = rows.take(held)
        view.slope, view.shift = logistic(view.raw(kept)[:, None], y[held])
        views.append(view)
        scores.append(view.logit(kept))
    return QualityModel(*views, logistic(np.column_stack(scores), y[held]), prior)


def featurise(
    texts: list[str], langs: list, sources: list, n_chars: list, hashes: TokenHashes | None = None
) -> tuple[Rows, Rows]:
    """Rows of the text view and of the page view."""
    places, sizes, shapes, names, measures = [], [], [], [], []
    hashes = TokenHashes() if hashes is None else hashes
    for text, lang, source, n in zip(texts, langs, sources, n_chars, strict=True):
        h = sorted(hashes.of(tokens(text)))
        places += h
        sizes.append(len(h))
        shapes.append(content_shape(text))
        at, m = metadata(text.encode(), lang, source, n)
        names += at
        measures.append(m)
    text_rows = Rows(np.array(places, np.uint32), np.cumsum(sizes, dtype=np.int64), np.array(shapes).reshape(-1, SHAPES))
    ends = np.arange(1, len(texts) + 1, dtype=np.int64) * 2
    return text_rows, Rows(np.array(names, np.uint32), ends, np.array(measures).reshape(-1, MEASURES))


_SAMPLE = "id string, label double, n int, places binary, ends binary, shape binary, names binary, measures binary"


def _pack(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Features of documents (id, label, text, lang, source, n_chars), packed; at_once of them make a row, which has the first's id."""
    hashes = TokenHashes()
    schema = [pa.string(), pa.float64(), pa.int32(), *[pa.binary()] * 5]
    for batch in batches:
        for k in range(0, batch.num_rows, at_once):
            ids, labels, *columns = (c.to_pylist() for c in batch.slice(k, at_once).columns)
            text, page = featurise(*columns, hashes)
            arrays = (text.places, text.ends, text.dense.astype(np.float32), page.places, page.dense.astype(np.float32))
            row = (ids[0], labels[0], len(ids), *(x.tobytes() for x in arrays))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema, strict=True)], _names(_SAMPLE))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _rows(packed: list[tuple]) -> tuple[Rows, Rows]:
    """Rows of both views from packed ones (n, places, ends, shape, names, measures)."""
    n, places, ends, shape, names, measures = zip(*packed, strict=True) if packed else ((),) * 6
    flat = lambda some, dtype: np.concatenate([np.frombuffer(x, dtype) for x in some] or [np.zeros(0, dtype)])
    sizes = [np.diff(np.frombuffer(x, np.int64), prepend=0) for x in ends]
    text_ends = np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]), dtype=np.int64)
    text = Rows(flat(places, np.uint32), text_ends, flat(shape, np.float32).astype(float).reshape(-1, SHAPES))
    page_ends = np.arange(1, sum(n) + 1, dtype=np.int64) * 2
    return text, Rows(flat(names, np.uint32), page_ends, flat(measures, np.float32).astype(float).reshape(-1, MEASURES))


#: Keys below 0: documents, and sums and squares of each measure.
DOCUMENTS = -1


def _measure_keys(n: int) -> np.ndarray:
    return -2 - np.arange(2 * n)


def _summed(batches: Iterator[pa.RecordBatch], classes, names: list[str], most_places: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Features and measures of packed documents, summed by class, a bounded number of documents at a time.

    classes(text, page) gives, for each view, which rows belong to each of the classes `names`.
    """
    held, size = [], 0

    def sums() -> pa.RecordBatch:
        views = _rows(held)
        out = []
        for view, (rows, found) in enumerate(zip(views, classes(*views), strict=True)):
            row = rows.row_of()
            keys, back = np.unique(rows.places, return_inverse=True)
            counts = [np.bincount(back, c[row], minlength=len(keys)) for c in found]
            seen = np.sum(counts, axis=0) > 0
            dense = [np.concatenate([rows.dense[c].sum(0), (rows.dense[c] ** 2).sum(0)]) for c in found]
            all_keys = np.concatenate([keys[seen].astype(np.int64), [DOCUMENTS], _measure_keys(rows.dense.shape[1])])
            columns = [np.concatenate([x[seen], [c.sum()], d]) for x, c, d in zip(counts, found, dense, strict=True)]
            out.append((np.full(len(all_keys), view, np.int32), all_keys, *columns))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["view", "key", *names])

    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in _names(_SAMPLE)[2:]), strict=True):
            held.append(row)
            size += len(row[1]) // 4
            if size >= most_places:
                yield sums()
                held, size = [], 0
    if held:
        yield sums()


def teach(pool: DataFrame, model: QualityModel, sure: float, counts: DataFrame | None = None) -> DataFrame:
    """What both views learn from all packed documents of pool: view (0 text, 1 page), key, every, good, bad.

    every says in how many documents a feature is, or sums a measure. It comes from the same pass, or from an
    earlier round's counts (view, key, every). A document that the text view is sure of counts, by the class it is sure of,
    for the page view's features (good, bad), and the other way round. Counts are summed in tasks, then by key.
    """
    held = pool.sparkSession.sparkContext.broadcast(model)  # bounded by the numbers of features
    names = ["good", "bad"] if counts is not None else ["every", "good", "bad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def classes(text: Rows, page: Rows) -> list:
            p = [sigmoid(held.value.page.logit(page)), sigmoid(held.value.text.logit(text))]
            return [(*[np.ones(len(x), bool)] * (len(names) - 2), x >= sure, x <= 1 - sure) for x in p]

        return _summed(batches, classes, names)

    learned = pool.mapInArrow(run, "view int, key long, " + ", ".join(f"{n} double" for n in names))
    sums = learned.groupBy("view", "key").agg(*[F.sum(n).alias(n) for n in names])
    return sums if counts is None else counts.join(sums, ["view", "key"], "left").fillna(0.0, names)


def gather(taught: DataFrame, most: int, least_rows: int, least_chi: float = 10.0) -> tuple[Evidence, Evidence]:
    """Evidence from what teach() gave (view, key, every, good, bad): the features that part the classes best, up to `most` for each view.

    Chi-square of presence, as in choose(); the best are found by a distributed top-k.
    """
    totals = {(r["view"], r["key"]): r for r in taught.where("key < 0").collect()}  # 1 + 2 per measure and view
    out = []
    for view, measures in enumerate((SHAPES, MEASURES)):
        docs = totals.get((view, DOCUMENTS))
        if docs is None or not (docs["good"] or docs["bad"]):
            out.append(Evidence.none(measures))
            continue
        of = [name if docs[name] else "every" for name in ("bad", "good")]
        bad, good = (docs[name] for name in of)
        b, g = (F.col(name) for name in of)
        n, p, seen = good + bad, good / (good + bad), g + b
        chi = (g - seen * p) ** 2 / F.greatest(seen * p * (1 - p) * (1 - seen / n), F.lit(1e-9))
        best = taught.where((F.col("view") == view) & (F.col("key") >= 0) & (seen >= least_rows)).withColumn("chi", chi)
        rows = best.where(F.col("chi") >= least_chi).orderBy(F.desc("chi"), "key").limit(most).collect()
        rows.sort(key=lambda r: r["key"])
        bads, goods = (np.array([r[name] for r in rows], float) for name in of)
        odds = np.log((goods + 1) / (good + 2)) - np.log((bads + 1) / (bad + 2))
        sums = np.array([[totals[view, int(k)][name] for k in _measure_keys(measures)] for name in of]).reshape(2, 2, measures)
        mean, squares = (sums[:, k] / np.array([[bad], [good]]) for k in (0, 1))
        keys = np.array([r["key"] for r in rows], np.uint32)
        out.append(Evidence(keys, odds, mean, np.maximum(squares - mean**2, 1e-4), int(docs["good"] + docs["bad"])))
    return out[0], out[1]


def _inputs(id_col: str, text_col: str) -> list[Column]:
    return [
        F.col(id_col).cast("string").alias("id"),
        text_or_empty(text_col).alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
    ]


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    most_labelled: int = 12_000,
    rounds: int = 3,
    sure: float = 0.98,
    features: int = 16_384,
    least_rows: int = 4,
    calibrate_every: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityModel:
    """Co-train on the documents that labels (doc_id, quality 0/1, toxic 0/1) names and on all documents.

    Good means quality 1 and not toxic. In each round both views are fitted on labelled rows and score every document in
    Spark, labels left aside; what the documents that a view is `sure` of say, counted over all of them, becomes
    evidence (naive Bayes log-odds) that the other view is fitted with in the next round. After the last round
    both views are fitted once more. Labelled documents count by what the views think of them, like any other, so
    that what a view is fitted on and what it scores are alike.

    Two things are bounded. By hash order of the ids, at most most_labelled documents give packed features to the driver. And
    a view knows at most `features` features, those of highest chi-square, so that a model has a bounded size wherever it is
    sent; features with a chi-square under 10 are taken for chance and are left out before that. All documents are packed to a table once. A label without quality is left out, one without
    toxic counts as not toxic; of several labels of an id the worst counts, and of several documents of a labelled id the
    least text. Where labels show fewer than two classes, the model gives every document the share of good ones (1
    without labels). Ids may be of any type; labels are found by their text. Null ids have no label.
    """
    named = (
        labels.select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")
        .where(F.col("id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .select("id", ((F.col("quality") > 0) & (F.col("toxic") == 0)).cast("double").alias("label"))
    )
    rows = docs.select(*_inputs(id_col, text_col))
    ids = rows.select("id").where(F.col("id").isNotNull()).distinct()
    told = named.join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    columns = ["text", "lang", "source", "n_chars"]
    once = rows.join(F.broadcast(told), "id").groupBy("id").agg(F.min(F.struct("label", *columns)).alias("x"))  # most_labelled
    found = once.select("id", "x.*").mapInArrow(lambda batches: _pack(batches, 1), _SAMPLE).collect()
    found.sort(key=lambda r: xxhash.xxh64_intdigest(str(r["id"])))
    text, page = _rows([tuple(r)[2:] for r in found])
    y = np.array([r["label"] for r in found])
    del found
    how = dict(features=features, least_rows=least_rows, calibrate_every=calibrate_every)
    model = fit_views(text, page, y, (Evidence.none(SHAPES), Evidence.none(MEASURES)), **how)
    if model.text is None or not rounds:
        return model
    everyone = rows.select("id", F.lit(None).cast("double").alias("label"), *columns)
    pool = keep(everyone.mapInArrow(lambda batches: _pack(batches, 256), _SAMPLE), "quality-pool")
    added, counts = [], None
    for _ in range(rounds):
        taught = keep(teach(pool, model, sure, counts), "quality-taught")
        counts = taught.select("view", "key", "every") if counts is None else counts
        told_views = gather(taught, features, least_rows)
        added.append(tuple(e.taught for e in told_views))
        model = fit_views(text, page, y, told_views, **how)
    model.added = added
    return model


SCORES = ("quality_score", "text_score", "page_score")


def score(
    docs: DataFrame,
    model: QualityModel,
    *,
    columns: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The columns of docs (or those named) with quality_score, text_score and page_score, probabilities of good.

    Scores whole texts of all rows. Columns that have the names of the scores already are replaced. A null text counts
    as empty; null lang, source and n_chars are values of their own. Rows may repeat. An empty table gives no rows.
    """
    kept = [c for c in (columns if columns is not None else docs.columns) if c not in SCORES]
    held = docs.sparkSession.sparkContext.broadcast(model)
    first = len(kept) + 1
    picked = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], *_inputs(id_col, text_col))
    names = [f"c{k}" for k in range(len(kept))] + list(SCORES)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema[: len(kept)])
    schema += (", " if kept else "") + ", ".join(f"{s} double" for s in SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = featurise(*(part.column(first + j).to_pylist() for j in range(4)), hashes)
                scores = held.value.score(*rows)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *map(pa.array, scores)], names)

    return picked.mapInArrow(run, schema).toDF(*kept, *SCORES)


def good(least: float = 0.5) -> Column:
    return F.col("quality_score") >= least
