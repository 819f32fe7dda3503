"""Quality classifier by co-training.

Two logistic models look at different views of a document: one at its text, one
at its metadata (language, source, length). Both start from labelled documents.
Each model's scores are calibrated on labelled documents held out from all else. In
each round either calibrated model labels the unlabelled documents it is surest of,
and those become examples for the other; a view that tells nothing is sure of
nothing and hands nothing over. At the end the calibrated views are combined by
adding their log-odds, and the threshold for rejection is set so that held-out good ones
pass. All documents are then scored, texts whole.

At most LABELLED labelled documents of each kind are taken, picked by hash of the
id. The unlabelled side is the whole corpus: in each round Spark scores every
other document with both models, and of all those either model is sure of the
SHARED surest of each kind are handed over. What reaches the driver is bounded by these
three numbers.

Nulls: a null text is empty; a null language, source or length is a value of its
own. Labels other than 0 and 1 and labels without an id are ignored. If either
kind has fewer than two labelled documents, one to fit and one to hold out, nothing
can be learnt: every score is 0.5 and every document passes. Of an id with both labels the lower counts. Rows that
repeat an id are examples each; repeated rows are scored alike. Equally sure
documents are handed over by the order of their ids' hashes. Texts are read whole,
however long. Columns that documents have besides may have any name; the one the
result goes into is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, cut

LABELLED = 3_000
ROUNDS = 4
#: Documents either model hands to the other in a round, of each kind.
SHARED = 150
#: How sure it has to be.
SURE = 0.95
#: At most this share of held-out good documents may score under twice the
#: threshold, which is MOST_STRICT at most.
LOST, MOST_STRICT = 0.002, 0.25

SHAPES, SOURCES, LANGS = 32, 64, 16
_SYMBOLS, _PUNCT, _DIGITS = b"#*$%&|<>{}[]~^_=+@\\/", b".,;:!?'\"()-", b"0123456789"
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
BLOCK = 100


def text_view(text: str | None) -> np.ndarray:
    """Rates of the whole text: lengths, kinds of characters, repetition, and how
    often each (hashed) shape of word occurs."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    n, size = max(len(words), 1), max(len(raw), 1)
    rate = lambda kinds: (len(raw) - len(raw.translate(None, kinds))) / size
    varied = [len(set(words[k : k + BLOCK])) / len(words[k : k + BLOCK]) for k in range(0, len(words), BLOCK)]
    out = [
        np.log1p(len(words)), sum(map(len, words)) / n, rate(_SYMBOLS), rate(_PUNCT), rate(_DIGITS), rate(UPPER.encode()), rate(LOWER.encode()), rate(b"!"), rate(b"|"),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(varied) / max(len(varied), 1), min(varied, default=0.0),
        len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)),
    ]
    shapes: dict[bytes, int] = {}
    for w in words:
        shape = w[-3:]
        shapes[shape] = shapes.get(shape, 0) + 1
    hashed = np.zeros(SHAPES)
    for shape, times in shapes.items():
        hashed[xxhash.xxh32_intdigest(shape.translate(_SHAPE)) % SHAPES] += times
    return np.concatenate([out, hashed / n]).astype(np.float32).astype(float)  # kept as single floats


def metadata_view(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(LANGS + SOURCES + 3)
    out[xxhash.xxh32_intdigest(lang or "") % LANGS] = 1
    out[LANGS + xxhash.xxh32_intdigest(source or "") % SOURCES] = 1
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    length = np.log1p(n_chars) if known else 0.0
    out[-3:] = length, length * length / 10, known
    return out


@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps over standardised features, the
    two kinds weighing alike."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1.0
        z = self._in(x)
        share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        w, pull = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        pull[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = share * np.maximum(p * (1 - p), 1e-9)
            step = np.linalg.solve((z * h[:, None]).T @ z + np.diag(pull), z.T @ (share * (y - p)) - pull * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def _in(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.scale, -20, 20), np.ones(len(x))]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self._in(x) @ self.weights


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


@dataclass
class CoTrained:
    """views: (model, calibrating model) for text and metadata."""

    views: list[tuple[Logistic, Logistic]]
    threshold: float

    def scores(self, *views: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each view, and combined. Calibration weighs both kinds alike, so
        the prior odds are even and the log-odds simply add."""
        odds = [c.odds(m.odds(x)[:, None]) for (m, c), x in zip(self.views, views, strict=True)]
        return _sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(odds[0] + odds[1])


Pair = tuple[Logistic, Logistic]


def fitted(examples: list[np.ndarray], kinds: list[np.ndarray], held: list[np.ndarray], y: np.ndarray) -> list[Pair]:
    """A model of each view from its own examples, with its calibration on the
    held-out rows: a view that tells nothing there is sure of nothing."""
    models = [Logistic().fit(x, k) for x, k in zip(examples, kinds, strict=True)]
    return [(m, Logistic().fit(m.odds(x)[:, None], y)) for m, x in zip(models, held, strict=True)]


def sureness(pair: Pair, x: np.ndarray) -> np.ndarray:
    """The calibrated probability of a good document by one view."""
    return _sigmoid(pair[1].odds(pair[0].odds(x)[:, None]))


def combined(pairs: list[Pair], held: list[np.ndarray], y: np.ndarray) -> CoTrained:
    """Both views, with the threshold that held-out good documents set."""
    out = CoTrained(pairs, 0.5)
    good = out.scores(*[x[y == 1] for x in held])[2]
    out.threshold = float(min(MOST_STRICT, np.quantile(good, LOST) / 2))
    return out


_PICKED = "view int, kind int, sure double, row long, doc_id long, place long, text binary, lang string, source string, n_chars double"


def _views_of(batch: pd.DataFrame) -> list[np.ndarray]:
    """Both views of rows as they are kept."""
    text = np.frombuffer(b"".join(batch["text"]), np.float32).reshape(len(batch), -1).astype(float)
    return [text, np.stack([metadata_view(*m) for m in zip(batch["lang"], batch["source"], batch["n_chars"], strict=True)])]


def _viewed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Every document with an id, with its text view and, if it is one of `ids`
    (doc_id, label), its label. Written, so that texts are read once."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_view(t).astype(np.float32).tobytes() for t in texts], dtype=object)

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), of("text").alias("text"), "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    rows = rows.join(F.broadcast(ids), "doc_id", "left")  # at most 2 * LABELLED ids
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id").alias("place"), "label", "text", "lang", "source", "n_chars"))


def _surest(rows: DataFrame, models: list[Pair], known: list[set[int]], shared: int) -> pd.DataFrame:
    """The unlabelled rows that either view's model is surest of, for the other."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["label"].isna()]
            if not len(batch):
                continue
            for view, (pair, x) in enumerate(zip(models, _views_of(batch), strict=True)):
                p = sureness(pair, x)
                free = ~batch["row"].isin(known[1 - view]).to_numpy()
                for kind, sure in ((1, p), (0, 1 - p)):
                    # Rounded, so that it doesn't depend on how rows come in batches.
                    part = batch.assign(view=view, kind=kind, sure=np.round(sure, 6))[free & (sure >= SURE)]
                    yield part.sort_values(["sure", "place", "doc_id", "row"], ascending=[False, True, True, True]).head(shared)[[c.split()[0] for c in _PICKED.split(", ")]]

    order = Window.partitionBy("view", "kind").orderBy(F.desc("sure"), "place", "doc_id", "row")
    found = rows.mapInPandas(best, _PICKED).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shared)
    return found.orderBy("view", F.desc("kind"), "rank").toPandas()


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, rounds: int = ROUNDS, shared: int = SHARED) -> CoTrained | None:
    """None if either kind has fewer than two labelled documents. Reads the columns doc_id, text,
    lang, source and n_chars of docs, and doc_id and quality of labels."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    ids = known.where("label = 1").orderBy(*order).limit(labelled).unionByName(known.where("label = 0").orderBy(*order).limit(labelled))
    rows = _viewed(docs, ids)
    own = rows.where("label is not null").orderBy("place", "doc_id", "row").limit(2 * labelled).toPandas()
    label = own["label"].to_numpy()
    held = np.zeros(len(own), bool)
    for kind in (0, 1):  # every fourth labelled document of each kind
        at = np.flatnonzero(label == kind)
        if len(at) < 2:
            return None
        held[at[1::4]] = True
    views = _views_of(own)
    examples = [x[~held] for x in views]
    kinds = [label[~held].astype(float) for _ in views]
    given: list[set[int]] = [set(), set()]
    out, y = [x[held] for x in views], label[held].astype(float)
    models = fitted(examples, kinds, out, y)
    for _ in range(rounds):
        picked = _surest(rows, models, given, shared)
        if not len(picked):
            break
        more = _views_of(picked)
        # A row that a view gives is an example of the other view only.
        for view in (0, 1):
            of = (picked["view"] == 1 - view).to_numpy()
            given[view] |= set(picked["row"][of])
            examples[view] = np.concatenate([examples[view], more[view][of]])
            kinds[view] = np.concatenate([kinds[view], picked["kind"][of].to_numpy(float)])
        models = fitted(examples, kinds, out, y)
    return combined(models, out, y)


def scored(docs: DataFrame, model: CoTrained | None, into: str = "quality") -> DataFrame:
    """`docs` with a struct of text_score, metadata_score, score and kept; a
    column of that name is replaced."""
    kinds = "text_score double, metadata_score double, score double, kept boolean"

    @F.pandas_udf(kinds)
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, langs, sources, lengths in batches:
            if not len(texts) or model is None:
                half = np.full(len(texts), 0.5)
                yield pd.DataFrame({"text_score": half, "metadata_score": half, "score": half, "kept": np.ones(len(texts), bool)})
                continue
            views = np.stack([text_view(t) for t in texts]), np.stack([metadata_view(*m) for m in zip(langs, sources, lengths, strict=True)])
            a, b, both = model.scores(*views)
            yield pd.DataFrame({"text_score": a, "metadata_score": b, "score": both, "kept": both >= model.threshold})

    return docs.withColumn(into, of(F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars").cast("double")))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text", "lang", "source", "n_chars"), fit(docs, labels))
    return out.select("doc_id", "quality.*")
