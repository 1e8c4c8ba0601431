"""Language identification: averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import without
from threadloom.llm.hashing import mix
from threadloom.llm.packing import pack, slices, unpack

UNKNOWN = "und"
_TABLE = 0x110000  # all code points
_BATCH_BYTES = 2 << 20
_SALTS = 64


@dataclass(frozen=True)
class Training:
    """Size of the model and of its training sample."""

    buckets_log2: int = 14
    dimensions: int = 16
    grams: tuple[int, ...] = (1, 2, 3, 4)
    rows_per_language: int = 600  # those of smallest hash
    max_rows: int = 12_000  # of all languages together, at least one of each
    epochs: int = 30
    batch: int = 32
    rate: float = 2.0
    calibration: float = 0.2  # share of the sample kept from training
    accepted_accuracy: float = 0.99
    seed: int = 5


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_TABLE)), bool, _TABLE)


def _stream(text: str | None, letter: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other characters as one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    is_letter = letter[points]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    out = np.where(is_letter, points, 32)[keep]
    return out if is_letter.any() else out[:0]


def _buckets(points: np.ndarray, n: int, log2: int) -> np.ndarray:
    """Bucket of every run of ``n`` code points."""
    total = np.full(max(0, points.size - n + 1), n, np.uint64)
    for j in range(n):
        total = total * np.uint64(0x100000001B3) + points[j : points.size - n + 1 + j]
    return (mix(total) >> np.uint64(64 - log2)).astype(np.int64)


def _features(text: str, setup: Training, letter: np.ndarray) -> np.ndarray:
    """Share of each bucket among all subwords of a whole text."""
    points = _stream(text, letter)
    counts = np.zeros(1 << setup.buckets_log2)
    for n in setup.grams:
        counts += np.bincount(_buckets(points, n, setup.buckets_log2), minlength=counts.size)
    return (counts / max(1.0, counts.sum())).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(
    x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, setup: Training
) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights per bucket, bias, temperature and rejection threshold.

    A row of ``x`` holds its buckets and their shares; only the rows of a step are
    ever laid out over all buckets. Stochastic gradient descent on embeddings and softmax. The embeddings enter
    only through their average, so after training they are multiplied out.
    """
    buckets = 1 << setup.buckets_log2

    def dense(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((rows.size, buckets), np.float32)
        for i, r in enumerate(rows):
            out[i, x[r][0]] = x[r][1]
        return out

    draw = np.random.default_rng(setup.seed)
    order = draw.permutation(y.size)
    held = order[: int(y.size * setup.calibration)] if y.size >= 10 else order[:0]
    used = order[held.size :]
    embed = draw.normal(0, 0.1, (buckets, setup.dimensions)).astype(np.float32)
    linear = np.zeros((setup.dimensions, classes), np.float32)
    bias = np.zeros(classes, np.float32)
    # Averages over thousands of subwords are small: scale them to unit size.
    norms = [float(np.sqrt((x[r][1] ** 2).sum())) for r in used]
    scale = np.float32(1 / max(1e-9, float(np.mean(norms)))) if norms else np.float32(1)
    for epoch in range(setup.epochs):
        rate = np.float32(setup.rate * (1 - epoch / setup.epochs))
        for at in np.array_split(draw.permutation(used), max(1, used.size // setup.batch)):
            rows = dense(at) * scale
            hidden = rows @ embed
            error = _softmax(hidden @ linear + bias)
            error[np.arange(at.size), y[at]] -= 1
            error /= max(1, at.size)
            back = error @ linear.T
            linear -= rate * (hidden.T @ error)
            bias -= rate * error.sum(axis=0)
            embed -= rate * (rows.T @ back)
    weights = (embed @ linear) * scale
    check = held if held.size else used
    steps = np.array_split(check, max(1, check.size // 256))
    logits = np.concatenate([dense(at) @ weights for at in steps]) + bias
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.2, 5, 41):
        p = _softmax(logits / t)
        loss = -np.log(np.maximum(p[np.arange(check.size), y[check]], 1e-12)).mean() if check.size else 0.0
        if loss < best:
            best, temperature = loss, float(t)
    p = _softmax(logits / temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    threshold = 0.0
    if check.size:
        down = np.argsort(-top)
        good = np.cumsum(right[down]) / np.arange(1, check.size + 1) >= setup.accepted_accuracy
        threshold = float(top[down][np.flatnonzero(good)[-1]]) if good.any() else 1.0
        # The lowest score seen says little if no row was wrong, or above the accuracy asked for.
        threshold = min(threshold, 0.5 if right.all() else setup.accepted_accuracy)
    return weights.astype(np.float32), bias, temperature, threshold


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    packed: bytes
    setup: Training


def training_rows(labelled: DataFrame, setup: Training, key: str, text: str, lang: str) -> DataFrame:
    """The rows (label, hash of the key and of the text, text) to learn from; repeated rows have the same hashes."""
    rows = labelled.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l"))
    rows = rows.filter(F.col("t").isNotNull() & F.col("l").isNotNull())
    hashed = [F.xxhash64(F.lit(setup.seed), F.coalesce(F.col("k").cast("string"), F.lit(""))), F.xxhash64("t")]
    rows = rows.withColumns(dict(zip("hg", hashed, strict=True)))
    slim = rows.select("l", "h", "g", F.pmod(F.xxhash64("h", "g"), F.lit(_SALTS)).alias("s")).distinct()
    # First within salts, so that no task sorts a whole language.
    for part in (["l", "s"], ["l"]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy("h", "g"))
        slim = slim.withColumn("r", place).filter(F.col("r") <= setup.rows_per_language).drop("r")
    chosen = slim.drop("s").checkpoint()
    languages = chosen.select("l").distinct().count()
    share = max(1, setup.max_rows // max(1, languages))
    place = F.row_number().over(Window.partitionBy("l").orderBy("h", "g"))
    chosen = chosen.withColumn("r", place).filter(F.col("r") <= share).drop("r")
    if languages <= setup.max_rows:  # then as many rows at most
        chosen = F.broadcast(chosen)
    return rows.join(chosen, ["l", "h", "g"], "left_semi").select("l", "h", "g", "t")


def train(
    labelled: DataFrame, setup: Training = Training(), key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> LanguageModel:
    """Fit on the labelled rows (key, text, lang) of smallest hash, per language.

    Every label is learned. A language gives at most ``rows_per_language`` different
    rows, fewer where all together would be more than ``max_rows``; the order is by
    the hash of the key, then by that of the text, so null and repeated keys are
    bounded too, and a repeated row counts once. Nulls and texts without a letter are left
    out. The texts become feature rows where they are, and one task fits the model:
    at most ``max_rows`` sparse rows, and a weight per bucket and language.
    """
    sample = training_rows(labelled, setup, key, text, lang)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = _letters()
        for batch in batches:
            out = []
            for l, h, g, t in zip(*batch.to_pydict().values(), strict=True):
                x = _features(t, setup, letter)
                at = np.flatnonzero(x)
                if at.size:
                    out.append((l, h, g, pack(at.astype(np.uint32), x[at])))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["l", "h", "g", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sorted(r for b in batches for r in zip(*b.to_pydict().values(), strict=True))
        languages = sorted({r[0] for r in data})
        number = {name: i for i, name in enumerate(languages)}
        x = [tuple(unpack(r[3])) for r in data]
        y = np.array([number[r[0]] for r in data], np.int64)
        weights, bias, temperature, threshold = fit(x, y, max(1, len(languages)), setup)
        body = pack(weights.ravel(), bias, np.array([temperature, threshold]))
        yield pa.RecordBatch.from_arrays([pa.array([languages], pa.list_(pa.string())), pa.array([body])], names=["languages", "packed"])

    found = sample.mapInArrow(featurize, "l string, h long, g long, x binary")
    found = found.groupBy("l", "h", "g").agg(F.first("x").alias("x"))
    model = found.repartition(1).mapInArrow(learn, "languages array<string>, packed binary").first()
    return LanguageModel(list(model.languages) if model else [], bytes(model.packed) if model else b"", setup)


def predict(
    docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score",
    rejected: str = "rejected",
) -> DataFrame:
    """Replace the text by its language, the calibrated probability and whether to reject it.

    A null text or one without a letter is ``und`` with the score 0, and rejected; so
    is everything if the model knows no language. Rejected are scores below the
    threshold that gave the accepted accuracy on the calibration rows. Texts are
    read whole; no other column matters. Other columns stay, those of the names of the
    new ones are replaced.
    """
    docs = without(docs, [out, score, rejected])
    rest = [c for c in docs.columns if c != text]
    fields = [docs.schema[c] for c in rest]
    schema = T.StructType(
        [*fields, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(rejected, T.BooleanType())]
    )
    setup, languages = model.setup, model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = _letters()
        classes = max(1, len(languages))
        weights, bias, (temperature, threshold) = unpack(model.packed) if languages else (np.zeros(0), np.zeros(1), (1, 1))
        weights = weights.reshape(-1, classes)
        for batch in slices(batches, text, _BATCH_BYTES):
            streams = [_stream(t, letter) for t in batch[text].to_pylist()]
            sizes = np.array([s.size for s in streams])
            labels, scores = [UNKNOWN] * sizes.size, np.zeros(sizes.size)
            some = np.flatnonzero(sizes) if languages else []
            if len(some):
                total, n_grams = np.zeros((len(some), classes)), np.zeros(len(some))
                for n in setup.grams:
                    parts = [_buckets(streams[i], n, setup.buckets_log2) for i in some]
                    lengths = np.array([p.size for p in parts])
                    full = np.flatnonzero(lengths)
                    if full.size:
                        starts = np.cumsum(lengths[full]) - lengths[full]
                        total[full] += np.add.reduceat(weights[np.concatenate(parts)], starts, axis=0, dtype=np.float64)
                    n_grams += lengths
                p = _softmax((total / np.maximum(n_grams, 1)[:, None] + bias) / temperature)
                scores[some] = p.max(axis=1)
                for i, c in zip(some, p.argmax(axis=1), strict=True):
                    labels[i] = languages[c]
            no = (scores < threshold) | np.array([x == UNKNOWN for x in labels], bool)
            columns = [*[batch[c] for c in rest], pa.array(labels, pa.string()), pa.array(scores), pa.array(no, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
