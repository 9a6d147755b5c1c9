"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's features are the word and its letter n-grams, hashed into one table of
embeddings. A text's vector is the mean over its words' features, its scores a
linear function of that, so every word's share of the scores can be computed once
and kept. Embeddings and weights are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows; a temperature and the rejection
threshold are fitted on rows of the sample that training did not see.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlift.llm.texts import mix, pick, text_udf

ROWS_PER_LABEL = 600  # labelled rows of each language that may be fitted on
SAMPLE_WORDS = 256  # consecutive words taken from each of those rows
PIECE = 32  # words of one training example
BUCKETS, WIDTH = 1 << 16, 16
GRAMS = (1, 2, 3, 4)
EPOCHS, RATE = 4, 0.5
PRECISION = 0.995  # of accepted answers, on the rows kept back
NONE = "und"
FOLDS, KEPT_BACK = 3, 1  # rows whose crc32(doc_id) leaves 1 modulo 3 are never learned from
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def letters(piece: str) -> list[str]:
    """Runs of letters, lower-cased. Numeric signs such as fractions are no letters."""
    words = _WORD.findall(piece.lower())
    return words if piece.isascii() else [w for w in ("".join(filter(str.isalpha, x)) for x in words) if w]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words' features in a row, and where each word's begin."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(starts + size, size) - np.arange(len(codes))  # letters from here to the word's end
    owners, hashes = [], []
    rolled = np.zeros(len(codes), np.uint64)
    for j in range(max(GRAMS)):
        step = np.zeros(len(codes), np.uint64)
        step[: len(codes) - j] = codes[j:]
        rolled = rolled * np.uint64(0x100000001B3) + step
        if j + 1 in GRAMS:
            full = left > j
            owners.append(owner[full])
            hashes.append(mix(rolled[full] + np.uint64((j + 1) << 56)))
    whole = np.add.reduceat(mix(codes + (np.arange(len(codes)) - starts[owner]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts) if len(words) else np.zeros(0, np.uint64)
    owners.append(np.arange(len(words)))
    hashes.append(mix(whole))
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owners, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])
    return (hashes[order] >> np.uint64(48)).astype(np.int64) % BUCKETS, begins


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # embeddings times weights: what each bucket adds to each label
    bias: np.ndarray
    temperature: float
    threshold: float

    def words(self, words: list[str]) -> np.ndarray:
        """Mean of each word's features, as scores."""
        ids, begins = features(words)
        sums = np.add.reduceat(self.scores[ids], begins[:-1], axis=0)
        return sums / np.diff(begins)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 11) -> Model | None:
    """Fit on (label, text) rows; None without any."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for label, _ in rows})
    examples = []
    for number, (label, text) in enumerate(rows):
        words = letters(text)
        for i in range(0, len(words), PIECE):
            examples.append((number % 5 == 0, labels.index(label), words[i : i + PIECE]))
    if not examples:
        return None
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    fit = []
    for back, label, words in examples:
        ids, begins = features(words)
        share = np.repeat(1 / np.diff(begins) / len(words), np.diff(begins)).astype(np.float32)
        unique, at = np.unique(ids, return_inverse=True)
        fit.append((back, label, unique, np.bincount(at, share).astype(np.float32)))
    learn = [x for x in fit if not x[0]] or fit
    total, done = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learn)).tolist():
            _, label, ids, share = learn[i]
            vector = share @ table[ids]
            error = _softmax(vector @ weights + bias)
            error[label] -= 1
            rate = RATE * (1 - done / total)
            table[ids] -= rate * 8 * share[:, None] * (weights @ error)[None, :]
            weights -= rate * 8 * np.outer(vector, error)
            bias -= rate * 0.1 * error
            done += 1
    held = [x for x in fit if x[0]] or fit
    logits = np.array([share @ table[ids] @ weights + bias for _, _, ids, share in held], np.float64)
    truth = np.array([x[1] for x in held])
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    best = _softmax(logits / temperature)
    score, right = best.max(axis=1), best.argmax(axis=1) == truth
    order = np.argsort(-score)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    ends = np.append(score[order][1:] < score[order][:-1], True)  # equal scores pass together or not at all
    passing = np.flatnonzero((good >= PRECISION) & ends)
    threshold = float(score[order[passing[-1]]]) if len(passing) else 1.0
    return Model(labels, (table @ weights).astype(np.float32), bias, temperature, threshold)


_SHARES: dict[int, dict] = {}


def _predictor(model: Model | None, name: int):
    """Scores of whole texts; a worker keeps what each piece of text between blanks adds."""

    def predict(texts: list[bytes | None]) -> list[pa.Array]:
        known = _SHARES.setdefault(name, {})
        pieces = [t.split() if t else [] for t in texts]
        if len(known) > CACHE_WORDS:
            known.clear()
        new = [p for p in set().union(*map(set, pieces)) if p not in known]
        words, spans = [], []
        for p in new:
            own = letters(p.decode())
            spans.append((len(words), len(words) + len(own)))
            words += own
        shares = model.words(words) if model and words else np.zeros((len(words), 1), np.float32)
        for p, (a, b) in zip(new, spans, strict=True):
            known[p] = (shares[a:b].sum(axis=0), b - a) if b > a else None
        labels, scores, taken = [], [], []
        for own in pieces:
            found = [x for x in map(known.__getitem__, own) if x is not None]
            if not found or model is None:
                labels.append(NONE)
                scores.append(0.0)
                taken.append(False)
                continue
            logits = np.sum([x[0] for x in found], axis=0, dtype=np.float64) / sum(x[1] for x in found) + model.bias
            chance = _softmax(logits / model.temperature)
            labels.append(model.labels[int(chance.argmax())])
            scores.append(float(min(1.0, chance.max())))
            taken.append(scores[-1] >= model.threshold)
        return [pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(taken, pa.bool_())]

    return predict


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == KEPT_BACK, F.lit(False))


def sample(docs: DataFrame, doc_id: str, text: str, label: str, rows_per_label: int) -> list[tuple[str, str]]:
    """At most ``rows_per_label`` labelled rows of each language, by a hash of their id, and a run of words of each."""
    body = pick(docs, doc_id=doc_id, text=text, label=label)
    usable = body.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    mark = F.xxhash64(F.col("doc_id").cast("string"))
    ranked = usable.select("label", mark.alias("mark")).withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("mark", "label")))
    limits = {r["label"]: r["limit"] for r in ranked.where(F.col("place") <= rows_per_label).groupBy("label").agg(F.max("mark").alias("limit")).collect()}
    if not limits:
        return []
    chosen = F.lit(False)
    for name, limit in limits.items():
        chosen = chosen | ((F.col("label") == name) & (mark <= limit))
    words = F.split(F.col("text"), r"[\x20\x09-\x0D]+")
    start = F.pmod(mark, F.greatest(F.lit(1), F.size(words) - SAMPLE_WORDS + 1)).cast("int") + 1
    run = F.concat_ws(" ", F.slice(words, start, SAMPLE_WORDS))
    taken = usable.where(chosen & F.col("text").isNotNull()).select("label", run.alias("run"), mark.alias("mark"))
    found = taken.orderBy("mark", "label", "run").limit(rows_per_label * len(limits)).collect()
    return [(r["label"], r["run"]) for r in found]


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score, accepted.

    Learned from text and label only, on rows that are not held out; label, id and
    all other columns are no inputs of a prediction. NULL texts and texts without a
    letter are ``und`` with score 0; so is every text if nothing could be learned.
    ``accepted`` is false where the score is under the calibrated threshold.
    """
    model = train(sample(docs, doc_id, text, label, rows_per_label))
    name = hash((model.temperature, model.threshold, float(model.scores.sum()))) if model else 0
    udf = text_udf(_predictor(model, name), "struct<lang_pred:string,score:double,accepted:boolean>", ["lang_pred", "score", "accepted"])
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("__p", udf(F.col("text")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "__p.lang_pred", "__p.score", "__p.accepted")
