"""Toxicity: non-negative positive-unlabelled learning of a linear numpy classifier.

Training needs confirmed toxic documents and unlabelled ones. The loss of the unlabelled
part is corrected by the class prior for the toxic documents in it, and is not let fall
below zero. The curve that turns sums into probabilities comes from the same two samples
and the prior. No document counts as clean anywhere. Features are words and how words
begin, hashed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, tidy

FEATURE_BITS = 20
#: Words whose features a task remembers.
MOST_KNOWN = 100_000
STEMS = (4, 5, 6)
WORD = re.compile(r"[^\W_]+")

#: Most documents of each kind that training reads, all of them among the rows of the labels; all others only get scores.
MOST_POSITIVE = 3_000
MOST_UNLABELLED = 6_000
#: The class prior is the share of toxic ones among the labels, held within these limits; without labels it is the third.
LEAST_PRIOR, MOST_PRIOR, USUAL_PRIOR = 0.01, 0.5, 0.1

#: A feature is used if it is in so many toxic documents, and that much likelier there.
MIN_POSITIVE = 5
MIN_RATIO = 3.0
MIN_Z = 4.0


class WordFeatures(dict):
    """Hashed features of a word, all or those that ``used`` marks; forgets them when there are too many."""

    def __init__(self, used: np.ndarray | None = None):
        super().__init__()
        self.used = used

    def __missing__(self, word: str) -> tuple[int, ...]:
        names = {"=" + word, *("^" + word[:n] for n in STEMS if len(word) > n)}
        every = (xxhash.xxh32_intdigest(x) >> (32 - FEATURE_BITS) for x in names)
        self[word] = value = tuple(every if self.used is None else [f for f in every if self.used[f]])
        return value


def document_features(text: str | None, known: WordFeatures) -> np.ndarray:
    """Sorted distinct features of a whole text."""
    words = set(WORD.findall((text or "").lower()))
    if len(known) > MOST_KNOWN:
        known.clear()
    return np.unique(np.fromiter((f for w in words for f in known[w]), np.int32))


@dataclass
class ToxicityModel:
    """Weights of the used features; others weigh nothing. ``slope`` and ``shift`` turn the sum into a probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum()) + self.bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -40, 40))))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return (np.concatenate(rows) if rows else np.array([], np.int32)), owner


def nn_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk estimate under the sigmoid loss, by Adam over all rows.

    The risk is ``prior * E+[l(g)] + max(0, Eu[l(-g)] - prior * E+[l(-g)])``; while the
    second part is negative, a step goes up it instead.
    """
    (fp, op), (fu, ou) = _flat(positive), _flat(unlabelled)
    n, m = len(positive), len(unlabelled)
    w, b = np.zeros(size), -1.0
    m1, m2 = np.zeros(size + 1), np.zeros(size + 1)

    def falling(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """l(z) = 1 / (1 + e^z) and its slope."""
        s = 1 / (1 + np.exp(np.clip(z, -40, 40)))
        return s, -s * (1 - s)

    for t in range(1, rounds + 1):
        zp = np.bincount(op, w[fp], n) + b
        zu = np.bincount(ou, w[fu], m) + b
        as_toxic, d_toxic = falling(zp)
        as_clean_p, d_clean_p = falling(-zp)
        as_clean_u, d_clean_u = falling(-zu)
        rest = as_clean_u.mean() - prior * as_clean_p.mean()
        gu = -d_clean_u / m
        gp = prior * d_clean_p / n
        if rest < 0:
            gp, gu = -gp, -gu
        else:
            gp = gp + prior * d_toxic / n
        grad = np.append(np.bincount(fp, gp[op], size) + np.bincount(fu, gu[ou], size) + decay * w, gp.sum() + gu.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def informative(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features that are clearly commoner in the toxic documents than in the unlabelled ones."""
    size = 1 << FEATURE_BITS
    in_p = np.bincount(np.concatenate(positive), minlength=size)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=size)
    n, m = max(1, len(positive)), max(1, len(unlabelled))
    p, u = in_p / n, (in_u + 0.5) / (m + 1)
    together = (in_p + in_u + 0.5) / (n + m + 1)
    z = (p - u) / np.sqrt(together * (1 - together).clip(1e-9) * (1 / n + 1 / m))
    return np.nonzero((in_p >= min(MIN_POSITIVE, max(2, n // 20))) & (p >= MIN_RATIO * u) & (z >= MIN_Z))[0]


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve that minimises the class-prior-corrected risk of two samples of margins.

    Under the logistic loss the risk ``prior * E+[l(z)] + Eu[l(-z)] - prior * E+[l(-z)]`` is
    ``Eu[log(1 + e^z)] - prior * E+[z]``, which is convex: Newton steps, lightly held, find its
    one minimum. There the mean score of the unlabelled sample is the prior.
    """
    if not len(positive) or not len(unlabelled):
        return 1.0, 0.0
    both = np.concatenate([positive, unlabelled])
    centre, scale = float(both.mean()), float(both.std()) or 1.0
    row = lambda m: np.stack([(m - centre) / scale, np.ones_like(m)], 1)
    x, target, held = row(unlabelled), prior * row(positive).mean(0), np.diag([1e-5, 1e-8])

    def risk(ab: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ ab).mean() - target @ ab + ab @ held @ ab / 2)

    ab = np.array([1.0, float(np.log(prior / (1 - prior)))])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ ab, -40, 40)))
        slope = (x * q[:, None]).mean(0) - target + held @ ab
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / len(x) + held, slope)
        size = 1.0
        while size > 1e-6 and risk(ab - size * step) > risk(ab):
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    if ab[0] <= 0:
        return 1.0, 0.0
    return float(ab[0] / scale), float(ab[1] - ab[0] * centre / scale)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> ToxicityModel:
    """A model from features of toxic and of unlabelled documents; without features that tell, every score is the prior."""
    size = 1 << FEATURE_BITS
    used = informative(positive, unlabelled) if positive and unlabelled else np.array([], np.int64)
    weights, bias = np.zeros(size), -1.0
    if not len(used):
        return ToxicityModel(weights, bias, 1.0, float(np.log(prior / (1 - prior))) - bias)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    narrow = lambda rows: [k[k >= 0] for k in (place[r] for r in rows)]
    weights[used], bias = nn_pu(narrow(positive), narrow(unlabelled), prior, len(used))
    model = ToxicityModel(weights, bias)
    margins = lambda rows: np.array([model.margin(x) for x in rows])
    model.slope, model.shift = calibrate(margins(positive), margins(unlabelled), prior)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of the ids whose labels training must not see; a null id is held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 7) -> ToxicityModel:
    """A model from a bounded sample of the rows of ``labels``: ``MOST_POSITIVE`` that are toxic, and
    ``MOST_UNLABELLED`` of any kind, whose labels aren't read; held-out ids never.

    The prior is the toxic share of all labels that may be used, within ``LEAST_PRIOR`` and
    ``MOST_PRIOR``. Samples are the rows with the smallest hashes of their ids. An id with
    contradictory labels is toxic; other labels than 0 and 1 are none. Of documents that
    repeat an id one is read. Labels without a document say nothing but for the prior.
    """
    stated = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).where(~held_out("_id") & F.col("_toxic").isin(0, 1))
    usable = stated.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    n, toxic = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    prior = min(MOST_PRIOR, max(LEAST_PRIOR, toxic / n)) if n else USUAL_PRIOR
    pick = F.xxhash64(F.lit(seed), F.col("_id"))
    confirmed = usable.where("_toxic = 1").orderBy(pick, "_id").limit(MOST_POSITIVE).select("_id", F.lit("toxic").alias("_kind"))
    any_kind = usable.orderBy(F.xxhash64(F.lit(seed + 1), F.col("_id")), "_id").limit(MOST_UNLABELLED).select("_id", F.lit("any").alias("_kind"))
    chosen = confirmed.union(any_kind)  # bounded by the limits
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id", "_kind").agg(F.min("_text").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([document_features(t.as_py(), known).tobytes() for t in batch.column(2)], pa.binary())], names=["_id", "_kind", "_features"])

    kind = texts.schema["_id"].dataType.simpleString()
    rows = texts.select("_id", "_kind", "_text").mapInArrow(tidy(work), f"_id {kind}, _kind string, _features binary").collect()
    found = {k: [np.frombuffer(r["_features"], np.int32) for r in sorted(rows, key=lambda r: r["_id"]) if r["_kind"] == k] for k in ("toxic", "any")}
    return train(found["toxic"], found["any"], prior)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Each row's id, columns ``keep``, the text if asked for, and ``score``, the probability that the whole text is toxic.

    A null text counts as empty and gets the score of no features; a text of any length is
    read whole. Rows keep their number, repeated ones and null ids too; columns that aren't
    named are not read, whatever their names. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.nonzero(model.weights)[0].astype(np.int32), model.weights[model.weights != 0], model.bias, model.slope, model.shift))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, own, bias, slope, shift = shared.value
        weights = np.zeros(1 << FEATURE_BITS)
        weights[used] = own
        local, known = ToxicityModel(weights, bias, slope, shift), WordFeatures((weights != 0).tobytes())
        for batch in batches:
            scores = [local.score(document_features(t.as_py(), known)) for t in batch.column(batch.num_columns - 1)]
            columns = batch.columns if with_text else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=names)

    text = fresh(text_col if with_text else "_text", docs.select(F.col(id_col), *keep))
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias(text))
    fields = rows.schema.fields if with_text else rows.schema.fields[:-1]
    names = [*(f.name for f in fields), "score"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(tidy(work), f"{schema}, score double")
