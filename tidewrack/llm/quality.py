"""Quality classifier from weak labels.

Simple labelers look at a text - symbols, capitals, stop words, repetition, list marks, word
lengths, ends of lines - and vote good, bad or nothing. Expectation-maximisation over the
counts of vote patterns in the whole corpus estimates how accurate each is; the posteriors
label a bounded sample of documents, on which a linear scorer over hashed words and word
shapes is trained. The scorer decides for every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import weak
from .common import column, free_name
from .html_text import STOP_WORDS
from .shingles import word_hashes

#: Each looks for one defect, but for the two that judge running text either way.
LABELERS = {"symbols": weak.DETECTOR, "capitals": weak.DETECTOR, "repetition": weak.DETECTOR, "lists": weak.DETECTOR, "word_length": weak.DETECTOR,
            "neighbours": weak.DETECTOR, "stop_words": weak.EITHER_WAY, "sentences": weak.EITHER_WAY}
#: The scorer is trained on about this many distinct documents, chosen by hash.
SAMPLE = 4_096
HASHED = 1 << 12
_SHAPES, _SPREAD = 64, 16
FEATURES = HASHED + _SHAPES + _SPREAD + 1
#: Texts of fewer words get no vote that needs a rate.
FEW_WORDS = 12
STEPS = 300

# marks of a byte: lower case, upper case, digit, list mark, symbol, plain punctuation; bytes of other scripts' letters count as lower case
_LOWER, _UPPER, _DIGIT, _LIST, _SYMBOL, _PLAIN = (1 << i for i in range(6))
_MARKS = np.zeros(256, np.uint8)
_MARKS[97:123], _MARKS[65:91], _MARKS[48:58], _MARKS[128:] = _LOWER, _UPPER, _DIGIT, _LOWER
for _b in b"!#$%&*+/<=>@\\^_`{}~[]":
    _MARKS[_b] = _SYMBOL
_MARKS[ord("|")] = _LIST
for _b in b".,;:?'\"()-":
    _MARKS[_b] = _PLAIN


def _stop_hashes() -> np.ndarray:
    words = [w + end for w in sorted(STOP_WORDS) for end in ("", ",", ".")]
    _, _, h = next(word_hashes(pa.array([" ".join(words)])))
    return np.unique(h)


def _votes(h: np.ndarray, mark: np.ndarray, size: np.ndarray, stop: np.ndarray) -> tuple[list[int], float]:
    """Votes of LABELERS on a text of one or more words, and its share of distinct words."""
    n = len(h)
    distinct = len(np.unique(h)) / n
    if n < FEW_WORDS:
        odd = ((mark & _SYMBOL) > 0).mean()
        return [-1 if odd > 0.5 else 0, *[0] * (len(LABELERS) - 1)], distinct

    def defect(x: float, most: float) -> int:
        return -1 if x >= most else 0

    def either(x: float, bad: float, good: float) -> int:
        return 1 if x >= good else -1 if x < bad else 0
    symbols = ((mark & _SYMBOL) > 0).mean()
    long_ = size > 1
    capitals = ((mark & (_UPPER | _LOWER)) == _UPPER)[long_].mean() if long_.any() else 0.0
    lists = ((mark & _LIST) > 0).mean()
    known = stop[np.minimum(np.searchsorted(stop, h), len(stop) - 1)] == h
    again = (h[1:] == h[:-1]).mean()
    sentences = (((mark & _PLAIN) > 0) & ((mark & _SYMBOL) == 0)).mean()
    expected = min(1.0, 12 / n ** 0.5)  # long texts repeat their words more
    return [defect(symbols, 0.2), defect(capitals, 0.3), defect(-distinct, -0.3 * expected), defect(lists, 0.15), defect(abs(size.mean() - 6), 7),
            defect(again, 0.2), either(known.mean(), 0.05, 0.12), either(sentences, 0.01, 0.04)], distinct


def _features(h: np.ndarray, mark: np.ndarray, distinct: float) -> np.ndarray:
    x = np.bincount((h % np.uint64(HASHED)).astype(np.int64), minlength=FEATURES).astype(np.float32)
    x[HASHED:HASHED + _SHAPES] = np.bincount(mark, minlength=_SHAPES)
    np.sqrt(x, out=x)
    x[:HASHED] /= max(1e-9, float(np.linalg.norm(x[:HASHED])))
    x[HASHED:HASHED + _SHAPES] /= max(1e-9, float(np.linalg.norm(x[HASHED:HASHED + _SHAPES])))
    x[HASHED + _SHAPES + min(_SPREAD - 1, int(distinct * _SPREAD))] = 1
    x[-1] = 1
    return x


def _code(votes: list[int]) -> int:
    return sum((v + 1) * 3 ** i for i, v in enumerate(votes))


def _decode(code: int) -> tuple[int, ...]:
    return tuple(code // 3 ** i % 3 - 1 for i in range(len(LABELERS)))


def _each(batch: pa.RecordBatch, text: int):
    """(votes, features) or None for every text of a batch; None: no words."""
    stop = _stop_hashes()
    for _, at, h, mark, size in word_hashes(batch.column(text), marks=_MARKS):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if a == b:
                yield None
                continue
            votes, distinct = _votes(h[a:b], mark[a:b], size[a:b], stop)
            yield votes, lambda a=a, b=b, h=h, mark=mark, d=distinct: _features(h[a:b], mark[a:b], d)


@dataclass(frozen=True)
class Model:
    """Labeler accuracies and the scorer's weights."""

    share_good: float
    accuracy: dict[str, float]
    posterior: dict[tuple[int, ...], float]
    weights: np.ndarray


def fit(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Model:
    """Votes are counted over all documents, at most 3 ** 8 patterns; the scorer sees a sample
    of about ``sample`` distinct texts. Texts without words, null ones too, take no part; without any other
    the scorer's weights are zero and all scores one half."""
    text = docs.select(column(docs, text_col).alias("t"))

    def codes(batches):
        for batch in batches:
            own = [_code(x[0]) for x in _each(batch, 0) if x]
            code, n = np.unique(np.array(own, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])
    counted = text.mapInArrow(codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    patterns = sorted((_decode(r.code), r.n) for r in counted)
    total = sum(n for _, n in patterns)
    prior, like, post = weak.estimate(patterns, list(LABELERS.values()))
    accuracy = {}
    for i, name in enumerate(LABELERS):
        right = prior * like[1][i][2] + (1 - prior) * like[0][i][0]
        wrong = prior * like[1][i][0] + (1 - prior) * like[0][i][2]
        accuracy[name] = right / (right + wrong)
    key = F.xxhash64(F.lit(3), column(docs, text_col))  # copies are one document
    cutoff = -(2 ** 63) + int(2 ** 64 * min(1.0, sample / max(1, total)))
    chosen = docs.select(key.alias("key"), column(docs, text_col).alias("t")).where(F.col("key") <= min(cutoff, 2 ** 63 - 1)).dropDuplicates(["key"])

    def vectors(batches):
        for batch in batches:
            rows = [(k, _code(x[0]), x[1]().astype("<f2").tobytes()) for k, x in zip(batch.column(0).to_pylist(), _each(batch, 1)) if x]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], ["key", "code", "x"])
    seen = sorted((r.key, r.code, r.x) for r in chosen.mapInArrow(vectors, "key long, code long, x binary").collect())  # 8 KB a document
    w = np.zeros(FEATURES, np.float32)
    if seen:
        x = np.frombuffer(b"".join(bytes(r[2]) for r in seen), "<f2").reshape(len(seen), FEATURES).astype(np.float32)
        y = np.array([post[_decode(r[1])] for r in seen], np.float32)
        good = max(1e-3, float(y.mean()))
        even = y / good + (1 - y) / max(1e-3, 1 - good)  # both classes weigh the same
        even /= even.sum()
        speed = np.zeros_like(w)
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            speed = 0.9 * speed + x.T @ ((p - y) * even) + 1e-4 * w
            w -= 2.0 * speed
    return Model(prior, accuracy, post, w)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score, the scorer's probability of good, and quality_votes, the
    labelers' posterior; both 0 for null and blank texts. Clashing names get underscores."""
    value, votes = (free_name(docs.columns, x) for x in ("quality_score", "quality_votes"))
    weights = docs.sparkSession.sparkContext.broadcast((model.weights, model.posterior))
    at = docs.columns.index(text_col)

    def run(batches):
        w, post = weights.value
        for batch in batches:
            rows = [(0.0, 0.0) if x is None else (1 / (1 + float(np.exp(-np.clip(float(x[1]() @ w), -30, 30)))), post.get(tuple(x[0]), 0.5)) for x in _each(batch, at)]
            cols = list(zip(*rows)) or [[], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(c), pa.float64()) for c in cols]], names=[*batch.schema.names, "value", "votes"])
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any name can be a column's
    schema = T.StructType([*plain.schema.fields, T.StructField("value", T.DoubleType()), T.StructField("votes", T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*docs.columns, value, votes)


def keep(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents that the classifier does not reject, unchanged. Empty texts are
    rejected; equal rows share their fate."""
    scored = score(docs, fit(docs, **options), options.get("text_col", "text"))
    return scored.where(F.col(f"`{scored.columns[-2]}`") >= least).select(*[column(scored, c) for c in docs.columns])
