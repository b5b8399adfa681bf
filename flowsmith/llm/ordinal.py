"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector w over hashed text features, shared by all
grades, and ordered thresholds theta_1 < theta_2 < ...  The expected grade is the
sum of the tail probabilities P(grade >= k); selection uses one tail probability.

Features (presence, hashed to 2^18 slots): each different word without its
punctuation and case, the raw shape of the text (share of capitals, digits,
exclamation marks, bars, repeated words, word length; each cut into steps), so a
document counts a word once however long it is.

Fit: a slot gets a weight if its frequency differs between some two grades by the Benjamini-Hochberg rule, with a share of ``FALSE`` chance
slots among those found for these two grades; the bound follows the number of ratings, of each grade and of slots, and
keeps chance words of a small sample out.  A document is accepted if P(best grade) reaches ``cut``: rated documents are scored by models
fitted without them (``FOLDS`` parts), and the cut rejects as many of the lower grades as a loss of ``LOSS`` of the best grade allows; with too few ratings for
that it is 0.5.  The fit is on at most ``SAMPLE`` rated documents, those with the smallest hash of their id (a documented bound; every other step
covers all rows).  Only their hashed features reach the driver.  The weights
(2^18 floats, a fixed size) are broadcast, and scoring is one map over the whole texts without a shuffle.

Nulls, ties, repeats: NULL or empty text has only the shape features of empty text; a NULL quality or id is not
used for the fit, a NULL toxic mark counts as clean; ids are whole numbers (cast to bigint); repeated rows are scored alike; with no rating at all the model is
uninformed (w = 0) and keeps everything; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, whole_text

SLOTS = 1 << 18
SAMPLE = 16_384
GRADES = 3
L2 = 1e-3
STEPS = 160
FALSE = 0.02                # share of chance slots among those that tell two grades apart
LOSS = 0.04                 # share of the best grade that the cut may reject
FOLDS = 5
RATE = 0.08
CACHE = 100_000
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the labels table: 0 poor, 1 good but toxic, 2 good and clean.  An id with several
    ratings has the lowest of them."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    grade = F.when(~good, 0).when(toxic, 1).otherwise(2)
    return (labels.filter("doc_id is not null and quality is not null").select("doc_id", F.when(F.col("toxic").isNull() & good, 2).otherwise(grade).alias("grade"))
            .groupBy("doc_id").agg(F.min("grade").alias("grade")))


def _slot(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 7) & (SLOTS - 1)


def _shape(raw: bytes, n_words: int, n_unique: int) -> list[int]:
    n = max(len(raw), 1)
    share = {
        "upper": (n - len(raw.translate(None, UPPER))) / n if raw else 0.0,
        "digit": (n - len(raw.translate(None, DIGITS))) / n if raw else 0.0,
        "bang": raw.count(b"!") * 4 / n,
        "bar": raw.count(b"|") * 4 / n,
        "again": 1 - n_unique / max(n_words, 1),
        "length": min(n / max(n_words, 1) / 40, 1.0),
    }
    steps = [_slot(f"\x00{k}:{int(min(v, 1.0) * 20)}".encode()) for k, v in share.items()]
    return steps + [_slot(f"\x00words:{int(np.log2(n_words + 1))}".encode())]


def features(raw: bytes, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted different feature slots of a whole text."""
    words = raw.split()
    unique = set(words)
    if len(cache) > CACHE:                 # bounds memory, not the features
        cache.clear()
    slots = []
    for w in unique:
        s = cache.get(w)
        if s is None:
            s = cache[w] = _slot(w.strip(EDGE).lower()) if len(w) <= 64 else _slot(w)
        slots.append(s)
    return np.unique(np.array(slots + _shape(raw, len(words), len(unique)), np.int32))


@dataclass
class OrdinalModel:
    weights: np.ndarray        # float32, SLOTS
    thresholds: np.ndarray     # ascending, one per grade above 0
    cut: float = 0.5           # least P(best grade) of an accepted document

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. (one column each)."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(slots: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, l2: float = L2, steps: int = STEPS) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by Adam on the whole sample.  The thresholds stay ordered:
    their gaps are exponentials of free numbers."""
    if not len(grades):
        return OrdinalModel(np.zeros(SLOTS, np.float32), np.arange(n_grades - 1) - 40.0)
    rows = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    cols = np.concatenate(slots)
    n, k = len(grades), n_grades - 1
    above = np.array([(np.sum(grades >= j) + 0.5) / (n + 1) for j in range(1, n_grades)])
    first = -np.log(above / (1 - above))
    free = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 0.05))))
    w = np.zeros(SLOTS)
    params = [w, free]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    share = np.array([n / (n_grades * max(np.sum(grades == g), 1)) for g in range(n_grades)]) ** 0.5
    each = share[grades] / n
    for t in range(1, steps + 1):
        theta = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
        score = np.bincount(rows, w[cols], n)
        cdf = np.zeros((n, n_grades + 1))                      # P(grade < j)
        cdf[:, 1:-1] = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -40, 40)))
        cdf[:, -1] = 1
        density = cdf * (1 - cdf)
        at = np.arange(n)
        p = np.maximum(cdf[at, grades + 1] - cdf[at, grades], 1e-12)
        g_score = each * (density[at, grades + 1] - density[at, grades]) / p
        g_theta = np.zeros(k)
        np.add.at(g_theta, grades[grades < k], -(each * density[at, grades + 1] / p)[grades < k])
        np.add.at(g_theta, grades[grades > 0] - 1, (each * density[at, grades] / p)[grades > 0])
        g_free = np.concatenate(([g_theta.sum()], [g_theta[j:].sum() * np.exp(free[j]) for j in range(1, k)]))
        grads = [np.bincount(cols, g_score[rows], SLOTS) + l2 * w, g_free]
        for i, (q, g) in enumerate(zip(params, grads)):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.001 * (g * g - v[i])
            q -= RATE * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    theta = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
    return OrdinalModel(w.astype(np.float32), theta)


def screen(slots: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, false: float = FALSE) -> np.ndarray:
    """True for the slots that tell some two grades apart."""
    size = np.array([np.sum(grades == g) for g in range(n_grades)])
    count = [np.bincount(np.concatenate([s for s, y in zip(slots, grades) if y == g] or [np.empty(0, np.int64)]), minlength=SLOTS)
             for g in range(n_grades)]
    tests = np.count_nonzero(sum(count))
    telling = np.zeros(SLOTS, bool)
    for a in range(n_grades):
        for b in range(a + 1, n_grades):
            if size[a] and size[b]:
                p = (count[a] + count[b] + 1) / (size[a] + size[b] + 2)
                z = np.abs(count[a] / size[a] - count[b] / size[b]) / np.sqrt(p * (1 - p) * (1 / size[a] + 1 / size[b]))
                far = np.flatnonzero(z > 2)                    # others have a chance of 0.045 or more
                far = far[np.argsort(-z[far], kind="stable")]
                chance = np.array([math.erfc(x / math.sqrt(2)) for x in z[far]])
                found = np.flatnonzero(chance <= false * np.arange(1, len(far) + 1) / max(tests, 1))
                telling[far[:found[-1] + 1 if len(found) else 0]] = True
    return telling


def best_cut(tail: np.ndarray, grades: np.ndarray, n_grades: int = GRADES, loss: float = LOSS) -> float:
    """The cut on P(best grade) that rejects most lower grades at a bounded loss of the best; 0.5 if that, or less, does as well."""
    best = np.sort(tail[grades == n_grades - 1])
    may = int(loss * len(best))
    if not may:
        return 0.5
    most = best[may]
    rejected = tail[(grades < n_grades - 1) & (tail < most)]
    return float(min(most, max(0.5, np.nextafter(rejected.max(initial=0.0), 1.0))))


def fit_with_cut(slots: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES) -> OrdinalModel:
    """The screened fit on all rows, with the cut from models fitted without the rows they score (equal texts together)."""
    def screened(rows: np.ndarray) -> OrdinalModel:
        own = [slots[i] for i in rows]
        telling = screen(own, grades[rows], n_grades)
        return fit([s[telling[s]] for s in own], grades[rows], n_grades)

    model = screened(np.arange(len(grades)))
    if int(LOSS * np.sum(grades == n_grades - 1)):
        fold = np.array([xxhash.xxh64_intdigest(s.tobytes(), 11) % FOLDS for s in slots])
        tail = np.empty(len(grades))
        for k in np.unique(fold):
            m, out = screened(np.flatnonzero(fold != k)), np.flatnonzero(fold == k)
            tail[out] = m.tails(np.array([m.weights[slots[i]].sum(dtype=np.float64) for i in out]))[:, -1]
        model.cut = best_cut(tail, grades, n_grades)
    return model


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[bytes, int] = {}
    for b in batches:
        raw = [t.encode("utf-8", "replace") for t in b.column(2).to_pylist()]
        found = [features(t, cache).tolist() for t in raw]
        keys = np.array([xxhash.xxh64_intdigest(t) for t in raw], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys), pa.array(found, pa.list_(pa.int32()))],
                                         names=["grade", "d_id", "key", "slots"])


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, n_grades: int = GRADES, id_col: str = "doc_id",
          text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``sample`` rated documents (smallest hash of the id).  The sample of the ratings is
    taken before the texts are read, so one join of a bounded side moves only those texts."""
    chosen = (ratings.select(F.col("doc_id").cast("bigint").alias("r_id"), "grade").filter("r_id is not null and grade is not null")
              .orderBy(F.xxhash64("r_id"), "r_id").limit(sample))
    d = docs.select(F.col(id_col).cast("bigint").alias("d_id"), whole_text(text_col).alias("text"))
    rated = d.join(F.broadcast(chosen), F.col("d_id") == F.col("r_id")).select("grade", "d_id", "text")
    rows = rated.select(F.col("grade").cast("int").alias("grade"), "d_id", "text").mapInArrow(_slot_rows, "grade int, d_id bigint, key bigint, slots array<int>")
    # a repeated id counts once, with the text of the smallest hash
    rows = rows.groupBy("d_id").agg(F.min(F.struct("key", "grade", "slots")).alias("r")).select("r.grade", "r.slots")
    got = rows.toArrow().combine_chunks()
    lists, grades = got.column("slots").combine_chunks(), got.column("grade").to_numpy()
    flat, ends = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    slots = [flat[s:e] for s, e in zip(ends[:-1], ends[1:])]
    # an order of the rows that does not depend on the order they came in: sums are then the same each time
    order = sorted(range(len(slots)), key=lambda i: (grades[i], len(slots[i]), slots[i].tobytes()))
    slots, grades = [slots[i] for i in order], grades[order].astype(np.int64)
    return fit_with_cut(slots, grades, n_grades)


def scorer(spark: SparkSession, model: OrdinalModel):
    """Column function: text -> struct(expected, grade, tail) of the whole text."""
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))
    kind = "expected double, grade int, tail array<double>"

    @F.pandas_udf(kind)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, cache = OrdinalModel(*shared.value), {}
        for texts in parts:
            s = np.array([m.weights[features(t.encode("utf-8", "replace"), cache)].sum(dtype=np.float64) for t in texts])
            tails = m.tails(s)
            p = np.hstack((np.ones((len(s), 1)), tails)) - np.hstack((tails, np.zeros((len(s), 1))))
            yield pd.DataFrame({"expected": tails.sum(axis=1), "grade": p.argmax(axis=1).astype(np.int32), "tail": list(tails)})

    return lambda text: score(text)


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_grade, grade (most likely), tail_1.. (P(grade >= k))."""
    score = scorer(docs.sparkSession, model)
    got = docs.select(F.col(id_col).alias("doc_id"), score(whole_text(text_col)).alias("s"))
    return got.select("doc_id", F.col("s.expected").alias("expected_grade"), F.col("s.grade").alias("grade"),
                      *[F.col("s.tail")[k].alias(f"tail_{k + 1}") for k in range(len(model.thresholds))])


def select_documents(docs: DataFrame, model: OrdinalModel, at_least: int = 2, probability: float | None = None,
                     text_col: str = "text") -> DataFrame:
    """The documents with P(grade >= at_least) >= probability, with all their columns; without one, the model's cut for the best
    grade, 0.5 for others."""
    if probability is None:
        probability = model.cut if at_least == len(model.thresholds) else 0.5
    score = scorer(docs.sparkSession, model)
    rows = packed(docs, s=score(whole_text(text_col)))
    return rows.filter(F.col("s.tail")[at_least - 1] >= F.lit(float(probability))).select("_row.*")
