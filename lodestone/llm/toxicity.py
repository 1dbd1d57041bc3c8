"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w . x - b_k) with one weight vector for all ordered
thresholds b_1 < b_2 < ...; the expected severity is the sum of these
probabilities. Features are the distinct words of a text and their first four,
five and six letters, kept where the training rows tell grades apart.

Grades are those of the labels, as whole numbers from 0: labels of m + 1 grades give
m thresholds. The tables at hand label documents 0 or 1, so the registered query has
one threshold, and its severity lies between 0 and 1. No grade is made up from the
text.

Training uses a bounded sample of the labelled rows, ``TRAIN_ROWS`` drawn by
identifier hash and written once; its feature counts are summed in Spark and only the
``MOST_FEATURES`` best reach the driver. Scoring reads every whole text.

Null and empty texts have no features and get the base severity. Labels with a
null id or grade are ignored, and negative grades count as 0; of several labels of one
document the highest counts. Repeated rows are scored alike; empty tables give no
rows, or where nothing was learned the severity 0, as do labels of a single grade.
Only the named columns are read, and ``drop_toxic`` carries all others along,
whatever their names. Identifiers may be of any type.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, release

TRAIN_ROWS = 20_000
MOST_FEATURES = 4096
#: A feature's likelihood ratio must exceed 2 ln(candidates) by so much: chance then gives hardly any.
LEAST_GAIN = 6.0
HEAD = 4
#: Feature of a text that has any other feature.
ANY = ""
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def severities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each score (rows) and threshold (columns)."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - np.array(self.thresholds)[None, :], -40, 40)))


def telling(text: str | None, heads: set[str], known) -> set[str]:
    """Features of a text that are in ``known``."""
    out = set()
    for w in set(_WORD.findall(text.lower())) if text else ():
        if w[:HEAD] in heads:
            for f in (w, w[:4] + "*", w[:5] + "*", w[:6] + "*"):
                if f in known:
                    out.add(f)
    if out:
        out.add(ANY)
    return out


def _count_features(batches):
    import pandas as pd

    for pdf in batches:
        totals: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, grade in zip(pdf["text"], pdf["grade"], strict=True):
            found = set()
            for w in set(_WORD.findall(text.lower())) if text else ():
                if len(w) >= HEAD:
                    found.update((w, w[:4] + "*", w[:5] + "*", w[:6] + "*"))
            totals[int(grade > 0)].update(found)
        names = list(totals[0].keys() | totals[1].keys())
        yield pd.DataFrame({"feature": names, "bad": [totals[1][f] for f in names], "good": [totals[0][f] for f in names]})


def _vectors(features: list[str]):
    at = {f: i for i, f in enumerate(features)}
    heads = {f[:HEAD] for f in features if f}

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"grade": pdf["grade"], "found": [[at[f] for f in telling(text, heads, at)] for text in pdf["text"]]})

    return run


def fit_cumulative_link(rows: list[list[int]], grades: np.ndarray, n_features: int, l2: float = 1e-5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam; thresholds stay ordered as a running sum of
    positive gaps. Weights are shared by all thresholds."""
    top = int(grades.max())
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((c for r in rows for c in r), np.int64, len(doc))
    w, first, gaps = np.zeros(n_features), 2.0, np.zeros(max(0, top - 1))
    theta = np.concatenate((w, [first], gaps))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, first, gaps = theta[:n_features], theta[n_features], theta[n_features + 1 :]
        b = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score = np.bincount(doc, weights=w[col], minlength=len(rows))
        # likelihood of grade y: F(s - b_y) - F(s - b_{y+1}), written by its cumulative parts
        s = 1 / (1 + np.exp(-np.clip(score[:, None] - b[None, :], -40, 40)))
        upper = np.concatenate((np.ones((len(rows), 1)), s), axis=1)
        lower = np.concatenate((s, np.zeros((len(rows), 1))), axis=1)
        pick = (np.arange(len(rows)), grades)
        p = np.maximum(upper[pick] - lower[pick], 1e-9)
        slope = s * (1 - s)
        d_upper = np.concatenate((np.zeros((len(rows), 1)), slope), axis=1)[pick] / p
        d_lower = np.concatenate((slope, np.zeros((len(rows), 1))), axis=1)[pick] / p
        g_score = (d_upper - d_lower) / len(rows)
        g_b = np.zeros(top)
        np.add.at(g_b, np.maximum(grades - 1, 0), np.where(grades > 0, -d_upper, 0) / len(rows))
        np.add.at(g_b, np.minimum(grades, top - 1), np.where(grades < top, d_lower, 0) / len(rows))
        g_w = np.bincount(col, weights=g_score[doc], minlength=n_features) - l2 * w
        tails = np.cumsum(g_b[::-1])[::-1]
        grad = np.concatenate((g_w, [g_b.sum()], tails[1:] * np.exp(gaps)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(theta[n_features + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, most_features: int = MOST_FEATURES) -> OrdinalModel:
    graded = labels.select(F.col(id_col).alias("id"), F.when(F.col(grade_col).isNotNull(), F.greatest(F.col(grade_col).cast("int"), F.lit(0))).alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.max("grade").alias("grade"))
    n = graded.count()
    if not n:
        return OrdinalModel()
    share = min(1.0, train_rows / n)
    sample = graded.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("text", "grade"), "training")
    counted = rows.mapInPandas(_count_features, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = rows.agg(F.count_if(F.col("grade") > 0).alias("bad"), F.count_if(F.col("grade") == 0).alias("good")).first()
    if not totals["bad"] or not totals["good"]:
        release(rows)
        return OrdinalModel()
    bad, good = float(totals["bad"]), float(totals["good"])
    # evidence for the toxic side: rate ratio, and a likelihood ratio against equal rates
    both = (F.col("bad") + F.col("good")) / (bad + good)
    gain = 2 * (F.col("bad") * F.log(F.col("bad") / (bad * both)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (good * both))).otherwise(0.0))
    candidates = materialize(counted.where("bad >= 3"), "features")
    least = 2 * math.log(max(1, candidates.count())) + LEAST_GAIN
    best = candidates.where(F.col("bad") / bad > 8 * F.col("good") / good).withColumn("gain", gain).where(F.col("gain") > least).orderBy(F.desc("gain"), "feature").limit(most_features)
    features = [r["feature"] for r in best.select("feature", "gain").collect()]
    release(candidates)
    if not features:
        release(rows)
        return OrdinalModel()
    features.append(ANY)
    found = rows.mapInPandas(_vectors(features), "grade int, found array<int>").collect()  # at most about train_rows rows
    release(rows)
    grades = np.array([r["grade"] for r in found])
    weights, thresholds = fit_cumulative_link([r["found"] for r in found], grades, len(features))
    return OrdinalModel(dict(zip(features, map(float, weights), strict=True)), [float(b) for b in thresholds])


def _scorer(model: OrdinalModel):
    heads = {f[:HEAD] for f in model.weights if f}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            scores = np.array([sum(model.weights[f] for f in sorted(telling(t.as_py(), heads, model.weights))) for t in b.column(1)], float)
            p = model.severities(scores)
            toxic = p[:, 0] >= 0.5 if p.shape[1] else np.zeros(len(scores), bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(toxic)], ["id", "text_key", "severity", "grade", "toxic"])

    return run


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id column, text_key (hash of the text), severity (expected grade),
    grade (most thresholds passed), toxic (first threshold passed)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    id_type = dict(slim.dtypes)["id"]
    return slim.mapInArrow(_scorer(model), f"id {id_type}, text_key long, severity double, grade int, toxic boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows that the first threshold does not reject, with all columns, in one
    pass without a shuffle."""
    heads = {f[:HEAD] for f in model.weights if f}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            scores = np.array([sum(model.weights[f] for f in sorted(telling(t.as_py(), heads, model.weights))) for t in texts], float)
            p = model.severities(scores)
            yield b.filter(pa.array(p[:, 0] < 0.5 if p.shape[1] else np.ones(len(scores), bool)))

    return docs.mapInArrow(run, docs.schema)
