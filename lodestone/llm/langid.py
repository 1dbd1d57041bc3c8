"""Language identification by rank-order profiles.

A text is lower-cased and every run of other characters than letters becomes one
blank; its 1- to 3-grams are ranked by frequency (ties by code point). A language
profile ranks the n-grams of its training texts. The distance of a text sums, over
its ``TOP`` most frequent n-grams, how far each is out of place in the profile,
``TOP`` where it is absent; the nearest language wins (ties by name). Trigrams of
21-bit code points fit 64 bits, so n-grams are compared exactly.

Profiles come from a bounded sample, ``TRAIN_DOCS`` texts a language drawn by
identifier hash, with counts summed in Spark. Prediction reads every whole text.

Null texts and texts without a letter are ``und`` with score 0; so are all texts
where nothing was learned, as from an empty table. Rows with a null language or id
teach nothing. Repeated rows teach once each and are predicted alike. Only the named
columns are read, so other columns cannot clash; identifiers may be of any type.
The score is 1 minus the distance over the largest possible one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 300
TRAIN_DOCS = 2000
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams, ascending, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    padded = np.full(len(codes) + 2, 32, np.uint64)
    padded[1:-1] = np.where(letter, codes, 32)
    blank = padded == 32
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    u = padded[keep]
    two = (u[:-1] << np.uint64(21)) | u[1:]
    three = (two[:-1] << np.uint64(21)) | u[2:]
    return np.unique(np.concatenate((u[u != 32], two, three)), return_counts=True)


def ranked(text: str, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first."""
    grams, counts = ngrams(text)
    if not len(grams):
        return grams
    down = np.argsort((counts.max() - counts).astype(np.uint16 if counts.max() < 65536 else np.int64), kind="stable")
    return grams[down[:top]]


def _count(batches):
    import pandas as pd

    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            parts = [ngrams(t) for t in group["text"]]
            grams = np.concatenate([p[0] for p in parts])
            distinct, at = np.unique(grams, return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(distinct)).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "gram": distinct.astype(np.int64), "n": n})


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles {language: n-grams by rank} from the rows where ``train`` holds.

    Languages are counted without their texts; their shares (a row a language, as
    the profiles themselves) are broadcast, so the draw needs no shuffle and only
    drawn texts are counted."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), train.alias("train")).where("train AND lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    shares = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    drawn = usable.join(F.broadcast(shares), "lang").where(draw < F.col("share") * 1_000_000)
    counts = drawn.select("lang", "text").mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("place", place).where(F.col("place") <= top).collect()  # top rows a language
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.uint64) for k, v in out.items()}


def nearest(text: str | None, names: list[str], tables: list[tuple[np.ndarray, np.ndarray]], top: int) -> tuple[str, float]:
    own = ranked(text, top) if text else ()
    if not len(own) or not names:
        return UNKNOWN, 0.0
    place = np.arange(len(own))
    best, least = UNKNOWN, None
    for name, (grams, ranks) in zip(names, tables, strict=True):
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        far = np.where(grams[at] == own, np.abs(ranks[at] - place), top)
        d = int(far.sum())
        if least is None or d < least:
            best, least = name, d
    return best, 1 - least / (top * len(own))


def _predictor(profiles: dict[str, np.ndarray], top: int):
    names = sorted(profiles)
    tables = []
    for name in names:
        order = np.argsort(profiles[name])
        tables.append((profiles[name][order], order))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [nearest(t.as_py(), names, tables, top) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """Per row: id column, lang_pred, score."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_predictor(profiles, top), f"id {dict(slim.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
