"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes a space, and the n-grams of one to four
characters of what is left, spaces included, are hashed into a table of embeddings. The mean of
a text's embeddings goes through a linear softmax. Both layers are trained here by stochastic
gradient descent in numpy. A part of the sample that training does not see sets the softmax's
temperature, and below which score a prediction is rejected.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm.hot import bounded, release

UNKNOWN = "und"
BUCKETS, DIM, ORDERS = 1 << 15, 16, (1, 2, 3, 4)
#: Bounds of the sample that the classifier is fitted on: texts of each language, characters of a
#: text that may be in it, and languages, the most frequent first.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS, LANGUAGES = 1_000, 20_000, 256
#: Characters of all texts in the sample together, shared equally by the languages: what the driver holds.
SAMPLE_TOTAL = 32_000_000
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Share of the fitting sample that only calibrates.
CALIBRATION = 4
#: Of right predictions on the calibrating part, this share at most is rejected.
REJECTED_RIGHT = 0.005
_PIECE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point itself if it is a letter, else a space."""
    return np.fromiter((p if chr(p).isalpha() else 32 for p in range(0x110000)), np.uint32, 0x110000)


def codes(text: str) -> np.ndarray:
    """The text's lower-case letters as code points, with one space where others stand, and at both ends; empty without a letter."""
    kept = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (kept != 32).any():
        return np.zeros(0, np.uint32)
    kept = np.concatenate([[32], kept, [32]]).astype(np.uint32)
    return kept[np.append(True, (kept[1:] != 32) | (kept[:-1] != 32))]


def features(code: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the n-grams of a text's codes."""
    out = []
    hashed = np.zeros(len(code), np.uint32)
    for n in ORDERS:
        if len(code) < n:
            break
        hashed = (hashed[: len(code) - n + 1] ^ code[n - 1 :]) * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        out.append(((hashed * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int64) % buckets)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    #: A row of logits for each bucket: embeddings times the linear layer, since the mean comes first.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        code = codes(text or "")
        if not len(code):
            return UNKNOWN, 0.0, True
        total, n = np.zeros(len(self.languages)), 0
        for a in range(0, len(code), _PIECE):  # bounded memory; pieces overlap by what an n-gram needs
            f = features(code[a : a + _PIECE + max(ORDERS) - 1] if a + _PIECE < len(code) else code[a:])
            total += np.bincount(f, minlength=len(self.logits)) @ self.logits if len(f) > 20_000 else self.logits[f].sum(axis=0)
            n += len(f)
        p = _softmax((total / n + self.bias) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k]), bool(p[k] < self.least_score)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _shares(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, counts = np.unique(f, return_counts=True)
    return unique, (counts / len(f)).astype(np.float32)


def fit(texts: list[str], langs: list[str], seed: int = SEED) -> Model:
    """Train on three of four texts and calibrate on the fourth. The texts' order must not depend on anything but their ids."""
    languages = sorted(set(langs))
    rng = np.random.default_rng(seed)
    pairs = [(*_shares(features(c)), languages.index(g)) for t, g in zip(texts, langs, strict=True) if len(c := codes(t))]
    held = [p for i, p in enumerate(pairs) if i % CALIBRATION == 0]
    train = [p for i, p in enumerate(pairs) if i % CALIBRATION] or held
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    linear, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = max(1, EPOCHS * len(train)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            unique, share, y = train[i]
            rate, done = RATE * (1 - done / steps), done + 1
            hidden = share @ table[unique]
            error = _softmax(hidden @ linear + bias)
            error[y] -= 1
            back = linear @ error
            linear -= rate * np.outer(hidden, error)
            bias -= rate * error
            table[unique] -= rate * share[:, None] * back * len(unique) ** 0.5
    logits = (table @ linear).astype(np.float64)
    scored = [(share @ logits[unique] + bias, y) for unique, share, y in held]
    temperature = min(np.geomspace(0.05, 5, 60), key=lambda t: sum(-np.log(max(_softmax(x / t)[y], 1e-12)) for x, y in scored)) if scored else 1.0
    right = [float(_softmax(x / temperature).max()) for x, y in scored if int(np.argmax(x)) == y]
    return Model(languages, logits, bias.astype(np.float64), float(temperature), float(np.quantile(right, REJECTED_RIGHT)) if right else 0.0)


def remainder(ids: F.Column) -> F.Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(ids.cast("string").cast("binary")) % 3


def sample(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> list:
    """Rows ``(doc_id, text, lang)`` whose hashed id lies below their language's share.

    A language's share is what gives about ``per_language`` rows of at most ``chars`` characters,
    or, if that is less, its part of SAMPLE_TOTAL characters; so the sample's size is bounded in
    rows and in characters whatever the table holds.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= chars))
    counts = usable.groupBy("lang").agg(F.count("*").alias("count"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return []
    part = SAMPLE_TOTAL / len(counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"], part / max(1, r["chars"])))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    picked = usable.where(chance < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    return sorted(picked.select("doc_id", "text", "lang").collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"], r["lang"]))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every whole text; without a model every text is unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            got = [model.predict(t.as_py()) if model else (UNKNOWN, 0.0, True) for t in texts]
            if not got:
                continue
            pred, score, rejected = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])
        release()

    bounded(docs.sparkSession)
    rows = docs.select("doc_id", (F.coalesce(remainder(F.col("doc_id")), F.lit(-1)) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from rows whose id's crc32 modulo 3 is not 1, and predict every row.

    Null texts and texts without a letter are ``und`` with score 0, and rejected. A null id is
    never learned from and never held out; null languages are not learned. Repeated rows are
    predicted alike, other columns are not looked at, an empty table gives an empty one.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text", "cast(lang as string) as lang")
    learned = sample(rows.where(remainder(F.col("doc_id")) != 1))
    model = fit([r["text"] for r in learned], [r["lang"] for r in learned]) if learned else None
    return predicted(rows, model)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
