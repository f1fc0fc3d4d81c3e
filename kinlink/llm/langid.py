"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of byte n-grams of 1 to
ORDERS bytes that both hold, over the square root of the numbers that each holds. Landmarks,
a bounded sample, give a Nystroem map; one-versus-rest kernel ridge regression is fitted on
a bounded sample of labelled documents. N-grams that no landmark holds add nothing to a
kernel value with a landmark, so a text is the presence vector over the landmarks' n-grams
(its norm is taken over them too), and a batch of texts is scored as a product of matrices:
(presence x landmarks) x weights, of which the last two factors are multiplied once.

Texts are read whole. The model sees text and labels of its sample, nothing else of a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import read_table, slices

ORDERS = 3
#: Documents of each language to fit on, and how many of those are landmarks: the bounds of the sample.
PER_LANGUAGE, LANDMARKS = 300, 64
RIDGE, JITTER = 1e-2, 1e-6
#: The most frequent labels are learnt, so many at most; and how many documents are drawn for each one wanted.
LANGUAGES, SPARE = 500, 3
#: Rows of a presence matrix.
ROWS = 64
NONE = "und"
#: Texts of whose n-grams (of over one byte) less than this share is known are in no learnt language.
LEAST_KNOWN = 0.2
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def _bytes(text: str) -> np.ndarray:
    """The text in lower case with one space for each run of other things than letters."""
    return np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass"), np.uint8)


def _codes(b: np.ndarray, order: int) -> np.ndarray:
    n = len(b) - order + 1
    out = np.zeros(max(n, 0), np.uint32)
    for i in range(order if n > 0 else 0):
        out = out << np.uint32(8) | b[i : i + n]
    return out


def presence(text: str) -> np.ndarray:
    """Sorted codes of the n-grams a text holds; the order stands in the upper bits."""
    b = _bytes(text)
    return np.concatenate([np.unique(_codes(b, n)) | np.uint32(n << 24) for n in range(1, ORDERS + 1)])


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted codes of the landmarks' n-grams
    weights: np.ndarray  # n-grams x languages
    tables: list[np.ndarray] = field(default_factory=list)
    alphabet: np.ndarray | None = None

    def __getstate__(self):
        return self.languages, self.grams, self.weights

    def __setstate__(self, state):
        self.languages, self.grams, self.weights = state
        self.tables, self.alphabet = [], None

    def _index(self) -> None:
        """Tables over the landmarks' own bytes, numbered from 1; any other byte is 0, and no landmark holds it."""
        own = np.unique(self.grams[self.grams >> np.uint32(24) == 1] & np.uint32(0xFF))
        self.alphabet = np.zeros(256, np.int64)
        self.alphabet[own] = np.arange(1, len(own) + 1)
        base = len(own) + 1
        for n in range(1, ORDERS + 1):
            table = np.full(base**n, len(self.grams), np.int32)
            at = np.flatnonzero(self.grams >> np.uint32(24) == n)
            code = np.zeros(len(at), np.int64)
            for k in range(n):
                code = code * base + self.alphabet[self.grams[at] >> np.uint32(8 * (n - 1 - k)) & np.uint32(0xFF)]
            table[code] = at
            self.tables.append(table)

    def columns(self, b: np.ndarray) -> list[np.ndarray]:
        """For each order the columns of a text's n-grams; the last column takes those that no landmark holds."""
        if not self.tables:
            self._index()
        letters = self.alphabet[b].astype(np.int32)
        base, code, out = int(self.alphabet.max()) + 1, letters, []
        for n, table in enumerate(self.tables, 1):
            if n > 1:
                code = code[: len(letters) - n + 1] * np.int32(base) + letters[n - 1 :]
            out.append(table[code])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """A language, a score from 0 to 1, and the share of n-grams of over one byte that a landmark holds, for each text.

        NONE, 0 and 0 without a letter or a model.
        """
        names, scores, known = [NONE] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        for at in range(0, len(able), ROWS):
            rows = able[at : at + ROWS]
            held = np.zeros((len(rows), len(self.grams) + 1), np.float32)
            for k, i in enumerate(rows):
                all_cols = self.columns(_bytes(texts[i]))
                for cols in all_cols:
                    held[k, cols] = 1
                known[i] = sum(np.count_nonzero(c < len(self.grams)) for c in all_cols[1:]) / max(sum(map(len, all_cols[1:])), 1)
            held = held[:, :-1]
            norm = np.sqrt(np.maximum(held.sum(axis=1), 1))
            value = (held @ self.weights) / norm[:, None]
            best = value.argmax(axis=1)
            for i, k, v in zip(rows, best.tolist(), value.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = self.languages[k], min(1.0, max(0.0, (v + 1) / 2))
        return names, scores, known


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model from ``(language, presence codes)``; the first ``landmarks`` of each language are the landmarks."""
    languages = sorted({lang for lang, _ in sample})
    seen = dict.fromkeys(languages, 0)
    marks = []
    for lang, codes in sample:
        if seen[lang] < landmarks:
            marks.append(codes)
        seen[lang] += 1
    if not marks:
        return Model([], np.zeros(0, np.uint32), np.zeros((0, 0), np.float32))
    grams = np.unique(np.concatenate(marks))

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(grams)), np.float32)
        for k, codes in enumerate(rows):
            at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
            out[k, at[grams[at] == codes]] = 1
        return out / np.sqrt(np.maximum(out.sum(axis=1), 1))[:, None]

    land = matrix(marks)
    value, vector = np.linalg.eigh((land @ land.T).astype(float))
    value = np.maximum(value, JITTER)
    root = (vector / np.sqrt(value)) @ vector.T  # K_LL to the power -1/2
    gram, right = np.zeros((len(marks), len(marks))), np.zeros((len(marks), len(languages)))
    index = {lang: k for k, lang in enumerate(languages)}
    for a in range(0, len(sample), ROWS):
        part = sample[a : a + ROWS]
        phi = (matrix([c for _, c in part]) @ land.T).astype(float) @ root
        y = -np.ones((len(part), len(languages)))
        y[np.arange(len(part)), [index[lang] for lang, _ in part]] = 1
        gram += phi.T @ phi
        right += phi.T @ y
    beta = root @ np.linalg.solve(gram + ridge * len(sample) / len(marks) * np.eye(len(marks)), right)
    return Model(languages, grams, (land.T @ beta).astype(np.float32))


def held_out() -> Column:
    """Documents that are never learnt from: crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Fit on at most ``per_language`` documents of each language, in the order of a hash of their ids."""
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    # about SPARE times as many as wanted pass a threshold on a hash, whatever the size of a language
    sizes = docs.where(F.col("lang").isNotNull() & ~held_out()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return fit([], landmarks)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, SPARE * per_language / r.n)])
    u = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("lang").orderBy("u", "doc_id")
    drawn = able.where(u < F.try_element_at(share, F.col("lang"))).select("doc_id", "lang", u.alias("u"))
    picked = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    ids = picked.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            grams = [presence(t).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(grams, pa.binary())], ["doc_id", "lang", "grams"])

    sample = able.join(F.broadcast(ids), (able.doc_id == ids._id) & (able.lang == ids._lang), "left_semi")
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, "doc_id long, lang string, grams binary").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, bytes(r.grams)))
    return fit([(r.lang, np.frombuffer(r.grams, np.uint32)) for r in rows], landmarks)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score and known, replacing columns of those names.

    lang_pred is a learnt language, or "und" (score 0) if the text is null, empty or has no letter,
    or if there was nothing to learn from. known is the share of its n-grams that the model has met.
    """
    made = ("lang_pred", "score", "known")
    names = [c for c in docs.columns if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score, known = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], [*names, *made])

    own = docs.select(*names)
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())])
    return own.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float = LEAST_KNOWN) -> DataFrame:
    """The rows of ``docs`` whose text is in a learnt language, as they are.

    Texts that are null or have no letter go, and those of whose n-grams the model has met less than ``least``: no
    language claims them. Where nothing could be learnt, all texts with a letter stay.
    """
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return identify(docs, model).where((F.col("lang_pred") != NONE) & (F.col("known") >= least)).select(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by identify(): null texts and texts without a letter are "und", repeated rows stay, extra columns are not read."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
