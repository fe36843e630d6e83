"""Language identification in two steps: the family first, then one-versus-one support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.llm.common import frugal, give_back
from rostrum.llm.shingles import views
from rostrum.operators.common import top_k

#: Columns into which byte n-grams are hashed.
WIDTH = 4096
#: Lengths of the n-grams in bytes.
GRAMS = (1, 2, 3, 4)
#: Labelled rows per language that a model is fitted on; the bound of what reaches the driver.
SAMPLE = 500
UNKNOWN = "und"

#: Families by language code; a code that is not listed belongs to "other".
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["pl", "cs", "sk", "ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
}


def family(lang: str) -> str:
    """The family of a language code."""
    return next((name for name, codes in FAMILIES.items() if lang in codes), "other")


def _byte_classes() -> np.ndarray:
    """Bytes with A-Z lower-cased and everything in ASCII that is no letter as a space."""
    table = np.arange(256, dtype=np.uint64)
    for code in range(128):
        if not chr(code).isalpha():
            table[code] = 32
    table[65:91] += np.uint64(32)
    return table


def features(column: pa.Array) -> Iterator[np.ndarray | None]:
    """For each text the square roots of its hashed n-gram counts, scaled to length one; None where no letter is.

    Whole texts are read; null texts give None.
    """
    table = _byte_classes()
    row = 0
    for first, last, data, offsets in views(column):
        codes = table[data]
        columns = []
        gram = np.zeros(len(codes), np.uint64)
        for k in range(1, max(GRAMS) + 1):
            gram = gram[: len(codes) - k + 1] * np.uint64(257) + codes[k - 1 :]
            if k in GRAMS:
                columns.append(((gram * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) >> np.uint64(52)).astype(np.int64))
        ascii_letter = ((codes >= 97) & (codes <= 122)).astype(np.int64)
        for i in range(last - first):
            a, b = int(offsets[i]), int(offsets[i + 1])
            row = first + i
            if not ascii_letter[a:b].any() and not any(c.isalpha() for c in column[row].as_py() or ""):
                yield None
                continue
            counts = np.zeros(WIDTH)
            for k, column_of in zip(GRAMS, columns, strict=True):
                if b - a >= k:
                    counts += np.bincount(column_of[a : b - k + 1], minlength=WIDTH)
            vector = np.sqrt(counts)
            yield (vector / np.linalg.norm(vector)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent; ``x`` ends in a column of ones."""
    rng = np.random.default_rng(10)
    w, alpha = np.zeros(x.shape[1], x.dtype), np.zeros(len(x))
    lean = 0.5 / cost
    diagonal = np.einsum("ij,ij->i", x, x) + lean
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * float(x[i] @ w) - 1.0 + lean * alpha[i]
            new = max(0.0, alpha[i] - slope / diagonal[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    """Families with one weight row each, and per family its languages and one weight row per pair of them."""

    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pair_weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and a confidence from 0 to 1: that of the least certain decision on the way."""
        margin, name = np.inf, self.families[0]
        if len(self.families) > 1:
            scores = self.family_weights[:, :-1] @ x + self.family_weights[:, -1]
            order = np.argsort(-scores, kind="stable")
            name, margin = self.families[order[0]], float(scores[order[0]] - scores[order[1]])
        langs = self.languages[name]
        if len(langs) == 1:
            return langs[0], 1.0 / (1.0 + float(np.exp(-2.0 * margin))) if np.isfinite(margin) else 1.0
        values = self.pair_weights[name][:, :-1] @ x + self.pair_weights[name][:, -1]
        votes, sums = np.zeros(len(langs)), np.zeros(len(langs))
        for (i, j), value in zip(combinations(range(len(langs)), 2), values, strict=True):
            votes[i if value >= 0 else j] += 1
            sums[i] += value
            sums[j] -= value
        best = int(np.lexsort((-sums, -votes))[0])
        own = [v if best == i else -v for (i, j), v in zip(combinations(range(len(langs)), 2), values, strict=True) if best in (i, j)]
        margin = min(margin, 2.0 * float(min(own)))
        return langs[best], 1.0 / (1.0 + float(np.exp(-margin)))


def learnable(id_col: str, lang_col: str) -> Column:
    """Rows a model may learn from: a known language, and crc32 of the id as text leaves no remainder of 2 by 4."""
    return F.col(lang_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` labelled rows per language, those with the smallest md5 of the id.

    Only the sample's ids are broadcast and only its features reach the driver; both are bounded by ``sample`` times
    the number of languages. None where there is no labelled text with a letter.
    """
    docs = docs.select(*dict.fromkeys([id_col, text_col, lang_col]))
    labelled = docs.filter(learnable(id_col, lang_col)).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    labelled = labelled.withColumn("_draw", F.md5(F.col("_id").cast("string")))
    chosen = top_k(labelled, ["_lang"], [F.asc("_draw"), F.asc("_id")], sample).select("_id").distinct()
    rows = docs.filter(learnable(id_col, lang_col)).join(F.broadcast(chosen), F.col(id_col) == F.col("_id"), "left_semi")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, x) for lang, x in zip(batch.column(0).to_pylist(), features(batch.column(1)), strict=True) if x is not None]
            yield pa.record_batch([pa.array([z[0] for z in found], pa.string()), pa.array([z[1].tobytes() for z in found], pa.binary())], ["lang", "x"])

    got = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(frugal(vectors), "lang string, x binary").toArrow()
    if not len(got):
        return None
    langs = np.array(got["lang"].to_pylist())
    column = got["x"].combine_chunks()
    del got
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    vectors_of = np.frombuffer(column.buffers()[2], np.float32, len(langs) * WIDTH, start).reshape(len(langs), WIDTH)
    order = np.lexsort((vectors_of[:, 0], vectors_of[:, 1], langs))
    langs, x = langs[order], np.ones((len(langs), WIDTH + 1), np.float32)
    np.take(vectors_of, order, axis=0, out=x[:, :WIDTH])
    del vectors_of, column
    kinds = np.array([family(z) for z in langs])
    families = sorted(set(kinds.tolist()))
    wide = np.stack([fit_svm(x, np.where(kinds == name, 1.0, -1.0)) for name in families]) if len(families) > 1 else np.zeros((1, WIDTH + 1))
    languages, pairs = {}, {}
    for name in families:
        own = sorted(set(langs[kinds == name].tolist()))
        languages[name] = own
        rows_of = []
        for a, b in combinations(own, 2):
            part = (langs == a) | (langs == b)
            rows_of.append(fit_svm(x[part], np.where(langs[part] == a, 1.0, -1.0)))
        pairs[name] = np.stack(rows_of) if rows_of else np.zeros((0, WIDTH + 1))
    del x
    give_back()
    return Model(families, wide, languages, pairs)


def identify(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
    names: tuple[str, str, str] = ("held_out", "lang_pred", "score"),
) -> DataFrame:
    """The input with ``held_out``, ``lang_pred`` and ``score`` (or other ``names``); columns so named are replaced.

    The text alone decides. A null text, one without a letter, and every text where there is no model gives ``und``
    with score 0. ``held_out`` says that crc32 of the id as text leaves 2 by 4 (false for a null id).
    """
    held_name, lang_name, score_name = names
    docs = docs.drop(*names)
    fields = docs.schema
    at = docs.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(UNKNOWN, 0.0) if x is None or model is None else model.predict(x) for x in features(batch.column(at))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([z[0] for z in found], pa.string()), pa.array([z[1] for z in found], pa.float64())],
                [*batch.schema.names, lang_name, score_name],
            )

    out = T.StructType([*fields.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    return docs.mapInArrow(frugal(label), out).withColumn(held_name, held)
