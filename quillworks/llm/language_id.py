"""Language identification with blended-spectrum string kernels.

Two texts are as similar as the n-grams that both hold: the kernel is the number of shared
n-grams (one to three UTF-8 bytes of the text with A-Z in lower case, each counted once)
over the root of the product of both numbers. The n-grams are those that at least
``min_texts`` landmark texts hold, and those of a language with fewer landmark texts than that; the
``vocabulary`` most frequent of them.

Nystroem: ``landmarks`` texts stand for all others. With L the landmarks, a text x has the features
K(x, L) K(L, L)^-1/2, and a kernel ridge regression per language (target 1 for its texts, 0
for others) is fitted in that space. Both fold into one matrix, so a text is scored
by two products: presence bits x landmark bits gives K(x, L), times the matrix the scores. Texts are
scored in batches of ``ROWS`` at a time, so memory is bounded by the batch.

The fit uses a bounded sample: the ``per_language`` distinct labelled texts of each language that come
first by their hash (``landmarks`` of them in turn over the languages); copies of a text count once,
however many there are, and every language weighs the same in the fit. All other steps cover
every row and every whole text. Only text is an input of a prediction.

Defined cases: a null text and a text without a letter are ``und`` with score 0; so is every text
if there are no labelled rows; rows with a null lang or doc_id teach nothing; repeated
rows are scored each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillworks.llm.common import staged

UNKNOWN = "und"
ROWS = 256
#: N-grams of 1, 2 and 3 bytes have codes in three ranges that follow each other.
BASES = (0, 256, 256 + 65536)
CODES = 256 + 65536 + 256**3
CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = regex.compile(r"\p{L}")


def codes_of(text: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all n-grams of a text (bytes), a bounded piece at a time."""
    for start in range(0, len(text), CHUNK):
        b = _LOWER[text[start : start + CHUNK + 2]].astype(np.int32)
        n = min(CHUNK, len(text) - start)
        yield b[:n]
        if len(b) > 1:
            two = (b[:-1] << 8) | b[1:]
            yield two[:n] + BASES[1]
        if len(b) > 2:
            yield ((two[:-1] << 8) | b[2:])[:n] + BASES[2]


@dataclass
class Model:
    """What scoring needs: n-gram codes, landmark bits, their norms, folded weights, languages."""

    codes: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    languages: list[str]


def _texts(column: pa.Array) -> Iterator[np.ndarray | None]:
    for value in column.cast(pa.binary()):
        buffer = value.as_buffer()
        yield None if buffer is None else np.frombuffer(buffer, dtype=np.uint8)


def _table(codes: np.ndarray) -> np.ndarray:
    """Column of each code; codes outside the vocabulary share the last column."""
    table = np.full(CODES, len(codes), dtype=np.int16)
    table[codes] = np.arange(len(codes), dtype=np.int16)
    return table


def presence(texts: list[np.ndarray | None], table: np.ndarray, size: int) -> np.ndarray:
    """Bits (rows x vocabulary) of the n-grams that each text holds."""
    bits = np.zeros((len(texts), size + 1), dtype=np.float32)
    for row, text in zip(bits, texts, strict=True):
        if text is not None:
            for codes in codes_of(text):
                row[table[codes]] = 1
    return bits[:, :size]


def kernel(bits: np.ndarray, landmarks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    shared = (bits @ landmarks.T).astype(np.float64)
    own = np.sqrt(np.maximum(bits.sum(1, dtype=np.float64), 1))
    return shared / own[:, None] / norms[None, :]


def _sample(docs: DataFrame, teaches: Column, per_language: int) -> DataFrame:
    """n (place among the texts of its language), lang and text of the rows to learn from."""
    place = Window.partitionBy("lang").orderBy("h")
    candidates = docs.filter(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Only identifiers and hashes are ordered, one row for all copies of a text; texts are fetched for
    # the chosen rows.
    chosen = (
        candidates.select("lang", "doc_id", F.xxhash64("text").alias("h"))
        .groupBy("lang", "h")
        .agg(F.min("doc_id").alias("doc_id"))
        .withColumn("n", F.row_number().over(place))
        .filter(F.col("n") <= per_language)
    )
    chosen = staged(chosen, "langid-chosen")
    texts = candidates.select("lang", "doc_id", "text", F.xxhash64("text").alias("h"))
    return staged(
        texts.join(F.broadcast(chosen), ["lang", "doc_id", "h"])  # per_language rows per language
        .groupBy("lang", "n")
        .agg(F.first("text").alias("text")),
        "langid-sample",
    )


def _vocabulary(sample: DataFrame, landmarks: int, size: int, min_texts: int) -> np.ndarray:
    marks = sample.filter(F.col("n") <= landmarks)
    # A row per language.
    few = {r["lang"] for r in marks.groupBy("lang").count().collect() if r["count"] < min_texts}

    def distinct_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch.column("text")), strict=True):
                seen = np.unique(np.concatenate([np.unique(c) for c in codes_of(text)] or [[]]))
                columns = [pa.array(seen.astype(np.int32)), pa.array(np.full(len(seen), lang in few))]
                yield pa.RecordBatch.from_arrays(columns, names=["code", "few"])

    found = marks.select("lang", "text").mapInArrow(distinct_codes, "code int, few boolean")
    counts = found.groupBy("code").agg(F.count("*").alias("count"), F.bool_or("few").alias("few"))
    enough = counts.filter(F.col("few") | (F.col("count") >= min_texts))
    rows = enough.orderBy(F.desc("count"), "code").limit(size).collect()
    return np.array(sorted(r["code"] for r in rows), dtype=np.int64)


def fit(
    docs: DataFrame,
    teaches: Column,
    per_language: int = 400,
    landmarks: int = 128,
    vocabulary: int = 6000,
    min_texts: int = 2,
    ridge: float = 1e-2,
) -> Model | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) for which ``teaches`` holds."""
    sample = _sample(docs, teaches, per_language)
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    per_landmark = max(1, landmarks // len(languages))
    codes = _vocabulary(sample, per_landmark, vocabulary, min_texts)
    size = len(codes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(codes)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                bits = presence(list(_texts(part.column("text"))), table, size)
                rows = [r.tobytes() for r in np.packbits(bits.astype(bool), axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("n"), pa.array(rows, pa.binary())],
                    names=["lang", "n", "bits"],
                )

    # per_language rows of vocabulary / 8 bytes for each language.
    rows = sorted(sample.select("lang", "n", "text").mapInArrow(packed, "lang string, n int, bits binary").collect())
    bits = np.unpackbits(np.array([list(r["bits"]) for r in rows], dtype=np.uint8).reshape(len(rows), -1), axis=1)
    bits = bits[:, :size].astype(np.float32)
    marks = bits[[r["n"] <= per_landmark for r in rows]]
    norms = np.sqrt(np.maximum(marks.sum(1, dtype=np.float64), 1))
    values, vectors = np.linalg.eigh(kernel(marks, marks, norms))
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel(bits, marks, norms) @ root
    target = np.array([[float(r["lang"] == lang) for lang in languages] for r in rows])
    # Every language weighs the same, however few distinct texts it has.
    weight = (target / target.sum(0)).sum(1) / len(languages)
    middle, mean = weight @ features, weight @ target
    centred = features - middle
    weighted = centred.T * weight
    gram = weighted @ centred + ridge * np.eye(features.shape[1]) / max(features.shape[1], 1)
    beta = np.linalg.solve(gram, weighted @ (target - mean))
    return Model(codes, marks, norms, root @ beta, mean - middle @ beta, languages)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of ``docs`` as ``row`` with lang_pred and score (0 to 1)."""
    rows = docs.select(F.struct("*").alias("row"))
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    languages = np.array(model.languages, dtype=object)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model.codes)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                column = part.column("row").field("text")
                column = column if not part.column("row").null_count else part.column("row").flatten()[0]
                bits = presence(list(_texts(column)), table, len(model.codes))
                scores = kernel(bits, model.landmarks, model.norms) @ model.weights + model.offset
                best = scores.argmax(1)
                sure = np.clip(scores[np.arange(len(best)), best], 0, 1)
                known = np.array(
                    [t is not None and _LETTER.search(t) is not None for t in column.to_pylist()], dtype=bool
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array(np.where(known, languages[best], UNKNOWN), pa.string()),
                        pa.array(np.where(known, sure, 0.0)),
                    ],
                    names=["row", "lang_pred", "score"],
                )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, **parameters) -> DataFrame:
    """Fit on the rows that are not held out and predict every row: ``row``, lang_pred and score."""
    known = docs.select("doc_id", "text", "lang")
    teaches = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    return predict(docs, fit(known, teaches, **parameters))


def clean(docs: DataFrame, **parameters) -> DataFrame:
    """Rows of ``docs`` whose language can be told, all columns; a null lang becomes the prediction.

    Learns from all labelled rows. Rejected are texts without a letter and null texts only.
    """
    known = docs.select("doc_id", "text", "lang")
    found = predict(docs, fit(known, F.lit(True), **parameters)).filter(F.col("lang_pred") != UNKNOWN)
    lang = F.coalesce("row.lang", "lang_pred").alias("lang")
    return found.select(*[lang if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])
