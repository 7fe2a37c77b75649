"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams (n = 1..4, blended) that
occur in both, over the geometric mean of the numbers that occur in each.
N-grams are hashed to a fixed number of slots, so a text is a vector of
presence bits. Landmark texts give the Nystrom approximation; one ridge
regression per language (one against the rest) is solved on it. Texts are
scored in batches: presence bits times weights, where the product of landmark
bits and coefficients is made once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficloom.llm.words import buffers, release_unused, slices

SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
MAX_N = 4
# Bounds of the training sample, per language.
ROWS_PER_LANGUAGE = 500
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-2
# Languages are classes of the model; more than these is not a language column.
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
_TEXTS_PER_BATCH = 64
_FACTORS = [np.uint32(f) for f in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def presence(texts: pa.Array) -> np.ndarray:
    """One row of ``SLOTS`` bits per text. A-Z counts as a-z, all ASCII white space as
    one kind, and other ASCII that is no letter is left out of n-grams' content as '.'."""
    data, bounds = buffers(texts)
    bits = np.zeros((len(texts), SLOTS), bool)
    folded = _FOLD[data]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds))
    base = row * SLOTS
    flat = bits.reshape(-1)
    code = folded.astype(np.uint32)
    flat[base + ((code + np.uint32(1)) * _FACTORS[0] >> np.uint32(32 - SLOT_BITS))] = True
    for n in range(2, MAX_N + 1):
        if len(data) < n:
            break
        code = (code[:-1] << np.uint32(8)) | folded[n - 1 :]
        slot = (code * _FACTORS[n - 1] + np.uint32(n)) >> np.uint32(32 - SLOT_BITS)
        inside = row[: len(code)] == row[n - 1 :]
        flat[(base[: len(code)] + slot)[inside]] = True
    return bits


def _fold_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() else (32 if c.isspace() else 46)
    return table


_FOLD = _fold_table()


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float32), b.astype(np.float32)
    norms = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))[None, :]
    return (a @ b.T) / norms


def _unpacked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1).astype(bool)


def solve(packed: np.ndarray, labels: np.ndarray, languages: list[str], landmarks: np.ndarray) -> LanguageModel:
    """Ridge regression on the Nystrom features of the landmarks, one target per language.

    ``packed`` has the presence bits of a text in each row, eight to a byte;
    a block of rows is unpacked at a time.

    With K the kernel of rows and landmarks and M that of the landmarks, the
    coefficients solve (K'K + n * ridge * M) a = K'y.
    """
    marks = _unpacked(packed[landmarks])
    blocks = range(0, len(packed), _TEXTS_PER_BATCH)
    k = np.concatenate([kernel(_unpacked(packed[i : i + _TEXTS_PER_BATCH]), marks) for i in blocks]).astype(np.float64)
    m = k[landmarks]
    y = np.where(labels[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    left = k.T @ k + len(packed) * RIDGE * m + 1e-6 * np.eye(len(m))
    coefficients = np.linalg.solve(left, k.T @ y)
    scaled = coefficients / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    return LanguageModel(languages, marks.astype(np.float32).T @ scaled.astype(np.float32))


def train(docs: DataFrame, learn: Column, rows: int = ROWS_PER_LANGUAGE, marks: int = LANDMARKS_PER_LANGUAGE) -> LanguageModel:
    """Fits the model on at most ``rows`` documents per language for which ``learn`` is true.

    The sample is the documents of smallest hash of doc_id in each language;
    their bits (4 KB each, whatever the length) come to the driver. Rows with
    a null language or text are not learned from. Without any, the model has
    no language.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = labelled.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32))
    # Keeps about 1.5 times the rows wanted of each language, by hash, then cuts exactly.
    wanted = F.lit(0.0)
    for r in counts:
        wanted = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, (1.5 * rows + 50) / r["count"]))).otherwise(wanted)
    unit = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch["text"]):
                for at in range(first, last, _TEXTS_PER_BATCH):
                    part = batch.slice(at, min(_TEXTS_PER_BATCH, last - at))
                    packed = np.packbits(presence(part["text"]), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [part["lang"], part["unit"], pa.array([r.tobytes() for r in packed], pa.binary())],
                        ["lang", "unit", "bits"],
                    )

    sample = (
        labelled.select("lang", "text", unit.alias("unit"))
        .where(F.col("unit") < wanted)
        .mapInArrow(pack, "lang string, unit double, bits binary")
        .collect()
    )
    chosen: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["unit"], r["bits"])):
        chosen.setdefault(r["lang"], [])
        if len(chosen[r["lang"]]) < rows:
            chosen[r["lang"]].append(np.frombuffer(r["bits"], np.uint8))
    languages = sorted(chosen)
    labels = np.concatenate([np.full(len(chosen[x]), i) for i, x in enumerate(languages)])
    starts = np.concatenate(([0], np.cumsum([len(chosen[x]) for x in languages])[:-1]))
    landmarks = np.concatenate([s + np.arange(min(marks, len(chosen[x]))) for s, x in zip(starts, languages)])
    model = solve(np.concatenate([np.stack(chosen[x]) for x in languages]), labels, languages, landmarks)
    # The sample stays on the driver no longer than it is learned from.
    del sample, chosen
    release_unused()
    return model


def classify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) added.

    ``und`` with score 0 stands for a text that is null or has no letter, and
    for all texts when the model knows no language. Else the language of the
    largest regression value; its score is that value, scaled from -1..1 and
    clipped. Ties go to the first language by name. Only the text is looked
    at; repeated rows get the same prediction; other columns pass through, and
    must not bear the two names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Inside, columns go by number: names may clash or hold any sign.
    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    at = docs.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights = shared.value.languages, shared.value.weights
        for batch in batches:
            texts = batch.column(at)
            letters = pa.compute.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            names, scores = [], []
            for first, last in slices(texts):
                for start in range(first, last, _TEXTS_PER_BATCH):
                    stop = min(start + _TEXTS_PER_BATCH, last)
                    if not languages:
                        names += [UNKNOWN] * (stop - start)
                        scores += [0.0] * (stop - start)
                        continue
                    bits = presence(texts.slice(start, stop - start))
                    sizes = np.sqrt(np.maximum(bits.sum(1), 1))
                    values = (bits.astype(np.float32) @ weights) / sizes[:, None]
                    best = values.argmax(1)
                    top = np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)
                    for ok, b, v in zip(letters[start:stop], best, top):
                        names.append(languages[b] if ok else UNKNOWN)
                        scores.append(float(v) if ok else 0.0)
            arrays = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])

    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return renamed.mapInArrow(predict, inner).toDF(*[f.name for f in fields])
