"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over hashed character n-grams tells
the languages with a one from those with a zero; its weight for an n-gram is the log ratio of the
n-gram's frequency on either side, each language counting alike. Decoding takes the language with
the least weighted loss over all bits, so some wrong bits are outvoted; a bit counts as much as it
separates the languages it was learned from. A text whose two best languages are nearly as good is
flagged as ambiguous.

Frequencies are learned from a sample of whole texts, about ``SAMPLE_TEXTS`` per language, chosen by
a hash of the key; they are counted in the tasks and summed in Spark.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is ambiguous; so
is every text if nothing could be learned. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm import batches
from worktide.operators.staging import stage

UNKNOWN = "und"
# Expected number of texts per language to learn from; all, where there are fewer.
SAMPLE_TEXTS = 3000
BINS_LOG2 = 14
BINS = 1 << BINS_LOG2
SLOPE = 4.0
SHARPNESS = 2.0
AMBIGUOUS = 0.75

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
RESULT_DDL = "struct<lang:string,score:double,ambiguous:boolean>"


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all three-byte grams and the n + 1 ends of each text's own."""
    padded = [b" " + t.translate(_LETTERS) + b" " for t in texts]
    data = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
    # Grams that reach into the next text are left out.
    last = ends[1:-1, None] - np.array([2, 1])
    own = np.ones(len(code), bool)
    own[last.reshape(-1)] = False
    counts = np.maximum(lengths - 2, 0)
    return (code >> np.uint32(32 - BINS_LOG2))[own], np.concatenate([[0], np.cumsum(counts)])


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in parts:
        done = 0
        for part in batches.slices(batch.column("text"), 1 << 20):
            langs = batch.column("lang").slice(done, len(part)).to_pylist()
            done += len(part)
            texts = batches.raw(part)
            for lang in set(langs):
                found, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                total = totals.setdefault(lang, np.zeros(BINS, np.int64))
                total += np.bincount(found, minlength=BINS)
    for lang, total in totals.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])],
            ["lang", "bin", "n"],
        )


def codewords(count: int, seed: int = 42) -> np.ndarray:
    """A row of +1 and -1 per language; all ways to split few languages, random ones else."""
    if count == 1:
        return np.ones((1, 1))
    if count <= 7:
        splits = np.arange(1, 1 << (count - 1))
        bits = splits[None, :] >> np.arange(count)[:, None] & 1
        return np.where(bits == 1, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(count)))
    best, distance = None, -1
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (count, width))
        mixed = code[:, np.abs(code.sum(axis=0)) < count]
        apart = (mixed.shape[1] - mixed @ mixed.T) / 2
        np.fill_diagonal(apart, np.inf)
        if apart.min() > distance:
            best, distance = mixed, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    importance: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        bins, ends = grams(texts)
        counts = np.maximum(np.diff(ends), 1)
        sums = np.add.reduceat(
            np.concatenate([self.weights[bins], np.zeros((1, self.code.shape[1]), np.float32)]),
            ends[:-1], axis=0,
        )
        margins = sums / counts[:, None]
        loss = np.zeros((len(texts), len(self.languages)))
        for b, weight in enumerate(self.importance):
            loss += weight * np.logaddexp(0, -SLOPE * margins[:, b : b + 1] * self.code[None, :, b])
        chance = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        score = chance[np.arange(len(texts)), best]
        return [self.languages[i] for i in best], score, score < AMBIGUOUS


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          sample: int = SAMPLE_TEXTS) -> Model | None:
    """Model from labelled rows; null when there are none."""
    labelled = docs.where(
        F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    ).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"))
    # One row per language, written, so that its size decides how Spark joins it.
    share = stage(counts.select("lang", (F.lit(float(sample)) / F.col("n")).alias("share")))
    chance = F.pmod(F.xxhash64(F.col("key"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(share, "lang").where(chance < F.col("share"))
    counted = chosen.select("lang", "text").mapInArrow(_count, "lang string, bin int, n bigint")
    table = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    if not languages:
        return None
    place = {name: i for i, name in enumerate(languages)}
    total = np.zeros((len(languages), BINS))
    rows = np.array([place[x] for x in table.column("lang").to_pylist()])
    total[rows, table.column("bin").to_numpy()] = table.column("n").to_numpy()
    total += 0.5
    chance = total / total.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((BINS, code.shape[1]), np.float32)
    importance = np.ones(code.shape[1])
    for b in range(code.shape[1] if len(languages) > 1 else 0):
        ones = code[:, b] > 0
        weights[:, b] = np.log(chance[ones].mean(axis=0) / chance[~ones].mean(axis=0))
        # What a text of each language is expected to score on its own side.
        importance[b] = max(0.05, float((code[:, b] * (chance @ weights[:, b])).min()))
    return Model(languages, code, weights, importance / importance.mean())


def _predictor(shared) -> Callable:
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Model | None = shared.value
        for text in parts:
            out = []
            for part in batches.slices(text, 1 << 20):
                if model is None:
                    langs, scores, unsure = [None] * len(part), np.zeros(len(part)), np.ones(len(part), bool)
                else:
                    langs, scores, unsure = model.predict(batches.raw(part))
                arrays = [pa.array(langs, pa.string()), pa.array(scores), pa.array(unsure)]
                out.append(pa.StructArray.from_arrays(arrays, fields=list(RESULT)))
            yield batches.joined(out, RESULT)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the struct ``out``: lang, score, ambiguous. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found: Column = F.arrow_udf(_predictor(shared), RESULT_DDL)(F.col(text))
    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    rows = docs.withColumn(out, found)
    usable = known & F.col(f"`{out}`.lang").isNotNull()
    return rows.withColumn(out, F.when(usable, F.col(f"`{out}`")).otherwise(unknown))
