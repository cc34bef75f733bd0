"""Quality rules as a ledger of bits.

Every rule is evaluated once per text. The ledger keeps the measurements and one number whose bit
``i`` is set where rule ``i`` failed. A policy is a version and a mask of rules that reject; another
policy, or the effect of leaving a rule out, follows from the bits alone, without the texts.

Defined results: a null or empty text has no words, so it fails ``few_words``; repeated rows get
equal results; an empty table gives an empty ledger.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm import batches

WINDOW_WORDS = 8
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_lower", "n_exclaim", "n_plain_words", "n_stutter",
)
MEASURES_DDL = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"
_KIND = pa.struct([(m, pa.int64()) for m in MEASURES])
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
# A word counts as plain if a letter, a digit or anything beyond ASCII is in it.
_PLAIN = bytes(
    b if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b in _SPACE else 0
    for b in range(256)
)
_DROP = bytes(b for b in range(256) if _PLAIN[b] == 0)


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    pairs = first.astype(np.int64) * (int(second.max()) + 1) + second
    return np.unique(pairs, return_inverse=True)[1]


def repeated_words(words: list[bytes], size: int = WINDOW_WORDS) -> int:
    """Words that lie in a window of ``size`` words (a power of two) found twice or more.

    Ranks of windows of 2, 4, 8 ... words come from the ranks of their halves, so equal ranks mean
    equal words, without hashing.
    """
    if len(words) <= size:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    width = 1
    while width < size:
        rank = _ranks(rank[: len(rank) - width], rank[width:])
        width *= 2
        if int(rank.max()) + 1 == len(rank):
            return 0
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure_text(text: bytes) -> tuple[int, ...]:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = dup = 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    points = len(text) - int(counts[128:192].sum())
    return (
        len(words),
        points - int(counts[_SPACE].sum()),
        int(counts[_SYMBOLS].sum()),
        lines,
        dup,
        repeated_words(words),
        int(counts[65:91].sum()),
        int(counts[97:123].sum()),
        int(counts[33]),
        len(text.translate(_PLAIN, _DROP).split()),
        sum(map(operator.eq, words, itertools.islice(words, 1, None))),
    )


def _measure(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for text in parts:
        out = []
        for part in batches.slices(text):
            rows = np.array([measure_text(x) for x in batches.raw(part)], np.int64)
            columns = [pa.array(rows[:, i]) for i in range(len(MEASURES))]
            out.append(pa.StructArray.from_arrays(columns, fields=list(_KIND)))
        yield batches.joined(out, _KIND)


_measure.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}


def measures(text: str | Column) -> Column:
    """Struct of all measurements of a text."""
    return F.arrow_udf(_measure, MEASURES_DDL)(text)


# Each rule is true where the text fails; m gives a measurement. The order fixes the bits.
RULES: Mapping[str, str] = {
    "few_words": "{m}.n_words < 20",
    "repeated_passages": "100 * {m}.n_repeat_words > 30 * {m}.n_words",
    "word_length": "{m}.word_chars < 2 * {m}.n_words or {m}.word_chars > 12 * {m}.n_words",
    "symbols": "10 * {m}.n_symbols > {m}.n_words",
    "duplicate_lines": "2 * {m}.n_dup_lines > {m}.n_lines",
    "shouting": "2 * {m}.n_exclaim > {m}.n_words",
    "capitals": "{m}.n_upper + {m}.n_lower >= 40 and {m}.n_upper > {m}.n_lower",
    "plain_words": "10 * {m}.n_plain_words < 6 * {m}.n_words",
    "stutter": "100 * {m}.n_stutter > 30 * {m}.n_words",
}


@dataclass(frozen=True)
class Policy:
    """Rules that reject a text, by name."""

    version: str
    rejects: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(r) for r in set(self.rejects))


BASE = Policy("base", ("few_words", "repeated_passages"))
POLICIES = {
    p.version: p
    for p in (
        BASE,
        Policy("1", (*BASE.rejects, "symbols", "word_length", "plain_words")),
        Policy("2", tuple(RULES)),
    )
}
CURRENT = POLICIES["2"]


def failures(measured: str, rules: Mapping[str, str] = RULES) -> Column:
    """Bits of the failed rules."""
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules.values()):
        failed = F.coalesce(F.expr(rule.format(m=f"`{measured}`")), F.lit(False))
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(0).cast("bigint"))
    return bits


def ledger(docs: DataFrame, text: str = "text", measured: str = "measures",
           failed: str = "failed") -> DataFrame:
    """``docs`` with the struct ``measured`` and the bits ``failed``; columns of these names are
    replaced."""
    rows = docs.withColumn(measured, measures(F.col(text)))
    return rows.withColumn(failed, failures(measured))


def passes(failed: Column, policy: Policy = CURRENT) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy = CURRENT, failed: str = "failed") -> DataFrame:
    """Per rule of the policy: texts that fail it, and texts that only it rejects.

    Rows are first counted per distinct bits, of which there are at most 2 to the number of rules.
    """
    names = list(RULES)
    counted = rows.groupBy(
        F.col(failed).bitwiseAND(F.lit(policy.mask)).alias("bits")
    ).agg(F.count("*").alias("n"))
    rules = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit"))
            for r in policy.rejects
        ]
    )
    each = counted.select("bits", "n", F.inline(rules))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum("n").alias("texts"),
    )


def keep(docs: DataFrame, text: str = "text", policy: Policy = CURRENT) -> DataFrame:
    """Rows that the policy keeps, with their columns."""
    rows = ledger(docs, text, "__measures", "__failed")
    return rows.where(passes(F.col("__failed"), policy)).drop("__measures", "__failed")
