"""Packing of token sequences by bounded-space online best-fit.

Documents arrive in the order of the scan. A document is its token ids and an end token; one longer
than a sequence is cut so that all pieces but the first are full. A piece goes into the open
sequence in which the least room is left after it. Open sequences are found through a bitset: bit
``f`` is set while some open sequence has ``f`` tokens of room, so the best fit is the lowest set
bit from the piece's length on. Only a fixed number of sequences stay open; when a further one is
needed, the fullest closes.

Each partition packs its own rows as they come, with bounded memory and no shuffle; a retried task
packs again from its own rows alone. Sequence ids hold the partition's number.

Defined results: a null or empty text is its end token alone; repeated rows are packed each; an
empty table gives no sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from worktide.llm import batches

SEQUENCE_TOKENS = 2048
OPEN_SEQUENCES = 1024
END_ID = 0

PIECE_DDL = (
    "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, `offset` bigint"
)
# The split before merging of byte-level vocabularies of this kind (a fixed value).
PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
# White space as the pattern sees it (Unicode's White_Space). Its runs are matched by backtracking,
# which overflows the stack at about a million characters, so longer ones are cut out before.
LONG_RUN = 100_000
_LONG_WHITE = re.compile(
    rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}"
)


def _letters() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves,
    the others are counted from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """Byte-pair encoding with the vocabulary of a tokenizer file.

    The ids of merged tokens rise in the order of the merges, so they serve as ranks. Strings of the
    file's added tokens in a text are those tokens, whatever surrounds them.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        letters = _letters()
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in added
        }
        self._encoding = tiktoken.Encoding(
            "file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

        self._added = added
        # The longest token counts where several begin.
        longest = sorted(added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None

    def ids(self, text: str) -> np.ndarray:
        out: list[int] = []
        for i, part in enumerate(self._split.split(text) if self._split else [text]):
            if i % 2:
                out.append(self._added[part])
            elif part:
                out += self._ordinary(part)
        return np.array(out, np.uint32)

    def _ordinary(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for run in _LONG_WHITE.finditer(text) if len(text) >= LONG_RUN else ():
            # All of a run but its last character is one piece; the last belongs to what follows.
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self._encoding.encode_ordinary(text[at : run.start()])
            out += self._piece(text[run.start() : end])
            at = end
        return out + self._encoding.encode_ordinary(text[at:] if at else text)

    def _piece(self, text: str) -> list[int]:
        return self._encoding._core_bpe.encode_single_piece(text.encode())


class BestFit:
    """Open sequences in a bitset keyed by the room left."""

    def __init__(self, size: int, slots: int, first: int = 0):
        self.size, self.slots, self.next = size, slots, first
        self.bits = 0
        self.by_room: dict[int, list[int]] = {}
        self.open = 0

    def _push(self, room: int, sequence: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(sequence)
            self.bits |= 1 << room
            self.open += 1

    def _pop(self, room: int) -> int:
        stack = self.by_room[room]
        sequence = stack.pop()
        if not stack:
            self.bits ^= 1 << room
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of at most the sequence's size."""
        fits = self.bits >> length << length
        if fits:
            room = (fits & -fits).bit_length() - 1
            sequence = self._pop(room)
        else:
            if self.open == self.slots:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            room, sequence = self.size, self.next
            self.next += 1
        self._push(room - length, sequence)
        return sequence, self.size - room


def pieces(total: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece; all but the first are full."""
    first = total % size or size
    yield 0, first
    for start in range(first, total, size):
        yield start, size


def _packer(path: str, text: str, kept: list[str], size: int, slots: int, ids: bool) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(path)
        bins = BestFit(size, slots, TaskContext.get().partitionId() << 40)
        for batch in parts:
            done = 0
            for part in batches.slices(batch.column(text)):
                rows: list[tuple] = []
                source: list[int] = []
                tokens: list[np.ndarray] = []
                for i, value in enumerate(part.to_pylist()):
                    own = np.append(tokenizer.ids(value or ""), np.uint32(END_ID)).astype("<u4")
                    for k, (start, length) in enumerate(pieces(len(own), size)):
                        piece = own[start : start + length]
                        rows.append((k, start, length, zlib.crc32(piece.tobytes()), *bins.place(length)))
                        source.append(done + i)
                        if ids:
                            tokens.append(piece)
                done += len(part)
                columns = list(zip(*rows, strict=True))
                arrays = [batch.column(c).take(pa.array(source)) for c in kept]
                arrays.append(pa.array(columns[0], pa.int32()))
                arrays += [pa.array(c, pa.int64()) for c in columns[1:]]
                names = [*kept, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                if ids:
                    ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                    flat = pa.array(np.concatenate(tokens).view(np.int32))
                    arrays.append(pa.ListArray.from_arrays(ends, flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
         size: int = SEQUENCE_TOKENS, slots: int = OPEN_SEQUENCES, ids: bool = True) -> DataFrame:
    """One row per piece: ``key``, its place in the document and in a sequence and, with ``ids``,
    its token ids. ``tokenizer``: path of the vocabulary file, the same on all executors."""
    narrow = docs.select(key, text)
    schema = f"`{key}` {narrow.schema[key].dataType.simpleString()}, {PIECE_DDL}"
    if ids:
        schema += ", ids array<int>"
    return narrow.mapInArrow(_packer(tokenizer, text, [key], size, slots, ids), schema)
