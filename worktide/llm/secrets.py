"""Secret scans: fixed patterns, and windows of high entropy in candidate strings.

Everything is a Spark function. The places of matches follow from the lengths of the pieces between
them. A candidate is a run of characters that tokens are made of. A window slides over it; when a
character enters or leaves, only the terms of that character's count change in the sum of
``c * log2(c)`` that gives the window's Shannon entropy. Terms are whole numbers of millionths of a
bit, so results do not depend on rounding. Each class of characters has its own limit. The
windows over the limit make one span from the first to the last of them. Candidates on the allow
list, and spans inside a match of a fixed pattern, add nothing.

Defined results: a null or empty text has no spans; repeated rows get equal results; positions count
code points.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")

# Fixed patterns of the base kinds. Short runs fail a least length of the whole run, so the length
# is part of the pattern where the run is taken whole.
ASSIGN = (
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_VALUE = 6

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
SCALE = 1_000_000


@dataclass(frozen=True)
class CharacterClass:
    """Candidates that match ``pattern`` wholly, and the entropy from which a window counts."""

    name: str
    pattern: str
    bits: float

    @property
    def limit(self) -> int:
        """The greatest sum of terms of a window that counts."""
        return math.floor(WINDOW * (math.log2(WINDOW) - self.bits) * SCALE)


# The first class that fits a candidate decides. Runs without a digit or without a letter are words
# and numbers.
CLASSES = (
    CharacterClass("number", "^[0-9+/_=-]+$", math.inf),
    CharacterClass("word", "^[A-Za-z+/_=-]+$", math.inf),
    CharacterClass("hex", "^[0-9a-fA-F]+$", 3.0),
    CharacterClass("token", "^.*$", 3.6),
)
# Placeholders (fixed values), in small letters.
ALLOWED = (
    "example", "placeholder", "changeme", "your[_-]?", "x{6,}", "0123456789", "abcdefghij", "^[0-9a-f]{8}-",
)
# For whole scans: placeholders are blanked where they stand, and the rest of the run is judged. Runs
# of x need no blanking, their entropy is zero.
BLANKED = (
    *(("(?i)" + p, len(p)) for p in (
        "example", "placeholder", "changeme", "your_", "your-", "your", "0123456789", "abcdefghij",
    )),
    ("(?i)(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])", 36),
)
# For whole scans: the entropy from which a window of a run of letters counts.
LETTER_BITS = 3.9


def term(count: int) -> int:
    return round(count * math.log2(count) * SCALE) if count > 1 else 0


TERMS = [term(c) for c in range(WINDOW + 1)]

# Elements that are appended one by one; longer arrays are made of such blocks.
BLOCK = 64
# Characters by which long runs and texts are cut.
PIECE = 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def running(
    items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str
) -> Column:
    """Array of what ``step(carry, item)``, which gives the next carry, an int, and a value of the SQL
    type ``out``, says of each item.

    A fold copies its state at each step, so only the carries between blocks of items are gathered
    first; each block then gathers its own values from its carry.
    """

    def nothing(of: str) -> Column:
        return F.expr(f"cast(array() as array<{of}>)").alias("out")

    def one(state: Column, item: Column) -> Column:
        carry, value = step(state["carry"], item)
        return F.struct(carry.alias("carry"), F.concat(state["out"], F.array(value)).alias("out"))

    def past(state: Column, part: Column) -> Column:
        return F.struct(
            F.aggregate(part, state["carry"], lambda carry, item: step(carry, item)[0]).alias("carry"),
            F.concat(state["out"], F.array(state["carry"])).alias("out"),
        )

    def from_carries(parts: Column) -> Column:
        carries = F.aggregate(
            parts, F.struct(zero.alias("carry"), nothing("int")), past, lambda state: state["out"]
        )
        return let(carries, lambda at: F.flatten(F.transform(parts, lambda part, i: F.aggregate(
            part, F.struct(F.get(at, i).alias("carry"), nothing(out)), one, lambda state: state["out"],
        ))))

    def blocks(array: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(array) / BLOCK).cast("int")),
            lambda i: F.slice(array, i * BLOCK + 1, BLOCK),
        )
        return let(parts, from_carries)

    return let(items, blocks)


SPAN = "struct<start:int,kind:int,end:int>"
FOUND = "struct<start:int,kind:int,end:int,text:string>"


def places(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, kind, end, text) of the leftmost matches that do not overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(
        found, between, lambda m, gap: F.struct(m.alias("text"), F.length(gap).alias("gap"))
    )
    rank = F.lit(KINDS.index(kind))

    def step(at: Column, m: Column) -> tuple[Column, Column]:
        start = at + m["gap"]
        end = start + F.length(m["text"])
        return end, F.struct(start.alias("start"), rank.alias("kind"), end.alias("end"), m["text"].alias("text"))

    # The piece after the last match has no match of its own.
    matches = F.filter(pairs, lambda m: m["text"].isNotNull())
    nothing = F.expr(f"cast(array() as array<{FOUND}>)")
    return F.when(text.rlike(pattern), running(matches, F.lit(0), step, FOUND)).otherwise(nothing)


# Cells of the counts of a window, one character each: the first is that of "+", the last that of "z".
FIRST_CELL, CELLS = ord("+"), ord("z") - ord("+") + 1
NO_COUNT = ord("A")


def _window_ends(text: str, limit: str) -> str:
    """SQL of (first, last), the ends of the first and the last window of a run whose sum of terms is
    within the limit; zero if none is.

    A long run is cut into pieces that share all but one character of a window, so each window lies
    in one piece. The counts of the window's characters are cells of a string; of the character that
    enters and the one that leaves, the cells and the terms of the sum are changed. A window is judged
    when the next character comes, so that its sum is computed once.
    """
    up = "array(" + ",".join(f"{TERMS[c + 1] - TERMS[c]}L" for c in range(WINDOW)) + ")"
    down = "array(0L," + ",".join(f"{TERMS[c - 1] - TERMS[c]}L" for c in range(1, WINDOW + 1)) + ")"
    pieces = f"regexp_extract_all({text}, '(?=(.{{{WINDOW},{PIECE + WINDOW - 1}}})).{{1,{PIECE}}}', 1)"
    gone = f"get(chars, a.i - {WINDOW})"

    def cell(char: str) -> str:
        return f"(ascii({char}) - {FIRST_CELL - 1})"

    def count(char: str) -> str:
        return f"(ascii(substring(a.cells, {cell(char)}, 1)) - {NO_COUNT})"

    def changed(cells: str, char: str, by: int) -> str:
        return f"overlay({cells} placing chr({count(char)} + {NO_COUNT + by}) from {cell(char)} for 1)"

    leaves = f"a.i >= {WINDOW}"
    total = f"a.sum + {up}[{count('x')}] + if({leaves}, {down}[{count(gone)}], 0L)"
    entered = changed("a.cells", "x", 1)
    cells = f"if({leaves}, {changed(entered, gone, -1)}, {entered})"
    counts = f"a.i >= {WINDOW} and a.sum <= {limit}"
    first, last = f"if(a.first = 0 and {counts}, a.i, a.first)", f"if({counts}, a.i, a.last)"
    folded = (
        "aggregate(chars, named_struct('sum', 0L, 'i', 0, 'cells', "
        f"repeat('{chr(NO_COUNT)}', {CELLS}), 'first', 0, 'last', 0), "
        f"(a, x) -> named_struct('sum', if(x <=> {gone}, a.sum, {total}), 'i', a.i + 1, "
        f"'cells', if(x <=> {gone}, a.cells, {cells}), 'first', {first}, 'last', {last}), "
        f"a -> named_struct('first', {first}, 'last', {last}))"
    )
    ends = f"transform({pieces}, p -> transform(array(split(p, '')), chars -> {folded})[0])"
    return (
        f"aggregate({ends}, named_struct('at', 0, 'first', 0, 'last', 0), (a, e) -> named_struct("
        f"'at', a.at + {PIECE}, 'first', if(a.first = 0 and e.first > 0, a.at + e.first, a.first), "
        "'last', if(e.last > 0, a.at + e.last, a.last)))"
    )


def _blanked(s: str) -> str:
    for pattern, size in BLANKED:
        s = f"regexp_replace({s}, '{pattern}', '{'_' * size}')"
    return s


def entropy_spans(candidates: str, whole: bool = False) -> Column:
    """Spans of the candidates' windows over the limit of their class. With ``whole``, a
    placeholder takes only itself out of its candidate, and runs of letters are judged too."""
    allowed = "|".join(ALLOWED)
    kinds = [
        CharacterClass(k.name, k.pattern, LETTER_BITS) if whole and k.name == "word" else k for k in CLASSES
    ]
    limit = "case " + " ".join(
        f"when rlike(c.text, '{k.pattern}') then {-1 if math.isinf(k.bits) else k.limit}L" for k in kinds
    ) + " end"
    folded = (
        f"transform(array({_window_ends('c.text', 'c.limit')}), e -> named_struct("
        f"'start', c.start + e.first - {WINDOW}, 'kind', {KINDS.index('entropy')}, "
        "'end', if(e.first = 0, -1, c.start + e.last)))[0]"
    )
    limited = (
        f"transform({candidates}, c -> named_struct('start', c.start, 'text', c.text, 'limit', {limit}))"
    )
    chosen = f"filter({limited}, c -> c.limit >= 0 and not rlike(lower(c.text), '{allowed}'))"
    if whole:
        judged = f"filter({limited}, c -> c.limit >= 0)"
        chosen = (
            f"transform({judged}, c -> named_struct("
            f"'start', c.start, 'text', {_blanked('c.text')}, 'limit', c.limit))"
        )
    return F.expr(f"filter(transform({chosen}, c -> {folded}), s -> s.end >= 0)")


def scan(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans",
         whole: bool = False) -> DataFrame:
    """``docs`` with two arrays of (start, kind, end), kind as place in ``KINDS``, sorted: the
    matches of the fixed patterns, and all spans. Columns of these names are replaced."""
    kept = [F.col(c) for c in docs.columns if c not in (base, spans) or c == text]
    value = F.coalesce(F.col(text), F.lit(""))
    assigned = F.filter(
        places(value, ASSIGN, "assign"),
        lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= ASSIGN_VALUE,
    )
    fixed = F.concat(assigned, places(value, ACCESS, "access"), places(value, HEX, "hex"))
    bare = F.transform(fixed, lambda m: F.struct(m["start"], m["kind"], m["end"]))
    # A generator keeps the costly columns from being computed again by what reads them.
    rows = docs.select(
        *kept,
        F.inline(F.array(F.struct(
            F.array_sort(bare).alias("__base"), places(value, CANDIDATE, "entropy").alias("__candidates"),
        ))),
    )
    rows = rows.withColumn("__entropy", entropy_spans("__candidates", whole))
    entropy = KINDS.index("entropy")

    def covered(reach: Column, s: Column) -> tuple[Column, Column]:
        # By start and kind, all fixed spans that may cover a span come before it.
        fixed = s["kind"] != entropy
        return (
            F.when(fixed, F.greatest(reach, s["end"])).otherwise(reach),
            F.struct(s["start"], s["kind"], s["end"], (fixed | (reach < s["end"])).alias("stays")),
        )

    all_spans = F.array_sort(F.concat("__base", "__entropy"))
    judged = running(all_spans, F.lit(-1), covered, SPAN[:-1] + ",stays:boolean>")
    standing = F.transform(
        F.filter(judged, lambda s: s["stays"]), lambda s: F.struct(s["start"], s["kind"], s["end"])
    )
    return rows.select(
        *[F.col(c) for c in docs.columns if c not in (base, spans) or c == text],
        *([] if base == text else [F.col("__base").alias(base)]),
        F.when(F.size("__entropy") > 0, standing).otherwise(F.col("__base")).alias(spans),
    )


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(
            F.col(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
    )


def count(spans: str, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == k)).cast("bigint")


MASK = "[SECRET]"


def redact(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; overlapping spans are replaced once."""
    columns = docs.columns
    rows = scan(docs, text, "__fixed", "__spans", whole=True)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.struct(at.alias("start"), s["start"].alias("end"))
        return F.greatest(at, s["end"]), gap

    def masked_text(pieces: Column) -> Column:
        def between(gap: Column) -> Column:
            # The end lies in the piece of the gap's last character, so that no gap needs a piece more.
            first, last = (F.floor(p / PIECE).cast("int") for p in (gap["start"], gap["end"] - 1))
            head = F.substring(F.get(pieces, first), gap["start"] % PIECE + 1, F.lit(PIECE))
            inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            tail = F.substring(F.get(pieces, last), F.lit(1), gap["end"] - last * PIECE)
            within = F.substring(
                F.get(pieces, first), gap["start"] % PIECE + 1, gap["end"] - gap["start"]
            )
            return (
                F.when(gap["end"] == gap["start"], "")
                .when(first == last, within).otherwise(F.concat(head, inner, tail))
            )

        gaps = F.filter(
            running(F.col("__spans"), F.lit(0), step, "struct<start:int,end:int>"),
            lambda gap: gap["start"] <= gap["end"],
        )
        rest = F.struct(
            F.array_max(F.transform("__spans", lambda s: s["end"])).alias("start"),
            F.length(F.col(text)).alias("end"),
        )
        return F.array_join(F.transform(F.concat(gaps, F.array(rest)), between), mask)

    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    masked = let(pieces, masked_text)
    changed = F.when(F.size("__spans") > 0, masked).otherwise(F.col(text))
    return rows.withColumn(text, changed).select(*columns)
