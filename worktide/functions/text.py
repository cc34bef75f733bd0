"""Text expressions: folding, cleaning, slugs, snippets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a browser sees it; the same class is valid in Java and RE2.
WS = (
    r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# The same characters one by one, for replacing and trimming without a pattern.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# ASCII word boundary. Java's \b counts accented letters as word characters.
NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"
YEAR = NOT_AFTER_WORD + r"(?:19|20)[0-9]{2}" + NOT_BEFORE_WORD


def words(pattern: str) -> str:
    """``pattern`` between ASCII word boundaries."""
    return NOT_AFTER_WORD + "(?:" + pattern + ")" + NOT_BEFORE_WORD


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Letters with their plain lower-case form, punctuation as blank, marks to delete."""
    source, target = [], []
    for code in range(0x10000):
        if 0xD800 <= code <= 0xDFFF or 0x300 <= code <= 0x36F:
            continue
        bare = "".join(
            c for c in unicodedata.normalize("NFD", chr(code)) if not "\u0300" <= c <= "\u036f"
        )
        if len(bare) == 1 and bare.isascii():
            plain = bare.lower() if bare.isalnum() else " "
            if plain != chr(code):
                source.append(chr(code))
                target.append(plain)
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    """Lower-case words without diacritics, separated by single blanks; null becomes empty."""
    folded = F.translate(text_or_empty(c), *_fold_table())
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def py_normalize(value: str | None) -> str:
    """Driver-side twin of :func:`normalize` for lexicon terms."""
    bare = "".join(
        c for c in unicodedata.normalize("NFD", value or "") if not "̀" <= c <= "ͯ"
    ).lower()
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split())


def identifier(c: Column, max_length: int = 120, default: str = "convenio") -> Column:
    """Lower-case id with ``_`` as separator; a longer one ends in a digest of the whole value."""
    joined = F.replace(normalize(c), F.lit(" "), F.lit("_"))
    short = F.concat_ws("_", F.substring(joined, 1, max_length), F.md5(joined))
    whole = F.when(F.length(joined) > max_length, short).otherwise(joined)
    return F.coalesce(F.nullif(whole, F.lit("")), F.lit(default))


def slug(c: Column) -> Column:
    return F.replace(normalize(c), F.lit(" "), F.lit("-"))


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def _one_blank(c: Column, chars: str) -> Column:
    """Runs of the given characters and blanks as one blank."""
    return F.regexp_replace(F.translate(c, chars, " " * len(chars)), " {2,}", " ")


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(F.trim(_one_blank(text_or_empty(c), WS_CHARS))))


def clean_extracted(c: Column) -> Column:
    """Corpus cleaning before chunking: CRLF becomes one line break."""
    return _squeeze(F.replace(text_or_empty(c), F.lit("\r\n"), F.lit("\n")))


def clean_published(c: Column) -> Column:
    """Corpus cleaning before extraction: every CR becomes a line break."""
    return _squeeze(F.replace(text_or_empty(c), F.lit("\r"), F.lit("\n")))


def _squeeze(c: Column) -> Column:
    return trim_ws(F.regexp_replace(_one_blank(c, "\t"), "\\n{3,}", "\n\n"))


def compact(c: Column) -> Column:
    """One line, no blank before ``. , ; :``."""
    one_line = _one_blank(text_or_empty(c), WS_CHARS)
    return F.trim(F.regexp_replace(one_line, " ([.,;:])", "$1"))


def without_years(c: Column) -> Column:
    gone = F.regexp_replace(text_or_empty(c), YEAR, "")
    return trim_ws(F.regexp_replace(gone, f"{WS}{{2,}}", " "))


def escape_markup(c: Column) -> Column:
    out = text_or_empty(c)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def escape_json_text(c: Column) -> Column:
    return F.replace(c, F.lit("<"), F.lit("\\u003c"))


def interpolate(pattern: str | Column, values: Mapping[str, Column]) -> Column:
    """Fill ``{key}`` places; unknown keys become empty.

    The template is cut at its places, so a value holding braces stays as it is.
    """
    if isinstance(pattern, str):
        import re

        parts = re.split(r"\{([a-zA-Z0-9_]+)\}", pattern)
        columns = [
            F.lit(p) if i % 2 == 0 else text_or_empty(values[p]) if p in values else F.lit("")
            for i, p in enumerate(parts)
        ]
        return F.concat(*columns)
    out = pattern
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), text_or_empty(value))
    return F.regexp_replace(out, r"\{\w+\}", "")


def ellipsis(c: Column, limit: int = 230, keep: int = 227) -> Column:
    cut = F.regexp_replace(F.substring(c, 1, keep), f"{WS}+[^\\s]*$", "")
    return F.when(F.length(c) > limit, F.concat(cut, F.lit("..."))).otherwise(c)


def base_name(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, "/+$", ""), "([^/]*)$", 1)


def strip_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=.)\.[^./]*$", "")


def with_pdf_names(names: Column) -> Column:
    """Each name and ``name.pdf`` unless it already ends so; order kept."""
    kept = F.filter(names, lambda n: n.isNotNull() & (n != ""))
    return F.array_distinct(
        F.flatten(
            F.transform(
                kept,
                lambda n: F.when(F.lower(n).endswith(".pdf"), F.array(n)).otherwise(
                    F.array(n, F.concat(n, F.lit(".pdf")))
                ),
            )
        )
    )


def split_list(c: Column) -> Column:
    parts = F.transform(F.split(text_or_empty(c), ","), trim_ws)
    return F.filter(parts, lambda p: p != "")


def verification_id(uid: Column, year: Column, month: Column, prefix: str = "RLC") -> Column:
    """Report id; the month counts from zero inside the encoded part.

    Where the encoded part is longer than 24 characters, a digest of the whole value stands for it.
    """
    raw = F.concat(uid.cast("string"), year.cast("string"), (month - 1).cast("string"))
    encoded = F.base64(raw.cast("binary"))
    code = F.upper(F.when(F.length(encoded) > 24, F.md5(raw)).otherwise(encoded))
    return F.concat_ws("-", F.lit(prefix), code, year.cast("string"))


def host(c: Column) -> Column:
    found = F.try_parse_url(c, F.lit("HOST"))
    return text_or_empty(F.lower(F.regexp_replace(found, r"^www\.", "")))


def primary_language(c: Column) -> Column:
    return F.lower(F.substring_index(c, "-", 1))


def first_present(*cols: Column) -> Column:
    """First value that is neither null nor blank, else empty."""
    return F.coalesce(*[F.nullif(trim_ws(c), F.lit("")) for c in cols], F.lit(""))


def context_block(chunks: Column, label: str, text: str = "text", source: str = "file_name") -> Column:
    """Readable context of an ordered chunk array."""
    return F.array_join(
        F.transform(
            chunks,
            lambda c, i: F.concat(
                F.lit(f"[{label}]\nFuente: "),
                F.coalesce(c[source], F.concat(F.lit("Fragmento "), (i + 1).cast("string"))),
                F.lit("\n"),
                text_or_empty(c[text]),
            ),
        ),
        "\n\n---\n\n",
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    Branches of ``coalesce`` and ``when`` would each compute a costly text again.
    """
    return F.transform(F.array(value), use)[0]
