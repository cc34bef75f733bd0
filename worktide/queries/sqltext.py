"""SQL snippets shared by the SQL twins."""

WS = (
    r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'), ' ')"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return trim_ws(
        f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    )


def compact(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), ' +([.,;:])', '\\1', 'g'), ' ')"
    )


def has_any(x: str, terms, whole_word: bool = False) -> str:
    alternatives = "|".join(terms)
    pattern = f"(^| )({alternatives})( |$)" if whole_word else alternatives
    return f"regexp_matches({x}, '{pattern}')"


def escape(x: str) -> str:
    out = x
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, '{raw}', '{entity}')"
    return out
