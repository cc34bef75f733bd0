"""Pattern extraction from whole texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions.rules import found
from worktide.functions.text import (
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    WS,
    YEAR,
    compact,
    let,
    text_or_empty,
    title_case,
    words,
)

# Case-insensitive for accented letters as well.
NO_CASE = "(?iu)"


def years(c: Column) -> Column:
    """All stand-alone years, in order."""
    return F.transform(
        F.regexp_extract_all(text_or_empty(c), F.lit(f"({YEAR})"), F.lit(1)),
        lambda y: y.cast("int"),
    )


def first_year(found_years: Column) -> Column:
    return F.try_element_at(found_years, F.lit(1))


def last_year(found_years: Column) -> Column:
    return F.try_element_at(found_years, F.lit(-1))


def part_number(norm_title: Column) -> Column:
    digits = F.regexp_extract(norm_title, words(r"parte ?([0-9]+)"), 1)
    return digits.try_cast("int")


# Annual hours, vacation days with kind, share followed by a word.
HOUR_VALUE = NO_CASE + words(rf"1[.,][0-9]{{3}}{WS}*horas?")
DAY_VALUE = NO_CASE + words(
    rf"(?:2[2-9]|3[01]){WS}+d[ií]as?{WS}+(?:naturales|laborables|h[aá]biles)"
)
# What every text with such a value holds.
HOUR_HINT = "(?i)hora"
DAY_HINT = "[23][0-9]"
SHARE_VALUE = rf"{NOT_AFTER_WORD}[0-9]{{1,3}}{WS}*%(?=[A-Za-z0-9_])"


def non_empty(c: Column) -> Column:
    """Null instead of empty, computed once; ``nullif`` would be computed ahead of every branch."""
    return let(c, lambda v: F.when(v != "", v))


def first_match(c: Column, pattern: str) -> Column:
    """Whole first match, else empty."""
    return F.regexp_extract(text_or_empty(c), pattern, 0)


def hour_value(c: Column) -> Column:
    """Annual hours such as ``1.780 horas``, else empty."""
    return first_match(c, HOUR_VALUE)


def day_value(c: Column) -> Column:
    """Vacation days 22 to 31 with their kind, else empty."""
    return compact(first_match(c, DAY_VALUE))


def percentage(c: Column) -> Column:
    """``25 %`` as ``25%``, else empty; a word character must follow the sign."""
    return F.regexp_replace(first_match(c, SHARE_VALUE), f"{WS}+", "")


def spellings(pattern: str) -> list[str] | None:
    """All texts that a pattern of letters, blanks, ``[ab]``, ``(?:a|b)``, ``a|b`` and ``a?`` matches;
    none for other patterns."""
    if re.search(r"[^\w\s\[\]()?:|-]|\[[^\]]*[^\w\]]|\((?!\?:)|\?\?|\]:|[\w\s]:", pattern):
        return None
    place = 0

    def either() -> list[str]:
        nonlocal place
        found = sequence()
        while pattern[place : place + 1] == "|":
            place += 1
            found = found + sequence()
        return found

    def sequence() -> list[str]:
        nonlocal place
        done = [""]
        while place < len(pattern) and pattern[place] not in "|)":
            if pattern[place] == "[":
                end = pattern.index("]", place)
                atom, place = list(pattern[place + 1 : end]), end + 1
            elif pattern.startswith("(?:", place):
                place += 3
                atom, place = either(), place + 1
            else:
                atom, place = [pattern[place]], place + 1
            if pattern[place : place + 1] == "?":
                atom, place = [*atom, ""], place + 1
            done = [d + a for d in done for a in atom]
        return done

    return list(dict.fromkeys(either()))


def folded(c: Column) -> Column:
    """Lower case as patterns without case see it, one character for one."""
    for odd, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        c = F.replace(c, F.lit(odd), F.lit(plain))
    return F.lower(c)


def _place(text: Column, low: Column, pattern: str) -> Column:
    """Where the pattern, without case, first occurs, from 1; null where it does not."""
    known = spellings(pattern)
    if known is None:
        before = F.regexp_extract(text, f"{NO_CASE}^([\\s\\S]*?)(?:{pattern})", 1)
        return F.when(text.rlike(f"{NO_CASE}(?:{pattern})"), F.length(before) + 1)
    places = F.array(*[F.instr(low, F.lower(F.lit(k))) for k in known])
    return F.array_min(F.filter(places, lambda p: p > 0))


def first_fragment(
    text: Column, patterns: Sequence[str], around: int = 700, low: Column | None = None
) -> Column:
    """``around`` characters from the first hit of the first pattern that occurs.

    ``low`` is ``folded(text)`` where the caller has it already.
    """
    if low is None:
        return let(folded(text), lambda made: first_fragment(text, patterns, around, made))
    return let(
        F.coalesce(*[_place(text, low, p) for p in patterns]),
        lambda at: F.when(at.isNull(), "").otherwise(compact(F.substring(text, at, F.lit(around)))),
    )


def fragment_with(
    text: Column, keyword: str, has_value: str, hint: str, around: int = 1800,
    low: Column | None = None,
) -> Column:
    """First fragment after a keyword hit that holds a value, over all hits.

    ``hint`` is a cheap pattern that must occur in a raw fragment for
    ``has_value`` to match its tidied form; other texts and fragments are
    skipped early. So is what comes before the first hit.
    """
    if low is None:
        return let(
            folded(text), lambda made: fragment_with(text, keyword, has_value, hint, around, made)
        )

    def search(rest: Column) -> Column:
        fragments = F.regexp_extract_all(
            rest, F.lit(f"{NO_CASE}(?=((?:{keyword})[\\s\\S]{{0,{around}}}))"), F.lit(1)
        )
        tidy = F.transform(
            F.filter(fragments, lambda f: f.rlike(hint)),
            lambda f: compact(F.substring(f, 1, around)),
        )
        first = F.try_element_at(F.filter(tidy, lambda f: f.rlike(has_value)), F.lit(1))
        return F.coalesce(F.when(rest.rlike(hint), first), F.lit(""))

    return let(
        _place(text, low, keyword),
        lambda at: F.when(at.isNull(), "").otherwise(let(F.substr(text, at), search)),
    )


# Bulletin names in order, official domains, bare domains.
BULLETINS = (
    r"Bolet[ií]n Oficial (?:de|del) [A-ZÁÉÍÓÚÜÑa-záéíóúüñ ]+",
    r"BOLET[IÍ]N OFICIAL (?:DE|DEL) [A-ZÁÉÍÓÚÜÑ ]+",
    words("BOPV"),
    words("BOB"),
    words("BON"),
    words("BOCM"),
    words("BOE"),
)
BULLETIN_DOMAINS = ("bopmalaga.es", "bop.dival.es", "araba.eus", "bop.diba.cat", "bocm.es",
                    "boe.es", "bizkaia.eus", "gipuzkoa.eus", "navarra.es", "sevilla.es", "dpz.es")
BARE_DOMAINS = ("bopmalaga.es", "araba.eus", "bop.dival.es", "bop.diba.cat")


def _named(line: Column, pattern: str) -> Column:
    """First hit of a pattern or null; that of plain words only where they occur at all."""
    hit = non_empty(F.regexp_extract(line, f"({pattern})", 1))
    plain = spellings(pattern.removeprefix(NOT_AFTER_WORD).removesuffix(NOT_BEFORE_WORD))
    if plain is None:
        return hit
    return F.when(reduce(Column.__or__, [line.contains(w) for w in plain]), hit)


def official_source(
    text: Column, patterns: Sequence[str] = BULLETINS, line: Column | None = None
) -> Column:
    """First bulletin name in the whole text; ``line`` is ``compact(text)`` where it is there."""
    if line is None:
        return let(compact(text), lambda made: official_source(text, patterns, made))
    return let(
        F.coalesce(*[_named(line, p) for p in patterns]),
        lambda name: F.when(
            name.isNotNull(),
            F.concat(
                F.lit("Referencia de publicacion localizada en el PDF: "), title_case(name), F.lit(".")
            ),
        ).otherwise(F.lit(lx.NOT_FOUND)),
    )


def _no_tail(url: Column) -> Column:
    return F.regexp_replace(url, "[.,;]+$", "")


def official_url(
    text: Column,
    domains: Sequence[str] = BULLETIN_DOMAINS,
    bare: Sequence[str] = BARE_DOMAINS,
    line: Column | None = None,
) -> Column:
    """First URL on an allowed domain, else a bare domain with ``https://``."""
    allowed = "|".join(re.escape(x) for x in domains)
    plain = "|".join(re.escape(x) for x in bare)

    def find(line: Column) -> Column:
        urls = F.transform(
            F.regexp_extract_all(
                line, F.lit(r"(?i)(https?://[^\s\x{00A0}\x{FEFF})]+)"), F.lit(1)
            ),
            _no_tail,
        )
        listed = F.try_element_at(F.filter(urls, lambda u: F.lower(u).rlike(allowed)), F.lit(1))
        bare_hit = non_empty(
            F.regexp_extract(
                line,
                rf"(?i)((?<![A-Za-z0-9_])(?:www\.)?(?:{plain})[^\s\x{{00A0}}\x{{FEFF}})]*)",
                1,
            )
        )
        return F.coalesce(
            listed, F.concat(F.lit("https://"), _no_tail(bare_hit)), F.lit(lx.NOT_FOUND)
        )

    return let(compact(text), find) if line is None else find(line)


@dataclass(frozen=True)
class Block:
    """A topic found when its fragment matches ``proof``."""

    starts: tuple[str, ...]
    proof: str
    message: str
    around: int = 1800


# Topic blocks of an agreement text.
BLOCKS: Mapping[str, Block] = {
    "permisos": Block(
        ("permisos y licencias", "licencias", "permisos retribuidos"),
        "matrimonio|fallecimiento|hospitalizaci[oó]n|enfermedad grave|licencia",
        "Articulo o cuadro de permisos y licencias localizado en el documento; revisa el texto "
        "completo para duraciones y supuestos concretos.",
    ),
    "horas_extra": Block(
        ("horas extraordinarias", "horas extras"),
        "no podr[aá]n efectuarse|norma general|horas extraordinarias|horas extras",
        "Reglas sobre horas extraordinarias localizadas en el documento; consulta el convenio "
        "para limites, compensacion y excepciones.",
    ),
    "pluses": Block(
        ("plus", "complementos?", "nocturnidad"),
        "plus|complemento|nocturnidad|antig[uü]edad|transporte",
        "Pluses o complementos localizados en el documento.",
        1200,
    ),
    "categorias": Block(
        ("categor[ií]as profesionales", "grupos profesionales",
         "clasificaci[oó]n profesional"),
        "categor|grupos profesionales|clasificaci[oó]n profesional",
        "Categorias o grupos profesionales localizados en el documento.",
        1200,
    ),
}
HOUR_KEYWORD = "jornada|c[oó]mputo anual"
HOUR_STARTS = ("jornada (?:anual|laboral|de trabajo)", "jornada anual", "c[oó]mputo anual")
DAY_KEYWORD = "vacaciones|vacaci[oó]n anual"
DAY_STARTS = ("vacaciones", "vacaci[oó]n anual")
HOLIDAY_STARTS = ("festivos", "d[ií]as festivos", "fiestas retribuidas")
NIGHT_STARTS = ("nocturnidad", "trabajos nocturnos", "horario nocturno")
REST_STARTS = ("descanso semanal", "descansos", "descanso entre jornadas", "festivos")
SCOPE_STARTS = ("[aá]mbito territorial", "[aá]mbito funcional")


def content(
    text: Column, sector_label: Column, province: Column, year_start: Column, year_end: Column,
    low: Column | None = None,
) -> Column:
    """Struct of the fourteen published fields, absent ones as "not found".

    ``low`` is ``folded(text)`` where the caller has it already, as each field looks at it.
    """
    if low is None:
        return let(
            folded(text),
            lambda made: content(text, sector_label, province, year_start, year_end, made),
        )
    missing = F.lit(lx.NOT_FOUND)
    place = title_case(province)
    label = F.lower(sector_label)

    def or_missing(flag: Column, message: Column | str) -> Column:
        message = F.lit(message) if isinstance(message, str) else message
        return F.when(flag, message).otherwise(missing)

    def block(name: str) -> Column:
        b = BLOCKS[name]
        return or_missing(
            first_fragment(text, b.starts, b.around, low).rlike(NO_CASE + b.proof), b.message
        )

    def value_or_start(keyword: str, value: str, hint: str, starts: Sequence[str]) -> Column:
        return F.coalesce(
            non_empty(fragment_with(text, keyword, value, hint, 2200, low)),
            first_fragment(text, starts, 1800, low),
        )

    hours = hour_value(value_or_start(HOUR_KEYWORD, HOUR_VALUE, HOUR_HINT, HOUR_STARTS))
    days = day_value(value_or_start(DAY_KEYWORD, DAY_VALUE, DAY_HINT, DAY_STARTS))
    holiday = first_fragment(text, HOLIDAY_STARTS, 1600, low)
    night = first_fragment(text, NIGHT_STARTS, 1800, low)
    rest = first_fragment(text, REST_STARTS, 1800, low)
    scope = first_fragment(text, SCOPE_STARTS, 1600, low)

    validity = or_missing(
        year_start.isNotNull() & year_end.isNotNull(),
        F.concat(
            F.lit("Vigencia detectada en el documento: "), year_start.cast("string"), F.lit("-"),
            year_end.cast("string"), F.lit("."),
        ),
    )
    annual = let(hours, lambda h: or_missing(
        h != "", F.concat(F.lit("Jornada anual localizada en el texto: "), h, F.lit("."))
    ))
    vacation = let(days, lambda v: or_missing(
        v != "", F.concat(F.lit("Vacaciones localizadas en el texto: "), v, F.lit("."))
    ))
    holidays = let(holiday, lambda h: (
        F.when(
            h.rlike(rf"75{WS}*%") & h.rlike(rf"50{WS}*%"),
            "Festivos trabajados localizados: compensacion economica con incremento del 75% o "
            "descanso posterior con aumento del 50%.",
        )
        .when(
            h.rlike(NO_CASE + "fiestas retribuidas|festivos"),
            "Reglas sobre festivos trabajados localizadas en el documento.",
        )
        .otherwise(missing)
    ))
    shared = lambda n: let(percentage(n), lambda share: (
        F.when(
            share != "",
            F.concat(
                F.lit("Regla de nocturnidad localizada en el texto, con referencia a un "
                      "incremento del "),
                share,
                F.lit("."),
            ),
        )
        .otherwise(
            "Regla de nocturnidad localizada en el texto; consulta el convenio para el tramo "
            "horario y la compensacion aplicable."
        )
    ))
    nights = let(night, lambda n: (
        F.when(~n.rlike(NO_CASE + "nocturn"), missing).otherwise(shared(n))
    ))
    rests = lambda holidays: (
        F.when(
            rest.rlike(NO_CASE + "descanso semanal|descansos|descanso entre jornadas"),
            "Reglas de descansos localizadas en el documento; consulta el convenio para "
            "calendario, descansos semanales y posibles compensaciones.",
        )
        .when(
            found(holidays),
            "Reglas sobre festivos y descansos compensatorios localizadas en el documento.",
        )
        .otherwise(missing)
    )

    def known(field: Column, unknown: str) -> Column:
        return F.when(found(field), field).otherwise(unknown)

    def fields(once: Column) -> Column:
        summary = F.concat_ws(
            " ",
            F.concat(
                F.lit("Pagina orientativa del convenio colectivo de "), label, F.lit(" de "), place,
                F.lit("."),
            ),
            known(once["validity"], "La vigencia no se ha podido confirmar automaticamente."),
            known(once["annual"], "La jornada anual debe comprobarse en el convenio completo."),
            known(once["vacation"], "Las vacaciones deben comprobarse en el convenio completo."),
        )
        return F.struct(
            summary.alias("resumen"),
            once["validity"].alias("vigencia"),
            or_missing(
                scope != "",
                F.concat(
                    F.lit("Ambito del convenio localizado para el sector "), label, F.lit(" en "),
                    place, F.lit("."),
                ),
            ).alias("ambito"),
            once["annual"].alias("jornada_anual"),
            once["vacation"].alias("vacaciones"),
            block("permisos").alias("permisos"),
            block("horas_extra").alias("horas_extra"),
            nights.alias("nocturnidad"),
            rests(once["holidays"]).alias("descansos"),
            once["holidays"].alias("festivos_descansos"),
            block("pluses").alias("pluses"),
            block("categorias").alias("categorias"),
            official_source(text, line=once["line"]).alias("fuente_oficial"),
            official_url(text, line=once["line"]).alias("fuente_url"),
        )

    # Computed once, as several fields use them.
    return let(
        F.struct(
            validity.alias("validity"), annual.alias("annual"), vacation.alias("vacation"),
            holidays.alias("holidays"), compact(text).alias("line"),
        ),
        fields,
    )


def content_score(fields: Sequence[Column], missing: str = lx.NOT_FOUND) -> Column:
    total = F.lit(0)
    for f in fields:
        total = total + found(f, missing).cast("int")
    return total


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<title>([^<]+)</title>", 1)


def description_of(html: Column) -> Column:
    return F.regexp_extract(html, r'(?i)<meta name="description" content="([^"]+)">', 1)
