import hashlib

from pyspark.sql import functions as F

from worktide.functions import extract as ex
from worktide.functions import rules
from worktide.functions import text as tx


def test_normalize_folds_and_is_idempotent(values):
    raw = ["Añón, ¿Qué ES?", None, "  ", "İzmir ñ", "straße K x", "a_b-c"]
    once = values(tx.normalize, raw)
    assert once == ["anon que es", "", "", "izmir n", "stra e k x", "a b c"]
    assert values(tx.normalize, once) == once
    assert [tx.py_normalize(r) for r in raw] == once


def test_ids_and_slugs(values):
    assert values(tx.identifier, ["Álava 2020!", "", None, "x" * 130]) == [
        "alava_2020", "convenio", "convenio", "x" * 120 + "_" + hashlib.md5(b"x" * 130).hexdigest(),
    ]
    first, second = values(tx.identifier, ["y" * 120 + "a", "y" * 120 + "b"])
    assert first != second
    assert values(tx.slug, ["Álava & Ñ!"]) == ["alava-n"]
    assert values(tx.title_case, ["  SAN   sebastian "]) == ["San Sebastian"]


def test_cleaning_variants(values):
    raw = "a\r\nb\rc \t d\n\n\n\ne "
    assert values(tx.clean_extracted, [raw]) == ["a\nb\rc d\n\ne"]
    assert values(tx.clean_published, [raw]) == ["a\n\nb\nc d\n\ne"]
    assert values(tx.compact, ["a   b ,c\n .d", "x  ;y"]) == ["a b,c.d", "x;y"]


def test_years_need_ascii_boundaries(values):
    assert values(tx.without_years, ["de 2020 a 2024 x_2021", "año2020"]) == ["de a x_2021", "año2020"]
    found = values(ex.years, ["Valencia2022-2025", "c_2024_x", "2018-2027", "ñ2019"])
    assert found == [[2025], [], [2018, 2027], [2019]]


def test_escape_and_templates(values):
    assert values(tx.escape_markup, ['<a & "b">']) == ["&lt;a &amp; &quot;b&quot;&gt;"]
    make = lambda c: tx.interpolate("{a}/{zz}-{a}", {"a": c})
    assert values(make, ["x", "{a}"]) == ["x/-x", "{a}/-{a}"]
    long = "palabra " * 40
    cut = values(tx.ellipsis, [long, "short"])
    assert cut[0].endswith("palabra...") and len(cut[0]) <= 230 and cut[1] == "short"


def test_names_and_lists(values):
    make = lambda c: tx.with_pdf_names(F.split(c, ";"))
    assert values(make, ["a;b.PDF;a;;a.pdf"]) == [["a", "a.pdf", "b.PDF"]]
    assert values(tx.split_list, [" a, ,b ,", None]) == [["a", "b"], []]
    assert values(tx.host, ["https://www.BOE.es/x", "nota url", None]) == ["boe.es", "", ""]
    make = lambda u, y, m: tx.verification_id(u, y, m)
    assert values(make, [("uid1", 2024, 1)], "u string, y int, m int") == ["RLC-DWLKMTIWMJQW-2024"]
    long = values(make, [("u" * 28, 2024, m) for m in (1, 2, 12)] + [("u" * 28, 2025, 1)], "u string, y int, m int")
    assert len(set(long)) == 4


def test_client_families(values):
    ua = ["x Edg/1 Chrome/1 Safari/1", "Firefox/2", "Chrome/1 Safari/1", "Safari/1", "curl"]
    assert values(rules.browser_family, ua) == ["Edge", "Firefox", "Chrome", "Safari", "Otro"]
    pairs = [("Android 1", "Linux"), ("iPad", "Mac"), ("x", "Win32"), ("x", "MacIntel"),
             ("x", "Linux x86"), ("x", "?")]
    assert values(rules.os_family, pairs, "u string, p string") == [
        "Android", "iOS", "Windows", "macOS", "Linux", "Otro",
    ]


def test_rounding_and_defaults(values):
    assert values(rules.round_half_up, [-1.5, 1.5, -0.5, 2.4], "x double") == [-1, 2, 0, 2]
    make = lambda c: rules.number_or(c, 1.0)
    assert values(make, ["0", "x", None, "0.75", "NaN"]) == [1.0, 1.0, 1.0, 0.75, 1.0]


TEXT = (
    "Boletín Oficial de la Provincia de Málaga. Ámbito funcional del sector. "
    + "Jornada: se pacta. " + "relleno " * 400
    + "La JORNADA anual sera de 1.780  horas. Vacaciones: 30 dÍas naturales. "
    + "Permisos y licencias: matrimonio. Horas extraordinarias: norma general. "
    + "Nocturnidad: incremento del 25 %x. Descanso semanal. Festivos al 75 % y 50 %. "
    + "ver https://www.bopmalaga.es/cve.php, y mas"
)


def test_content_from_text(values):
    make = lambda t: ex.content(
        t, F.lit("Limpieza"), F.lit("MALAGA"), F.lit(2018), F.lit(2027)
    )
    found, empty = values(make, [TEXT, "nada"])
    assert found.jornada_anual == "Jornada anual localizada en el texto: 1.780 horas."
    assert found.vacaciones == "Vacaciones localizadas en el texto: 30 dÍas naturales."
    assert found.nocturnidad.endswith("incremento del 25%.")
    assert found.festivos_descansos.startswith("Festivos trabajados localizados")
    assert found.fuente_oficial.startswith("Referencia de publicacion localizada")
    assert found.fuente_url == "https://www.bopmalaga.es/cve.php"
    assert found.vigencia == "Vigencia detectada en el documento: 2018-2027."
    assert found.permisos.startswith("Articulo") and found.ambito.endswith("limpieza en Malaga.")
    assert empty.permisos == ex.lx.NOT_FOUND and empty.fuente_url == ex.lx.NOT_FOUND


def test_validity_needs_both_years(values):
    make = lambda t: ex.content(
        t, F.lit("x"), F.lit("y"), F.lit(2018), F.lit(None).cast("int")
    )["vigencia"]
    assert values(make, ["t"]) == [ex.lx.NOT_FOUND]


def test_spellings_of_patterns():
    assert ex.spellings("jornada (?:anual|laboral)") == ["jornada anual", "jornada laboral"]
    assert set(ex.spellings("c[oó]mputo|pluse?s")) == {"cómputo", "computo", "pluses", "pluss"}
    assert ex.spellings("a+") is None and ex.spellings("a.c") is None and ex.spellings("[a-z]x") is None


def test_fragments_equal_plain_patterns(values):
    """Letters that only lower to plain ones, marks, wide characters, nulls; hits by the old patterns."""
    import re

    texts = ["x \U0001f600 JORNADA ANUAL de", "\u0130\u0130 festivo\u017f y F\u0131estas retribuidas", "CÓMPUTO anual",
             "d\u0130as festivos", "", None, "plus jornada laboral \u212a", "sin nada"]
    starts = ("festivos", "fiestas retribuidas", "jornada (?:anual|laboral)", "c[oó]mputo anual", "ks|\u212a")
    got = values(lambda t: ex.first_fragment(t, starts, 12), texts)
    plain = lambda t: "".join({"\u0130": "i", "\u0131": "i", "\u017f": "s"}.get(c, c) for c in t or "").lower()
    hits = [next((m.start() for p in starts if (m := re.search(p.replace("\u212a", "k"), plain(t)))), None) for t in texts]
    assert got == ["" if h is None else (t or "")[h : h + 12].strip() for t, h in zip(texts, hits, strict=True)]
    odd = values(lambda t: ex.first_fragment(t, ("jor.ada",), 12), texts)
    assert odd == ["JORNADA ANUA", "", "", "", "", "", "jornada labo", ""]


def test_each_field_searches_the_text_once(spark):
    """No hit is computed ahead of the branches that may not need it."""
    from worktide.queries import registry

    plan = registry.load()[0]["content_fields"](spark, "/root/testdata/sf0.001")
    assert "_common_expr" not in plan._jdf.queryExecution().executedPlan().toString()
