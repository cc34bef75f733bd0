import pytest
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import rules
from worktide.plans import answers as an
from worktide.plans import catalog as ct
from worktide.plans import requests as rq

QUESTIONS = [
    ("cuándo es la final del Mundial", {"out_of_scope"}),
    ("cuándo es la final del Mundial, quiero pedir vacaciones ese día", {"mixed_labor"}),
    ("qué es un despido objetivo", {"general_labor"}),
    ("cuál es el salario mínimo", {"current_labor"}),
    ("camarero en hotel de Donosti, vacaciones", {"collective_agreement"}),
    ("días festivos de gipuzkoa", {"needs_clarification", "current_labor"}),
    ("cocinero en Madrid, asuntos propios", {"collective_agreement"}),
    ("", {"needs_clarification"}),
    ("que convenio me toca", {"needs_clarification"}),
    ("camarero", {"out_of_scope"}),
    ("mi derecho", {"general_labor"}),
]


def test_intents(values):
    make = lambda q: rules.intent(q, rules.provinces_in(q), rules.sectors_in(q))
    got = values(make, [q for q, _ in QUESTIONS])
    for (question, expected), verdict in zip(QUESTIONS, got):
        assert verdict.intent in expected, question
    strict = lambda q: rules.intent(
        q, F.array(), F.array(), whole_word=True
    )["reason"]
    assert values(strict, ["mi derecho"]) == ["no_labor_signal"]


def test_places_and_sectors(values):
    assert values(rules.provinces_in, ["en Bilbao y Donosti", "Euskadi", "nada"]) == [
        ["GIPUZKOA", "BIZKAIA"], ["GIPUZKOA", "BIZKAIA", "ALAVA"], [],
    ]
    assert values(rules.sectors_in, ["camarero en hotel", "bar", "recepcionista de bar"]) == [
        ["alojamientos"], ["hosteleria"], ["alojamientos", "hosteleria"],
    ]


def test_file_names(spark):
    names = [
        "Convenio Hosteleria Malaga 2018-2027.pdf",
        "Convenio Alojamientos y Hostelería Valencia2022-2025.pdf",
        "Convenio Transporte Alava 201-2026.pdf",
        "Convenio Transporte GIPUZKOA 2007-2010parte1.pdf",
        "estatuto_trabajadores.pdf",
    ]
    df = spark.createDataFrame([(i, "in/" + n) for i, n in enumerate(names)], "ord int, file_name string")
    rows = ct.file_fields(df).withColumns(
        {
            "broken": rules.broken_metadata(F.col("file_name"), F.col("province"), F.col("sector_keys")),
            "part": rules.part_marker(F.col("file_name")),
            "kind": rules.doc_type(F.col("file_name")),
        }
    ).orderBy("ord").collect()
    assert rows[0].catalog_key == "hosteleria_malaga_2018_2027" and not rows[0].broken
    assert (rows[1].year_start, rows[1].year_end, rows[1].province) == (2025, 2025, None)
    assert rows[1].sector_keys == ["alojamientos", "hosteleria"]
    assert rows[2].broken and rows[3].part and rows[3].year_end == 2007
    assert rows[4].catalog_key == "sin_sector_sin_provincia_na_na" and rows[4].kind == "base"
    assert {r.kind for r in rows[:4]} == {"especifico"}


def test_catalog_resolution(spark):
    files = spark.createDataFrame(
        [(0, "Convenio Hosteleria Bizkaia 2018-2020.pdf"),
         (1, "Convenio Hosteleria Bizkaia 2021-2024.pdf"),
         (2, "Convenio Alojamientos y Hosteleria Madrid 2020-2021.pdf"),
         (3, "Convenio Hosteleria Madrid 2019-2020.pdf"),
         (4, "Convenio Hosteleria Bizkaia 2018-2020 parte 2.pdf")],
        "ord int, file_name string",
    )
    catalog = ct.build(ct.file_fields(files))
    asked = ct.criteria(
        spark.createDataFrame(
            [(1, "camarero en Bilbao"), (2, "camarera en Madrid"), (3, "camarero"), (4, "en Bilbao"),
             (5, "hola"), (6, "conductor en Sevilla")], "q int, question string"),
        F.col("question"), F.lit(""), F.lit(""),
    )
    got = {
        r.q: r for r in asked.join(ct.resolve(asked, catalog), "criteria_key").collect()
    }
    assert got[1].status == "resolved" and got[1].entry.title.endswith("2021-2024")
    assert got[1].n_options == 2 and got[1].shown is None
    assert got[2].status == "ambiguous" and len(got[2].shown) == 2
    assert [got[i].status for i in (3, 4, 5, 6)] == [
        "missing_location", "missing_sector", "missing_all", "not_found",
    ]
    files_of = ct.entry_files(ct.file_fields(files), F.floor(F.col("ord") / 2))
    kept = [r.file_name for r in files_of.where("catalog_key like '%2018_2020'").orderBy("position").collect()]
    assert kept == [files.collect()[0].file_name, files.collect()[4].file_name]


def test_statute_rules(values):
    assert values(rules.statute_rule, ["mudanza y boda", "mi boda", "días de vacaciones", "x"]) == [
        "et_art_37_3_traslado_domicilio", "et_art_37_3_matrimonio", "et_art_38_vacaciones", None,
    ]
    make = lambda r, f: rules.statute_answer(r, f)
    answer = values(make, [("et_art_38_vacaciones", ""), ("et_art_38_vacaciones", "a.pdf")], "r string, f string")
    assert answer[0].startswith(lx.STATUTE_PREFIX_WITHOUT_AGREEMENT)
    assert answer[1].endswith("Fuente: Estatuto de los Trabajadores, artículo 38.")
    assert values(rules.answer_not_found, ["No he encontrado el dato exacto.", "ok"]) == [True, False]
    assert values(rules.language_of_question, ["Zer da hau?", "ñeta", "qué du"]) == [
        "euskera", "euskera", "euskera",
    ]


def test_domains_and_prices(values):
    strict = lambda v: rules.official_domain(v)
    loose = lambda v: rules.official_domain(v, mode="contains")
    hosts = ["boe.es", "x.boe.es", "boe.es.other.tld", "notboe.es", None]
    assert values(strict, hosts) == [True, True, False, False, False]
    assert values(loose, hosts) == [True, True, True, True, False]
    empty = lambda p: rules.allowed_price(p, p, (), ())
    assert values(empty, ["a"]) == [False]
    assert values(lambda n: rules.recent_login(n, F.lit(1000)), [940, 699, 1001, None], "t bigint") == [
        True, False, False, False,
    ]


def test_discipline_score(values):
    make = lambda t: rules.weighted_score(t)
    assert values(make, ["faltas muy graves y sanciones", "delegados as sindicales", "x"]) == [9, -4, 0]


def test_request_order(spark):
    rows = [
        ("text/plain", "[]", "not_json"),
        ("application/json", "[1]", "not_an_object"),
        ("application/json", '{"pregunta":"x","extra":1,"sector":2}', "unexpected_field"),
        ("application/json", '{"pregunta":1,"sector":2}', "context_not_text"),
        ("application/json", '{"sector":"a"}', "question_not_text"),
        ("application/json", '{"pregunta":" \\u00a0 "}', "question_empty"),
        ("application/json", '{"pregunta":"%s"}' % ("a" * 1201), "question_too_long"),
        ("application/json", '{"pregunta":"hola","sector":null}', "context_not_text"),
        ("application/JSON; x", '{"pregunta":"hola","ciudad":"y"}', None),
    ]
    df = spark.createDataFrame(rows, "t string, body string, want string").withColumn(
        "doc", rq.fields(F.col("body"))
    )
    for r in df.withColumn("got", rq.request_verdict(F.col("t"), F.col("doc"))).collect():
        assert r.got == r.want, r


@pytest.mark.parametrize(
    "row,source",
    [
        (("out_of_scope", False, "resolved", None, 2, 5, False, True, False, "x"), "out_of_scope"),
        (("needs_clarification", False, "resolved", None, 2, 5, False, True, False, "x"), "clarification"),
        (("current_labor", False, "resolved", None, 2, 5, False, True, True, "x"), "web_official"),
        (("collective_agreement", False, "ambiguous", None, 2, 5, False, True, False, "x"), "clarification"),
        (("collective_agreement", False, "not_found", "r", 2, 5, False, True, True, "x"), "estatuto"),
        (("collective_agreement", True, "not_found", "r", 0, 0, False, True, True, "x"), "estatuto"),
        (("collective_agreement", True, "catalog_empty", None, 0, 0, False, True, False, "x"), "unconfirmed"),
        (("collective_agreement", False, "resolved", "r", 2, 0, True, True, False, "x"), "estatuto"),
        (("collective_agreement", False, "resolved", None, 2, 0, True, True, False, "web_fallback_disabled"), "convenio"),
        (("collective_agreement", False, "resolved", None, 2, 0, True, True, False, "empty_response"), "unconfirmed"),
        (("collective_agreement", False, "resolved", None, 2, 5, False, False, False, "x"), "unconfirmed"),
        (("collective_agreement", False, "resolved", None, 2, 5, False, True, False, "x"), "convenio"),
    ],
)
def test_routing(spark, row, source):
    df = spark.createDataFrame(
        [row],
        "intent string, has_reference boolean, catalog_status string, statute_rule string, n_base int, "
        "n_specific int, not_found boolean, complete boolean, search_used boolean, search_reason string",
    )
    got = an.route(df).first()
    assert got.response_source == source
    assert got.event == lx.ANSWER_EVENTS[source]


def test_visit_update_parses_and_writes_each_value_once(spark):
    """Several conditions look at the counters and at both sides of a change."""
    sides = spark.createDataFrame([("{}", "{}")], "old string, new string")
    docs = sides.select(*[rq.fields(sides[c]).alias(c) for c in ("old", "new")])
    verdict = docs.select(rq.visit_update_verdict(docs["old"], docs["new"]).alias("verdict"))
    plan = verdict._jdf.queryExecution().analyzed().toString()
    # Both sides and the counters are parsed; both sides and the counters are written.
    assert (plan.count("from_json("), plan.count("to_json(")) == (3, 3)
    assert verdict.first()[0] == "bad_counters"
