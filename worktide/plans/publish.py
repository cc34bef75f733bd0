"""Publication: triage, overrides, selection, related items, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import extract as ex
from worktide.functions import rules
from worktide.functions import text as tx
from worktide.operators.ordered import ordinal, running_sum, top_k
from worktide.operators.staging import stage

LOCALE = "es"
APP_LINKS, INDEX_LINKS, RELATED = 3, 2, 4


# ---- overrides and triage ----------------------------------------------


def apply_overrides(
    rows: DataFrame, manual: DataFrame, key: str, fields: Sequence[str]
) -> DataFrame:
    """Verified manual values replace extracted ones, field by field.

    ``manual`` holds ``key``, ``verified`` and any of ``fields``; an unverified
    row changes nothing. ``manual_fields`` lists what was replaced.
    """
    theirs = manual.select(
        key,
        F.coalesce("verified", F.lit(False)).alias("manual_verified"),
        *[F.col(f).alias(f"__m_{f}") for f in fields],
    )
    joined = rows.join(theirs, key, "left").withColumn(
        "manual_verified", F.coalesce("manual_verified", F.lit(False))
    )

    def given(f: str) -> Column:
        return F.col("manual_verified") & (tx.text_or_empty(F.col(f"__m_{f}")) != "")

    return (
        joined.withColumn(
            "manual_fields", F.array_compact(F.array(*[F.when(given(f), F.lit(f)) for f in fields]))
        )
        .withColumns({f: F.when(given(f), F.col(f"__m_{f}")).otherwise(F.col(f)) for f in fields})
        .drop(*[f"__m_{f}" for f in fields])
    )


def pick_sector(
    norm_name: Column, sector_keys: Column, order: Sequence[str] = ("alojamientos", "hosteleria",
                                                                    "limpieza", "transporte")
) -> Column:
    """Sector by precedence, one mixed name settled by hand."""
    out = F.when(norm_name.contains(lx.MIXED_LODGING_NAME), "hosteleria")
    for key in order:
        out = out.when(F.array_contains(sector_keys, key), F.lit(key))
    return out


def triage(
    rows: DataFrame, sector: Column, high: int = 50000, medium: int = 15000
) -> DataFrame:
    """Adds ``status`` and ``reason``; the first rule that applies wins.

    Expects file_name, text, province, sector_keys, manual_verified, skip,
    skip_status and skip_reason.
    """
    name, verified = F.col("file_name"), F.col("manual_verified")

    def verdict(status: Column | str, reason: Column | str) -> Column:
        status = F.lit(status) if isinstance(status, str) else status
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(status.alias("status"), reason.alias("reason"))

    rule = (
        F.when(
            F.coalesce(F.col("skip"), F.lit(False)),
            verdict(
                F.coalesce("skip_status", F.lit("no_publicar")),
                F.coalesce(
                    "skip_reason", F.lit("Documento marcado manualmente como no publicable.")
                ),
            ),
        )
        .when(
            tx.normalize(name).startswith(lx.BASE_LAW_NAME),
            verdict("no_publicar", "No es convenio provincial especifico."),
        )
        .when(
            ~verified & rules.part_marker(name),
            verdict("corregir", "PDF partido o parte no fusionada."),
        )
        .when(
            ~verified & rules.broken_metadata(name, F.col("province"), F.col("sector_keys")),
            verdict("corregir", "Metadata ambigua o rota en nombre de archivo."),
        )
        .when(sector.isNull(), verdict("corregir", "Sector no detectado."))
        .when(F.col("text").isNull(), verdict("no_publicar", "Error leyendo PDF."))
        .when(
            rules.quality_tier(F.length("text"), high, medium) == "baja",
            verdict("no_publicar", "Baja calidad de extraccion de texto."),
        )
        .otherwise(verdict("candidate", F.lit(None).cast("string")))
    )
    return rows.withColumn("__v", rule).select("*", "__v.*").drop("__v")


# ---- selection ----------------------------------------------------------


def select_latest(
    records: DataFrame, n_fields: int = len(lx.CONTENT_FIELDS), publish_at: int = 4,
    correct_at: int = 2,
) -> DataFrame:
    """Score gate, then the latest record per slug; losers say which rule beat them.

    Expects slug, status, reason, score, end_year and ord (arrival order). A
    record that was the best on arrival is replaced later, any other loses on
    arrival. Per (slug, end year) only the first arrival matters, so the
    ranking runs over one row per year, never over all records of a slug.
    """
    end = F.coalesce("end_year", F.lit(0))
    open_ = F.col("status") == "candidate"
    low = F.concat(
        F.lit("Contenido tematico insuficiente para publicar ("), F.col("score").cast("string"),
        F.lit(f"/{n_fields} bloques localizados)."),
    )
    gated = records.withColumns(
        {
            "__end": end,
            "reason": F.when(open_ & (F.col("score") < publish_at), low).otherwise(F.col("reason")),
            "status": F.when(~open_ | (F.col("score") >= publish_at), F.col("status"))
            .when(F.col("score") >= correct_at, "corregir")
            .otherwise("no_publicar"),
        }
    )
    # A null slug joins nothing, which keeps gated-out records as they are.
    gated = gated.withColumn("__slug", F.when(F.col("status") == "candidate", F.col("slug")))
    later = Window.partitionBy("__slug").orderBy(F.desc("__end"))
    years = (
        gated.where("__slug is not null")
        .groupBy("__slug", "__end")
        .agg(F.min("ord").alias("__first"))
        .select(
            "__slug",
            "__end",
            "__first",
            F.min("__first")
            .over(later.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            .alias("__first_from_here"),
            F.row_number().over(later).alias("__rank"),
        )
    )
    first = F.col("ord") == F.col("__first")
    won = first & (F.col("__rank") == 1)
    led = F.col("ord") == F.col("__first_from_here")
    lost = F.when(
        led,
        F.concat(F.lit("Duplicado para "), "slug",
                 F.lit("; sustituido por documento mas reciente.")),
    ).otherwise(
        F.concat(F.lit("Duplicado para "), "slug",
                 F.lit("; existe documento igual o mas reciente."))
    )
    raced = F.col("__slug").isNotNull()
    return (
        gated.join(years, ["__slug", "__end"], "left")
        .withColumns(
            {
                "reason": F.when(raced & ~won, lost).when(raced, None).otherwise(F.col("reason")),
                "status": F.when(raced & won, "selected")
                .when(raced, "no_publicar")
                .otherwise(F.col("status")),
            }
        )
        .drop("__slug", "__end", "__first", "__first_from_here", "__rank")
    )


def publish_order(priority: Sequence[str] = lx.PRIORITY_SLUGS) -> list[Column]:
    """Listed slugs first in list order, then by title in Spanish order."""
    place = F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("slug")),
                     F.lit(0))
    return [F.coalesce(place, F.lit(2**31)).asc(), F.collate("title", LOCALE).asc()]


def listing(entries: DataFrame, order: Sequence[str] = lx.SECTOR_ORDER) -> DataFrame:
    """Position of each entry in the listing: sector groups in fixed order, then province."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("sector"))
    listed = entries.where(F.col("sector").isin(*order)).withColumns(
        {"group_position": place, "__p": F.collate("province", LOCALE)}
    )
    bucket = F.struct("group_position", "__p")
    return ordinal(listed, [], ["group_position", "__p", "slug"], bucket, "position").drop("__p")


# ---- related items ------------------------------------------------------


def related(
    entries: DataFrame, group: str, key: str, title: str, k: int = RELATED, out: str = "related"
) -> DataFrame:
    """First ``k`` other entries of the same group by title.

    The first ``k + 1`` entries of a group serve all its members, so no pairs
    are built.
    """
    order = [F.collate(title, LOCALE).asc(), F.col(key).asc()]
    heads = (
        top_k(entries.select(group, key, title), [group], order, k + 1, "__r")
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct("__r", key))).alias("__heads"))
    )
    others = F.filter(F.col("__heads"), lambda h: h[key] != F.col(key))
    return entries.join(heads, group, "left").withColumn(
        out, F.slice(F.transform(others, lambda h: h[key]), 1, k)
    ).drop("__heads")


def link_counts(entries: DataFrame, k: int = RELATED) -> DataFrame:
    """Number of sector and province links of each entry, from group sizes alone."""
    for group, out in (("sector", "sector_links"), ("province", "province_links")):
        sizes = entries.groupBy(group).agg(
            F.least(F.count("*") - 1, F.lit(k)).cast("bigint").alias(out)
        )
        entries = entries.join(sizes, group, "left")
    return entries


# ---- question list, page data ------------------------------------------


def faq(label: Column, place: Column, content: Mapping[str, Column], product: str) -> Column:
    """Question and answer pairs whose answer was found."""
    label = F.lower(label)

    def about(head: str) -> Column:
        return F.concat(F.lit(head), label, F.lit(" de "), place, F.lit("?"))

    # Questions in order.
    pairs = [
        (about("Que vigencia tiene el convenio de "), content["vigencia"]),
        (about("Cuantas horas anuales tiene el convenio de "), content["jornada_anual"]),
        (F.lit("Cuantos dias de vacaciones corresponden?"), content["vacaciones"]),
        (F.lit("Como funcionan los festivos?"), content["festivos_descansos"]),
        (F.lit("Como se pagan las horas extra?"), content["horas_extra"]),
        (F.lit("Hay regla de nocturnidad?"), content["nocturnidad"]),
        (F.lit("Que descansos aparecen en el convenio?"), content["descansos"]),
        (F.lit("Que permisos retribuidos hay?"), content["permisos"]),
        (F.lit("Como consultar mi convenio con IA?"), F.lit(product)),
    ]
    items = F.array(*[F.struct(q.alias("question"), a.alias("answer")) for q, a in pairs])
    return F.filter(items, lambda i: rules.found(i["answer"]))


def page_graph(
    url: Column, site: str, name: Column, description: Column, title: Column, items: Column,
    topics: Column, language: str = "es",
) -> Column:
    """Linked page data as JSON; the question list appears only when it has items."""
    has_faq = F.size(items) > 0
    faq_id = F.concat(url, F.lit("#faq"))
    crumbs = F.concat(url, F.lit("#breadcrumb"))

    def crumb(position: int, label: Column, item: Column) -> Column:
        return F.struct(
            F.lit("ListItem").alias("@type"), F.lit(position).alias("position"),
            label.alias("name"), item.alias("item"),
        )

    page = F.struct(
        F.lit("WebPage").alias("@type"),
        F.concat(url, F.lit("#webpage")).alias("@id"),
        url.alias("url"),
        name.alias("name"),
        description.alias("description"),
        F.lit(language).alias("inLanguage"),
        F.struct(crumbs.alias("@id")).alias("breadcrumb"),
        F.when(has_faq, F.struct(faq_id.alias("@id"))).alias("mainEntity"),
        F.transform(topics, lambda t: F.struct(F.lit("Thing").alias("@type"), t.alias("name"))).alias(
            "about"
        ),
    )
    trail = F.struct(
        F.lit("BreadcrumbList").alias("@type"),
        crumbs.alias("@id"),
        F.lit(language).alias("inLanguage"),
        F.array(
            crumb(1, F.lit("Inicio"), F.lit(f"{site}/")),
            crumb(2, F.lit("Convenios"), F.lit(f"{site}/convenios")),
            crumb(3, title, url),
        ).alias("itemListElement"),
    )
    questions = F.struct(
        F.lit("FAQPage").alias("@type"),
        faq_id.alias("@id"),
        F.lit(language).alias("inLanguage"),
        F.transform(
            items,
            lambda i: F.struct(
                F.lit("Question").alias("@type"),
                i["question"].alias("name"),
                F.struct(F.lit("Answer").alias("@type"), i["answer"].alias("text")).alias(
                    "acceptedAnswer"
                ),
            ),
        ).alias("mainEntity"),
    )
    nodes = [F.to_json(page), F.to_json(trail), F.when(has_faq, F.to_json(questions))]
    return tx.escape_json_text(
        F.concat(
            F.lit('{"@context":"https://schema.org","@graph":['),
            F.concat_ws(",", *nodes),
            F.lit("]}"),
        )
    )


def page_issues(
    pages: DataFrame, key: str, html: str, n_faq: Column, faq_section: str,
    markers: Mapping[str, str] = lx.PAGE_MARKERS,
) -> DataFrame:
    """One row per issue: absent markers, absent question list, repeated title or description."""
    text = F.col(html)
    absent = [
        F.when(~text.rlike("(?i)" + pattern), F.lit(f"Falta {name}."))
        for name, pattern in markers.items()
    ]
    no_faq = F.when(
        (n_faq >= 3) & ~text.rlike("(?i)" + faq_section),
        F.lit("Falta FAQ pese a existir contenido suficiente."),
    )
    # The page text is read once; the branches below work on this narrow table.
    heads = stage(
        pages.select(
            key,
            ex.title_of(text).alias("title"),
            ex.description_of(text).alias("description"),
            F.array_compact(F.array(*absent, no_faq)).alias("issues"),
        )
    )
    single = heads.select(key, F.explode("issues").alias("issue"))
    repeated = [
        repeats(heads, key, column).select(key, F.concat(F.lit(label), F.col(column)).alias("issue"))
        for column, label in (
            ("title", "Title duplicado: "), ("description", "Meta description duplicada: ")
        )
    ]
    return single.unionByName(repeated[0]).unionByName(repeated[1])


def repeats(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Second and later rows with the same value; the first is found by aggregation."""
    firsts = rows.groupBy(column).agg(F.min(key).alias("__first"), F.count("*").alias("__n"))
    return (
        rows.select(key, column)
        .join(firsts.where("__n > 1").drop("__n"), column)
        .where(F.col(key) > F.col("__first"))
        .withColumnRenamed("__first", "first_key")
    )


# ---- reports ------------------------------------------------------------


def coverage_by_field(entries: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Extracted and missing counts per field: one pass, then one row per field."""
    counts = entries.groupBy(*by).agg(
        *[F.count_if(rules.found(F.col(f))).alias(f) for f in fields], F.count("*").alias("__n")
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f).alias("extracted"),
                (F.col("__n") - F.col(f)).alias("missing"),
            )
            for f in fields
        ]
    )
    return counts.select(*by, F.inline(lines))


def missing_fields(entries: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per missing field of each entry; a list per field would not be bounded."""
    absent = F.array_compact(
        F.array(*[F.when(~rules.found(F.col(f)), F.lit(f)) for f in fields])
    )
    # The plain form would test for empty lists by a second extraction.
    return entries.select(key, F.explode_outer(absent).alias("field")).where(
        F.col("field").isNotNull()
    )


def coverage_by_page(entries: DataFrame, key: str, labels: Mapping[str, str]) -> DataFrame:
    """Found and missing labels and link counts of each page."""

    def names(want: bool) -> Column:
        flags = [
            F.when(rules.found(F.col(f)) == F.lit(want), F.lit(label))
            for f, label in labels.items()
        ]
        return F.array_compact(F.array(*flags))

    return link_counts(entries).select(
        key,
        names(True).alias("extracted"),
        names(False).alias("not_located"),
        F.lit(APP_LINKS).cast("bigint").alias("app_links"),
        "sector_links",
        "province_links",
        F.lit(INDEX_LINKS).cast("bigint").alias("index_links"),
    )


def totals(pages: DataFrame) -> DataFrame:
    return pages.agg(
        F.sum(F.size("extracted")).alias("extracted"),
        F.sum(F.size("not_located")).alias("missing"),
        F.sum(
            F.col("app_links") + F.col("sector_links") + F.col("province_links")
            + F.col("index_links")
        ).alias("internal_links"),
    )


def risks(
    entries: DataFrame, fields: Sequence[str], by: str = "sector", few: int = 4, many: int = 8
) -> DataFrame:
    """Groups at risk of look-alike pages and the number of thin pages."""
    missing = F.lit(len(fields)) - ex.content_score([F.col(f) for f in fields])
    counted = entries.select(by, (missing >= few).alias("thin"))
    groups = (
        counted.groupBy(F.col(by).alias("subject"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= many)
        .select(F.lit("group_size").alias("risk"), "subject", "n")
    )
    thin = (
        counted.agg(F.count_if("thin").alias("n"))
        .where("n > 0")
        .select(F.lit("thin_pages").alias("risk"), F.lit("").alias("subject"), "n")
    )
    return groups.unionByName(thin)


def topic_plan(
    entries: DataFrame,
    key: str,
    title: str,
    topics: Sequence[lx.Topic] = lx.TOPICS,
    url_pattern: str = lx.TOPIC_URL_PATTERN,
    validity: str = "vigencia",
    enabled: bool = False,
) -> DataFrame:
    """Readiness of each (entry, topic); topics are expanded in place, without a join."""

    def plan(topic: lx.Topic) -> Column:
        missing = F.array_compact(
            F.array(*[F.when(~rules.found(F.col(f)), F.lit(f)) for f in topic.minimum_data])
        )
        prudent = F.lit(topic.fallback_policy == "generate_prudent") & rules.found(F.col(validity))
        status = (
            F.when(F.size(missing) == 0, "ready").when(prudent, "prudent").otherwise("blocked")
        )
        places = {"convenioSlug": F.col(key).cast("string"), "topicSlug": F.lit(topic.slug)}
        return F.struct(
            F.lit(topic.slug).alias("topic"),
            status.alias("status"),
            missing.alias("missing"),
            tx.interpolate(url_pattern, places).alias("url"),
            tx.interpolate(topic.title_pattern, {"title": F.col(title)}).alias("page_title"),
            (F.lit(enabled) & (status != "blocked")).alias("published"),
        )

    return entries.select(
        *[c for c in entries.columns if c not in ("topic", "status", "missing", "url")],
        F.inline(F.array(*[plan(t) for t in topics])),
    )


def topic_table_plan(
    entries: DataFrame,
    key: str,
    title: str,
    topics: DataFrame,
    url_pattern: str = lx.TOPIC_URL_PATTERN,
    validity: str = "vigencia",
    enabled: bool = False,
) -> DataFrame:
    """As :func:`topic_plan` for configured topics (slug, titlePattern, minimumData, fallbackPolicy).

    The configuration is one value, which Spark puts into the plan once; entries are not joined.
    """
    listed = topics.agg(
        F.collect_list(F.struct("slug", "titlePattern", "minimumData", "fallbackPolicy"))
    ).scalar()
    texts = [f.name for f in entries.schema.fields if f.dataType.simpleString() == "string"]
    present = F.array_compact(F.array(*[F.when(rules.found(F.col(c)), F.lit(c)) for c in texts]))

    def plan(topic: Column) -> Column:
        missing = F.array_except(F.coalesce(topic["minimumData"], F.array().cast("array<string>")), F.col("__present"))
        prudent = (topic["fallbackPolicy"] == "generate_prudent") & F.array_contains(
            "__present", validity
        )
        status = (
            F.when(F.size(missing) == 0, "ready").when(prudent, "prudent").otherwise("blocked")
        )
        places = {"convenioSlug": F.col(key).cast("string"), "topicSlug": topic["slug"]}
        return F.struct(
            topic["slug"].alias("topic"),
            status.alias("status"),
            missing.alias("missing"),
            tx.interpolate(url_pattern, places).alias("url"),
            tx.interpolate(topic["titlePattern"], {"title": F.col(title)}).alias("page_title"),
            (F.lit(enabled) & (status != "blocked")).alias("published"),
        )

    return entries.withColumns({"__present": present, "__topics": listed}).select(
        *[c for c in entries.columns if c not in ("topic", "status", "missing", "url")],
        F.inline(F.transform("__topics", plan)),
    )


NUMBERED = r"^(.+)_(0[1-9]|[1-9][0-9]+)((?:\.[^./]*)?)$"


def free_names(
    files: DataFrame, name: str, order: str, bucket: Column, existing: DataFrame | None = None
) -> DataFrame:
    """Target names without collisions: repeats get the next free of ``_01``, ``_02`` and so on.

    A number is taken if another file, or one of ``existing`` (column ``name``), bears that name;
    a file whose own name exists is a repeat as well. The n-th free number is n plus the taken
    numbers before it, counted along the numbers of each name.
    """
    numbered = ordinal(files, [name], [order], bucket, "__n")
    names = files.select(F.col(name).alias("__own")).distinct()
    if existing is not None:
        old = existing.select(F.col(name).alias("__own")).distinct()
        numbered = numbered.join(
            old.select(F.col("__own").alias(name), F.lit(1).alias("__old")), name, "left"
        ).withColumn("__n", F.col("__n") + F.coalesce("__old", F.lit(0))).drop("__old")
        names = names.union(old).distinct()
    repeats = numbered.where("__n > 1").select(name).distinct()
    taken = (
        names.where(F.col("__own").rlike(NUMBERED))
        .select(
            F.concat(
                F.regexp_extract("__own", NUMBERED, 1), F.regexp_extract("__own", NUMBERED, 3)
            ).alias(name),
            F.regexp_extract("__own", NUMBERED, 2).cast("bigint").alias("__k"),
        )
        .join(repeats, name, "left_semi")
    )
    step = 10000
    ranked = ordinal(taken, [name], ["__k"], F.floor(F.col("__k") / step), "__i")
    marks = ranked.select(
        name, (F.col("__k") - F.col("__i") + 1).alias("__at"), F.lit(0).alias("__kind"),
        F.lit(1).cast("bigint").alias("__taken"), F.lit(None).cast("bigint").alias("__n"),
    )
    asks = numbered.where("__n > 1").select(
        name, (F.col("__n") - 1).alias("__at"), F.lit(1).alias("__kind"),
        F.lit(0).cast("bigint").alias("__taken"), "__n",
    )
    shifts = (
        running_sum(marks.unionByName(asks), [name], ["__at", "__kind"],
                    F.floor(F.col("__at") / step), "__taken", "__shift")
        .where("__n is not null")
        .select(name, "__n", "__shift")
    )
    stem = tx.strip_extension(F.col(name))
    ending = F.regexp_extract(name, r"(?<=.)(\.[^./]*)$", 1)
    number = (F.col("__n") - 1 + F.col("__shift")).cast("string")
    # lpad cuts long numbers, which must stay whole.
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return (
        numbered.join(shifts, [name, "__n"], "left")
        .withColumn(
            "target",
            F.when(F.col("__n") == 1, F.col(name)).otherwise(
                F.concat(stem, F.lit("_"), padded, ending)
            ),
        )
        .drop("__n", "__shift")
    )


def routes(protected: DataFrame, slugs: DataFrame, prefix: str = "/convenios") -> DataFrame:
    """Route table: kept routes, the index, one per page, the catch-all last."""
    own = (F.col("source") == "**") | (F.col("source") == prefix) | F.col("source").startswith(
        prefix + "/"
    )
    kept = protected.where(~own | F.col("source").isNull()).select(
        F.lit(0).alias("place"), "source", "destination"
    )
    pages = slugs.select(
        F.lit(2).alias("place"),
        F.concat(F.lit(prefix + "/"), "slug").alias("source"),
        F.concat(F.lit("/seo/"), "slug", F.lit(".html")).alias("destination"),
    )
    index = protected.sparkSession.createDataFrame(
        [(1, prefix, f"/seo{prefix}.html"), (3, "**", "/index.html")],
        "place int, source string, destination string",
    )
    return kept.unionByName(pages).unionByName(index)


def site_urls(slugs: DataFrame, site: str, prefix: str = "/convenios") -> DataFrame:
    index = slugs.sparkSession.createDataFrame([(0, site + prefix)], "place int, loc string")
    return index.unionByName(
        slugs.select(
            F.lit(1).alias("place"), F.concat(F.lit(f"{site}{prefix}/"), "slug").alias("loc")
        )
    )


def audit_lines(summary: DataFrame, rejected: DataFrame, issues: DataFrame) -> DataFrame:
    """Audit report as (section, ord, line); the writer sorts it, nobody collects it.

    ``summary`` holds (name, value), ``rejected`` (name, status, reason) and
    ``issues`` (name, issue).
    """

    def section(number: int, ord_: Column, line: Column, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(number).alias("section"), ord_.alias("ord"), line.alias("line"))

    head = F.concat(F.lit("- "), "name", F.lit(": "), F.col("value").cast("string"))
    item = F.concat(F.lit("- "), "name", F.lit(": "))
    to_fix = rejected.where("status = 'corregir'")
    dropped = rejected.where("status = 'no_publicar'")
    return (
        section(1, F.col("name"), head, summary)
        .unionByName(section(2, F.col("name"), F.concat(item, F.col("reason")), to_fix))
        .unionByName(section(3, F.col("name"), F.concat(item, F.col("reason")), dropped))
        .unionByName(section(4, F.col("name"), F.concat(item, F.col("issue")), issues))
    )
