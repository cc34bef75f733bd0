"""Word lists and tables the rules take as arguments.

Everything here is a fixed value: results depend on the exact entries and on
their order. All functions accept other lists in the same shape.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Sector:
    key: str
    labels: tuple[str, ...]
    file_keywords: tuple[str, ...]


@dataclass(frozen=True)
class StatuteRule:
    id: str
    article: str
    topic: str
    query_terms: tuple[str, ...]
    answer: str


@dataclass(frozen=True)
class Topic:
    slug: str
    content_field: str
    title_pattern: str
    minimum_data: tuple[str, ...]
    fallback_policy: str


@dataclass(frozen=True)
class Places:
    """Provinces with aliases, communities with aliases, province -> community."""

    provinces: dict[str, tuple[str, ...]]
    communities: dict[str, tuple[str, ...]] = field(default_factory=dict)
    community_of: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class IntentTerms:
    labour: tuple[str, ...]
    collective: tuple[str, ...]
    current: tuple[str, ...]
    definition: tuple[str, ...]
    general: tuple[str, ...]
    out_of_scope: tuple[str, ...]
    calendar: tuple[str, ...] = ("festivo", "calendario laboral")
    which_agreement: tuple[str, ...] = ("que convenio",)


# Places.
PLACES = Places(
    provinces={
        "GIPUZKOA": ("gipuzkoa", "guipuzcoa", "donostia", "san sebastian", "donosti"),
        "BIZKAIA": ("bizkaia", "vizcaya", "bilbao", "bilbo"),
        "ALAVA": ("alava", "araba", "vitoria", "gasteiz"),
        "NAVARRA": ("navarra", "nafarroa", "pamplona", "iruna"),
        "BARCELONA": ("barcelona",),
        "MADRID": ("madrid",),
        "MALAGA": ("malaga",),
        "SEVILLA": ("sevilla",),
        "VALENCIA": ("valencia",),
        "ZARAGOZA": ("zaragoza",),
    },
    communities={
        "PAIS VASCO": ("pais vasco", "euskadi", "euskal autonomia erkidegoa"),
        "NAVARRA": ("navarra", "comunidad foral de navarra"),
        "CATALUNA": ("cataluna",),
        "COMUNIDAD DE MADRID": ("comunidad de madrid", "madrid"),
        "ANDALUCIA": ("andalucia",),
        "COMUNIDAD VALENCIANA": ("comunidad valenciana", "pais valenciano", "valenciana"),
        "ARAGON": ("aragon",),
    },
    community_of={
        "GIPUZKOA": "PAIS VASCO",
        "BIZKAIA": "PAIS VASCO",
        "ALAVA": "PAIS VASCO",
        "NAVARRA": "NAVARRA",
        "BARCELONA": "CATALUNA",
        "MADRID": "COMUNIDAD DE MADRID",
        "MALAGA": "ANDALUCIA",
        "SEVILLA": "ANDALUCIA",
        "VALENCIA": "COMUNIDAD VALENCIANA",
        "ZARAGOZA": "ARAGON",
    },
)

# Sectors.
SECTORS = (
    Sector(
        "alojamientos",
        ("alojamientos", "alojamiento", "hotel", "hoteles", "hostal", "hostales", "hospedaje",
         "recepcionista", "recepcion"),
        ("alojamientos",),
    ),
    Sector(
        "hosteleria",
        ("hosteleria", "restauracion", "camarero", "camarera", "cocina", "cocinero", "cocinera",
         "bar", "restaurante", "cafeteria"),
        ("hosteleria", "hosteleria y restauracion", "restauracion"),
    ),
    Sector(
        "limpieza",
        ("limpieza", "limpiador", "limpiadora", "limpiar", "oficinas", "edificios", "locales"),
        ("limpieza",),
    ),
    Sector(
        "transporte",
        ("transporte", "transportista", "conductor", "conductora", "chofer", "repartidor",
         "repartidora", "logistica", "camionero", "camionera"),
        ("transporte",),
    ),
)

# Words that settle a question on lodging.
LODGING_SECTOR = "alojamientos"
LODGING_DROPS = "hosteleria"
LODGING_CUES = ("convenio alojamientos", "hotel", "hoteles", "alojamiento", "alojamientos",
                "hospedaje")

# Intent word lists.
INTENT_TERMS = IntentTerms(
    labour=(
        "vacaciones", "jornada", "horas", "hora", "convenio", "permiso", "permisos", "mudanza",
        "traslado de domicilio", "asuntos propios", "baja", "incapacidad", "salario", "smi",
        "nomina", "contrato", "despido", "finiquito", "excedencia", "erte", "ere", "lactancia",
        "maternidad", "paternidad", "conciliacion", "festivos", "festivo", "calendario laboral",
        "plus", "nocturnidad", "antiguedad", "cotizacion", "jubilacion", "sepe",
        "seguridad social", "inspeccion de trabajo", "boda", "matrimonio",
    ),
    collective=(
        "convenio", "vacaciones", "jornada", "horas", "permiso", "permisos", "mudanza",
        "traslado de domicilio", "asuntos propios", "plus", "nocturnidad", "festivos", "festivo",
        "calendario laboral", "boda", "matrimonio", "camarero", "camarera", "cocinero",
        "cocinera", "hotel", "hoteles", "alojamientos", "hosteleria",
    ),
    current=(
        "salario minimo", "smi", "bases de cotizacion", "base de cotizacion",
        "edad de jubilacion", "permiso parental", "reforma laboral", "normativa vigente",
        "vigente", "actual", "actualizado", "actualizada", "seguridad social", "sepe",
        "inspeccion de trabajo",
    ),
    definition=("que es", "que significa", "diferencia entre", "en que consiste"),
    general=(
        "despido objetivo", "despido disciplinario", "ere", "erte", "excedencia voluntaria",
        "antiguedad consolidada", "finiquito", "contrato indefinido", "contrato temporal",
        "baja voluntaria",
    ),
    out_of_scope=(
        "futbol", "mundial", "eurovision", "pelicula", "peliculas", "receta", "recetas",
        "famoso", "famosos", "viaje", "viajes", "apuesta", "apuestas", "videojuego",
        "videojuegos", "clima", "tiempo mañana", "restaurante", "restaurantes", "messi",
        "eurocopa", "champions", "laliga", "netflix", "cancion", "horoscopo",
    ),
)

# Statute rules in order; the first match answers.
STATUTE_NAME = "Estatuto de los Trabajadores"
STATUTE_RULES = (
    StatuteRule(
        "et_art_37_3_traslado_domicilio", "artículo 37.3", "traslado de domicilio habitual",
        ("mudanza", "traslado de domicilio", "domicilio habitual"),
        "Como mínimo legal, tienes derecho a 1 día retribuido por traslado de domicilio "
        "habitual. Este permiso no consume vacaciones.",
    ),
    StatuteRule(
        "et_art_37_3_matrimonio", "artículo 37.3", "matrimonio",
        ("matrimonio", "casarme", "boda"),
        "Como mínimo legal, tienes derecho a 15 días naturales retribuidos por matrimonio.",
    ),
    StatuteRule(
        "et_art_38_vacaciones", "artículo 38", "vacaciones anuales",
        ("vacaciones", "dias de vacaciones"),
        "Como mínimo legal, tienes derecho a 30 días naturales de vacaciones al año.",
    ),
    StatuteRule(
        "et_nacimiento_cuidado_normativa_especifica",
        "normativa específica sobre nacimiento y cuidado", "nacimiento y cuidado",
        ("nacimiento", "paternidad", "maternidad", "cuidado de menor", "cuidado del menor"),
        "No tengo una respuesta exacta en la fuente local mínima. Para nacimiento y cuidado "
        "hay que revisar la normativa específica aplicable.",
    ),
)
STATUTE_PREFIX_WITH_AGREEMENT = (
    "No he encontrado una mejora específica en el convenio recuperado. "
)
STATUTE_PREFIX_WITHOUT_AGREEMENT = (
    "No he encontrado un convenio aplicable con los datos de la pregunta. "
)
NOT_FOUND_ANSWER = "no he encontrado el dato exacto"

# Question cues and chunk cues of the two keyword families.
DAYS_OFF_TERMS = ("dias libres", "dia libre", "permiso", "permisos", "licencia", "licencias")
LEAVE_QUERY = ("mudanza", "traslado", "domicilio", "permiso", "permisos", "licencia", "licencias")
LEAVE_EXACT = ("traslado de domicilio", "domicilio habitual", "mudanza")
LEAVE_HEADERS = ("permisos y licencias", "articulo 16", "remunerados")
DISCIPLINE_QUERY = (
    "falta grave", "faltas graves", "falta muy grave", "faltas muy graves", "despido",
    "despedir", "despedirme", "echar", "echarme", "sancion", "sanciones",
    "regimen disciplinario",
)
DISCIPLINE_EXACT = (
    "faltas graves", "faltas muy graves", "falta grave", "falta muy grave",
    "clases de sanciones", "seccion tercera sanciones", "despido con perdida",
)
DISCIPLINE_HEADERS = (
    "capitulo xii premios faltas sanciones", "premios faltas sanciones",
    "seccion segunda faltas", "seccion tercera sanciones", "articulo 53",
)
# Chunk weights.
DISCIPLINE_WEIGHTS = {
    "despido con perdida": 10,
    "clases de sanciones": 9,
    "seccion tercera sanciones": 8,
    "faltas muy graves": 7,
    "faltas graves": 6,
    "seccion segunda faltas": 5,
    "articulo 53": 4,
    "despido disciplinario": 3,
    "sanciones": 2,
    "representantes de las personas trabajadoras": -4,
    "delegados as sindicales": -4,
}

# Cue words of a Basque question.
BASQUE_CUES = ("eta", "zein", "zer", "nola", "nire", "zuen", "du", "dago", "lan", "opor",
               "soldata", "ordaindu", "anitz")

# Official sources for stored search answers.
OFFICIAL_DOMAINS = (
    "boe.es", "bocm.es", "mites.gob.es", "expinterweb.mites.gob.es",
    "inspecciondetrabajo.mites.gob.es", "seg-social.es", "sepe.es", "euskadi.eus",
    "bopv.euskadi.eus", "gipuzkoa.eus", "bop.gipuzkoa.eus", "bizkaia.eus", "araba.eus",
    "navarra.es", "boletin.navarra.es",
)
SEARCH_LABOUR_TERMS = (
    "convenio", "trabajo", "trabajador", "trabajadora", "laboral", "salario", "sueldo",
    "jornada", "descanso", "vacaciones", "permiso", "asuntos propios", "mudanza",
    "traslado de domicilio", "licencia", "despido", "sancion", "falta", "contrato", "camarero",
    "cocinero", "hotel", "hosteleria", "alojamientos", "baja", "incapacidad", "smi", "nomina",
    "finiquito", "excedencia", "erte", "ere", "lactancia", "maternidad", "paternidad",
    "conciliacion", "festivos", "calendario laboral", "plus", "nocturnidad", "antiguedad",
    "cotizacion", "jubilacion", "sepe", "seguridad social", "inspeccion de trabajo", "limpieza",
    "transporte",
)
SEARCH_OFF_TOPIC_TERMS = ("comprar un coche", "comprar coche", "comprar un auto", "comprar auto")

# Request fields.
REQUEST_FIELDS = ("pregunta", "ciudad", "ciudadActual", "location", "sector", "sectorUsuario",
                  "profesion", "convenioFileName", "file_name", "fileName", "convenioNombre",
                  "convenioId")
QUESTION_MAX_LENGTH = 1200

# Columns of the user row and of an anonymous visit.
USER_EDITABLE = ("email", "fechaRegistro", "ciudadActual", "sectorUsuario", "esHosteleria")
USER_RESERVED = (
    "tipoCuenta", "stripeCustomerId", "subscriptionId", "subscriptionStatus", "billing",
    "billingStatus", "role", "admin", "isPremium", "premium", "createdAt", "updatedBillingAt",
    "stripeSubscriptionId", "stripePriceId", "stripeProductId", "stripeCurrentPeriodEnd",
    "stripeCancelAtPeriodEnd",
)
VISIT_TEXT_FIELDS = ("visit_id", "session_id", "inicio_sesion", "device_class",
                     "browser_family", "os_family", "language", "theme", "load_bucket",
                     "app_version")
VISIT_COUNTERS = ("calendario_clicks", "datos_usuario_clicks", "cambios_mes", "cambios_anio",
                  "modos_seleccionados", "aperturas_premium", "intentos_pdf", "errores")

# Publication.
NOT_FOUND = "No localizado en el texto disponible"
CONTENT_FIELDS = ("vigencia", "ambito", "jornada_anual", "vacaciones", "permisos",
                  "horas_extra", "nocturnidad", "descansos", "festivos_descansos",
                  "fuente_oficial", "fuente_url")
REPORT_FIELDS = {
    "vigencia": "Vigencia",
    "jornada_anual": "Jornada anual",
    "vacaciones": "Vacaciones",
    "permisos": "Permisos",
    "horas_extra": "Horas extra",
    "nocturnidad": "Nocturnidad",
    "descansos": "Descansos",
    "festivos_descansos": "Festivos",
    "fuente_oficial": "Fuente oficial/boletin",
    "fuente_url": "URL del boletin",
}
PRIORITY_SLUGS = (
    "hosteleria-gipuzkoa", "alojamientos-gipuzkoa", "hosteleria-bizkaia", "hosteleria-madrid",
    "alojamientos-alava", "alojamientos-sevilla", "alojamientos-valencia",
    "alojamientos-zaragoza", "limpieza-madrid", "limpieza-gipuzkoa", "limpieza-bizkaia",
    "transporte-madrid", "transporte-valencia", "transporte-sevilla",
)
SECTOR_ORDER = ("hosteleria", "alojamientos", "limpieza", "transporte")
SECTOR_LABELS = {"hosteleria": "Hosteleria", "alojamientos": "Alojamientos",
                 "limpieza": "Limpieza", "transporte": "Transporte"}
MIXED_LODGING_NAME = "alojamientos y hosteleria bizkaia"
BASE_LAW_NAME = "estatuto trabajadores"

# Derived topics (slug, field, title, needed fields, policy).
TOPICS = (
    Topic("jornada-anual", "jornada_anual", "Jornada anual del {title}",
          ("vigencia", "jornada_anual"), "do_not_generate"),
    Topic("vacaciones", "vacaciones", "Vacaciones del {title}",
          ("vigencia", "vacaciones"), "do_not_generate"),
    Topic("permisos", "permisos", "Permisos del {title}",
          ("vigencia", "permisos"), "generate_prudent"),
    Topic("horas-extra", "horas_extra", "Horas extra del {title}",
          ("vigencia", "horas_extra"), "generate_prudent"),
    Topic("nocturnidad", "nocturnidad", "Nocturnidad del {title}",
          ("vigencia", "nocturnidad"), "do_not_generate"),
    Topic("festivos", "festivos_descansos", "Festivos del {title}",
          ("vigencia", "festivos_descansos"), "do_not_generate"),
)
TOPIC_URL_PATTERN = "/convenios/{convenioSlug}/{topicSlug}"

# Page markers that must be present.
PAGE_MARKERS = {
    "title": r"<title>[^<]+</title>",
    "meta_description": r'<meta name="description" content="[^"]+">',
    "canonical": r'<link rel="canonical" href="[^"]+">',
    "open_graph": r'<meta property="og:title" content="[^"]+">',
    "twitter_cards": r'<meta name="twitter:card" content="[^"]+">',
    "json_ld": r'<script type="application/ld\+json">',
    "app_links": r'href="/"',
}

# Sector holidays (city, sector, month, day).
SECTOR_HOLIDAYS = (
    ("Donostia", "transporte", 7, 10),
    ("Donostia", "alojamientos", 7, 29),
    ("Donostia", "hosteleria", 7, 29),
    ("Donostia", "limpieza", 7, 29),
)
HOSPITALITY_SECTORS = ("hosteleria", "alojamientos")
DEFAULT_CITY = "Donostia"
DEFAULT_SECTOR = "general"
WORK_KINDS = ("trabajado", "baja")
OVERTIME_LIMIT = 80
HOURS_PER_DAY = 8
HOLIDAY_CREDIT = 4

# Account state.
FREE_TOTAL_LIMIT = 3
PAID_DAILY_LIMIT = 100
TERMINAL_SUBSCRIPTIONS = ("canceled", "incomplete_expired")
LIVE_SUBSCRIPTIONS = ("active", "trialing", "past_due", "unpaid", "paused")
RECENT_LOGIN_SECONDS = 300

# Answer source -> log event.
ANSWER_EVENTS = {
    "convenio": "convenio_response",
    "estatuto": "statute_response",
    "web_official": "web_official_response",
    "general_labor": "general_labor_response",
    "out_of_scope": "out_of_scope_response",
    "mixed_labor": "mixed_labor_response",
    "clarification": "consultarConvenio_response",
    "unconfirmed": "unconfirmed_response",
    "error": "consultarConvenio_error",
}
DEFAULT_ANSWER_EVENT = "consultarConvenio_response"
