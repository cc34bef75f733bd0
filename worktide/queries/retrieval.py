"""Retrieval queries: documents with their vectors play chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.functions import rules
from worktide.functions import text as tx
from worktide.operators.computed import computed
from worktide.operators.staging import stage
from worktide.plans import answers as an
from worktide.plans import pruned
from worktide.plans import retrieval as rt
from worktide.queries import intents as it
from worktide.queries import sqltext as sq
from worktide.queries.catalog import RESOLVE_SQL, resolved
from worktide.queries import registry
from worktide.queries.registry import query
from worktide.sources.tables import table

LEAVE_Q, LEAVE_EXACT, LEAVE_HEADERS = ("and", "que"), ("thre", "ered"), ("ing the", "eaux")
RULES_Q, RULES_EXACT, RULES_HEADERS = ("the", "der"), ("whst", "ungs"), ("heon", "cion")
WEIGHTS = {"whst": 10, "heon": 7, "thea": 5, "ering": 2, "than": -4, "onou": -4}


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label"
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """All documents, those with a vector by its label's file; label 0 is the base law."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        "text",
        F.when(F.col("lang") != "de", F.floor(F.col("doc_id") / 10).cast("int")).alias(
            "chunk_index"
        ),
    )
    rows = docs.join(vectors(spark, d), "chunk_id", "left").withColumn(
        "label", F.coalesce("label", (F.col("chunk_id") % 10).cast("int"))
    )
    return rows.select(
        "*",
        F.concat(F.lit("file"), "label", F.lit(".pdf")).alias("file_name"),
        F.when(F.col("label") == 0, "base").otherwise("especifico").alias("doc_type"),
    )


@query(
    "knn_base",
    """
with p as (
  select v.conv_id || '-' || v.turn as query_id, c.vec_id as chunk_id,
         round(1 - list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as distance
  from conversations v join embeddings q on q.vec_id = v.conv_id join embeddings c on c.label = 0
  where role = 'user')
select query_id, chunk_id, round(distance, 6) as distance,
       row_number() over (partition by query_id order by distance, chunk_id)::int as rank
from p qualify rank <= 2""",
)
def knn_base(spark: SparkSession, d: str) -> DataFrame:
    """Two nearest base chunks of every question."""
    corpus = vectors(spark, d)
    asked = questions(spark, d).select("query_id", "vector")
    return rt.knn(asked, corpus.where("label = 0"), 2).withColumn(
        "distance", F.round("distance", 6)
    )


@query(
    "knn_file",
    """
with p as (
  select q.vec_id as query_id, c.vec_id as chunk_id,
         round(1 - list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as distance
  from embeddings q join embeddings c on c.label = q.label)
select query_id, chunk_id, round(distance, 6) as distance,
       row_number() over (partition by query_id order by distance, chunk_id)::int as rank
from p qualify rank <= 5""",
)
def knn_file(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest chunks of every vector inside its own file."""
    corpus = vectors(spark, d)
    asked = corpus.withColumnRenamed("chunk_id", "query_id")
    return rt.knn(asked, corpus, 5, on=["label"]).withColumn("distance", F.round("distance", 6))


@query(
    "knn_batch",
    """
with p as (
  select v.conv_id || '-' || v.turn as query_id, c.vec_id as chunk_id,
         round(1 - list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as distance
  from conversations v join embeddings q on q.vec_id = v.conv_id cross join embeddings c where role = 'user')
select query_id, chunk_id, round(distance, 6) as distance,
       row_number() over (partition by query_id order by distance, chunk_id)::int as rank
from p qualify rank <= 5""",
)
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest chunks of every question."""
    corpus = vectors(spark, d)
    asked = questions(spark, d).select("query_id", "vector")
    return rt.knn(asked, corpus, 5).withColumn("distance", F.round("distance", 6))


@query("knn_pruned", registry.ORACLES["knn_batch"])
def knn_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest chunks of every question, from the blocks that may hold them."""
    asked = questions(spark, d).select("query_id", "vector")
    best, _ = pruned.knn(asked, pruned.Index(vectors(spark, d), block_bytes=1 << 14), 5)
    return best.withColumn("distance", F.round("distance", 6))


_WEIGHT_SQL = " + ".join(
    f"case when contains(norm, '{p}') then {w} else 0 end" for p, w in WEIGHTS.items()
)


@query(
    "keyword_rank",
    f"""
with n as (
  select doc_id, source, case when lang <> 'de' then doc_id // 10 end as idx, {sq.norm('text')} as norm
  from documents),
t as (
  select *, case when {sq.has_any('norm', RULES_EXACT)} then 0
                 when {sq.has_any('norm', RULES_HEADERS)} then 1 end as tier, {_WEIGHT_SQL} as score
  from n),
r as (
  select *, row_number() over (partition by source order by tier, score desc, idx nulls last, doc_id) as rn
  from t where tier is not null)
select source as file_name, doc_id as chunk_id, tier::int as tier, score::int as score,
       row_number() over (partition by source order by idx nulls last, doc_id)::int as place
from r where rn <= 8""",
)
def keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    """Best eight keyword chunks per source, back in reading order."""
    docs = table(spark, d, "documents").select(
        F.col("source").alias("file_name"),
        F.col("doc_id").alias("chunk_id"),
        F.when(F.col("lang") != "de", F.floor(F.col("doc_id") / 10).cast("int")).alias(
            "chunk_index"
        ),
        "text",
    )
    hits = rt.tier_hits(docs, RULES_EXACT, RULES_HEADERS, 8, WEIGHTS)
    refs = hits.select("file_name").distinct().select(F.col("file_name").alias("query_id"), "file_name")
    placed = rt.keyword_chunks(refs, hits, 8, by_index=True)
    return hits.join(placed.select("chunk_id", "place"), "chunk_id").select(
        "file_name", "chunk_id", "tier", "score", "place"
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the vector of their conversation."""
    turns = (
        table(spark, d, "conversations")
        .where("role = 'user'")
        .select(
            F.concat_ws("-", "conv_id", "turn").alias("query_id"),
            F.col("conv_id").alias("chunk_id"),
            "text",
        )
    )
    turns = computed(turns, {"norm": tx.normalize(F.col("text"))}).drop("text")
    return turns.join(vectors(spark, d), "chunk_id").drop("chunk_id")


def references(asked: DataFrame) -> DataFrame:
    """Files a question refers to: its own and the next, with and without ``.pdf``."""
    names = F.array(
        F.concat(F.lit("file"), "label"),
        F.concat(F.lit("file"), (F.col("label") + 1) % 10, F.lit(".pdf")),
        F.concat(F.lit("file"), "label", F.lit(".pdf")),
    )
    return asked.select(
        "query_id", "norm", "vector", F.explode(tx.with_pdf_names(names)).alias("file_name")
    )


def hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base rows and merged specific rows of every question, and the questions.

    Folded questions and keyword hits are written once; several branches follow. Only the vector
    branch needs a vector.
    """
    asked = stage(questions(spark, d))
    refs = references(asked)
    corpus = chunks(spark, d)
    # The normalised text is needed only by the keyword branches; the vector
    # branch reads the vectors alone.
    vecs = vectors(spark, d).withColumn(
        "file_name", F.concat(F.lit("file"), "label", F.lit(".pdf"))
    )
    specific = corpus.where("doc_type = 'especifico'").drop("vector")
    families = {
        "leave": (LEAVE_EXACT, LEAVE_HEADERS, 5, {}),
        "rules": (RULES_EXACT, RULES_HEADERS, 8, WEIGHTS),
    }
    hits = stage(rt.tier_families(specific, families))
    leave = rt.keyword_chunks(
        refs.where(rules.has_any(F.col("norm"), LEAVE_Q)).select("query_id", "file_name"),
        hits.where("family = 'leave'"),
        5,
    )
    discipline = rt.keyword_chunks(
        refs.where(rules.has_any(F.col("norm"), RULES_Q)).select("query_id", "file_name"),
        hits.where("family = 'rules'"),
        8,
        by_index=True,
    )
    near = rt.knn(
        refs.select("query_id", "vector", "file_name"),
        vecs.where("label <> 0"), 5, on=["file_name"],
    )
    merged = rt.merge_ranked(
        [leave, discipline, near.select("query_id", "chunk_id", F.col("rank").alias("place"))], 10
    )
    base = rt.knn(asked.select("query_id", "vector"), vecs.where("label = 0"), 2)
    columns = ("query_id", "chunk_id", "rank")
    return base.select(*columns), merged.select(*columns), asked


HYBRID_SQL = f"""
ch as (
  select doc_id as chunk_id, text, 'file' || coalesce(label, doc_id % 10) || '.pdf' as file_name,
         coalesce(label, doc_id % 10) as label, embedding,
         case when lang <> 'de' then doc_id // 10 end as idx, {sq.norm('text')} as norm
  from documents left join embeddings on doc_id = vec_id),
ct as (
  select *, case when {sq.has_any('norm', LEAVE_EXACT)} then 0
                 when {sq.has_any('norm', LEAVE_HEADERS)} then 1 end as lt,
         case when {sq.has_any('norm', RULES_EXACT)} then 0
              when {sq.has_any('norm', RULES_HEADERS)} then 1 end as rt, {_WEIGHT_SQL} as score
  from ch),
qs as (
  select conv_id || '-' || turn as query_id, {sq.norm('text')} as nq, label, embedding
  from conversations join embeddings on vec_id = conv_id where role = 'user'),
refs as (
  select query_id, nq, embedding, unnest(['file' || label || '.pdf', 'file' || ((label + 1) % 10) || '.pdf'])
           as file_name
  from qs),
pairs as (
  select r.query_id, r.nq, c.*,
         round(1 - list_cosine_similarity(r.embedding::double[], c.embedding::double[]), 9) as distance
  from refs r join ct c on r.file_name = c.file_name where c.label <> 0),
lv as (
  select query_id, chunk_id, row_number() over (partition by query_id order by lt, idx nulls last, chunk_id)
           as place
  from pairs where lt is not null and {sq.has_any('nq', LEAVE_Q)} qualify place <= 5),
d0 as (
  select query_id, chunk_id, idx from pairs where rt is not null and {sq.has_any('nq', RULES_Q)}
  qualify row_number() over (partition by query_id order by rt, score desc, idx nulls last, chunk_id) <= 8),
ds as (
  select query_id, chunk_id, row_number() over (partition by query_id order by idx nulls last, chunk_id)
           as place from d0),
vc as (
  select query_id, chunk_id, row_number() over (partition by query_id order by distance, chunk_id) as place
  from pairs where distance is not null qualify place <= 5),
al as (
  select 0 as l, * from lv union all select 1, * from ds union all select 2, * from vc),
fi as (
  select query_id, chunk_id, min(l * 100 + place) as pos from al group by 1, 2),
merged as (
  select query_id, chunk_id, row_number() over (partition by query_id order by pos, chunk_id)::int as rank
  from fi qualify rank <= 10),
base as (
  select q.query_id, c.vec_id as chunk_id,
         row_number() over (partition by query_id order by
           round(1 - list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9), c.vec_id)::int
           as rank
  from qs q join embeddings c on c.label = 0 qualify rank <= 2)
"""


@query(
    "hybrid_merge",
    f"""
with {HYBRID_SQL}
select query_id, 'base' as source, rank, chunk_id from base
union all select query_id, 'especifica', rank, chunk_id from merged
union all select query_id, 'base_local', 1, -1 from qs where {sq.has_any('nq', it.RULES[2].query_terms)}
  and not {sq.has_any('nq', [*it.RULES[0].query_terms, *it.RULES[1].query_terms])}""",
)
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    base, merged, asked = hybrid(spark, d)
    statute = (
        asked.where(rules.statute_rule(F.col("norm"), it.RULES) == "r3")
        .select("query_id", F.lit(1).alias("rank"))
    )
    return rt.sources(base, merged, statute).withColumn(
        "chunk_id", F.coalesce("chunk_id", F.lit(-1))
    )


@query(
    "context_block",
    f"""
with {HYBRID_SQL},
parts as (
  select query_id, 0 as s, rank, 'NORMA BASE - ESTATUTO' as tag, chunk_id from base
  union all select query_id, 1, rank, 'NORMA ESPECÍFICA - CONVENIO', chunk_id from merged),
t as (
  select query_id, s, string_agg('[' || tag || ']' || chr(10) || 'Fuente: ' || file_name || chr(10) || text,
           chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as block
  from parts join ch using (chunk_id) group by 1, 2)
select query_id, md5(string_agg(block, chr(10) || chr(10) || '===' || chr(10) || chr(10) order by s)) as digest,
       length(string_agg(block, chr(10) || chr(10) || '===' || chr(10) || chr(10) order by s))::int as n
from t group by 1""",
)
def context_block(spark: SparkSession, d: str) -> DataFrame:
    base, merged, _ = hybrid(spark, d)
    ranked = base.withColumn("source", F.lit("base")).unionByName(
        merged.withColumn("source", F.lit("especifica"))
    )
    texts = chunks(spark, d).select("chunk_id", "file_name", "text")
    return rt.context(ranked.join(texts, "chunk_id")).select(
        "query_id", F.md5("context").alias("digest"), F.length("context").alias("n")
    )


@query(
    "file_choice",
    """
with p as (
  select q.vec_id as query_id, c.label, c.vec_id as chunk_id,
         round(1 - list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as distance
  from embeddings q join embeddings c on c.label <> 0),
t as (
  select *, row_number() over (partition by query_id order by distance, chunk_id) as rank
  from p qualify rank <= 3),
f as (select query_id, 'file' || label || '.pdf' as file_name, min(rank) as r from t group by 1, 2)
select query_id, file_name, row_number() over (partition by query_id order by r)::int as position from f""",
)
def file_choice(spark: SparkSession, d: str) -> DataFrame:
    """Files of the three nearest specific chunks, in first-seen order."""
    corpus = vectors(spark, d)
    asked = corpus.withColumnRenamed("chunk_id", "query_id")
    near = rt.knn(asked, corpus.where("label <> 0"), 3)
    named = near.join(
        corpus.select("chunk_id", F.concat(F.lit("file"), "label", F.lit(".pdf")).alias("file_name")),
        "chunk_id",
    )
    return rt.names_in_order(named)


@query(
    "chunk_diagnostics",
    """
with p as (
  select q.vec_id as query_id, c.vec_id as chunk_id, c.label,
         round(1 - list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as distance
  from embeddings q join embeddings c on c.label <> 0),
t as (
  select *, row_number() over (partition by query_id order by distance, chunk_id) as rank
  from p qualify rank <= 3)
select query_id, string_agg('file' || label || '.pdf', '|' order by rank) as files,
       round(min(distance), 6) as nearest
from t group by 1""",
)
def chunk_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Files and distances of the three nearest specific chunks, without their text."""
    corpus = vectors(spark, d)
    asked = corpus.withColumnRenamed("chunk_id", "query_id")
    near = rt.knn(asked, corpus.where("label <> 0"), 3)
    named = near.join(
        corpus.select("chunk_id", F.concat(F.lit("file"), "label", F.lit(".pdf")).alias("file_name")),
        "chunk_id",
    )
    lists = named.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "file_name", "distance"))).alias("chunks")
    )
    view = rt.redacted(F.col("chunks"))
    return lists.select(
        "query_id",
        F.array_join(view["file_name"], "|").alias("files"),
        F.round(F.array_min(view["distance"]), 6).alias("nearest"),
    )


# ---- chunking and embedding ----------------------------------------------


@query(
    "chunk_fixed",
    """
with l as (
  select doc_id, source, text, greatest(0, ceil((length(text) - 1000) / 800.0))::int as last_
  from documents where length(text) > 0),
c as (select *, unnest(range(0, last_ + 1))::int as chunk_index from l)
select doc_id, doc_id || '_' || lpad((chunk_index + 1)::varchar, 4, '0') as chunk_id, chunk_index,
       (last_ + 1)::int as chunk_total, md5(substr(text, chunk_index * 800 + 1, 1000)) as digest
from c""",
)
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rt.fixed_chunks(docs, "doc_id", "text").select(
        "doc_id", "chunk_id", "chunk_index", "chunk_total", F.md5("chunk").alias("digest")
    )


@query(
    "ingest_totals",
    """
with l as (
  select source, text, greatest(0, ceil((length(text) - 1000) / 800.0))::int as last_
  from documents where length(text) > 0),
c as (select source, length(substr(text, unnest(range(0, last_ + 1))::int * 800 + 1, 1000)) as n from l),
f as (select source, count(*) as chunks, sum(n)::bigint as chars from c group by 1)
select coalesce(source, '*') as source, sum(chunks)::bigint as chunks, sum(chars)::bigint as chars,
       count(*) as files
from f group by rollup(source)""",
)
def ingest_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    totals = rt.ingest_totals(rt.fixed_chunks(docs, "doc_id", "text"), "source")
    return totals.withColumn("source", F.coalesce("source", F.lit("*")))


@query(
    "chunk_recursive",
    f"""
select doc_id, true as bounded, true as in_order, true as covered, true as numbered from (
  select doc_id, {sq.squeeze('text')} as t from documents) where t <> ''""",
)
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    """Per document: chunks within the size, found in the cleaned text one after another, with only
    white space between and around them, and numbered without gap."""
    docs = table(spark, d, "documents").select(
        "doc_id", tx.clean_extracted(F.col("text")).alias("text")
    )
    parts = rt.recursive_chunks(docs, "doc_id", "text")
    # A text has no more chunks than its length allows.
    lists = parts.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_total", "chunk"))).alias("parts")
    )
    folded = F.expr("""
        aggregate(parts, named_struct('start', 0, 'end', 0, 'ok', true, 'covered', true),
          (a, p) -> transform(array(locate(p.chunk, text, a.start + 1)), s -> named_struct(
            'start', s, 'end', greatest(a.end, s + length(p.chunk) - 1), 'ok', a.ok and s > 0,
            'covered', a.covered and substring(text, a.end + 1, s - a.end - 1) rlike '^\\\\s*$'))[0],
          a -> named_struct('ok', a.ok, 'covered', a.covered and substring(text, a.end + 1) rlike '^\\\\s*$'))
    """)
    sizes = F.transform("parts", lambda p: F.length(p["chunk"]))
    # In a text that repeats itself a chunk has several places; there the ends and the amount count.
    repeats = F.expr("exists(parts, p -> locate(p.chunk, text, locate(p.chunk, text) + 1) > 0)")
    amount = F.expr("""
        startswith(text, parts[0].chunk) and endswith(text, element_at(parts, -1).chunk)
        and aggregate(parts, 0, (n, p) -> n + length(regexp_replace(p.chunk, '\\\\s', '')))
            >= length(regexp_replace(text, '\\\\s', ''))
    """)
    return lists.join(docs, "doc_id").withColumn("f", folded).select(
        "doc_id",
        (F.array_max(sizes) <= 1000).alias("bounded"),
        F.col("f.ok").alias("in_order"),
        (F.col("f.covered") | (repeats & amount)).alias("covered"),
        F.forall(
            "parts",
            lambda p: (p["chunk_total"] == F.size("parts"))
            & (F.get("parts", p["chunk_index"])["chunk_index"] == p["chunk_index"]),
        ).alias("numbered"),
    )


@query(
    "embed_batch",
    """
with l as (
  select doc_id, source, text, greatest(0, ceil((length(text) - 1000) / 800.0))::int as last_
  from documents where length(text) > 0),
c as (select *, unnest(range(0, last_ + 1))::int as chunk_index from l)
select doc_id, chunk_index, 16 as dims,
       upper(md5(source || chr(10) || substr(text, chunk_index * 800 + 1, 1000))) as bytes from c""",
)
def embed_batch(spark: SparkSession, d: str) -> DataFrame:
    """Vectors compared by value: the test model returns digest bytes."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    parts = rt.fixed_chunks(docs, "doc_id", "text")
    embedded = rt.embed(parts, rt.digest_model(), "chunk", "source")
    codes = F.transform("vector", lambda x: F.lpad(F.hex(F.round(x * 255).cast("bigint")), 2, "0"))
    return embedded.select(
        "doc_id", "chunk_index", F.size("vector").alias("dims"), F.array_join(codes, "").alias("bytes")
    )


# ---- answer routing --------------------------------------------------------


@query(
    "answer_route",
    f"""
with {RESOLVE_SQL}, {HYBRID_SQL}, {it.TRIAGE_SQL},
intents as (
  select conv_id, turn, case
    when nq = '' then 'needs_clarification'
    when {it._hit(it.TERMS.out_of_scope)} and {it._hit(it.TERMS.labour)} then 'mixed_labor'
    when {it._hit(it.TERMS.out_of_scope)} then 'out_of_scope'
    when not {it._hit(it.TERMS.labour)} then 'out_of_scope'
    when {it._hit(it.TERMS.current)} or {it._hit(it.TERMS.calendar)} then 'current_labor'
    when {it._hit(it.TERMS.definition)} and {it._hit(it.TERMS.general)} then 'general_labor'
    when {it._hit(it.TERMS.which_agreement)} and (len(provinces) = 0 or len(sectors) = 0)
      then 'needs_clarification'
    when {it._hit(it.TERMS.collective)} then 'collective_agreement'
    else 'general_labor' end as intent,
    case {it.STATUTE_CASE} end as rule
  from asked),
k as (select query_id, count(*) as n from merged group by 1),
rep as (
  select conv_id, turn - 1 as turn, contains({sq.norm('text')}, 'thnd') as nf, length(text) < 1000 as complete
  from conversations where role = 'assistant'),
j as (
  select r.conv_id, r.turn, i.intent, i.rule, r.status, r.turn > 2 as has_ref,
         case when rep.turn is null then 0 else 2 end as nb,
         case when rep.turn is null then 0 else coalesce(k.n, 0) end as ns,
         coalesce(nf, false) as nf, coalesce(complete, false) as complete,
         coalesce(t.reason = 'web_grounded', false) as su, coalesce(t.reason, 'web_fallback_disabled') as sr
  from resolved r join intents i using (conv_id, turn) left join rep using (conv_id, turn)
  left join k on k.query_id = r.conv_id || '-' || r.turn left join triaged t on t.page_id = r.conv_id),
o as (
  select *, case
    when intent in ('out_of_scope', 'mixed_labor') then intent
    when intent = 'needs_clarification' then 'clarification'
    when intent = 'current_labor' then case when su then 'web_official' else 'unconfirmed' end
    when intent = 'general_labor' then 'general_labor'
    when not has_ref and status in ('missing_all', 'missing_sector', 'missing_location', 'ambiguous')
      then 'clarification'
    when not has_ref and status = 'not_found' and rule is not null then 'estatuto'
    when not has_ref and status = 'not_found' then case when su then 'web_official' else 'unconfirmed' end
    when nb + ns = 0 and rule is not null then 'estatuto'
    when nb + ns = 0 then case when su then 'web_official' else 'unconfirmed' end
    when nf and rule is not null and complete then 'estatuto'
    when nf and rule is null and sr <> 'web_fallback_disabled'
      then case when su then 'web_official' else 'unconfirmed' end
    when not complete then 'unconfirmed' else 'convenio' end as response_source
  from j)
select conv_id, turn, intent, status as catalog_status, response_source,
       case response_source when 'convenio' then 'convenio_response' when 'estatuto' then 'statute_response'
         when 'clarification' then 'consultarConvenio_response' else response_source || '_response' end as event
from o""",
)
def answer_route(spark: SparkSession, d: str) -> DataFrame:
    """Answer source of every question, from intent, catalogue, chunks and stored search."""
    verdict = rules.intent(F.col("question"), F.col("provinces"), F.col("sectors"), it.TERMS)
    asked = resolved(spark, d).select(
        "conv_id",
        "turn",
        verdict["intent"].alias("intent"),
        rules.statute_rule(F.col("question"), it.RULES).alias("statute_rule"),
        F.col("status").alias("catalog_status"),
        (F.col("turn") > 2).alias("has_reference"),
        F.concat_ws("-", "conv_id", "turn").alias("query_id"),
    )
    replies = table(spark, d, "conversations").where("role = 'assistant'").select(
        "conv_id",
        (F.col("turn") - 1).alias("turn"),
        tx.normalize(F.col("text")).contains("thnd").alias("not_found"),
        (F.length("text") < 1000).alias("complete"),
        F.lit(True).alias("replied"),
    )
    counts = hybrid(spark, d)[1].groupBy("query_id").agg(F.count("*").alias("n"))
    search = it.triaged(spark, d).select(
        F.col("page_id").alias("conv_id"), F.col("used").alias("search_used"),
        F.col("reason").alias("search_reason"),
    )
    replied = F.col("replied").isNotNull()
    rows = (
        asked.join(replies, ["conv_id", "turn"], "left")
        .join(counts, "query_id", "left")
        .join(search, "conv_id", "left")
        .withColumns(
            {
                "n_base": F.when(replied, 2).otherwise(0),
                "n_specific": F.when(replied, F.coalesce("n", F.lit(0))).otherwise(0),
                "not_found": F.coalesce("not_found", F.lit(False)),
                "complete": F.coalesce("complete", F.lit(False)),
                "search_used": F.coalesce("search_used", F.lit(False)),
                "search_reason": F.coalesce("search_reason", F.lit("web_fallback_disabled")),
            }
        )
    )
    return an.route(rows).select(
        "conv_id", "turn", "intent", "catalog_status", "response_source", "event"
    )
