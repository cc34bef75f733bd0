import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from worktide.functions.splitting import split
from worktide.operators.ordered import carry_last, ordinal, running_sum
from worktide.plans import publish as pb
from worktide.plans import retrieval as rt
from worktide.plans import worktime as wt


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows under one key."""
    rnd = random.Random(7)
    rows = [(0 if rnd.random() < 0.4 else rnd.randrange(1, 20), i, rnd.choice([None, "a", "b"]),
             rnd.randrange(5)) for i in range(600)]
    return rows, spark.createDataFrame(rows, "k int, at int, v string, n int").repartition(5)


def test_bucketed_order_matches_a_plain_scan(skewed):
    rows, df = skewed
    bucket = F.floor(F.col("at") / 50)
    out = ordinal(df, ["k"], ["at"], bucket, "pos")
    out = carry_last(out, ["k"], ["at"], bucket, "v", "last_v")
    got = running_sum(out, ["k"], ["at"], bucket, "n", "total").collect()
    pos, last, total, want = Counter(), {}, Counter(), {}
    for k, at, v, n in rows:
        pos[k] += 1
        total[k] += n
        last[k] = v or last.get(k)
        want[at] = (pos[k], last[k], total[k])
    assert {r.at: (r.pos, r.last_v, r.total) for r in got} == want


def test_toggle_matches_a_fold(spark):
    rnd = random.Random(3)
    clicks = [(rnd.randrange(3), "2024-01-0%d" % rnd.randrange(1, 4), rnd.choice("ab"), i)
              for i in range(80)]
    state: dict = {}
    for user, day, kind, _ in clicks:
        if state.get((user, day)) == kind:
            del state[(user, day)]
        else:
            state[(user, day)] = kind
    df = spark.createDataFrame(clicks, "user_id int, day string, kind string, ts int")
    df = df.withColumn("event_id", F.col("ts"))
    got = wt.toggled_marks(df, ["ts", "event_id"]).collect()
    assert {(r.user_id, r.day): r.kind for r in got} == state


def _choose(records):
    """Sequential choice of the latest record per slug."""
    best, out = {}, {}
    for slug, end, ord_, score in records:
        if score < 4:
            out[ord_] = "corregir" if score >= 2 else "no_publicar"
            continue
        held = best.get(slug)
        if held is None or (end or 0) > (held[0] or 0):
            if held:
                out[held[1]] = "sustituido"
            best[slug] = (end, ord_)
        else:
            out[ord_] = "existe"
    out.update({o: "selected" for _, o in best.values()})
    return out


def test_select_latest_matches_the_sequential_rule(spark):
    rnd = random.Random(5)
    records = [("s%d" % (0 if rnd.random() < 0.5 else rnd.randrange(4)),
                rnd.choice([None, 2020, 2021, 2022, 2023]), i, rnd.randrange(1, 9)) for i in range(120)]
    df = spark.createDataFrame(records, "slug string, end_year int, ord int, score int").withColumns(
        {"status": F.lit("candidate"), "reason": F.lit(None).cast("string")}
    )
    rows = pb.select_latest(df).collect()
    got = {
        r.ord: next((w for w in ("sustituido", "existe") if w in (r.reason or "")), r.status)
        for r in rows
    }
    assert got == _choose(records)
    chosen = [r.slug for r in rows if r.status == "selected"]
    assert len(chosen) == len(set(chosen))


def test_related_excludes_self_and_keeps_order(spark):
    rows = [(i, "g%d" % (i % 2), "t%02d" % (20 - i)) for i in range(12)] + [(99, "solo", "x")]
    got = pb.related(spark.createDataFrame(rows, "id int, g string, title string"), "g", "id", "title")
    for r in got.collect():
        want = sorted((t, i) for i, g, t in rows if g == r.g and i != r.id)[:4]
        assert r.related == [i for _, i in want]


def test_free_names_and_long_numbers(spark):
    df = spark.createDataFrame([(i, "a.b.pdf") for i in range(102)], "i int, name string")
    got = {r.i: r.target for r in pb.free_names(df, "name", "i", F.floor(F.col("i") / 10)).collect()}
    assert (got[0], got[1], got[99], got[101]) == ("a.b.pdf", "a.b_01.pdf", "a.b_99.pdf", "a.b_101.pdf")


def test_report_arithmetic(spark):
    """28 pages over ten fields as published: 225 found, 55 missing, sectors of 8 and 9 listed."""
    found = dict(vigencia=28, jornada_anual=21, vacaciones=14, permisos=27, horas_extra=28,
                 nocturnidad=27, descansos=28, festivos_descansos=24, fuente_oficial=23, fuente_url=5)
    sectors = ["limpieza"] * 8 + ["transporte"] * 9 + ["hosteleria"] * 6 + ["alojamientos"] * 5
    missing = pb.lx.NOT_FOUND
    rows = [
        (i, sectors[i], "p%d" % (i % 10), *["x" if i < n else missing for n in found.values()])
        for i in range(28)
    ]
    names = ", ".join(f"{f} string" for f in found)
    entries = spark.createDataFrame(rows, f"slug int, sector string, province string, {names}")
    fields = list(found)
    by_field = {r.field: (r.extracted, r.missing) for r in pb.coverage_by_field(entries, fields).collect()}
    assert by_field == {f: (n, 28 - n) for f, n in found.items()}
    total = pb.totals(pb.coverage_by_page(entries, "slug", pb.lx.REPORT_FIELDS)).first()
    assert (total.extracted, total.missing) == (225, 55)
    assert {r.subject: r.n for r in pb.risks(entries, fields).where("risk = 'group_size'").collect()} == {
        "limpieza": 8, "transporte": 9,
    }


# ---- retrieval -------------------------------------------------------------


def test_split_invariants():
    rnd = random.Random(11)
    for _ in range(60):
        words = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 12))) for _ in range(900)]
        text = "".join(w + rnd.choice([" ", " ", " ", "\n", "\n\n"]) for w in words) 
        text += "".join("%05d" % i for i in range(rnd.randrange(500)))  # one long word
        chunks = split(text)
        assert all(0 < len(c) <= 1000 and c == c.strip() for c in chunks)
        at = 0
        for c in chunks:
            # A short chunk may occur earlier as well; take the place that goes on.
            start = text.find(c, max(0, at - 1200))
            while start >= 0 and start + len(c) <= at:
                start = text.find(c, start + 1)
            assert start >= 0 and not text[at:start].strip(), "text between chunks is lost"
            at = start + len(c)
        assert not text[at:].strip()
    assert split("short") == ["short"]


def test_knn_equals_brute_force_on_a_hot_group(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(90, 8)).round(2)
    base[40:70] = base[40]  # a third are copies
    files = ["hot" if i % 3 else "f%d" % (i % 4) for i in range(90)]
    corpus = spark.createDataFrame(
        [(i, base[i].tolist(), files[i]) for i in range(90)], "chunk_id int, vector array<float>, f string"
    )
    asked = spark.createDataFrame(
        [(i, base[i].tolist(), files[i]) for i in range(0, 90, 4)], "query_id int, vector array<float>, f string"
    )
    got = defaultdict(list)
    found = rt.knn(asked, corpus, 5, on=["f"], query_bytes=4 * 32, corpus_bytes=7 * 32)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    data = np.asarray(base, dtype=np.float32).astype(float)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(0, 90, 4):
        pool = [i for i in range(90) if files[i] == files[q]]
        want = sorted(pool, key=lambda i: (round(1 - unit[q] @ unit[i], 9), i))[:5]
        assert got[q] == want
    one = rt.nearest(corpus, base[0].tolist(), 3).collect()
    assert [r.chunk_id for r in one] == sorted(range(90), key=lambda i: (round(1 - unit[0] @ unit[i], 9), i))[:3]


def test_knn_of_all_rows_in_many_packs(spark):
    """Packs of four queries and seven chunks, with copies across packs and repeated ids."""
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(120, 8)).round(2)
    base[40:60] = base[40]
    corpus = spark.createDataFrame(
        [(i % 110, base[i].tolist()) for i in range(120)], "chunk_id int, vector array<float>"
    ).repartition(3)
    asked = spark.createDataFrame(
        [("q%d" % i, base[i].tolist()) for i in range(0, 120, 3)], "query_id string, vector array<float>"
    ).repartition(2)
    got = defaultdict(list)
    found = rt.knn(asked, corpus, 5, query_bytes=4 * 32, corpus_bytes=7 * 32)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    data = np.asarray(base, dtype=np.float32).astype(float)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(0, 120, 3):
        want = sorted((round(1 - unit[q] @ unit[i], 9), i % 110) for i in range(120))[:5]
        assert got["q%d" % q] == [i for _, i in want]
    # A vector is shuffled once, to make packs even; pairs of packs are read from their tables.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" in plan and "explode" not in plan


def test_knn_of_many_small_groups_and_a_hot_one(spark):
    """Ten thousand groups of one chunk share tiles; a group with a third of all rows is cut."""
    rows = spark.range(15000).select(
        F.col("id").alias("chunk_id"),
        F.when(F.col("id") < 10000, F.col("id")).otherwise(-1).alias("g"),
        F.array(F.sin("id").cast("float"), F.cos(F.col("id") * 3).cast("float")).alias("vector"),
    )
    asked = rows.where("chunk_id < 10000 or chunk_id % 500 = 0").withColumnRenamed("chunk_id", "query_id")
    found = rt.knn(asked, rows, 1, on=["g"], query_bytes=1 << 12, corpus_bytes=1 << 13)
    assert found.where("query_id < 10000 and query_id = chunk_id").count() == 10000
    hot = {r.query_id: r.chunk_id for r in found.where("query_id >= 10000").collect()}
    assert len(hot) == 10
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


@pytest.mark.parametrize("equal", [False, True])
def test_a_full_tile_holds_few_distances_at_once(equal):
    """The matrix of all distances of a full tile has 16 million numbers (134 MB)."""
    rnd = np.random.default_rng(4)

    def side(key, n):
        rows = np.ones((n, 8)) if equal else rnd.normal(size=(n, 8))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 8), pa.array(rows.ravel()))
        return pa.table({key: np.arange(n), "vector": vectors, "__group": [""] * n})

    out = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64())])
    queries, corpus = side("query_id", 2048), side("chunk_id", 8192)
    tracemalloc.start()
    found = rt._block_top_k(3, out)(queries, corpus)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 3 * 2048 and peak < 120e6
    if equal:
        assert found["chunk_id"].to_pylist()[:6] == [0, 1, 2, 0, 1, 2]
        return
    a, b = rt._matrix(queries["vector"])[:50], rt._matrix(corpus["vector"])
    want = [sorted(range(8192), key=lambda j: (round(1 - a[i] @ b[j], 9), j))[:3] for i in range(50)]
    assert found["chunk_id"].to_pylist()[:150] == sum(want, [])


def test_merge_never_repeats_or_exceeds(spark):
    def ranked(ids):
        return spark.createDataFrame([("q", c, p) for p, c in enumerate(ids)], "query_id string, chunk_id int, place int")

    got = rt.merge_ranked([ranked([3, 1]), ranked([1, 7, 8]), ranked([9, 3, 4])], 5)
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [3, 1, 7, 8, 9]


def test_keyword_order_null_index_last(spark):
    rows = [("f", 1, None, "mudanza"), ("f", 2, 5, "permisos y licencias"), ("f", 3, 9, "la mudanza"),
            ("f", 4, 1, "domicilio habitual"), ("f", 5, 0, "nada"), ("g", 6, 0, "mudanza")]
    chunks = spark.createDataFrame(rows, "file_name string, chunk_id int, chunk_index int, text string")
    refs = spark.createDataFrame([("q", "f")], "query_id string, file_name string")
    got = rt.keyword_chunks(refs, rt.leave_hits(chunks), 5).orderBy("place").collect()
    assert [r.chunk_id for r in got] == [4, 3, 1, 2]


def test_context_layout(spark):
    rows = [("q", "especifica", 1, "b.pdf", "dos"), ("q", "base", 1, "a.pdf", "uno"), ("q", "especifica", 2, None, "tres")]
    df = spark.createDataFrame(rows, "query_id string, source string, rank int, file_name string, text string")
    assert rt.context(df).first().context == (
        "[NORMA BASE - ESTATUTO]\nFuente: a.pdf\nuno\n\n===\n\n[NORMA ESPECÍFICA - CONVENIO]\n"
        "Fuente: b.pdf\ndos\n\n---\n\n[NORMA ESPECÍFICA - CONVENIO]\nFuente: Fragmento 2\ntres"
    )


def test_embedding_retries_and_counts(spark):
    chunks = spark.createDataFrame([(i, "t%d" % i, "x") for i in range(7)], "id int, chunk string, title string").coalesce(1)

    def limited():
        calls = []

        def run(texts, titles):
            calls.append(len(texts))
            if len(calls) % 2:
                raise rt.RateLimited(0)
            assert len(texts) <= 3
            return np.ones((len(texts), 2))

        return run

    assert rt.embed(chunks, limited, batch=3).where("size(vector) = 2").count() == 7
    with pytest.raises(Exception, match="gave 1 vectors"):
        rt.embed(chunks, lambda: (lambda texts, titles: np.ones((1, 2))), batch=3).collect()


def test_users_of_longer_periods_from_days(spark):
    from datetime import datetime, timedelta

    from worktide.plans import monitoring as mo

    rows = [(datetime(2024, 1, 1) + timedelta(days=d, seconds=u), u + 500 * (d % 3), k)
            for d in range(40) for u, k in [*((u, "big") for u in range(0, 3000, 3)), *((u, "small") for u in range(20))]]
    df = spark.createDataFrame([*rows, *rows[:100], (datetime(2024, 1, 1), None, "small")], "ts timestamp, user_id bigint, kind string")
    days = mo.daily_users(df, few=100).cache()
    assert {(r.users, r.few is None) for r in days.where("kind = 'big'").collect()} == {(1000, True)}
    exact = {}
    for ts, user, kind in rows:
        start = (ts - timedelta(days=ts.weekday())).date()
        for unit, period in (("week", start), ("month", ts.date().replace(day=1))):
            exact.setdefault((unit, str(period), kind), set()).add(user)
    for unit in ("week", "month"):
        for r in mo.period_users(days, unit).collect():
            want = len(exact.pop((unit, str(r.period), r.kind)))
            assert r.exact == (r.kind == "small")
            assert r.users == want if r.exact else abs(r.users - want) <= 0.02 * want
    assert not exact
