import json

from pyspark.sql import functions as F

from worktide import lexicon as lx
from worktide.plans import monitoring as mo
from worktide.plans import publish as pb
from worktide.plans import worktime as wt
from worktide.sources import files, sinks


def test_pdf_scans(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.pdf", "a.PDF", "c.txt", "sub/d.Pdf"):
        (tmp_path / name).write_bytes(b"x")
    assert {r.file_name for r in files.pdf_files(spark, str(tmp_path)).collect()} == {"b.pdf", "a.PDF", "d.Pdf"}
    assert [r.file_name for r in files.pdf_listing(spark, str(tmp_path)).collect()] == ["a.PDF", "b.pdf"]


def test_overrides_and_topics(spark, tmp_path):
    assert files.overrides(spark, str(tmp_path / "none.json")).count() == 0
    side = tmp_path / "manual.json"
    side.write_text(json.dumps({"version": 1, "entries": [
        {"documento": "a.pdf", "verified": True, "vacaciones": "30"},
        {"documento": "b.pdf", "verified": False, "vacaciones": "31"}]}, indent=1))
    manual = files.overrides(spark, str(side)).withColumnRenamed("documento", "doc")
    rows = spark.createDataFrame([("a.pdf", "x", "y"), ("b.pdf", "x", "y"), ("c.pdf", "x", "y")],
                                 "doc string, vacaciones string, jornada_anual string")
    got = {r.doc: (r.vacaciones, r.jornada_anual, r.manual_fields) for r in
           pb.apply_overrides(rows, manual, "doc", ["vacaciones", "jornada_anual"]).collect()}
    assert got == {"a.pdf": ("30", "y", ["vacaciones"]), "b.pdf": ("x", "y", []), "c.pdf": ("x", "y", [])}

    config = tmp_path / "topics.json"
    config.write_text(json.dumps({"generationEnabled": False, "urlPattern": "/x", "topics": [
        {"slug": "s", "contentField": "f", "titlePattern": "T {title}", "minimumData": ["f", "g"],
         "fallbackPolicy": "generate_prudent"}]}))
    topics = files.topics(spark, str(config))
    entries = spark.createDataFrame([("e1", "t", "x", lx.NOT_FOUND, "x"), ("e2", "t", "x", "y", "z"), ("e3", "t", "", "", "")],
                                    "slug string, title string, f string, g string, vigencia string")
    plan = {r.slug: (r.status, r.missing, r.page_title, r.published) for r in pb.topic_table_plan(entries, "slug", "title", topics).collect()}
    assert plan["e1"] == ("prudent", ["g"], "T t", False)
    assert plan["e2"][0] == "ready" and plan["e3"][0] == "blocked"
    fixed = (lx.Topic("s", "f", "T {title}", ("f", "g"), "generate_prudent"),)
    same = pb.topic_plan(entries, "slug", "title", fixed)
    by_table = pb.topic_table_plan(entries, "slug", "title", topics)
    assert sorted(same.collect(), key=lambda r: r.slug) == sorted(by_table.select(same.columns).collect(), key=lambda r: r.slug)


def test_replace_by_file(spark, tmp_path):
    path, schema = str(tmp_path / "chunks"), "file_name string, chunk string"
    sinks.replace_files(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], schema), path, "file_name", 0)
    sinks.replace_files(spark.createDataFrame([("a", "9")], schema), path, "file_name", 1)
    sinks.replace_files(spark.createDataFrame([("a", "7")], schema), path, "file_name", 1)  # retried

    def stored(where):
        return {(r.file_name, r.chunk) for r in sinks.current_files(spark, where, "file_name").collect()}

    assert stored(path) == {("a", "7"), ("b", "3")}
    sinks.compact_files(spark, path, str(tmp_path / "packed"), "file_name")
    assert stored(str(tmp_path / "packed")) == stored(path)


def test_year_sink_replaces_only_its_years(spark, tmp_path):
    path, schema = str(tmp_path / "years"), "user_id int, year int, goal int, old string"
    sinks.write_years(spark.createDataFrame([(1, 2023, 5, "x"), (1, 2024, 6, "x")], schema), path, ["old"])
    sinks.write_years(spark.createDataFrame([(1, 2024, 7, "x")], schema), path, ["old"])
    stored = spark.read.parquet(path)
    assert stored.columns == ["user_id", "goal", "year"]
    assert {(r.year, r.goal) for r in stored.collect()} == {(2023, 5), (2024, 7)}


def test_latest_row_over_versions(spark, tmp_path):
    path, schema, keys = str(tmp_path / "l"), "user_id int, year int, goal int, v int", ["user_id", "year"]
    sinks.append_version(spark.createDataFrame([(1, 2023, 6, 1), (1, 2024, 8, 1)], schema), path, keys, "v", 0)
    sinks.append_version(spark.createDataFrame([(1, 2024, 0, 0), (2, 2024, 1, 0)], schema), path, keys, "v", 1)
    want = {(1, 2023): 6, (1, 2024): 8, (2, 2024): 1}
    found = sinks.current_latest(spark, path, keys, "v")
    assert {(r.user_id, r.year): r.goal for r in found.collect()} == want
    sinks.compact_latest(spark, path, str(tmp_path / "packed"), keys, "v", "year")
    packed = spark.read.parquet(str(tmp_path / "packed"))
    assert {(r.user_id, r.year): r.goal for r in packed.collect()} == want


def test_reports_round_trip(spark, tmp_path):
    lines = pb.audit_lines(
        spark.createDataFrame([("b", 2), ("a", 1)], "name string, value int"),
        spark.createDataFrame([("f", "corregir", "r1"), ("g", "no_publicar", "r2")], "name string, status string, reason string"),
        spark.createDataFrame([("h", "i")], "name string, issue string"),
    )
    sinks.write_lines(lines, str(tmp_path / "audit"), ["section", "ord"])
    text = [r.value for r in spark.read.text(str(tmp_path / "audit")).collect()]
    assert text == ["- a: 1", "- b: 2", "- f: r1", "- g: r2", "- h: i"]
    entries = spark.createDataFrame([("s", [("q", "a")])], "slug string, faq array<struct<question string, answer string>>")
    sinks.write_inventory(entries, str(tmp_path / "inv"))
    assert spark.read.json(str(tmp_path / "inv")).select("faq.answer").first()[0] == ["a"]


def test_old_and_new_year_documents(spark, tmp_path):
    schema = "user_id int, day_marks map<string,string>"
    spark.createDataFrame([(1, {"2024-01-01": "trabajado", "2024-01-02": "baja"})], schema).write.parquet(str(tmp_path / "u"))
    spark.createDataFrame([(1, {"2024-01-02": "trabajado", "2023-05-05": "otro"})], schema).write.parquet(str(tmp_path / "y"))
    both = files.year_documents(spark, str(tmp_path / "u"), str(tmp_path / "y"))
    marks = wt.overlay(both, ["user_id", "day"])
    assert {(str(r.day), r.kind) for r in wt.year_only(marks, 2024).collect()} == {
        ("2024-01-01", "trabajado"), ("2024-01-02", "trabajado"),
    }


def test_alerts_are_strict_and_gaps_end_runs(spark):
    rows = [(t, "error") for t in (0, 10, 20, 599, 600, 601)]
    df = spark.createDataFrame(rows, "t int, kind string").withColumn("ts", F.timestamp_seconds("t"))
    rule = [mo.Rule("r", "kind = 'error'", 600, 3), mo.Rule("never", "kind = 'x'", 600, 0)]
    assert [(r.rule, r.bucket, r.n) for r in mo.fired(df, rule).collect()] == [("r", 0, 4)]
    points = spark.createDataFrame([("s", b, 11.0) for b in (0, 60, 120, 240)] + [("s", 180, 9.0)], "s string, bucket bigint, p double")
    got = mo.sustained(points, ["s"], "p", 60, 10, 3).collect()
    assert [(r.run_start, r.run_end, r.points) for r in got] == [(0, 180, 3)]
    assert mo.sustained(points, ["s"], "p", 60, 10, 4).count() == 0
