from worktide.llm import urls


def test_literals_are_whole_tokens():
    assert urls.Rule("||example.net/en/", "allow").literals == ["example", "net", "en"]
    assert urls.Rule("||example.net/en", "allow").literals == ["example", "net"]
    assert urls.Rule("||example.net", "block").literals == ["example", "net"]
    assert urls.Rule("casino", "block").literals == []
    assert urls.Rule("^cheap^pills*", "block").literals == ["cheap"]


def test_index_takes_the_rarest_literal(spark):
    rows = [("http://a.com/x/rare/",)] + [(f"http://a.com/x/{i}/",) for i in range(5)]
    pages = spark.createDataFrame(rows, "url string").withColumn("tokens", urls.tokens(urls.F.col("url")))
    rules = urls._table(spark, [urls.Rule("/x/rare/", "block"), urls.Rule("casino", "block")])
    got = {r.pattern: r.token for r in urls.index(pages, rules).collect()}
    assert got == {"/x/rare/": "rare", "casino": ""}


def test_every_rule_is_found_as_by_trying_all(spark):
    rules = [
        urls.Rule("||example.net", "block"), urls.Rule("||example.net/ok", "allow"), urls.Rule("casino", "block"),
        urls.Rule("/ads/*banner^", "block"), urls.Rule("^safe^", "allow"),
    ]
    given = [
        "http://example.net", "http://example.net/ok", "http://a.example.net/okay?x", "http://badexample.net/",
        "http://x.com/myCASINOs", "http://x.com/ads/1/banner", "http://x.com/ads/1/banners", "http://x.com/safe/casino",
        None, "http://x.com/ads/banner?x", "http://x.com/ads/banner?x",
    ]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(given)], "id int, url string, verdict string")
    got = {r.id: r.verdict for r in urls.judge(pages, rules).collect()}
    want = ["block", "allow", "allow", "allow", "block", "block", "allow", "allow", "allow", "block", "block"]
    assert [got[i] for i in range(len(given))] == want
    kept = urls.keep(pages, rules)
    assert kept.columns == pages.columns
    assert sorted(r.id for r in kept.collect()) == [i for i, w in enumerate(want) if w == "allow"]
