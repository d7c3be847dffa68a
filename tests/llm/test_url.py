from souq.llm import url_filter as U

URLS = [
    (1, "https://a.example.org/es/x"), (2, "http://Example.ORG/en/12"), (3, "http://example.org/en/2"), (4, "https://org"),
    (5, "https://x.com/fr/1?a=/de/"), (6, "https://x.com/de/1"), (7, "ftp://notorg/x"), (8, None), (9, ""), (10, "no scheme.org/"),
    (11, "https://x.com#frag/fr/"), (12, "https://x.com?q=/fr/"), (None, "https://b.net/fr/a"), (13, "https://b.net/fr/a"),
    (13, "https://b.net/fr/a"), (14, "x" * 5000 + "://h.org/"),
]


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in U.judge(spark.createDataFrame([(*u, "z", 1.5) for u in URLS],
                                                               "page_id long, url string, verdict string, score double")).collect()}
    parts = {k: (r.host, r.path, r.rule) for k, r in got.items()}
    assert parts[1] == ("a.example.org", "/es/x", "example.org/es/") and got[1].verdict == "block"
    assert parts[2] == ("example.org", "/en/12", "example.org/en/1") and got[2].verdict == "block"
    assert parts[3][2] == "org/" and got[3].verdict == "allow"
    assert parts[4] == ("org", "", None)
    assert parts[5] == ("x.com", "/fr/1", "com/fr/") and parts[6][2] == "com/de/" and got[6].verdict == "block"
    assert parts[7] == ("notorg", "/x", None)
    for k in (8, 9, 10):
        assert parts[k] == ("", "", None)
    assert got[8].verdict == got[9].verdict == "allow"
    assert parts[11] == ("x.com", "", None) and parts[12] == ("x.com", "", None)
    assert parts[14][2] == "org/"
    assert all(r.verdict in ("allow", "block") for r in got.values())


def test_models_tell_styles_apart(spark):
    good = [(i, f"https://site{i}.org/articles/story-{i}") for i in range(300)]
    bad = [(1000 + i, f"https://x{i}.com/de/win-casino-bonus-{i}") for i in range(300)]
    ask = [(5000 + i, f"https://site{i}.net/articles/story-{i}") for i in range(50)] \
        + [(6000 + i, f"https://x{i}.net/win-casino-bonus-{i}") for i in range(50)]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(good + bad + ask, "page_id long, url string")).collect()}
    assert sum(got[5000 + i].verdict == "allow" for i in range(50)) >= 48
    assert sum(got[6000 + i].verdict == "block" for i in range(50)) >= 48


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "https://b.net/x"), (2, "https://c.net/y")], "page_id long, url string")
    assert [(r.score, r.verdict) for r in U.judge(df).collect()] == [(0.0, "allow")] * 2
    assert U.judge(df.limit(0)).count() == 0
