from isohypse.llm import urls as U


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


EDGE = [(-1, None), (-2, "nohost"), (-3, "HTTP://A.Example.COM?x"), (-4, "a://b://c/en/#"), (-5, "http://example.com/en/7"), (-6, "x://com/en/"), (-7, "x://notexample.com/en/7"), (-8, "://"), (-9, "http://u:p@x.org:80/es/?a=://"), (-9, "http://u:p@x.org:80/es/?a=://"), (None, "h://\u00c9.net/de/8")]


def test_rules_and_parts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").union(spark.createDataFrame(EDGE, "page_id long, url string"))
    got = sorted((str(r.page_id), r.host, r.path, r.rule or "") for r in U.judge(pages).collect())
    rows = pages.collect()
    assert got == sorted((str(r.page_id), *brute(r.url)[:2], brute(r.url)[2] or "") for r in rows)
    for r in U.judge(pages).where("rule IS NOT NULL").collect():
        assert r.verdict == next(v for v, h, p in U.RULES if h + p == r.rule)
    assert U.judge(pages).where("verdict NOT IN ('allow', 'block')").count() == 0


def test_templates_take_the_verdict_of_their_labelled_urls(spark):
    rows = [(i, f"http://a.test/bad/{i}") for i in range(30)] + [(100 + i, f"http://a.test/good/{i}") for i in range(30)] + [(200 + i, f"http://a.test/bad/item-{i}") for i in range(30)]
    rows += [(300 + i, f"http://a.test/tag/{w}") for i, w in enumerate("".join(chr(97 + (i * k) % 26) for k in range(1, 6)) for i in range(60))]
    rules = (("block", "a.test", "/bad/1"), ("block", "a.test", "/bad/2"), ("allow", "a.test", "/good/1"))
    out = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert out[5].rule is None and out[5].verdict == "block" and out[5].template == "/bad/*"
    assert out[105].verdict == "allow" and out[105].rule is None
    assert out[300].template == "/tag/*" and out[300].verdict == "allow"


def test_templates_without_labels_take_those_above_them(spark):
    rows = [(i, f"http://spam.example.com/en/{i + 100}") for i in range(1, 61) if i % 10] + [(100, "http://spam.example.com/fr/x"), (101, "http://spam.example.com/"), (102, "http://spam.example.com")]
    rows += [(200 + i, f"http://rare.example.com/en/2{i}") for i in range(2)] + [(210, "http://rare.example.com/fr/x"), (211, "http://none.example.com/fr/x")]
    rows += [(300 + i, f"http://even.example.com/en/{i}") for i in (*range(70, 80), *range(10, 20))] + [(400, "http://even.example.com/fr/x")]
    out = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}  # the production rules
    assert all(out[i].rule is None and out[i].verdict == "block" for i in (100, 101, 102))
    assert all(out[i].rule is None and out[i].verdict == "allow" for i in (210, 211, 400))
    # the nearest node decides, not the host
    rows = [(i, f"http://a.test/x/bad/{i}") for i in range(20)] + [(100 + i, f"http://a.test/y/{i}") for i in range(40)] + [(200, "http://a.test/x/new/q"), (201, "http://a.test/z/new/q")]
    rules = (("block", "a.test", "/x/bad/"), ("allow", "a.test", "/y/"))
    out = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert out[200].verdict == "block" and out[201].verdict == "allow"


def test_verdicts_are_those_of_the_contract(spark):
    rows = [(1, "x://a.com/en/1"), (2, "x://example.com/en/7"), (3, "x://a.net/de/1"), (4, "x://example.net/de/8"), (5, "x://www.example.net/de/7"), (6, "x://a.org/es/1")]
    out = {r.page_id: (r.rule, r.verdict) for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert out == {1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("net/de/", "allow"), 6: ("org/es/", "block")}


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
