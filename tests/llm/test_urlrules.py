from evitrace.llm import urlrules


def run(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'x' AS host", "1 AS verdict")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(df).collect()}


def test_given_rules(spark):
    got = run(spark, [
        None, "", "no scheme", "http://A.Net/x?y", "https://www.example.NET/en/1#z", "http://example.net/fr/", "http://notexample.net/en/", "http://b.org/fr/x",
        "http://b.org/fr", "http://example.com/de/?q", "http://xexample.com/de/", "http://net", "a://b://c.net/d", "x://h.org?/fr/", "http://fr.org/FR/\n://z"])
    assert [got[i] for i in range(3)] == [("", "", None, "allow")] * 3
    assert got[3] == ("a.net", "/x", "net/", "block") and got[4] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[5][2:] == ("net/", "block") and got[6][2:] == ("net/", "block") and got[7][2:] == ("org/fr/", "allow")
    assert got[8] == ("b.org", "/fr", None, "allow") and got[9][2:] == ("example.com/de/", "block") and got[10][2] is None
    assert got[11] == ("net", "", None, "allow") and got[12][:2] == ("b:", "//c.net/d") and got[13][:2] == ("h.org", "")
    assert got[14][:2] == ("fr.org", "/FR/\n://z")


def test_mined_combinations_decide_the_rest(spark):
    urls = [f"http://{'casino' if i % 4 == 0 else 'bakery'}.s{i}.example.com/de/{'win' if i % 8 == 0 else 'item'}" for i in range(200)]
    urls += [f"http://bakery.t{i}.example.net/en/item" for i in range(200)]
    urls += ["http://casino.new.example.com/fr/other", "http://bakery.new.example.com/fr/other", "http://news.example.com/fr/"] + [urls[0]] * 300
    got = run(spark, urls)
    assert got[400][3] == "block" and got[401][3] == "allow" and got[402][3] == "allow"
    assert run(spark, []) == {}
