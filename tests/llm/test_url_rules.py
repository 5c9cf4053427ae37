import itertools

from meshweave.llm import urls

HOSTS = ["com", "example.com", "bad.com", "badger.com", "foo.com", "a.bad.com", "x.example.com", "", "com.", "b-ad.com"]
RULES = [("com", "", "block"), ("example.com", "/en/", "allow"), ("bad.com", "", "allow"), ("bad.com", "/x", "block"), ("foo.com", None, "allow"), ("", "", "block"), ("com#/e", "", "block"), ("x.example.com", "/en/a", "block"), ("ad.com", "/", "block")]


def fits(host, path, rules):
    """The condition and the order of OP4_SQL."""
    found = [(len(h + (p or "")), len(h), h + (p or ""), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    return max(found)[2:] if found else (None, "allow")


def test_empty_paths(spark):
    places = [*itertools.product(HOSTS, ["", "/", "/x", "/en/", "/en/ab", "/z"])]
    df = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p) in enumerate(places)], "page_id long, url string")
    for rules in (RULES, RULES[:2], RULES[2:3]):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, urls.rule_table(spark, rules)).collect()}
        assert got == {k: fits(h, p, rules) for k, (h, p) in enumerate(places)}
