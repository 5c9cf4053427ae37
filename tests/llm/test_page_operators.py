import duckdb
import pytest

from meshweave.llm import html_text, registry, urls, warc

PAGE = '<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="main-12"><div class="post"><h2>Ti&eacute;tle</h2><p>Hello <b>big</b>\n world, this is text &amp; more.<div class="share">x</div><p>Second <a href=x>link</a> para<script>if(a<b){}</script></div><div class="comments"><p>reader says</p></div></div><span class="ad">AD</span><footer>f</footer>'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pages")
    hosts = ["http://A.example.com/en/1", "https://www.example.com/en/x?q#f", "http://x.net/fr/", "http://net/es/a", "no scheme", None, "http://com", "ftp://u@h:1/p", "http://sub.example.com/en/a"]
    rows = [(k, hosts[k % len(hosts)], PAGE if k % 3 else None if k % 2 else f"<p>own {k}</p>") for k in range(30)]
    rows += [(None, None, PAGE), (4, hosts[4], PAGE), (31, "http://b.com/\n", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"file://{path}/pages.parquet")
    return f"file://{path}"


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_warc"])
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder[7:]}/pages.parquet/*.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    got = [tuple(r[c] for c in names) for r in registry.QUERIES[name](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


def test_rules_need_none(spark, folder):
    rules = urls.rule_table(spark).limit(0)
    got = urls.judge(spark.read.parquet(f"{folder}/pages.parquet"), rules)
    assert {tuple(r)[3:] for r in got.collect()} == {(None, "allow")}


def test_splits_own_their_records(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").selectExpr("page_id id", "url", "html payload")
    from meshweave.plans.lineage import new_path

    files = warc.write_archive(pages.coalesce(1), new_path(spark, "warc-test"))
    uris = [f["uri"] for f in files]
    whole, cut = (sorted((r["offset"], r["id"]) for r in warc.read_archive(spark, uris, split=n).collect()) for n in (1 << 30, 97))
    assert len(whole) == pages.count() and whole == cut


def test_extraction(spark, folder):
    text = "Tiétle\nHello big world, this is text & more.\nSecond link para"
    assert html_text.extract(PAGE, None) == text
    got = {r["page_id"]: r for r in registry.QUERIES["op2_html_extract"](spark, folder).collect()}
    assert got[1]["text"] == text and got[1]["n_chars"] == len(text) and got[0]["text"] == "own 0" and got[3]["text"] == "" and got[31]["text"] == ""
    for broken in ("", "<", "<p", "a<b>c", "<div><p>x</div></p></b>", "<!-- x", "<script>", '<p class="a>b', "<![CDATA[x]]>"):
        html_text.extract(broken, None)
