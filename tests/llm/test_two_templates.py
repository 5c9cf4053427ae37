from meshweave.llm import html_text

STORY = " ".join(f"story{k}" for k in range(60))
TEASER = " ".join(f"teaser{k}" for k in range(25))


def test_host_with_two_templates(spark):
    post = "<body><div class=post><p>{}</p></div></body>"
    other = f"<body><div class=post><p>{TEASER}</p></div><section class=story><p>{STORY}</p></section></body>"
    short = f"<body><div class=post><p>{STORY}</p></div><section class=story><p>{TEASER}</p></section></body>"
    rows = [(k, "http://a.com/", post.format(f"{STORY} number {k}")) for k in range(5)] + [(9, "http://a.com/x", other), (10, "http://a.com/y", short)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == f"{STORY} number 0" and got[10] == STORY
    assert got[9] == f"{TEASER}\n{STORY}"
