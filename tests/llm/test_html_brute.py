import random
import re
import resource
import time
from html.parser import HTMLParser

import pytest

from meshweave.llm import html_text

LEAVES = ["p", "h2", "li"]
NAMES = ["", "", "story", "post-3", "sidebar", "ad", "comments", "related-posts", "social-science", "search-engine-history", "widget"]


def grow(rng, depth=0):
    """A well-formed random page, as (tag, class, children or text)."""
    if depth and rng.random() < 0.35 or depth > 4:
        return rng.choice(LEAVES), "", " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(1, 25)))
    tag = "body" if not depth else rng.choice(["div", "div", "section", "article", "nav", "aside", "main"])
    return tag, rng.choice(NAMES) if depth else "", [grow(rng, depth + 1) for _ in range(rng.randrange(1, 5))]


def told(tree):
    tag, name, inner = tree
    inside = inner if isinstance(inner, str) else "".join(map(told, inner))
    return f"<{tag} class='{name}'>{inside}</{tag}>" if name else f"<{tag}>{inside}</{tag}>"


class Blocks(HTMLParser):
    """(path of (tag, class, number), text) of each text."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.found, self.n = [("#page", "", 0)], [], 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.n += 1
        self.stack.append((tag, dict(attrs).get("class", ""), self.n))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, text):
        self.found.append((tuple(self.stack), text))


def kind(tag, name):
    """What a name of NAMES says, by hand."""
    return "" if tag in ("article", "main", "body") else {"sidebar": "around", "related-posts": "around", "widget": "around", "ad": "remark", "comments": "remark"}.get(name, "")


def kept(page):
    found = [b for b in Blocks(page).found if not any(t in ("nav", "aside") for t, _, _ in b[0])]
    clean = [b for b in found if not any(kind(t, c) == "remark" for t, c, _ in b[0])]
    whole, gone = sum(len(t) for _, t in clean), set()
    for path, _ in clean:
        for e in path:
            if kind(*e[:2]) == "around" and sum(len(t) for p, t in clean if e in p) <= whole / 2:
                gone.add(e)
    return [b for b in clean if not gone.intersection(b[0])] or found


def label(e):
    return e[0] + "".join("." + re.sub(r"\d+", "#", c) for c in e[1].split())


def best_path(path):
    at = next((k for k, e in enumerate(path) if e[0] in ("article", "main")), len(path) - 1)
    return tuple(map(label, path[: at + 1]))


def scores(found):
    out = {}
    for path, text in found:
        boxes = [path[: k + 1] for k in range(len(path)) if path[k][0] not in LEAVES]
        for d, box in enumerate(reversed(boxes)):
            out[box] = out.get(box, 0) + len(text) / 2**d
    return {b: s * (1.25 if b[-1][0] in ("article", "main") else 1) for b, s in out.items()}


def brute(pages):
    """The texts of one host's pages."""
    every, votes = [kept(p) for p in pages], {}
    for found in every:
        got, mine = scores(found), {}
        for box, s in got.items():
            mine[best_path(box)] = mine.get(best_path(box), 0) + s
        for path, s in mine.items():
            votes[path] = votes.get(path, 0) + round(1000 * s / sum(got.values()))
    votes = {p: v for p, v in votes.items() if v}
    top = {p for p in votes if votes[p] == max(votes.values())}
    under = lambda found, path: [any(tuple(map(label, p[: k + 1])) == path for k in range(len(p))) for p, _ in found]
    out = []
    for found in every:
        got, each = scores(found), set()
        own = under(found, best_path(min(got, key=lambda b: (-got[b], b[-1][2])))) if got else [True] * len(found)
        for path in top:  # equal votes: any of them
            use = under(found, path)
            size = lambda u: sum(len(t) for (_, t), x in zip(found, u) if x)
            if not any(use):
                use = own
            elif size([o and not t for o, t in zip(own, use)]) > size(use):
                use = [o or t for o, t in zip(own, use)]
            each.add("\n".join(t for (_, t), u in zip(found, use) if u))
        out.append(each)
    return out, any(under(f, p) != under(f, best_path(max(scores(f), key=scores(f).get))) for f in every if f for p in top)


def test_hosts_of_random_pages(spark):
    rng, rows, want, over = random.Random(8), [], {}, 0
    for host in range(25):
        first = [grow(rng) for _ in range(2)]
        pages = [told(rng.choice(first) if rng.random() < 0.4 else grow(rng)) for _ in range(6)]
        texts, differs = brute(pages)
        over += differs
        for k, (page, text) in enumerate(zip(pages, texts)):
            rows.append((host * 10 + k, f"http://h{host}.org/{k}", page, "clash", 7))
            want[host * 10 + k] = text
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(5)
    got = html_text.extract_pages(df).collect()
    assert len(got) == len(rows) and over > 5  # the host's path decides on some pages
    assert not [(r["page_id"], r["text"]) for r in got if r["text"] not in want[r["page_id"]]]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_names_do_not_remove_articles():
    cut = lambda page: html_text.extract(page, None)
    assert cut('<article class="social-science"><p>the article</p></article><div><p>other</p></div>') == "the article"
    assert cut("<article><p>one</p><div class='search-engine-history'><p>two</p></div><ul class='list-related-works'><li>three</li></ul></article>") == "one\ntwo\nthree"
    assert cut("<body><div class='widget'><p>" + "long text " * 20 + "</p></div><p>tiny</p></body>").startswith("long text")
    assert cut("<article><p>one two three</p><div class='comments'><p>" + "reader " * 99 + "</p></div><ul class='more-related'><li><a href=x>link text</a></li></ul></article>") == "one two three"


def test_ties_go_to_one_path(spark):
    pages = ["<div class=a><p>same size</p></div>", "<div class=b><p>same size</p></div>"]
    both = "<body>" + "".join(pages) + "</body>"
    rows = [(1, "http://x.de/", f"<body>{pages[0]}</body>"), (2, "http://x.de/", f"<body>{pages[1]}</body>"), (3, "http://x.de/", both)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    runs = [{r["page_id"]: (r["text"], r["host_path"]) for r in html_text.extract_pages(df.repartition(n)).collect()} for n in (1, 3)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("page", ["<div>x" * 170_000, '<span class="ad">x' * 55_000, "<svg/>x" * 150_000, '<span class="ad">' * 30_000 + "<p>x" * 100_000, "<div>" * 50_000 + "</p></span></section>" * 40_000])
def test_a_hostile_megabyte(page):
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    html_text.extract(page, None)
    assert time.process_time() - began < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 << 10
