"""Links of all kinds against urljoin and plain components; odd urls; many rows of one node."""

import random
from urllib.parse import urldefrag, urljoin

import pytest

from prismflow.llm import components, skew, url_filter

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/"), ("allow", "org", "/es/"), ("block", "b.org", "/e")]


def key(url):
    rest = urldefrag(url)[0].split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?" if c in rest), default=len(rest))
    return rest[:cut].lower() + rest[cut:]


def rule(node):
    host, _, path = node.partition("/")
    host, path = host.split("?")[0], ("/" + path).split("?")[0] if "/" in node else ""
    fits = [(len(h + p), len(h), v == "allow", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def by_hand(pages):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, url, links in pages:
        for target in links:
            up[top(key(url))] = top(key(urljoin(url, target)))
    verdicts = {}
    for node in up:
        verdicts.setdefault(top(node), set()).add(rule(node)[1])
    out = []
    for page, url, _ in pages:
        own, got = rule(key(url)), verdicts.get(top(key(url)), set())
        out.append((page, own[0], own[1] or ("allow" if "allow" in got else "block" if "block" in got else "allow")))
    return sorted(out)


def written(rng, links):
    forms = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">', "<meta content='5;URL={}' http-equiv=Refresh>"]
    return "<p>x</p>".join(rng.choice(forms).format(t.replace("&", "&amp;")) for t in links)


@pytest.mark.parametrize("fan", [None, 3])
def test_links_against_urljoin(spark, monkeypatch, fan):
    if fan:
        monkeypatch.setattr(skew, "FAN", fan)
    rng = random.Random(5)
    hosts = ["a.com", "example.com", "b.org", "c.net", "D.info"]
    paths = ["/", "/en/", "/en/7", "/es/x", "/f/g", "/f/", "", "/f/g?q=1&r=2"]
    targets = ["next", "./next", "../up", "../../top", "/es/x", "/f/./g", "/f/../en/7", "?q=1&r=2", "sub/page#f", "//c.net/f/g", "http://B.org/es/x", "https://c.net/", "g", ".", ".."]
    pages = [(k, "http://" + rng.choice(hosts) + rng.choice(paths), rng.sample(targets, rng.choice([0, 0, 1, 1, 2, 3]))) for k in range(60)]
    frame = spark.createDataFrame([(p, u, written(rng, t), "n", "c", 1) for p, u, t in pages], "page_id long, url string, html string, node string, component string, _salt int")
    got = url_filter.judged(frame, url_filter.link_edges(frame), RULES)
    assert sorted((r.page_id, r.rule, r.verdict) for r in got.collect()) == by_hand(pages)


def test_targets_that_are_no_urls_and_base(spark):
    rows = [
        (1, "http://a.info/x/y", '<base href="http://b.org/es/"><link rel=canonical href="z">'),
        (2, "http://a.info/m", '<link rel=canonical href="mailto:x@b.org"><meta http-equiv=refresh content="5">'),
        (3, "http://a.info/n", '<link rel=canonical href="javascript:go()"><link rel=canonical href="#top">'),
        (4, "http://a.info/" + "l" * 200_000, '<link rel=canonical href="http://b.org/es/q">' + "y" * 500_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, url_filter.link_edges(pages), [("block", "b.org", "/es/")]).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block"}


def test_ties_of_rules(spark):
    pages = spark.createDataFrame([(1, "http://x.org/es/", None)], "page_id long, url string, html string")
    got = url_filter.judged(pages, url_filter.link_edges(pages), RULES).first()
    assert (got.rule, got.verdict) == ("org/es/", "allow")


def test_components_with_frequent_nodes(spark, monkeypatch):
    monkeypatch.setattr(skew, "FAN", 4)
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(20)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: top(n) for n in list(up)}
