from __future__ import annotations

from lectern.llm import urls
from lectern.llm.catalog import op7_urls

SF = "/root/testdata/sf0.001"


def slow(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    rule = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")

    def hits(term):
        ok = lambda c: not ("a" <= c <= "z" or "0" <= c <= "9")
        return sum(low.startswith(term, i) and (i == 0 or ok(low[i - 1])) and (i + len(term) == len(low) or ok(low[i + len(term)])) for i in range(len(low)))

    strict, soft = sum(map(hits, urls.STRICT)), sum(hits(t) > 0 for t in urls.SOFT)
    own = "block" if strict or soft >= urls.SOFT_LIMIT else "allow"
    return host, path, rule and rule[0] + rule[1], rule[2] if rule else own, strict, soft


CASES = (
    None, "", "no-scheme.com/en/", "http://example.com", "HTTPS://WWW.Example.COM/en/x?q=1#f", "http://a.example.com/en/", "http://wexample.com/en/",
    "http://x.net/es/1", "http://net/fr/", "http://u.org/porn", "http://u.org/porn-porn/xxx", "http://u.org/adult/dating?casino", "http://sussex.org/adult",
    "http://a.org/p://b", "http://é.org/É", "http://x.org?x#y", "ftp://user:pw@h.org:80/a", "http://x.org/free_free", "http://" + "a" * 50_000 + ".com/", "http://x.org/a\nb",
)


def test_edges_against_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(CASES)] + [(None, CASES[3], "x")]
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert tuple(r)[1:] == slow(CASES[r.page_id]), CASES[r.page_id]
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_query_equals_brute_force(spark, sf):
    want = {r.page_id: slow(r.url) for r in sf("pages").collect()}
    assert {r.page_id: tuple(r)[1:] for r in op7_urls(spark, SF).collect()} == want


def test_html_is_not_read(spark):
    assert "html" not in op7_urls(spark, SF)._jdf.queryExecution().executedPlan().toString()
