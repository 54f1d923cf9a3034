"""Urls of any length, hosts of very many labels and rules of several labels."""

import pytest

from imprintmatch.llm.url_filter import RULES, Rule, judge_urls

RULE_SETS = {"given": RULES, "deep": (Rule("block", "a.b.c.d", "/"), Rule("allow", "x.a.b.c.d", "/ok/"), Rule("block", "d", "/no"), Rule("allow", "c.d", "/"))}


def plain(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.key), r.key), default=None)
    return (best.key, best.verdict) if best else (None, "allow")


@pytest.mark.parametrize("name", RULE_SETS)
def test_long_urls(spark, name):
    rules = RULE_SETS[name]
    hosts = ["sub." * 5000 + "example.net", "a." * 3000 + "b.c.d", "x.a.b.c.d", "c.d", "d", "net", "example.com.", ".org", "b.c.d", "EXAMPLE.net", ""]
    paths = ["/", "/en/" + "x" * 100_000, "/de/", "/fr/a?b#c", "/ok/", "/no", "", "/ok/" + "../" * 1000]
    urls = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    rows = judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rest = urls[r.page_id][1].split("://", 1)[1]
        host = rest[: min(rest.find(c) for c in "/?#" if c in rest)] if any(c in rest for c in "/?#") else rest
        path = rest[len(host) :].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (host.lower(), path)
        assert (r.rule, r.verdict) == plain(r.host, r.path, rules)
