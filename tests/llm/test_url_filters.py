import re

import pytest
from pyspark.sql import functions as F

from civiclake.llm import url_filters as U
from civiclake.llm.queries import URL_RULES


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith("/" + r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)).text if fits else None


URLS = [None, "", "no scheme", "http://A.Example.COM/en/x?q#f", "https://www.example.com/en/1", "http://www.example.com", "http://x.net/es/", "http://net/es/a",
        "http://knet/es/", "ftp://u@h.org:80/p://q", "http://a.b.net?x=/es/", "http://é.com/É", "://", "http:///path", "http://m.example.com/fr/#/en/"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r["_id"]: (r["_host"], r["_path"], r["_rule"]) for r in U.filter_urls(pages, URL_RULES, iterations=8).collect()}
    assert [got[i] for i in range(len(URLS))] == [plain_rule(u) for u in URLS]


def test_trust_follows_links_and_distrust_goes_against_them(spark):
    link = '<a href="http://{}/x">l</a>'.format
    pages = spark.createDataFrame([
        (1, "http://good.com/", link("nice.org") + link("nice.org")), (2, "http://nice.org/", link("NICER.org")), (3, "http://nicer.org/", None),
        (4, "http://farm.org/", "<a href='//bad.net/es/'>"), (5, "http://bad.net/es/", ""), (6, "http://friend.org/", link("farm.org")),
        (7, "http://alone.org/", link("")), (8, "http://farm.org/", "<a href='//bad.net/es/'>")], "page_id long, url string, html string")
    rows = {r["_id"]: r for r in U.filter_urls(pages, URL_RULES).collect()}
    assert {i: rows[i]["_verdict"] for i in rows} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "block"}
    assert rows[2]["_trust"] > rows[3]["_trust"] > 0 and rows[4]["_distrust"] > rows[6]["_distrust"] > 0 and rows[7]["_trust"] == 0


def test_distrust_counts_beyond_what_a_host_gets_by_its_place(spark):
    """A farm and a portal link to the same bad host alike; the portal links to everything else as well."""
    link = '<a href="http://{}/x">l</a>'.format
    others = [f"h{i}.org" for i in range(30)]
    pages = [(0, "http://bad.net/es/", ""), (1, "http://farm.org/", link("bad.net")), (2, "http://portal.org/", "".join(map(link, ["bad.net", *others])))]
    pages += [(10 + i, f"http://{h}/", link("portal.org")) for i, h in enumerate(others)]
    rows = {r["_id"]: r for r in U.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    assert rows[1]["_distrust"] > 0 and rows[2]["_distrust"] > 0
    assert (rows[0]["_verdict"], rows[1]["_verdict"], rows[2]["_verdict"], rows[10]["_verdict"]) == ("block", "block", "allow", "allow")


def test_hosts_of_one_parent_differ(spark):
    rows = U.filter_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), URL_RULES).where("_rule is null and _host like '%example.net'").collect()
    assert {r["_verdict"] for r in rows} == {"allow", "block"}


def test_ranks_equal_power_iteration(spark):
    edges = [("t", "a", "b", 2.0), ("t", "b", "c", 1.0), ("t", "c", "a", 1.0), ("t", "a", "d", 1.0), ("t", "d", "a", 3.0), ("t", "c", "z", 1.0)]
    seeds = {"a": 0.75, "d": 0.25}
    got = {r["host"]: r["rank"] for r in U.propagate(
        spark.createDataFrame(edges, "kind string, src string, dst string, weight double"),
        spark.createDataFrame([("t", h, x) for h, x in seeds.items()], "kind string, host string, seed double"), iterations=80, tolerance=1e-9).collect()}
    rank = dict(seeds)
    out = {s: sum(w for _, a, _, w in edges if a == s) for _, s, _, _ in edges}
    for _ in range(300):
        new = {}
        for _, s, d, w in edges:
            new[d] = new.get(d, 0) + 0.85 * rank.get(s, 0) * w / out[s]
        lost = 1 - sum(new.values())
        rank = {h: new.get(h, 0) + lost * seeds.get(h, 0) for h in {*new, *seeds}}
    assert got.keys() == rank.keys() and all(got[h] == pytest.approx(rank[h], abs=1e-5) for h in rank)


def test_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string, rank double")
    assert U.filter_urls(empty, URL_RULES, iterations=8).count() == 0
    some = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    assert [r["_verdict"] for r in U.filter_urls(some, [], iterations=8).collect()] == ["allow", "allow"]
