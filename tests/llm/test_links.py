"""URL verdicts against a plain walk over the links."""

import random

import brute
import pytest
from basketry.llm import links

FIELDS = "page_id long, url string, html string, host string, row string, rule string, trust double, src long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1.0, 2) for r in rows], FIELDS)


def got(df, **how):
    out = links.judge_urls(df, **how).select("row.page_id", "host", "path", "rule", "verdict")
    return sorted(map(tuple, out.collect()), key=repr)


def html_of(hosts):
    forms = ['<a href="https://{}/x?y">', "<A HREF = 'http://{}'>", "<a href=//{}#z>", '<link rel=x href="HTTPS://{}">']
    r = random.Random(len(hosts))
    return "<p><a href='/own'>" + "text ".join(r.choice(forms).format(h) for h in hosts) + "http://not.a.link/ href=x"


@pytest.fixture(scope="module")
def web():
    """A hub that holds a third of the pages, chains, rings, hosts without pages, mixed seeds."""
    r = random.Random(8)
    hosts = [f"h{i}.{e}" for i in range(25) for e in ("net", "com", "example.org")] + ["hub.net"]
    out = []
    for i in range(600):
        host = "hub.net" if i % 3 == 0 else r.choice(hosts)
        path = r.choice(["/fr/1", "/de/2", "/es/3", "/en/1x", "/en/2", "", "?q=/fr/", "/de"])
        linked = [r.choice(hosts).replace("h1", "H1") for _ in range(r.choice([0, 0, 1, 3]))]
        linked += ["gone.net:80"] * (i % 50 == 0) + [host]
        out.append((i, f"{r.choice(['http', 'HTTPS', 'ftp'])}://{host.replace('h2', 'H2')}{path}", linked))
    return out


@pytest.mark.parametrize("threshold", [1.0, 0.3, 5.0])
def test_urls(spark, web, threshold):
    df = pages_of(spark, [(p, u, html_of(h)) for p, u, h in web]).repartition(4)
    expected = brute.urls([(p, u, [x.lower() for x in h]) for p, u, h in web], links.RULES, threshold)
    judged = [e[4] for e in expected if e[3] is None]
    assert got(df, threshold=threshold) == sorted(expected, key=repr)
    assert min(judged.count("allow"), judged.count("block")) > 20


def test_trust_and_distrust_walk_in_opposite_directions(spark):
    def page(i, host, path, *linked):
        return (i, f"http://{host}{path}", html_of(linked))

    rows = [
        page(0, "good.com", "/fr/", "liked.net"),
        page(1, "liked.net", "/", "further.net"),
        page(2, "further.net", "/"),
        page(3, "bad.com", "/de/", "victim.net"),
        page(4, "victim.net", "/"),
        page(5, "farm.net", "/", "bad.com"),
        page(6, "behind.net", "/", "farm.net"),
        page(7, "alone.net", "/"),
    ]
    df = pages_of(spark, rows)
    found = {r["page_id"]: r for r in links.judge_urls(df).select("row.page_id", "verdict", "trust", "distrust").collect()}
    assert {i for i, r in found.items() if r["verdict"] == "block"} == {3, 5, 6}
    assert found[2]["trust"] > 0 and found[4]["distrust"] == 0 and found[7]["trust"] == 0
    assert found[5]["distrust"] == pytest.approx(0.15 * 0.85) and found[6]["distrust"] == pytest.approx(0.15 * 0.85**2)


def test_odd_urls_and_empty_tables(spark):
    urls = [None, "", "no scheme", "a://", "x:///p", "http://ORG/", "http://a.org", "http://é.ORG/É?x", "u://b://c.org/d", "http://aorg/", "http://a.org:80/", "h://a.org/x\ny#z"]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(None, "http://a.org/", ""), (5, "http://ORG/", None)]
    expected = brute.urls([(p, u, []) for p, u, _ in rows], links.RULES)
    assert got(pages_of(spark, rows)) == sorted(expected, key=repr)
    assert got(pages_of(spark, []).limit(0)) == []
    assert got(pages_of(spark, rows), rules=()) == sorted(brute.urls([(p, u, []) for p, u, _ in rows], ()), key=repr)


def test_given_columns_stay_as_they_are(spark):
    row = links.judge_urls(pages_of(spark, [(1, "http://a.org/", "")])).select("row.*").first()
    assert tuple(row) == (1, "http://a.org/", "", "x", "x", "x", 1.0, 2)


def test_sql_twin_walks_alike(spark, web, tmp_path):
    import duckdb

    path = str(tmp_path / "pages")
    pages_of(spark, [(p, u, html_of(h)) for p, u, h in web]).select("page_id", "url", "html").write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
        expected = db.execute(links.SQL).fetchall()
    assert got(spark.read.parquet(path)) == sorted(expected, key=repr)
