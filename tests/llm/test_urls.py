"""URL filter: rules against a plain version, and trees that learn what the rules show."""

import re

from pyspark.sql import functions as F

from tickloom.llm import urls
from tickloom.llm.queries import RULES, op5_urls

ODD = [
    None, "", "no scheme.com/en/", "HTTPS://WWW.Example.COM/en/x", "http://example.com/en/", "http://example.com/EN/", "ftp://a.net/es/?q=1#x",
    "http://a.net?x=/es/", "http://com/", "http://xcom/", "http://sub.com", "x://y://z.com/a", "http:///es/", "http://a.net/fr/" + "y" * 50_000,
    "http://notexample.com/en/1", "http://a.example.com/en/1", "http://b.www.example.com/en/1",
]


def plain(url):
    found = re.match(r"^(?:(?!://).)*://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (found[1].lower(), found[2]) if found else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_query(spark, sf_dir):
    given = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    rows = op5_urls(spark, sf_dir).collect()
    assert len(rows) == len(given)
    for r in rows:
        host, path, rule, verdict = plain(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_odd_rows(spark):
    rows = [(i, u, "h", 1) for i, u in enumerate(ODD)] + [(None, ODD[3], "h", 1)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, label int")
    got = urls.filter_urls(pages, RULES).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule or "") for r in got) == sorted(
        (i is None, i or 0, *plain(u)[:2], plain(u)[2] or "") for i, u, *_ in rows
    )
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert urls.filter_urls(pages.limit(0), RULES).count() == 0
    allowed = pages.filter("url like '%//com/%' or url is null")
    assert {r.verdict for r in urls.filter_urls(allowed, RULES).collect()} == {"allow"}


def test_trees_learn_from_rules(spark, sf_dir):
    """On labelled URLs that were not trained on, the trees mostly give the rules' verdicts."""
    ruled = urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).filter("ruled is not null")
    known = urls.lexical(ruled.withColumn("label", F.expr("cast(ruled = 'block' as int)")))
    seen, held = known.filter("page_id % 3 > 0"), known.filter("page_id % 3 = 0")
    sizes = seen.selectExpr("count(*) n", "avg(label) share").first()
    shares = urls.Shares(seen, sizes.share)
    model = urls.train(seen, shares, 10_000, sizes.n)
    right = model.transform(urls._vectors(shares.attach(held))).selectExpr("avg(int(_blocked = label)) part").first().part
    assert right >= 0.9
