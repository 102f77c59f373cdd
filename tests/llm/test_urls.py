import re

import duckdb
import pytest

from hitlytics.llm import oracle, queries, urls

RULES = [*urls.BASE_RULES, *urls.SITE_RULES]
URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://ORG/", "http://org", "http://a.org/x", "http://example.org/es/1", "http://EXAMPLE.org/ES/1",
    "http://sub.example.org/en/12", "http://example.org/en/2", "http://notexample.org/en/1", "http://x.com/fr/", "http://com/fr/?q", "http://x.com/de/a#f",
    "http://x.com/de", "http://xcom/de/", "http://m.casino-win.example.com/en/1", "http://casino.example.com/fr/9", "http://thecasino.net/", "http://a://b.org/",
    "http://free-bets.example.net?x=/fr/", "http://user@casino.x.net:80/", "http://x.com/" + "a" * 20000, "http://ü.org/日", "http://a.net/\n.org/", "http://a.org/x",
]


def brute(url):
    rest = (url or "").partition("://")[2] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.BASE_RULES if (host == (h := r.name.split("/")[0]) or host.endswith("." + h)) and path.startswith(r.name[len(h):])]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    return host, path, None, "block" if any(re.search(r.pattern, host + path) for r in urls.SITE_RULES) else "allow"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(n if n % 7 else None, u, "t", "n") for n, u in enumerate(URLS)], "page_id long, url string, token string, name string")


def test_odd_urls_equal_brute_force(pages):
    found = urls.judge(pages, RULES).collect()
    want = [(n if n % 7 else None, *brute(u)) for n, u in enumerate(URLS)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_rules_keyed_by_rarest_token(spark):
    book = spark.createDataFrame([("r", "block", "", ["com", "rare", "new"], 1, False)], "name string, verdict string, pattern string, tokens array<string>, precedence int, named boolean")
    tokens = spark.createDataFrame([("com",), ("com",), ("rare",), ("new",), ("new",)], "token string")
    assert urls.index(book, tokens).first()["token"] == "rare"


def test_rule_without_token_is_refused(pages):
    with pytest.raises(ValueError):
        urls.judge(pages, [urls.Rule("x", "block", ".", (), 1)])


def test_empty_and_whole_table(spark, sf_dir, pages):
    assert urls.judge(pages.limit(0), RULES).count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracle.url_rules()})").fetchall()
    found = queries.url_rules(spark, sf_dir).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
