import re

import pytest

from harvestry.llm import url_filter as U
from harvestry.llm.queries import URL_RULES


def brute(url, vocabulary):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    return {t for t in vocabulary if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)}


@pytest.mark.parametrize("url", ["http://cheap-pills.example.com/x", "http://adsense.com/", "https://a.com/?WIN=free_bets",
                                 "casinos", "casino", "xCASINO/casino", "http://é.com/ädsads/ads", "", None, "https://freefree.free/free"])
def test_hits_equal_regex(url):
    assert U.vocabulary_hits(url, U.automaton(sorted(U.VOCABULARY))) == brute(url, U.VOCABULARY)


def test_empty_vocabulary():
    assert U.vocabulary_hits("http://casino.com", U.automaton([])) == set()


def test_judgement(spark):
    rows = [(1, "HTTP://Sub.Example.ORG/es/1?x#y", "p"), (2, "http://example.org/en/12", "p"), (3, "http://casino.org/a", "p"),
            (4, "http://shop.com/fr/casino", "p"), (5, "http://shop.com/de/", "p"), (6, "http://com/de/", "p"), (7, None, "p"),
            (8, "no scheme casino", "p"), (9, "x://free.net?cheap=1", "p"), (9, "x://free.net?cheap=1", "p"), (10, "", "p"),
            (11, "http://notexample.org", "p"), (None, "http://a.net/b", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = [tuple(r)[:5] for r in U.judge_urls(pages, URL_RULES).collect()]
    assert got == [
        (1, "sub.example.org", "/es/1", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "casino.org", "/a", "org/", "allow"), (4, "shop.com", "/fr/casino", "com/fr/", "allow"),
        (5, "shop.com", "/de/", "com/de/", "block"), (6, "com", "/de/", "com/de/", "block"), (7, "", "", None, "allow"),
        (8, "", "", None, "block"), (9, "free.net", "", None, "block"), (9, "free.net", "", None, "block"), (10, "", "", None, "allow"),
        (11, "notexample.org", "", None, "allow"), (None, "a.net", "/b", None, "allow")]
    assert U.judge_urls(pages.limit(0), URL_RULES).collect() == []


def test_terms_of_four_languages(spark):
    rows = [(1, "http://a.net/gratuit/gagner"), (2, "http://a.net/kostenlos"), (3, "http://a.net/apuestas?x=premios"), (4, "http://a.net/erotik"),
            (5, "http://a.net/de/fr/es/en/page/ref")]
    got = {r.page_id: r.verdict for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"}
    assert not set(U.STRICT) & set(U.SOFT) and len(set(U.VOCABULARY)) == len(U.STRICT) + len(U.SOFT)


def test_large_vocabulary_and_very_long_url(spark):
    """100,000 terms with weights of their own, and a URL of three million characters."""
    vocabulary = {f"t{i}": 1 + i % 4 for i in range(100_000)}
    url = "http://a.net/" + "x/" * 1_500_000 + "t99997-T3/t5x?t8#t0"
    hits = U.vocabulary_hits(url, U.automaton(sorted(vocabulary)))
    assert hits == {"t99997", "t3", "t8", "t0"}
    (r,) = U.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string"), (), vocabulary, 4).collect()
    assert (r.n_strict, r.n_soft, r.verdict) == (1, 3, "block")
