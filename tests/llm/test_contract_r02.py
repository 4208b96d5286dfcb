"""Contract points that round 2 found broken."""


def test_rules_of_the_contract(spark):
    """Each rule with the contract's own word; a longer rule of the same host wins."""
    from tessera.llm.url_filter import RULES, judge

    assert dict(RULES) == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://b.example.net/de/9", "http://b.example.net/de/8/z", "http://net/de/", "http://c.org/es/1"]
    got = {r.page_id: (r.rule, r.verdict) for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {0: ("com/en/", "block"), 1: ("example.com/en/7", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("net/de/", "allow"), 5: ("org/es/", "block")}
