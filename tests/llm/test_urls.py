import random

import pytest

from corvane.llm.urls import judge

LOW = {c: c + 32 for c in range(65, 91)}


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].translate(LOW), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for action, h, p in rules:
        if action and h and p is not None and (host == h.translate(LOW) or host.endswith("." + h.translate(LOW))) and path.startswith(p):
            fits.append((len(h) + len(p), len(h), action == "block", h.translate(LOW) + p, action))
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def found(spark, urls, rules, **settings):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame(rules, "action string, host string, path string")
    got = judge(pages, "url", listed, **settings)
    return [tuple(r)[1:] for r in sorted(got.select("page_id", "host", "path", "rule", "verdict").collect())]


ODD = [
    None, "", "no scheme/x", "http://", "http://Example.ORG", "http://example.org?x=/es/", "https://example.org/es/", "a://b://example.org/es/",
    "http://notexample.org/es/", "http://example.org:80/es/", "http://u@example.org/es/1", "http://.org/", "http://org./", "http://x.example.org/EN/1", "http://example.org/en/12#t",
    "http://ö.example.org/en/1ü", "http://example.org/\n/en", "http://" + "a." * 3000 + "org/" + "b" * 20000, "http://com/fr/de", "//com/de/", "http://..com//de/",
]
FIXED = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_odd_addresses(spark):
    assert found(spark, ODD + ODD, FIXED) == [plain(u, FIXED) for u in ODD + ODD]


@pytest.mark.parametrize("broadcast_rules", [0, 50_000])
def test_many_rules_by_either_join(spark, broadcast_rules):
    rnd = random.Random(broadcast_rules)
    labels, steps = ["a", "b", "C", "shop", "ö"], ["x", "y", "/", "z1", "ü"]
    host = lambda n: ".".join(rnd.choices(labels, k=rnd.randint(1, n)))
    path = lambda n: "".join(rnd.choices(steps, k=rnd.randint(0, n)))
    rules = [(rnd.choice(["allow", "block"]), host(3), "/" * (rnd.random() < 0.8) + path(2)) for _ in range(150)]
    rules += [("block", None, "/"), (None, "a", "/"), ("allow", "a", None), ("allow", "", "/"), ("allow", "a.b", "/x"), ("block", "a.b", "/x"), *rules[:9]]
    urls = [f"http://{host(5)}/{path(6)}" for _ in range(300)] + ["http://a.b/x"] * 50
    assert found(spark, urls, rules, broadcast_rules=broadcast_rules) == [plain(u, rules) for u in urls]


def test_long_rules_take_the_shuffle(spark):
    rules = [("block", "a.b", "/" + "x" * 1000), ("allow", "b", "/")]
    urls = ["http://a.b/" + "x" * n for n in (999, 1000, 1001)]
    assert [r[3] for r in found(spark, urls, rules)] == ["allow", "block", "block"]


def test_no_rules_empty_table_and_other_columns(spark):
    assert found(spark, ODD, []) == [(*plain(u, [])[:2], None, "allow") for u in ODD]
    assert found(spark, [], FIXED) == []
    df = spark.createDataFrame([(1, "http://com/de/x", 5, 6, 7)], "rule int, `u r.l` string, prefix int, row int, `best` int")
    got = judge(df, "u r.l", spark.createDataFrame(FIXED, "action string, host string, path string"))
    assert got.columns == ["u r.l", "prefix", "row", "best", "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == ("http://com/de/x", 5, 6, 7, "com", "/de/x", "com/de/", "block")
