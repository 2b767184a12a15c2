import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from fieldmark.llm import url_rules as U

URLS = ["http://A.Org", "https://x.ORG/es/1?a=1#z", "a://b://c/d", "nope", None, "", "://", "http://example.org/en/12#z",
        "http://www.example.org/es/", "http://notexample.org/es/", "http://h?q/x://y/", "ftp://com/fr/x", "http://a.com/de", "http://a.com/de/",
        "http://org/\nx/", "http://É.Com/fr/É"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def listed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_listed_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    h, p = U.host_and_path(F.col("url"))
    name, verdict = U.listed_rule(F.col("h"), F.col("p"))
    for r in df.withColumn("h", h).withColumn("p", p).select("url", "h", "p", name.alias("n"), verdict.alias("v")).collect():
        assert (r.h, r.p) == split(r.url), r.url
        assert (r.n, r.v) == listed(r.h, r.p), r.url


def test_long_url(spark):
    url = "http://" + "a" * 60_000 + "/" + "b" * 60_000
    h, p = U.host_and_path(F.lit(url))
    assert spark.range(1).select(F.length(h), F.length(p)).first()[:] == (60_000, 60_001)


def mined(rows, support, confidence):
    """All token sets by brute force, with the same pruning."""
    sets, pairs = Counter(), Counter()
    for tokens, label in rows:
        for k in range(1, len(tokens) + 1):
            for s in itertools.combinations(sorted(tokens), k):
                sets[s] += 1
                pairs[s, label] += 1
    rules = {k: n / sets[k[0]] for k, n in pairs.items() if n / len(rows) >= support and n / sets[k[0]] >= confidence}
    return {(s, l) for (s, l), c in rules.items()
            if not any(rules.get((t, l), 0) >= c for t in itertools.combinations(s, len(s) - 1))}


def test_mined_rules_against_brute_force(spark):
    rows = [(["a", "b", "c"], "block"), (["a", "b"], "block"), (["a", "c"], "allow"), (["b", "d"], "allow"), (["c"], "allow"),
            (["a", "b", "d"], "block"), (["d", "e"], "block"), (["d"], "allow")] * 5
    got = U.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.1, 0.8).collect()
    assert {(tuple(r.tokens), r.label) for r in got} == mined(rows, 0.1, 0.8)


def test_judged_by_list_then_by_rules(spark):
    pages = [(i, f"http://spam{i % 3}.net/win/{i}") for i in range(30)] + [(100 + i, f"http://good.net/en/{i}") for i in range(30)]
    pages += [(200 + i, u) for i, u in enumerate(URLS)] + [(None, "http://good.net/win/"), (500, "http://spam1.net/win/9")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("token", F.lit(1)).withColumn("tokens", F.lit("x"))
    labels = spark.createDataFrame([(i, "block") for i in range(20)] + [(100 + i, "allow") for i in range(20)], "page_id long, label string")
    got = {r.page_id: r for r in U.judge_urls(df, labels).collect()}
    assert len(got) == len(pages)
    assert all(got[i].verdict == "block" and got[i].rule is None for i in [*range(30), 500])
    assert all(got[100 + i].verdict == "allow" for i in range(30))
    for i, u in enumerate(URLS):
        rule, verdict = listed(*split(u))
        assert got[200 + i].rule == rule and got[200 + i].verdict == (verdict or "allow")
    assert U.judge_urls(df.limit(0), labels).count() == 0
    assert {r.verdict for r in U.judge_urls(df.where("page_id < 200"), labels.limit(0)).collect()} == {"allow"}


def labelled_pages(spark, rows):
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    return pages, spark.createDataFrame([(i, l) for i, (_, l) in enumerate(rows) if l], "page_id long, label string")


def test_long_urls_end(spark):
    """200 tokens in one url, and such a url in a third of all rows: one item, not every subset of its tokens."""
    one = "http://long.net/" + "/".join(f"p{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in range(200))
    hot = one.replace("long", "hot").replace("/p", "/q")
    rows = [(one, "block")] + [(hot, "block")] * 60 + [(f"http://good.net/en/{i}", "allow") for i in range(100)]
    rows += [(hot + "/more", None), ("http://hot.net/qaku", None), ("http://good.net/en/x", None), (one, None)]
    pages, labels = labelled_pages(spark, rows)
    got = [r.verdict for r in U.judge_urls(pages, labels).orderBy("page_id").collect()]
    assert got[1:61] == ["block"] * 60 and got[61:161] == ["allow"] * 100
    assert got[161:] == ["block", "block", "allow", "allow"]  # a single labelled page makes no rule


def test_judged_as_by_all_rules(spark):
    """The whole judgement against rules of all token sets, tokens in equal pages among them."""
    rows = []
    for i in range(120):
        kind = i % 6
        url = ["http://bad.net/x/y/{}", "http://ads.net/x", "http://good.net/x/z", "http://mixed.net/y", "http://rare{}.net/w", "http://bad.net/z"][kind]
        label = "block" if kind in (0, 1, 5) or kind == 3 and i % 4 else "allow"
        rows.append((url.format("v" * (i % 9)), label if i % 3 else None))
    pages, labels = labelled_pages(spark, rows)
    host, path = U.host_and_path(F.col("url"))
    parted = pages.withColumn("h", host).withColumn("p", path)
    tokens = {r.page_id: r.t for r in parted.select("page_id", U.url_tokens(F.col("url"), F.col("h"), F.col("p")).alias("t")).collect()}
    known = [(tokens[i], l) for i, (_, l) in enumerate(rows) if l]
    rules = []
    for s, label in mined(known, max(U.MIN_SUPPORT, U.LEAST_PAGES / len(known)), U.MIN_CONFIDENCE):
        held = [l for t, l in known if set(s) <= set(t)]
        rules.append((-held.count(label) / len(held), -held.count(label), len(s), label, s))
    got = {r.page_id: r.verdict for r in U.judge_urls(pages, labels).collect()}
    for i in range(len(rows)):
        fits = sorted(r for r in rules if set(r[4]) <= set(tokens[i]))
        assert got[i] == (fits[0][3] if fits else "allow"), rows[i]
