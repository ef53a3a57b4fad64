import random
import re

from hushlake.llm.url_filter import HOST_RULES, PATTERN_RULES, judge_urls, pattern_rule, rules_table


def plain(url, hosts, patterns):
    at = url.find("://") if url is not None else -1
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    address = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) + rest[len(host) :]
    host = address[: len(host)]
    fit = [(len(h + p), h + p, v) for v, h, p in hosts if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    hit = {v for v, p in patterns if re.search(pattern_rule(v, p)[5], address)}
    return host, path, None, "block" if hit == {"block"} else "allow"


def test_equals_every_rule_on_every_url(spark):
    rng = random.Random(4)
    schemes = ["http://", "https://", "ftp://x://", "", "://"]
    hosts = ["com", "example.com", "WWW.Example.com", "a.b.net", "xnet", "example.net", "www.example.com", "ads.site.org", "", "notexample.com", "é.net", "user@a.net:80"]
    paths = ["", "/", "/en/x", "/en", "/es/", "/fr/1", "/login", "/login/help", "/a.zip", "/EN/", "/ads/1", "/x//y.php?sid=1", "?q", "#/en/", "/en/?sessionid=3", "/b?a=1&sessionid=2"]
    urls = [rng.choice(schemes) + rng.choice(hosts) + rng.choice(paths) for _ in range(600)] + [None, None, "", "no scheme", "://", "http://\nnet/es/", "http://a.net/es/" + "x/" * 100_000 + "b.zip", "http://" + "a." * 20_000 + "net/fr/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules_table(spark, HOST_RULES, PATTERN_RULES)).collect()}
    for i, u in enumerate(urls):
        assert got[i] == plain(u, HOST_RULES, PATTERN_RULES), u


def test_rules_without_tokens_and_large_lists(spark):
    hosts = [("block", f"host{i}.org", f"/p{i}") for i in range(3000)]
    patterns = [("block", "*bad*"), ("block", "|x.y"), ("block", "a*b|")]
    urls = [f"http://w.host{i}.org/p{i}/x" for i in range(0, 3000, 50)] + ["http://q/verybadly", "http://x.yz", "http://x-yz", "http://q/a12b", "http://host7.org/p70"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules_table(spark, hosts, patterns)).collect()}
    for i, u in enumerate(urls):
        assert got[i] == plain(u, hosts, patterns), u


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), rules_table(spark, HOST_RULES, [])).count() == 0
