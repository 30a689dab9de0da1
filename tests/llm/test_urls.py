from halyard.llm import urls
from halyard.llm.queries import URL_RULES


def judge(spark, rows, rules=URL_RULES, **how):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    return {r["page_id"]: r for r in urls.judge_urls(df, rules, **how).collect()}


def test_hosts_paths_and_the_longest_rule(spark):
    cases = [
        (1, "https://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "http://a.example.com/EN/", "a.example.com", "/EN/", "com/", "allow"), (4, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        (5, "http://x.com", "x.com", "", None, "allow"), (6, "http://x.com?a=/b", "x.com", "", None, "allow"), (7, None, "", "", None, "allow"), (8, "no scheme", "", "", None, "allow"),
        (9, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (10, "a://b://c/d", "b:", "//c/d", None, "allow"), (11, "http://com/", "com", "/", "com/", "allow"),
        (12, "http://b.net?u=http://other.org/es/x", "b.net", "", None, "allow"), (13, "http://b.net#http://o/es/y", "b.net", "", None, "allow"),
        (14, "http://b.net/es?u=a://c/d", "b.net", "/es", None, "allow"), (15, "HTTP://B.NET/fr/#?x", "b.net", "/fr/", "net/fr/", "block"), (16, "://", "", "", None, "allow"),
        (17, "http:///es/1", "", "/es/1", None, "allow"), (18, "a?b#c://D.net\n/es/", "d.net\n", "/es/", None, "allow"), (19, "http://x.net" + "/es" * 50_000, "x.net", "/es" * 50_000, "net/es/", "block"),
    ]
    got = judge(spark, [(i, u, None, 1) for i, u, *_ in cases])
    for i, _, host, path, rule, verdict in cases:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict), i


def test_joined_rules_agree_with_inline_ones(spark, monkeypatch):
    rows = [(i, u, None, 1) for i, u in enumerate(["http://a.b.net/es/", "http://net/fr/x", "http://example.com/en/", "http://www.example.com/en/", "http://q.org/", "", None] * 3)]
    inline = judge(spark, rows)
    monkeypatch.setattr(urls, "INLINE_RULES", 0)
    assert judge(spark, rows) == inline


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f"<a HREF='//{h}/x'>l</a>" for h in hosts)
    rules = [urls.Rule("block", "bad.org", "/"), urls.Rule("allow", "good.org", "/")]
    rows = [
        (1, "http://bad.org/1", link("bad.org"), 1), (2, "http://farm.org/1", link("bad.org", "BAD.org"), 1), (3, "http://good.org/1", link("fine.org"), 1),
        (4, "http://fine.org/1", link("good.org"), 1), (5, "http://far.org/1", link("farm.org"), 1), (6, "http://lone.org/", None, 1),
    ]
    got = judge(spark, rows, rules)
    assert {i: r["verdict"] for i, r in got.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow"}
    assert got[2]["distrust"] > got[5]["distrust"] > 0.5 and got[4]["trust"] > 0.5

    # plain iteration over all hosts
    seeds = {"bad.org": (0, 1), "good.org": (1, 0), "farm.org": (0, 0), "fine.org": (0, 0), "far.org": (0, 0), "lone.org": (0, 0)}
    edges = [("farm.org", "bad.org"), ("good.org", "fine.org"), ("fine.org", "good.org"), ("far.org", "farm.org")]
    state = dict(seeds)
    for _ in range(10):
        new = {h: list(v) for h, v in seeds.items()}
        for a, b in edges:
            new[b][0] += 0.85 * state[a][0]
            new[a][1] += 0.85 * state[b][1]
        state = {h: tuple(v) for h, v in new.items()}
    for r in got.values():
        assert abs(r["trust"] - state[r["host"]][0]) < 1e-9 and abs(r["distrust"] - state[r["host"]][1]) < 1e-9


def test_empty_and_repeated(spark):
    assert judge(spark, []) == {}
    df = spark.createDataFrame([(1, "http://a.com/", None)] * 3, "page_id long, url string, html string")
    assert urls.judge_urls(df, URL_RULES).count() == 3


def test_a_hub_that_most_hosts_link_to(spark):
    import random

    rng = random.Random(8)
    hosts = [f"h{k}.org" for k in range(60)]
    links = {h: ["hub.org"] * (k % 5 > 0) + rng.sample(hosts, rng.randint(0, 3)) for k, h in enumerate(hosts)}
    links["hub.org"] = rng.sample(hosts, 30)
    rows = [(k, f"http://{h}/a", "".join(f'<a href="http://{x}/">x</a>' for x in to), 1) for k, (h, to) in enumerate(links.items())]
    rules = [urls.Rule("block", "h1.org", "/"), urls.Rule("block", "h2.org", "/"), urls.Rule("allow", "h3.org", "/"), urls.Rule("allow", "hub.org", "/")]
    seed = {h: (float(h in ("h3.org", "hub.org")), float(h in ("h1.org", "h2.org"))) for h in links}
    edges = {(a, b): to.count(b) / sum(x != a for x in to) for a, to in links.items() for b in to if a != b}
    into = {b: sum(s for (_, x), s in edges.items() if x == b) for _, b in edges}
    state = dict(seed)
    for _ in range(10):
        new = {h: list(v) for h, v in seed.items()}
        for (a, b), s in edges.items():
            new[b][0] += 0.85 * s * state[a][0]
            new[a][1] += 0.85 * s / into[b] * state[b][1]
        state = {h: tuple(v) for h, v in new.items()}
    got = judge(spark, rows, rules)
    for r in got.values():
        assert abs(r["trust"] - state[r["host"]][0]) < 1e-9 and abs(r["distrust"] - state[r["host"]][1]) < 1e-9
    assert {r["verdict"] for r in got.values() if not r["rule"]} == {"allow", "block"} or max(d for _, d in state.values()) < 0.5
