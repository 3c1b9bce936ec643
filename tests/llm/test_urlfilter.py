"""What the trees of the URL filter learn, and what they can't."""

from __future__ import annotations

import numpy as np

from sequoria.llm import urlfilter as U


def plain_tree(x, g, h, cuts):
    """Best splits of one tree by trying every cut at every node, as (feature, threshold) by node."""
    out, rows = {}, {0: list(range(len(g)))}
    gain = lambda idx: sum(g[i] for i in idx) ** 2 / (sum(h[i] for i in idx) + 1)
    for node in range(2**U.DEPTH - 1):
        mine, best = rows.get(node, []), (1e-6, None, None)
        for k, cut in enumerate(cuts):
            for t in cut:
                left, right = [i for i in mine if x[i][k] <= t], [i for i in mine if x[i][k] > t]
                if len(left) < U.LEAST_LEAF or len(right) < U.LEAST_LEAF:
                    continue
                if (got := gain(left) + gain(right) - gain(mine)) > best[0] + 1e-12:
                    best = (got, k, t)
        out[node] = best[1:]
        k, t = best[1:] if best[1] is not None else (0, np.inf)
        rows[2 * node + 1], rows[2 * node + 2] = [i for i in mine if x[i][k] <= t], [i for i in mine if x[i][k] > t]
    return out, rows


def test_first_tree_against_all_cuts():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x[:, 1] + 0.5 * rng.normal(size=300) > 0.3).astype(float)
    model = U.boost(x, y)
    w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    g, h = (y - 0.5) * w, 0.25 * w
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, U.BINS + 1)[1:-1])) for c in x.T]
    want, rows = plain_tree(x, g, h, cuts)
    for node, (k, t) in want.items():
        assert (model.threshold[0][node] == np.inf) if k is None else (model.feature[0][node], model.threshold[0][node]) == (k, t)
    inner = 2**U.DEPTH - 1
    for leaf in range(inner + 1):
        idx = rows[inner + leaf]
        assert np.isclose(model.leaf[0][leaf], sum(g[idx]) / (sum(h[idx]) + 1) * U.RATE)


def test_held_out_accuracy_and_shuffled_labels():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 9))
    y = (x[:, 2] * x[:, 4] > 0).astype(float)
    right = lambda a, b: ((U.boost(x[:2000], a).probability(x[2000:]) > 0.5) == b).mean()
    assert right(y[:2000], y[2000:]) > 0.9
    noise = rng.permutation(y)
    assert abs(right(noise[:2000], noise[2000:]) - 0.5) < 0.05


def test_own_labels_are_in_no_rate(spark):
    """Rows of one suffix and fold have one rate, whatever their label; suffixes of one verdict are neutral."""
    hosts = [f"h{i}.mix.com" for i in range(60)] + [f"h{i}.one.net" for i in range(30)] + ["x.org"]
    rows = [(h, None if h == "x.org" else "block" if h.endswith("net") or i % 5 else "allow") for i, h in enumerate(hosts)] * 2
    got = U.with_rates(spark.createDataFrame(rows, "host string, ruled string")).collect()
    rates: dict = {}
    for r in got:
        rates.setdefault((r.two, r.fold, r.ruled is None), set()).add((r.last_rate, r.two_rate))
    assert all(len(v) == 1 for v in rates.values())
    assert {r.last_rate for r in got if r.host.endswith(("net", "org"))} == {0.5}
    assert {r.two_rate for r in got if r.two == "mix.com"} == {0.75} and len(got) == len(rows)


def test_lexical_features_decide_where_rules_are_silent(spark):
    """Long paths with digits are blocked on some hosts and short ones allowed; the same holds where no rule speaks."""
    rules = tuple((f"s{i}.com/", "block") for i in range(30)) + tuple((f"t{i}.com/", "allow") for i in range(30))
    urls = [f"http://s{i}.com/a/b/{i}{j}99887766/c{j}" for i in range(30) for j in range(10)] + [f"http://t{i}.com/{'abcdefghij'[j]}" for i in range(30) for j in range(10)]
    urls += ["http://new.org/a/b/4499887766/c4", "http://new.org/q", None, ""]
    got = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    by = {r.page_id: r for r in got}
    assert by[600].verdict == "block" and by[601].verdict == "allow" and by[600].rule is None
    assert len(got) == len(urls) and by[602].host == by[603].host == ""


def test_long_urls_and_ties(spark):
    urls = ["http://a.net/fr/" + "x" * 100_000, "http://b.com/" + "?" * 1000] * 3
    got = U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {(r.rule, r.verdict) for r in got} == {("net/fr/", "block"), ("com/", "allow")} and len(got) == 6


def test_rates_reach_what_no_rule_speaks_on(spark):
    """Rules block parts of net and are silent on the rest: its rate tells net from org, where all else is alike."""
    hosts = [f"h{i}.a" for i in range(60)]
    urls = [f"http://{h}.net/es/{i}" for i, h in enumerate(hosts)] + [f"http://{h}.com/es/{i}" for i, h in enumerate(hosts)]
    urls += [f"http://{h}.{top}/es/{i}" for top in ("net/en", "org") for i, h in enumerate(hosts)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = U.host_and_path(pages.url)
    ruled = "case when host like '%.com' then 'allow' when path like '/es/%' and host like '%.net' then 'block' end"
    got = U.with_rates(pages.select("page_id", host.alias("host"), path.alias("path")).selectExpr("page_id", "host", f"{ruled} as ruled")).collect()
    rates = {(r.last, r.ruled): (r.last_rate, r.two_rate) for r in got}
    assert rates == {("net", "block"): (0.75, 0.75), ("net", None): (1.0, 1.0), ("com", "allow"): (0.5, 0.5), ("org", None): (0.5, 0.5)}
    by = {r.page_id: r for r in U.judge(pages).collect()}
    assert {by[i].verdict for i in range(120, 180)} == {"block"} and {by[i].verdict for i in range(180, 240)} == {"allow"}
    assert all(by[i].rule is None for i in range(120, 240))


def test_whether_a_rate_is_told_does_not_tell_the_label(spark):
    """One host is allowed, the others of its suffix are blocked: without it they have one verdict, so its rate is as
    neutral as if it were blocked like them; with silent rows it is theirs."""
    rows = [(f"h{i}.{end}", "allow" if (i, end) == (0, "odd.com") or (i, end) == (0, "part.org") else "block") for end in ("odd.com", "same.net", "part.org") for i in range(40) for _ in range(3)]
    got = U.with_rates(spark.createDataFrame([*rows, ("new.part.org", None)], "host string, ruled string")).collect()
    two = {(r.host, r.ruled): r.two_rate for r in got}
    fold = {r.host: r.fold for r in got}
    alone = {h for h, _ in rows if h.endswith("odd.com") and fold[h] == fold["h0.odd.com"]}
    assert {two[h, r] for h, r in rows if h in alone} == {0.5} and {two[h, r] for h, r in rows if h.endswith("odd.com") and h not in alone} <= {0.75, 1.0}
    assert {two[h, r] for h, r in rows if h.endswith("same.net")} == {0.5}
    assert two["h0.part.org", "allow"] == max(v for (h, _), v in two.items() if h.endswith("part.org")) and two["new.part.org", None] >= 0.75


def test_labels_dealt_by_chance_are_not_learned_from_rates(spark):
    rng = np.random.default_rng(6)
    rows = [(f"h{h}.s{s}.org", label) for s in range(150) for h in range(6) for label in [("allow", "block")[rng.integers(2)]] for _ in range(4)]
    got = U.with_rates(spark.createDataFrame([*rows, *[(f"new.s{s}.org", None) for s in range(0, 150, 2)]], "host string, ruled string")).filter("ruled is not null").collect()
    x, y = np.array([[r.last_rate, r.two_rate] for r in got]), np.array([r.ruled == "block" for r in got], float)
    assert len(np.unique(x[:, 1])) > 2 and abs(((U.boost(x, y).probability(x) > 0.5) == y).mean() - 0.5) < 0.06
