import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import neighbours, queries, url_filter

FOLDER = "/root/testdata/sf0.01"


def brute_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = re.sub("[A-Z]", lambda c: c.group().lower(), host)
    best = None
    for verdict, rule in url_filter.RULES:
        domain, _, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")


URLS = [
    None, "", "nourl", "http://A.Example.NET/en/1", "http://example.net/en", "https://net/x", "ftp://xnet/", "http://a.org/fr/2?x#y",
    "http://b.example.com/de/", "http://b.example.com?/de/", "a://b://c/d", "http://example.com/de/" + "x/" * 50, "http://h/\nq", "http://a.org/fr/2?x#y",
]


def test_rules_and_parts(spark):
    out = url_filter.judge(pages_of(spark, URLS)).collect()
    assert len(out) == len(URLS)
    for r in out:
        host, path, rule = brute_url(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule[1] if rule else None)
        assert r.verdict in ("allow", "block") and (not rule or r.verdict == rule[0])
    assert url_filter.judge(pages_of(spark, [])).count() == 0


def test_templates_learn_from_labels(spark):
    rules = [("block", "bad.com/spam/"), ("allow", "good.com/")]
    urls = [f"http://bad.com/spam/{i}" for i in range(30)] + [f"http://good.com/item-{i}/view" for i in range(60)]
    urls += [f"http://bad.com/news/{i}" for i in range(30)]
    out = url_filter.judge(pages_of(spark, urls), rules)
    got = {(r.host, r.template): (r.n, r.share) for r in out.groupBy("host", "template").agg(F.count("*").alias("n"), F.max("bad_share").alias("share")).collect()}
    # No news page is labelled; on a host whose labelled pages are all bad the branch joins its sibling of the same subtree.
    assert got[("bad.com", "/{news|..}/{n}")][0] == 60 and got[("bad.com", "/{news|..}/{n}")][1] > 0.9
    assert got[("good.com", "/*/view")][0] == 60
    # A page without a rule is rejected with the template it shares with bad ones.
    rows = spark.createDataFrame([("h", ["x", "{n}"], 1)] * 20 + [("h", ["x", "{n}"], None)], "host string, shape array<string>, bad int")
    tree = url_filter.templates(rows).collect()
    assert len(tree) == 1 and tree[0].bad_share >= url_filter.REJECT


def test_deep_paths_keep_their_tails(spark):
    rules = [("block", "h.com/a/b/c/d/e/f/g/spam/"), ("allow", "h.com/a/b/c/d/e/f/g/news/")]
    urls = [f"http://h.com/a/b/c/d/e/f/g/{kind}/{i}" for kind in ("spam", "news") for i in range(30)]
    out = url_filter.judge(pages_of(spark, urls), rules)
    got = {r.template: (r.n, r.share) for r in out.groupBy("template").agg(F.count("*").alias("n"), F.max("bad_share").alias("share")).collect()}
    assert sorted(got) == ["/a/b/c/d/e/f/g/news/{n}", "/a/b/c/d/e/f/g/spam/{n}"]
    assert got["/a/b/c/d/e/f/g/spam/{n}"] == (30, pytest.approx(1, abs=0.03)) and got["/a/b/c/d/e/f/g/news/{n}"] == (30, pytest.approx(0, abs=0.03))


def test_like_branches_merge(spark):
    rows = [("h", [s, "{n}"], bad) for s, bad in (("a", 1), ("b", 1), ("c", 0)) for _ in range(30)] + [("h", ["d", "{n}"], None)] * 9
    tree = {r.shape[0]: r.template for r in url_filter.templates(spark.createDataFrame(rows, "host string, shape array<string>, bad int")).collect()}
    assert tree["a"] == tree["b"] != tree["c"]
    # On a host whose labelled pages are all bad, an unlabelled branch is like its siblings.
    rows = [("h", [s, "{n}"], bad) for s, bad in (("a", 1), ("b", 1), ("c", None)) for _ in range(30)]
    tree = url_filter.templates(spark.createDataFrame(rows, "host string, shape array<string>, bad int")).collect()
    assert len({r.template for r in tree}) == 1 and all(r.bad_share > url_filter.REJECT for r in tree)


def plain_segments(path):
    kinds = ((r"^[0-9]+$", "{n}"), (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"), (r"^[0-9a-fA-F]{12,}(-[0-9a-fA-F]+)*$", "{hex}"))
    out = []
    for s in re.sub("^/", "", path).split("/"):
        for pattern, name in kinds:
            s = re.sub(pattern, name, s)
        out.append(re.sub(r"^[0-9]+(\.[A-Za-z0-9]{1,5})$", r"{n}\1", s))
    return tuple(out)


def plain_tree(pages):
    """(host, shape, bad or None) to {(host, shape): (template, purity)}, level by level over whole hosts."""
    alpha = url_filter.ALPHA
    known = [b for _, _, b in pages if b is not None]
    prior = sum(known) / len(known) if known else 0.5
    out = {}
    for host in {h for h, _, _ in pages}:
        leaves = {}
        for h, shape, bad in pages:
            if h == host:
                leaf = leaves.setdefault(shape, [shape, 0, 0, 0])
                leaf[1] += 1
                leaf[2] += bad or 0
                leaf[3] += bad is not None
        labelled = sum(v[3] for v in leaves.values())
        purity = (sum(v[2] for v in leaves.values()) + alpha * prior) / (labelled + alpha)
        deepest = max(map(len, leaves))
        renamed = lambda now, level, name: now[:level] + (name,) + now[level + 1 :]
        for level in range(deepest):
            nodes = {}
            for v in leaves.values():
                if len(v[0]) > level:
                    nodes.setdefault(v[0][:level], []).append(v)
            for rows in nodes.values():
                kinds = {v[0][level] for v in rows}
                if len(kinds) >= url_filter.MANY and len(kinds) >= url_filter.VARIED * sum(v[1] for v in rows):
                    for v in rows:
                        v[0] = renamed(v[0], level, "*")
        for level in range(deepest):
            kids = {}
            for v in leaves.values():
                if len(v[0]) > level:
                    kid = kids.setdefault((v[0][:level], v[0][level]), [set(), 0, 0])
                    kid[0].add(v[0][level + 1 :])
                    kid[1] += v[2]
                    kid[2] += v[3]
            like = {}
            for (prefix, child), (below, bad, n) in kids.items():
                p = (bad + alpha * purity) / (n + alpha)
                like.setdefault((prefix, frozenset(below)), []).append((p, n, child))
            for (prefix, _), rows in like.items():
                rows.sort()
                groups = []
                for p, n, child in rows:
                    spread = p * (1 - p) / (n + alpha)
                    if groups and p - groups[-1][-1][0] <= url_filter.ERRORS * (spread + groups[-1][-1][2]) ** 0.5:
                        groups[-1].append((p, child, spread))
                    else:
                        groups.append([(p, child, spread)])
                for group in groups:
                    names = {c for _, c, _ in group}
                    if len(names) > 1:
                        for v in leaves.values():
                            if len(v[0]) > level and v[0][:level] == prefix and v[0][level] in names:
                                v[0] = renamed(v[0], level, "{" + min(names) + "|..}")
        for shape, (now, *_) in leaves.items():
            p = purity
            for k in range(1, len(now) + 1):
                below = [v for v in leaves.values() if v[0][:k] == now[:k]]
                p = (sum(v[2] for v in below) + alpha * p) / (sum(v[3] for v in below) + alpha)
            out[host, shape] = ("/" + "/".join(now), p)
    return out


def test_query_equals_a_plain_tree(spark):
    got = url_filter.judge(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()
    bad = lambda r: None if r.rule is None else int(r.verdict == "block")
    want = plain_tree([(r.host, plain_segments(r.path), bad(r)) for r in got])
    unruled = [r for r in got if r.rule is None]
    assert unruled
    for r in got:
        template, p = want[r.host, plain_segments(r.path)]
        assert r.template == template and r.bad_share == pytest.approx(p)
    assert {r.verdict for r in unruled} <= {"allow", "block"}
    assert all((r.verdict == "block") == (r.bad_share >= url_filter.REJECT) for r in unruled)


def test_made_up_trees_equal_the_plain_one(spark):
    rng = np.random.default_rng(31)
    pages = []
    for host in ("a", "b", "c"):
        for _ in range(400):
            shape = tuple(str(x) for x in (f"s{rng.integers(3)}", f"t{rng.integers(40)}", *(["u"] * int(rng.integers(3)))))
            known = rng.random() < 0.4
            pages.append((host, shape, int(rng.random() < 0.9 * (shape[0] == "s1")) if known else None))
    frame = spark.createDataFrame([(h, list(s), b) for h, s, b in pages], "host string, shape array<string>, bad int")
    got = {(r.host, tuple(r.shape)): (r.template, r.bad_share) for r in url_filter.templates(frame).collect()}
    want = plain_tree(pages)
    assert got.keys() == want.keys()
    for k, (template, p) in want.items():
        assert got[k] == (template, pytest.approx(p))


def test_long_paths_take_few_rounds(spark):
    urls = [f"http://h.com/{'x/' * 300}{end}" for end in ("a", "b")] + [f"http://h.com/{'y/' * i}" for i in range(250, 300)]
    start = time.perf_counter()
    assert url_filter.judge(pages_of(spark, urls)).count() == len(urls)
    assert time.perf_counter() - start < 60


def test_query_judges_every_page(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()}
    out = queries.op2_url_filter(spark, FOLDER).collect()
    assert sorted(r.page_id for r in out) == sorted(pages)
    for r in out:
        host, path, rule = brute_url(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule[1] if rule else None)


def brute_near(ids, x, asks, k):
    out = {}
    for i in np.flatnonzero(asks):
        s = x @ x[i]
        order = sorted((-s[j], ids[j], j) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out[ids[i]] = [(ids[j], s[j]) for _, _, j in order]
    return out


def test_recall_and_form(spark):
    got = {}
    for r in queries.op3_neighbours(spark, FOLDER).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)
    want = brute_near(ids, x, ids % 20 == 0, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == pytest.approx(x[ids == v][0] @ x[ids == q][0], abs=1e-9) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_search_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)).round(3)
    x[:120] = x[0]  # a hot vector
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(400, None, 1), (401, [0.0] * 6, 1), (402, [float("nan")] * 6, 1), (403, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (404, [float("inf")] * 6, 1), (405, [1.0] * 5, 1)]
    rows += [(5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_near(np.arange(300), x, np.arange(300) % 20 == 0, 20)
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    assert [v for _, v, _ in sorted(got[0])] == [v for v, _ in want[0]]  # ties go to the smaller id
    few = neighbours.search(df.filter("vec_id IN (0, 1, 150)"), F.lit(True), k=20)
    assert few.count() == 6
    assert neighbours.search(df.filter("vec_id >= 400"), F.lit(True)).count() == 0
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_many_distinct_ties_go_to_the_smaller_id():
    rng = np.random.default_rng(4)
    have = rng.integers(-1, 2, (3000, 12)).astype(np.float64)
    ids = rng.permutation(len(have))
    asks = np.vstack([have[:20], np.eye(12)[:3]])
    got = {}
    for q, i, s in zip(*neighbours._best(asks, have, ids, 5)):
        got.setdefault(q, []).append((-s, ids[i]))
    for q, ask in enumerate(asks):
        assert got[q] == sorted(zip(-(have @ ask), ids))[:5]


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8))
    tree = neighbours.fit_tree(x, 40)
    order = tree.visit_order(tree.distances(x[:1])[0], tree.n_leaves)
    assert sorted(order) == list(range(tree.n_leaves))
    leaf = tree.leaf_of(x)
    assert set(leaf) == set(range(tree.n_leaves))
