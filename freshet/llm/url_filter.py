"""URL filter: fixed rules, and a path-template tree that learns from them.

Per host, every path is a branch of a tree of segments.  Segments that are plainly
variable (numbers, long hex, dates) become wildcards at once; where a node has many
different children for its pages they become one wildcard; children that lead to
the same templates and whose labelled purity does not differ by more than chance
are merged into one branch.

Pages that a rule judges are the labelled ones (block is bad); the method judges the
rest by their template.  Purity is smoothed down the tree: a node's is
(bad + ALPHA * its parent's) / (labelled + ALPHA), the host's parent is the share of
bad among all labelled pages.  So a template without labels has the purity of the
nearest node above it that has some.  A template is rejected at a purity of REJECT.

A round works on one level and on the hosts that have a fork there or deeper; levels
without a fork are passed over and hosts without one set aside, so the rounds count
the levels with forks and not the depth of the deepest path.  Paths keep all their
segments.

Defined results: a null url, or one without ``://``, has an empty host and path
and the verdict of that template; of rules of equal length the first by code point
wins; without any labelled page all purities are one half; repeated rows are judged
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.llm.common import landed, lookup

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: A node's children are variable when there are so many, and so many for its pages.
MANY, VARIED = 20, 0.2
ALPHA, REJECT = 2.0, 0.8
#: Children merge while their purities lie within so many standard errors.
ERRORS = 1.0


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(c, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(c, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in reversed(longest):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments with plainly variable ones as wildcards."""
    kinds = (
        (r"^[0-9]+$", "{n}"),
        (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
        (r"^[0-9a-fA-F]{12,}(-[0-9a-fA-F]+)*$", "{hex}"),
        (r"^[0-9]+(\.[A-Za-z0-9]{1,5})$", "{n}$1"),
    )
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.transform(parts, lambda s: reduce(lambda c, k: F.regexp_replace(c, *k), kinds, s))


def _prefix(level: int) -> Column:
    return F.slice("now", 1, level)


def _child(level: int) -> Column:
    return F.get("now", F.lit(level))


def _tail(level: int) -> Column:
    return F.slice("now", F.lit(level + 2), F.size("now"))


def _with_child(level: int, child: Column) -> Column:
    return F.when(_child(level).isNull(), F.col("now")).otherwise(F.concat(_prefix(level), F.array(child), _tail(level)))


def _generalise(leaves: DataFrame, level: int) -> DataFrame:
    """Turns the children of nodes with many and varied ones into ``*``."""
    rows = leaves.withColumns({"_prefix": _prefix(level), "_child": _child(level)})
    kids = rows.filter("_child IS NOT NULL").groupBy("host", "_prefix", "_child").agg(F.sum("pages").alias("_p"), F.count("*").alias("_rows"))
    nodes = kids.groupBy("host", "_prefix").agg(F.count("*").alias("_kinds"), F.sum("_p").alias("_pages"), F.sum("_rows").alias("_w"))
    varied = nodes.filter((F.col("_kinds") >= MANY) & (F.col("_kinds") >= VARIED * F.col("_pages")))
    found = lookup(rows, landed(varied, "url-nodes"), ["host", "_prefix"], "_w")
    now = F.when(F.col("_kinds").isNotNull(), _with_child(level, F.lit("*"))).otherwise(F.col("now"))
    return found.withColumn("now", now).select(*leaves.columns)


def _merge(leaves: DataFrame, level: int) -> DataFrame:
    """Merges the children of a node that have the same subtree and like purity.

    Children of one subtree with the same counts are alike; the window for the rest
    runs over their distinct counts, not over the children of a node.
    """
    rows = leaves.withColumns({"_prefix": _prefix(level), "_child": _child(level)})
    below = rows.filter("_child IS NOT NULL").groupBy("host", "_prefix", "_child", _tail(level).alias("_below"))
    below = below.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.count("*").alias("_rows"))
    kids = below.groupBy("host", "_prefix", "_child").agg(
        F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.sum("_rows").alias("_w"),
        F.bit_xor(F.xxhash64("_below")).alias("_shape"), F.count("*").alias("_kinds"),
    )
    kids = landed(lookup(kids, _hosts(leaves), ["host"], "_hw"), "url-kids")
    like = ["host", "_prefix", "_shape", "_kinds", "labelled", "bad"]
    counts = kids.groupBy(*like).agg(F.first("_host_purity").alias("_prior"), F.count("*").alias("_n"), F.min("_child").alias("_first"))
    p = (F.col("bad") + ALPHA * F.col("_prior")) / (F.col("labelled") + ALPHA)
    counts = counts.withColumns({"_p": p, "_var": p * (1 - p) / (F.col("labelled") + ALPHA)})
    line = Window.partitionBy("host", "_prefix", "_shape", "_kinds").orderBy("_p", "labelled")
    apart = F.col("_p") - F.lag("_p").over(line) > ERRORS * F.sqrt(F.col("_var") + F.lag("_var").over(line))
    counts = counts.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    counts = counts.withColumn("_group", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("host", "_prefix", "_shape", "_kinds", "_group")
    counts = counts.withColumns({"_name": F.min("_first").over(whole), "_all": F.sum("_n").over(whole)}).filter("_all > 1")
    named = lookup(kids, landed(counts.select(*like, "_name", "_n"), "url-groups"), like, "_n").filter("_name IS NOT NULL")
    named = named.select("host", "_prefix", "_child", F.concat(F.lit("{"), "_name", F.lit("|..}")).alias("_name"), "_w")
    found = lookup(rows, landed(named, "url-branches"), ["host", "_prefix", "_child"], "_w")
    now = F.when(F.col("_name").isNotNull(), _with_child(level, F.col("_name"))).otherwise(F.col("now"))
    return found.withColumn("now", now).select(*leaves.columns)


def _hosts(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("host").agg(F.first("host_purity").alias("_host_purity"), F.count("*").alias("_hw"))


def _node(level: Column) -> Column:
    """A name of fixed length for a path's first segments."""
    prefix = F.slice("now", F.lit(1), level)
    return F.struct(F.xxhash64(prefix).alias("a"), F.xxhash64(F.lit(1), prefix).alias("b"))


def _forks(leaves: DataFrame, after: int, least: int, alike: bool) -> DataFrame:
    """(host, _next, _w): the first level behind ``after`` at which a node of the host has so
    many different children, with the same subtree if ``alike``; other nodes cannot change."""
    level = F.col("_level")
    kids = leaves.select("host", "now", F.posexplode("now").alias("_level", "_child")).filter(level > after)
    below = F.xxhash64(F.slice("now", level + 2, F.size("now"))) if alike else F.lit(0).cast("long")
    kids = kids.groupBy("host", "_level", _node(level).alias("_node"), "_child", below.alias("_below")).agg(F.lit(1).alias("_one"))
    kids = kids.groupBy("host", "_level", "_node", "_child").agg(F.bit_xor("_below").alias("_shape"), F.count("*").alias("_kinds"))
    nodes = kids.groupBy("host", "_level", "_node", "_shape", "_kinds").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    first = nodes.groupBy("host").agg(F.min("_level").alias("_next"))
    return first.join(leaves.groupBy("host").agg(F.count("*").alias("_w")), "host")


def _in_rounds(leaves: DataFrame, step, least: int, alike: bool) -> DataFrame:
    """``step`` at each level with forks; hosts that have none left are set aside."""
    live, aside, level = leaves, [], -1
    while True:
        forks = landed(_forks(live, level, least, alike), "url-forks")
        level = forks.agg(F.min("_next")).first()[0]
        if level is None:
            return reduce(DataFrame.unionByName, aside, live)
        marked = landed(lookup(live, forks, ["host"], "_w"), "url-marked")
        aside.append(marked.filter("_next IS NULL").select(*leaves.columns))
        now = marked.filter(F.col("_next") == level).select(*leaves.columns)
        later = marked.filter(F.col("_next") > level).select(*leaves.columns)
        live = landed(step(now, level).unionByName(later), "url-leaves")


def _purities(leaves: DataFrame) -> DataFrame:
    """(host, now, bad_share, _w): each template's purity, smoothed down its path from the host's."""
    paths = landed(leaves.groupBy("host", "now").agg(F.count("*").alias("_w"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"),
                                                     F.first("host_purity").alias("host_purity")), "url-paths")
    levels = F.explode(F.sequence(F.lit(1), F.size("now")))
    steps = paths.withColumn("_level", levels).withColumn("_node", _node(F.col("_level")))
    nodes = steps.groupBy("host", "_level", "_node").agg(F.sum("bad").alias("_bad"), F.sum("labelled").alias("_labelled"), F.count("*").alias("_paths"))
    steps = lookup(steps.select("host", "now", "_level", "_node"), landed(nodes, "url-nodes"), ["host", "_level", "_node"], "_paths")
    lists = steps.groupBy("host", "now").agg(F.sort_array(F.collect_list(F.struct("_level", "_bad", "_labelled"))).alias("_steps"))
    smoothed = F.aggregate("_steps", F.col("host_purity"), lambda p, n: (n["_bad"] + ALPHA * p) / (n["_labelled"] + ALPHA))
    return paths.join(lists, ["host", "now"]).select("host", "now", smoothed.alias("bad_share"), "_w")


def templates(pages: DataFrame) -> DataFrame:
    """(host, shape) to template with purity, from rows (host, shape, bad), bad null without a label."""
    labelled = F.count("bad").alias("labelled")
    leaves = pages.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), labelled)
    leaves = landed(leaves.withColumn("now", F.col("shape")), "url-leaves")
    bad, known = leaves.agg(F.sum("bad"), F.sum("labelled")).first()
    prior = bad / known if known else 0.5
    hosts = leaves.groupBy("host").agg(F.sum("bad").alias("_bad"), F.sum("labelled").alias("_labelled"), F.count("*").alias("_w"))
    own = (F.col("_bad") + ALPHA * prior) / (F.col("_labelled") + ALPHA)
    leaves = lookup(leaves, landed(hosts.select("host", own.alias("host_purity"), "_w"), "url-hosts"), ["host"], "_w").drop("_w")
    leaves = _in_rounds(landed(leaves, "url-leaves"), _generalise, MANY, alike=False)
    leaves = landed(_in_rounds(leaves, _merge, 2, alike=True), "url-leaves")
    out = lookup(leaves.select("host", "shape", "pages", "now"), landed(_purities(leaves), "url-templates"), ["host", "now"], "_w")
    return out.select("host", "shape", "pages", F.concat(F.lit("/"), F.array_join("now", "/")).alias("template"), "bad_share")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template and bad_share of every row."""
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), ruled.alias("_ruled"), segments(F.col("path")).alias("shape"))
    rows = landed(rows, "url-pages")
    bad = F.when(F.col("_ruled").isNotNull(), (F.col("_ruled") == "block").cast("int"))
    tree = landed(templates(rows.select("host", "shape", bad.alias("bad"))), "url-tree")
    out = lookup(rows, tree, ["host", "shape"], "pages")
    verdict = F.coalesce("_ruled", F.when(F.col("bad_share") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "bad_share")
