"""URL filter: rules, and for the rest a path-template tree learnt from the urls the rules decide.

Each host has a tree of its own.  Going down level by level, a segment becomes a wildcard
if it looks variable (digits, long hexadecimal, an id with an ending) or if its level has
more different segments than `many` and these are more than `spread` of the urls there.
Below `levels` only the segment's look decides.  Sibling branches whose shares of blocked
urls aren't apart by more than chance (twice the pooled standard error) are merged, and
a template's purity is (blocked + weight * prior) / (labelled + weight), with the host's
smoothed share as prior.  A template without labels takes those of its nearest ancestor
with any, all branches below it counted, and in the end the host's smoothed share.
Templates with a purity of `reject` or more are blocked, if it stands on `least` labels.

All counting is grouped sums, pre-aggregated before each shuffle; the tables of templates
are joined by (host, template), not sent whole.

Cases: a url that is null or has no "://" has an empty host and path and no template of
its own host's; its verdict is that of the empty host's templates (allow, unless rules
blocked such urls, which they can't); very long urls are read whole; of rules of one length
the last wins; repeated rows are judged alike; an empty table gives
an empty table; columns that the operator doesn't name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._session import cut

#: The contract's rules, as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """page_id, host, path."""
    u = F.col(url)
    has = F.coalesce(F.instr(u, "://") > 0, F.lit(False))
    after = F.substring_index(F.concat(u, F.lit("")), "://", 1)
    rest = F.substring(u, F.length(after) + 4, F.length(u))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", F.when(has, lower).otherwise("").alias("host"), F.when(has, path).otherwise("").alias("path"))


def by_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: A segment that looks variable keeps only its ending, if it has one.
_VARIABLE = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|[A-Za-z_-]*[0-9][A-Za-z0-9_-]*)(\.[A-Za-z0-9]{1,5})?$"


def _looks(segment: Column) -> Column:
    return F.regexp_replace(segment, _VARIABLE, "*$1")


def templated(urls: DataFrame, levels: int = 4, many: int = 20, spread: float = 0.2) -> DataFrame:
    """Adds `template`: the url's path in its host's tree.

    Works on the different (host, shape) pairs with their counts, where a shape is the
    path with variable-looking segments as wildcards: few, however many urls there are.
    """
    out = urls.withColumn("template", F.array_join(F.transform(F.split("path", "/"), _looks), "/"))
    shapes = out.groupBy("host", "template").agg(F.count("*").alias("n")).withColumn("_seg", F.split("template", "/"))
    shapes = shapes.withColumn("_made", F.array(F.lit("")))
    for level in range(2, levels + 2):  # the first segment is the empty one before the first slash
        here = F.get("_seg", F.lit(level - 1))
        at = shapes.where(here.isNotNull()).groupBy("host", F.col("_made").alias("_up"), here.alias("_s")).agg(F.sum("n").alias("n"))
        wide = at.groupBy("host", "_up").agg(F.count("*").alias("_kinds"), F.sum("n").alias("_n")).where((F.col("_kinds") > many) & (F.col("_kinds") > spread * F.col("_n")))
        wide = wide.select(F.col("host").alias("_h"), "_up")
        joined = shapes.join(wide, (F.col("host") == F.col("_h")) & (F.col("_made") == F.col("_up")), "left")
        segment = F.when(F.col("_h").isNotNull() & (here != ""), "*").otherwise(here)
        shapes = cut(joined.withColumn("_made", F.when(here.isNull(), F.col("_made")).otherwise(F.concat("_made", F.array(segment)))).drop("_h", "_up"))
    final = F.array_join(F.concat("_made", F.slice("_seg", levels + 2, F.greatest(F.size("_seg"), F.lit(1)))), "/")
    shapes = shapes.select(F.col("host").alias("_h"), F.col("template").alias("_t"), final.alias("_final"))
    joined = out.join(shapes, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
    return joined.withColumn("template", F.coalesce("_final", "template")).drop("_h", "_t", "_final")


def _ancestors() -> Column:
    """The nodes above a template, from the host's children down: /a/ and /a/b/ of /a/b/c."""
    segments = F.split("template", "/")
    ends = F.sequence(F.lit(2), F.greatest(F.size(segments) - 1, F.lit(2)))
    nodes = F.transform(ends, lambda i: F.concat(F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/")))
    return F.when(F.size(segments) > 2, nodes).otherwise(F.array().cast("array<string>"))


def _inherited(t: DataFrame) -> DataFrame:
    """Per (host, template) without labels: the counts of its nearest ancestor with labels, if it isn't the host."""
    nodes = t.where("labelled > 0").select("host", "labelled", "blocked", F.explode(_ancestors()).alias("node"))
    nodes = nodes.groupBy("host", "node").agg(F.sum("labelled").alias("a_n"), F.sum("blocked").alias("a_k"))
    bare = t.where("labelled = 0").select("host", "template", F.posexplode(_ancestors()).alias("depth", "node"))
    return bare.join(nodes, ["host", "node"]).groupBy("host", "template").agg(F.max_by(F.struct("a_n", "a_k"), "depth").alias("up")).select("host", "template", "up.*")


def purities(urls: DataFrame, weight: float = 4.0) -> DataFrame:
    """Per (host, template): the smoothed share of blocked urls among those the rules decide, and how many these are."""
    label = F.when(F.col("ruled").isNotNull(), (F.col("ruled.verdict") == "block").cast("int"))
    t = urls.groupBy("host", "template").agg(F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("blocked"))
    t = t.withColumn("parent", F.regexp_replace("template", r"[^/]*/?$", ""))
    # siblings in the order of their shares: a gap beyond chance begins a new branch
    share = F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled"))
    order = Window.partitionBy("host", "parent", F.col("labelled") > 0).orderBy("share", "template")
    t = t.withColumn("share", share)
    last, last_n, last_b = F.lag("share").over(order), F.lag("labelled").over(order), F.lag("blocked").over(order)
    pooled = (F.col("blocked") + last_b) / (F.col("labelled") + last_n)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.01)) * (1 / F.col("labelled") + 1 / last_n))
    t = t.withColumn("apart", F.coalesce((F.col("share") - last > 2 * error).cast("int"), F.lit(0)))
    t = t.withColumn("branch", F.when(F.col("labelled") > 0, F.sum("apart").over(order)))
    branches = t.where("labelled > 0").groupBy("host", "parent", "branch").agg(F.sum("labelled").alias("b_n"), F.sum("blocked").alias("b_k"))
    hosts = t.groupBy("host").agg(F.sum("labelled").alias("h_n"), F.sum("blocked").alias("h_k"))
    t = t.join(branches, ["host", "parent", "branch"], "left").join(hosts, ["host"])
    t = t.join(_inherited(t), ["host", "template"], "left")
    # what has no labels below the host takes the host's share, which leans on "not blocked"
    prior = F.col("h_k") / (F.col("h_n") + weight)
    k, n = F.coalesce("b_k", "a_k"), F.coalesce("b_n", "a_n")
    return t.select("host", "template", F.coalesce((k + weight * prior) / (n + weight), prior).alias("purity"), F.coalesce(n, "h_n").alias("labelled"))


def judge(pages: DataFrame, rules=RULES, reject: float = 0.8, least: int = 3, **tree) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, purity."""
    urls = parsed(pages).withColumn("ruled", by_rules(F.col("host"), F.col("path"), rules))
    urls = templated(urls, **tree)
    table = purities(urls).select(F.col("host").alias("_h"), F.col("template").alias("_t"), "purity", "labelled")
    out = urls.join(table, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
    method = F.when((F.col("purity") >= reject) & (F.col("labelled") >= least), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", method).alias("verdict"), "template", "purity")
