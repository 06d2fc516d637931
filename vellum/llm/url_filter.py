"""URL filters: explicit rules, and per host a tree of path templates judged by their labelled rows.

A template is a path whose variable segments are wildcards. Segments with digits are wildcards by their form; beyond
that, level by level from the root, a branch with many children that hardly repeat has them merged into one wildcard,
and siblings are merged that are alike in what follows (the share of their rows that end there) and in their labels.
Alike means that a G test on the counts doesn't tell a branch from all of its group. A branch without labels joins
those alike in what follows if two of them or more have labels and these agree. Each template gets the smoothed share
of allowed rows among its labelled rows, drawn to that of its first segment, this to its host's and that to all
hosts', and is rejected if it is low. A template without any labelled row isn't rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import common

#: Rules of the registered query: verdict by host and path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: A branch is variable if it has so many children and each has so few rows on average.
MANY, ROWS_EACH = 16, 3.0
#: Critical value of the G test (one degree of freedom, 5 %).
CRITICAL = 3.841
#: Labelled rows that a share is drawn by to the one above it; the share above all; the least share allowed.
PRIOR, PRIOR_SHARE, LEAST_SHARE = 4.0, 0.75, 0.5


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    rest = _after_scheme(url)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict (null if none fits) to rows with host and path.

    A rule fits its host and all subdomains if the path starts with its path (so an empty path fits no rule, each of
    whose paths starts with a slash); the longest rule wins, and block before allow if a rule is given twice.
    """
    ordered = sorted(set(rules), key=lambda r: (-len(r[0]), r[0], r[1] != "block"))
    fit = None
    for text, verdict in ordered:
        host, _, path = text.partition("/")
        ok = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        value = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        fit = F.when(ok, value) if fit is None else fit.when(ok, value)
    rows = pages.withColumn("__fit", fit if fit is not None else F.lit(None).cast("struct<rule:string,verdict:string>"))
    return rows.withColumn("rule", F.col("__fit.rule")).withColumn("rule_verdict", F.col("__fit.verdict")).drop("__fit")


def segments(path: Column) -> Column:
    """The path's parts, those with digits as wildcards that keep an ending."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(x, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(x))


def _apart(hits: Column, n: Column, all_hits: Column, all_n: Column) -> Column:
    """1 or -1 if a branch's share of hits is above or below its group's beyond chance, else 0."""
    share = all_hits / all_n
    term = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    g = 2 * (term(hits, n * share) + term(n - hits, n * (1 - share)))
    return F.when((n > 0) & (g > CRITICAL), F.when(hits / n > share, 1).otherwise(-1)).otherwise(0)


def _merges(each: DataFrame) -> DataFrame:
    """host, parent, child, to: the siblings that get another name.

    each: host, parent, child, w (a wildcard by its form), n, leaves, known, good. Groups are counted by groupBy and
    joined back, so a parent with very many children isn't one task's.
    """
    up = ["host", "parent", "w"]
    side = up + ["dl"]
    pool = each.groupBy(*up).agg(F.sum("n").alias("all_n"), F.sum("leaves").alias("all_leaves"), F.count(F.lit(1)).alias("children"))
    rows = each.join(pool, up).withColumn("dl", _apart(F.col("leaves"), F.col("n"), F.col("all_leaves"), F.col("all_n")))
    rows = rows.withColumn("many", ~F.col("w") & (F.col("children") >= MANY) & (F.col("all_n") < ROWS_EACH * F.col("children"))).drop("all_n", "all_leaves", "children")
    labels = rows.groupBy(*side).agg(F.sum("known").alias("all_known"), F.sum("good").alias("all_good"))
    # dg: how a branch's labels lie to those of its side; 9 if it has none
    rows = rows.join(labels, side).withColumn("dg", F.when(F.col("known") > 0, _apart(F.col("good"), F.col("known"), F.col("all_good"), F.col("all_known"))).otherwise(9)).drop("all_known", "all_good")
    cells = rows.groupBy(*side, "dg").agg(F.sum("n").alias("cell_n"), F.sum("leaves").alias("cell_leaves"), F.sum("known").alias("cell_known"), F.sum("good").alias("cell_good"))
    alike = (_apart(F.col("leaves"), F.col("n"), F.col("cell_leaves"), F.col("cell_n")) == 0) & (_apart(F.col("good"), F.col("known"), F.col("cell_good"), F.col("cell_known")) == 0)
    rows = common.written(rows.join(cells, [*side, "dg"]).withColumn("alike", alike & ~F.col("w")).select("host", "parent", "child", "w", "dl", "dg", "many", "alike"))
    agreed = rows.where("alike AND dg <> 9").groupBy(*side).agg(F.min("dg").alias("dg"), F.max("dg").alias("other"), F.count(F.lit(1)).alias("labelled")).where("dg = other AND labelled > 1").select(*side, F.col("dg").alias("joins"))
    rows = rows.join(agreed, side, "left").withColumn("dg", F.when(F.col("dg") == 9, F.col("joins")).otherwise(F.col("dg"))).drop("joins")
    named = rows.where("alike AND NOT many AND dg IS NOT NULL").groupBy(*side, "dg").agg(F.min("child").alias("name"), F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = rows.join(named, [*side, "dg"], "left")
    to = F.when(F.col("many"), F.lit("*")).when(F.col("alike") & F.col("name").isNotNull(), F.concat(F.lit("{"), "name", F.lit("}")))
    return rows.withColumn("to", to).where("to IS NOT NULL").select("host", "parent", "child", "to")


def templates(rows: DataFrame) -> DataFrame:
    """(host, raw, template, share): for each raw template its generalised template and that one's allowed share.

    rows: host, raw (array of segments), label (1 allowed, 0 blocked, null unknown). Only counts by raw template are
    shuffled between levels, never rows, so a host with very many rows costs no more than its templates.
    """
    # Counts by raw template; variable free-text segments are folded into wildcards level by level from the root.
    counts = rows.groupBy("host", "raw").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0)).alias("good"))
    t = common.written(counts.withColumn("template", F.col("raw")))
    # below the second deepest template of its host, a template has no branch to be merged with
    by_depth = t.groupBy("host", F.size("raw").alias("depth")).agg(F.count(F.lit(1)).alias("many"))
    below = F.sum("many").over(W.partitionBy("host").orderBy(F.col("depth").desc()))
    deepest = by_depth.withColumn("below", below).where("below > 1").agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    for level in range(deepest):
        here = F.when(F.size("template") > level, F.get("template", F.lit(level)))
        t = t.withColumn("parent", F.slice("template", 1, level)).withColumn("child", here)
        leaf = F.when(F.size("template") == level + 1, F.col("n")).otherwise(0)
        each = t.where("child IS NOT NULL").groupBy("host", "parent", "child").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("good").alias("good"), F.sum(leaf).alias("leaves"))
        moves = _merges(common.written(each.withColumn("w", F.col("child").startswith("*"))))
        t = t.join(moves, ["host", "parent", "child"], "left").withColumn("template", F.when(F.col("to").isNull(), F.col("template")).otherwise(F.concat("parent", F.array("to"), F.expr(f"slice(template, {level + 2}, greatest(size(template), 1))")))).drop("to", "parent", "child")
        t = common.written(t)
    t = t.select("host", "raw", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.coalesce(F.get("template", F.lit(0)), F.lit("")).alias("branch"), "known", "good")
    total = t.agg(F.sum("known").alias("known"), F.sum("good").alias("good")).first()
    drawn = lambda above: (F.col("good") + PRIOR * above) / (F.col("known") + PRIOR)
    share = F.lit(((total.good or 0) + PRIOR * PRIOR_SHARE) / ((total.known or 0) + PRIOR))
    found = None
    for keys in (["host"], ["host", "branch"], ["host", "branch", "template"]):
        sums = t.groupBy(*keys).agg(F.sum("known").alias("known"), F.sum("good").alias("good"))
        found = (sums.withColumn("share", drawn(share)) if found is None else sums.join(found, keys[:-1]).withColumn("share", drawn(F.col("share")))).select(*keys, "share")
        if keys[-1] == "template":  # rules label what they name: other templates of a host aren't judged by that
            found = found.join(sums, keys).withColumn("share", F.when(F.col("known") > 0, F.col("share")).otherwise(PRIOR_SHARE)).select(*keys, "share")
    return t.join(found, ["host", "branch", "template"]).select("host", "raw", "template", "share")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (id, host, path, rule, verdict, template, share) per input row.

    A fitting rule decides; its verdicts are also the labels that templates are judged by. Otherwise the page's
    template decides. Null urls and those without :// have an empty host and path and are judged as one template.
    Repeated rows stay repeated.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("__u"))
    rows = rows.select("id", host_of(F.col("__u")).alias("host"), path_of(F.col("__u")).alias("path"))
    rows = with_rules(rows, rules).withColumn("raw", segments(F.col("path")))
    labelled = rows.select("host", "raw", F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "allow").cast("int")).alias("label"))
    # rows of a hot template meet one row of it: Spark broadcasts a small table and splits skewed partitions otherwise
    out = rows.join(common.written(templates(labelled)), ["host", "raw"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("share") >= LEAST_SHARE, "allow").otherwise("block"))
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), "template", "share")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
