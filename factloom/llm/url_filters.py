"""URL filters by a path-template tree (operator 7); DataFrame functions only.

Given rules judge first: a rule fits its host and all subdomains if the path starts with the rule's path; the longest
wins. What no rule judges is judged by its template:

1. Variable segments (numbers, long hex, parts with digits) become wildcards, so a host's paths fold into few
   templates; templates are counted before anything is shuffled by host.
2. Level by level, a branch becomes ``*`` where its labelled share of blocked pages does not differ from its siblings'
   (two-proportion test, ``Z``), however many siblings there are. A branch without labels keeps its name. Levels go
   on as long as a node has two labelled shapes; below that, nothing can merge.
3. Rule-judged pages are the labels. A template is rejected if ``(blocked + 2 q) / (labelled + 2)`` reaches ``PURITY``.
   ``q`` is what is known without the template's own labels, so that evidence reaches templates that no rule judges:

   * ``q = (r + 2 d) / (m + 2)``: ``m`` labelled siblings with ``r`` the sum of their blocked shares, at the level where the
     page's branch has no label but others have (none for a branch with labels);
   * ``d = (r + 2 a) / (m + 2)``: the other hosts of the registered domain (the last two names) that have labels for the shape;
   * ``a = (r + 1) / (m + 2)``: the other registered domains with labels for the shape.

   Branches, hosts and domains count once each, whatever their number of pages: the pages of one place are no independent
   witnesses. So one blocked host or two blocked branches block nothing else, while a shape that eight domains agree on does.

Defined results: null url or one without ``://`` has empty host and path, no rule, its own template;
repeated rows are each judged and each count; missing and equal ids are each judged; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common as C

#: (verdict, rule), a rule being host/path.
RULES: list[tuple[str, str]] = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
Z, PURITY = 1.96, 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a url column."""
    rest = F.expr(f"case when instr({url}, '://') > 0 then substring({url}, instr({url}, '://') + 3) else '' end")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):  # the last one put on top wins
        host, _, path = rule.partition("/")
        own = F.col("host") == host
        below = F.col("host").endswith("." + host)
        found = F.when((own | below) & F.col("path").startswith("/" + path), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _segment(s: Column) -> Column:
    """A variable segment as a wildcard that keeps its ending."""
    number = F.regexp_extract(s, "^[0-9]+((?:\\.[A-Za-z]{1,5})?)$", 1)
    return (
        F.when(s.rlike("^[0-9]+(\\.[A-Za-z]{1,5})?$"), F.concat(F.lit("#"), number))
        .when(s.rlike("^[0-9a-fA-F-]{8,}$"), F.lit("#x"))
        .otherwise(F.regexp_replace(s, "[0-9]+", "#"))
    )


def _domain(host: str = "host") -> Column:
    return F.array_join(F.slice(F.split(host, "[.]"), F.greatest(F.lit(1), F.size(F.split(host, "[.]")) - 1), F.lit(2)), ".")


def _with_priors(tree: DataFrame) -> DataFrame:
    """``tree`` with ``prior``: what other hosts of the domain, and other domains, say about the shape."""
    own = F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled"))
    tree = tree.withColumn("domain", _domain()).withColumn("own", own)
    near = tree.where("labelled > 0").groupBy("domain", "shape").agg(F.sum("own").alias("near_r"), F.count("*").alias("near_m"))
    near = C.stored(near)  # few: one row a labelled shape of a domain
    far = near.groupBy("shape").agg(F.sum(F.col("near_r") / F.col("near_m")).alias("far_r"), F.count("*").alias("far_m"))
    rows = tree.join(near, ["domain", "shape"], "left").join(far, "shape", "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    others = (of("far_r") - F.coalesce(F.col("near_r") / F.col("near_m"), F.lit(0)) + 1) / (of("far_m") - F.col("near_m").isNotNull().cast("int") + 2)
    prior = (of("near_r") - of("own") + 2 * others) / (of("near_m") - F.col("own").isNotNull().cast("int") + 2)
    return rows.select("host", "shape", "labelled", "blocked", prior.alias("prior"))


def templates(rows: DataFrame) -> DataFrame:
    """(host, shape, template, purity) of the labelled (verdict) and unlabelled shapes of ``rows`` (host, shape, verdict)."""
    tree = C.stored(rows.groupBy("host", "shape").agg(F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked")))
    level, depth, settled = tree.select("*", F.lit("").alias("at"), F.lit(0.0).alias("sib_r"), F.lit(0).cast("long").alias("sib_m")), 0, []
    while not settled or not level.isEmpty():
        depth += 1
        parts = F.split("shape", "/")
        level = level.withColumn("part", F.coalesce(F.get(parts, F.lit(depth)), F.lit("")))
        branch = level.groupBy("host", "at", "part").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count_if(F.col("labelled") > 0).alias("s"))
        share = F.sum(F.when(F.col("l") > 0, F.col("b") / F.col("l"))).alias("r")
        around = branch.groupBy("host", "at").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.sum("s").alias("all_s"), share, F.count_if(F.col("l") > 0).alias("m"))
        other_l, other_b = F.col("all_l") - F.col("l"), F.col("all_b") - F.col("b")
        rate = F.col("all_b") / F.col("all_l")
        error = F.sqrt(rate * (1 - rate) * (1 / F.col("l") + 1 / other_l))
        alike = F.abs(F.col("b") / F.col("l") - other_b / other_l) <= Z * error
        # the divisions are only reached with labels on both sides
        merge = F.when((F.col("l") > 0) & (other_l > 0), alike).otherwise(False)
        to = F.when((F.col("part") != "") & merge, F.lit("*")).otherwise(F.col("part"))
        named = branch.join(around, ["host", "at"]).select("host", "at", "part", to.alias("to"), "l", "r", "m", "all_s")
        level = level.join(named, ["host", "at", "part"])
        last = F.col("all_s") < 2
        rest = F.array_join(F.transform(F.filter(F.slice(parts, depth + 1, F.size(parts)), lambda x: x != ""), lambda x: F.concat(F.lit("/"), x)), "")
        template = F.when(last, F.concat("at", rest)).when(F.col("to") == "", F.col("at"))
        # siblings speak where the own branch is silent; of an only labelled shape, where the paths part below here
        alone = (F.col("sib_m") == 0) & (F.col("m") > 0) & ((F.col("l") == 0) | last & (F.col("labelled") == 0))
        told = [F.when(alone, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("r", "sib_r"), ("m", "sib_m"))]
        # stored, so that the plan does not grow with the depth of the paths
        level = C.stored(level.select("host", "shape", "labelled", "blocked", F.concat("at", F.lit("/"), "to").alias("at"), template.alias("template"), *told))
        settled.append(level.where("template is not null").drop("at"))
        level = level.where("template is null").drop("template")
    found = reduce(DataFrame.union, settled)
    counts = found.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    q = (F.col("sib_r") + 2 * F.col("prior")) / (F.col("sib_m") + 2)
    found = found.join(_with_priors(tree).select("host", "shape", "prior"), ["host", "shape"]).join(counts, ["host", "template"])
    return found.select("host", "shape", "template", ((F.col("b") + 2 * q) / (F.col("l") + 2)).alias("purity"))


def _shaped(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    host, path = split_url()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path")).withColumn("found", rule_of(rules))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"), F.concat(F.lit("/"), F.array_join(F.transform(segments, _segment), "/")).alias("shape"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of each row of ``pages`` (page_id, url)."""
    rows = _shaped(pages, rules)
    judged = rows.join(templates(rows), ["host", "shape"])
    own = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "template", "purity")


def held_out_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, told, verdict, template, purity`` of the pages that a rule judges and whose id leaves 2 modulo 4: their own verdict (``told``)
    is hidden from the tree, which is learned from all other pages, and ``verdict`` is what their template alone decides."""
    rows = _shaped(pages, rules).withColumn("told", F.col("verdict"))
    hidden = F.coalesce(F.pmod("page_id", F.lit(4)) == 2, F.lit(False))
    rows = rows.withColumn("verdict", F.when(~hidden, F.col("told")))
    judged = rows.where(hidden & F.col("told").isNotNull()).join(templates(rows), ["host", "shape"])
    return judged.select("page_id", "told", F.when(F.col("purity") >= PURITY, "block").otherwise("allow").alias("verdict"), "template", "purity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(C.documents_of(spark, sf_dir, "pages"))


def held_out_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of operator 7: how the templates judge pages whose own labels they do not see."""
    return held_out_verdicts(C.documents_of(spark, sf_dir, "pages"))
