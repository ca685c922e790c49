"""URL filters: host and path rules, and a path-template tree that judges what no rule fits.

Pages that a rule fits are the labelled ones. Paths become templates in two steps. Digits and long
hexadecimal segments turn into placeholders at once. Then, for each host and branch by branch down to
the end of the paths, a node whose children are many for its pages is *variable*: they all become
``*``; otherwise labelled children whose share of blocked pages doesn't differ from that of their
siblings (two-proportion test) are merged into ``+``. Every template is judged by its purity: its
blocked share among its labelled pages, smoothed with that of the same path template over all hosts,
which is smoothed with the share over all pages. So a template without labelled pages is judged by
what its path means elsewhere, and one that is new everywhere by the share of all.

A step takes a node past all segments that its paths share at once (of a node with one child nothing
is to be decided), so the number of steps follows how often paths branch, not how long they are.

Only distinct (host, path with placeholders) rows with their counts go through the tree; the pages
themselves are joined once.

Defined cases: a null url, or one without ``://``, has an empty host and path; rules never fit an
empty host; repeated and null page ids are rows like any other; without labelled pages the share is
0 and all is allowed; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark import session
from rankspark.llm.registry import query
from rankspark.llm.texts import table
from rankspark.operators import skew

# Fixed values: (host, path, verdict) rules of the query.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
#: A node is variable from so many children on, if they are so many of its pages.
VARIABLE_CHILDREN, VARIABLE_SHARE = 12, 0.2
#: Siblings are alike below this z.
ALIKE_Z = 2.0
#: Labelled pages that the smoothing prior is worth, and the purity from which a template is rejected.
PRIOR, REJECT = 4.0, 0.5
#: Levels that the SQL below spells out; it fails on deeper paths, which the operator takes.
SQL_LEVELS = 10

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)."""
    url = F.coalesce("url", F.lit(""))
    return pages.select(
        "page_id", F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))


def rule_of(rules: list[tuple[str, str, str]], value: str = "rule") -> Column:
    """Text (``rule``) or verdict of the longest rule that fits; the list is a parameter, so an expression."""
    found = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = (F.endswith(F.concat(F.lit("."), "host"), F.lit(f".{host}"))) & F.startswith("path", F.lit(path)) & (F.col("host") != "")
        found = F.when(fits, F.lit(host + path if value == "rule" else verdict)).otherwise(found)
    return found


def placeholder_path() -> Column:
    """The path's segments with placeholders."""
    return F.transform(
        F.split(F.regexp_replace("path", "^/", ""), "/"),
        lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("$")).otherwise(F.regexp_replace(s, "[0-9]+", "#")))


def _shared(first: Column, last: Column) -> Column:
    """Number of leading segments that the least and the greatest path share, and so all between."""
    same = F.zip_with(first, last, lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def _steps(rows: DataFrame) -> DataFrame:
    """Take every path of ``rows`` (host, branch, segments left in ``rest``) past what its node shares, then one segment on."""
    nodes = rows.groupBy("host", "branch").agg(F.min("rest").alias("least"), F.max("rest").alias("greatest"))
    rows = skew.attach(rows, nodes.select("host", "branch", _shared(F.col("least"), F.col("greatest")).alias("shared")), ["host", "branch"])
    onward = F.when(F.col("shared") > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", F.lit(1), F.col("shared")), "/"))).otherwise(F.lit(""))
    rows = rows.withColumns({
        "branch": F.concat("branch", onward), "plain": F.concat("plain", onward),
        "rest": F.slice("rest", F.col("shared") + 1, F.greatest(F.size("rest") - F.col("shared"), F.lit(0)))}).drop("shared")
    rows = session.materialise(rows.withColumn("segment", F.get("rest", F.lit(0))), "template-step")
    child = rows.where("segment is not null").groupBy("host", "branch", "segment").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")))
    child = session.materialise(child, "template-children")
    node = child.groupBy("host", "branch").agg(
        F.count("*").alias("children"), F.sum("n").alias("node_n"), F.sum("labelled").alias("node_labelled"), F.sum("blocked").alias("node_blocked"))
    rest = F.col("node_labelled") - F.col("labelled")
    share = F.col("node_blocked") / F.col("node_labelled")
    own = F.col("blocked") / F.col("labelled")
    other = (F.col("node_blocked") - F.col("blocked")) / rest
    error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / rest))
    alike = (F.col("labelled") > 0) & (rest > 0) & (F.abs(own - other) <= ALIKE_Z * error)
    variable = (F.col("children") >= VARIABLE_CHILDREN) & (F.col("children") >= VARIABLE_SHARE * F.col("node_n"))
    names = skew.attach(child, node, ["host", "branch"]).select(
        "host", "branch", "segment",
        F.when(variable, F.lit("*")).when(alike, F.lit("+")).otherwise(F.col("segment")).alias("to"),
        F.when(variable, F.lit("*")).otherwise(F.col("segment")).alias("to_plain"))
    moved = skew.attach(rows, names, ["host", "branch", "segment"], "left")
    name = lambda c, to: F.when(F.col(to).isNull(), F.col(c)).otherwise(F.concat(c, F.lit("/"), to)).alias(c)
    left = F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0)))
    return moved.select("host", "segments", left.alias("rest"), "n", "labelled", "blocked", name("branch", "to"), name("plain", "to_plain"))


def template_tree(paths: DataFrame) -> DataFrame:
    """Templates and purity of distinct paths.

    paths: host, segments, n, labelled, blocked (counts). Adds ``template``, ``purity`` and whether it is ``rejected``.
    """
    # ``branch`` has merged siblings and says what shares a purity; ``plain`` is the path template over hosts.
    at = paths.withColumns({"branch": F.lit(""), "plain": F.lit(""), "rest": F.col("segments")})
    done = None
    while True:
        at = session.materialise(_steps(at), "template-tree")
        ended = at.where(F.size("rest") == 0).drop("rest")
        done = ended if done is None else done.unionByName(ended)
        at = at.where(F.size("rest") > 0)
        if not at.head(1):
            break
    tree = session.materialise(done, "template-tree")

    total = tree.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    share = total["b"] / total["l"] if total["l"] else 0.0
    smooth = lambda prior: (F.sum("blocked") + PRIOR * prior) / (F.sum("labelled") + PRIOR)
    over_hosts = tree.groupBy("plain").agg(smooth(F.lit(share)).alias("prior"))
    # A branch can join several plain templates; its prior is that of the first by name.
    first = tree.groupBy("host", "branch").agg(F.min("plain").alias("plain")).join(over_hosts, "plain").select("host", "branch", "prior")
    purity = skew.attach(tree, first, ["host", "branch"]).groupBy("host", "branch").agg(smooth(F.first("prior")).alias("purity"))
    return skew.attach(tree, purity, ["host", "branch"]).select(
        "host", "segments", F.concat("host", "branch").alias("template"), "purity", (F.col("purity") >= REJECT).alias("rejected"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for pages (page_id, url)."""
    rows = session.materialise(parsed(pages).withColumns(
        {"rule": rule_of(rules), "label": rule_of(rules, "verdict"), "segments": placeholder_path()}), "urls")
    paths = rows.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked"))
    found = session.materialise(template_tree(session.materialise(paths, "paths")), "templates")
    return rows.join(found, ["host", "segments"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("label", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", "purity")


def _sql() -> str:
    """The same judgement in SQL."""
    fits = lambda h, p: f"host <> '' AND ('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[i]}'" for h, p, v in ordered) + " END"
    steps, last = [], "t0"
    for k in range(SQL_LEVELS):
        steps.append(f"""
s{k} AS (SELECT *, segments[{k + 1}] AS segment FROM {last}),
c{k} AS (SELECT host, branch, segment, sum(n) AS n, sum(labelled) AS l, sum(blocked) AS b FROM s{k} WHERE segment IS NOT NULL GROUP BY ALL),
m{k} AS (SELECT *, count(*) OVER w AS children, sum(n) OVER w AS nn, sum(l) OVER w AS nl, sum(b) OVER w AS nb FROM c{k} WINDOW w AS (PARTITION BY host, branch)),
v{k} AS (SELECT *, children >= {VARIABLE_CHILDREN} AND children >= {VARIABLE_SHARE} * nn AS variable,
  CASE WHEN l > 0 AND nl > l THEN abs(b / l - (nb - b) / (nl - l)) <= {ALIKE_Z} * sqrt((nb / nl) * (1 - nb / nl) * (1 / l + 1 / (nl - l))) ELSE false END AS alike FROM m{k}),
t{k + 1} AS (SELECT s.host, s.segments, s.n, s.labelled, s.blocked,
  CASE WHEN v.segment IS NULL THEN s.branch ELSE s.branch || '/' || CASE WHEN variable THEN '*' WHEN alike THEN '+' ELSE s.segment END END AS branch,
  CASE WHEN v.segment IS NULL THEN s.plain ELSE s.plain || '/' || CASE WHEN variable THEN '*' ELSE s.segment END END AS plain
  FROM s{k} s LEFT JOIN v{k} v ON s.host = v.host AND s.branch = v.branch AND s.segment = v.segment),""")
        last = f"t{k + 1}"
    segments = "list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9a-fA-F-]{16,}') THEN '$' ELSE regexp_replace(s, '[0-9]+', '#', 'g') END)"
    return f"""
WITH parsed AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
cut AS (SELECT *, {case(0)} AS rule, {case(1)} AS label, {segments} AS all_segments FROM parsed),
rows AS (SELECT *, CASE WHEN len(all_segments) > {SQL_LEVELS} THEN error('a path has more levels than this statement') ELSE all_segments END AS segments FROM cut),
t0 AS (SELECT host, segments, CAST(count(*) AS DOUBLE) AS n, CAST(count(label) AS DOUBLE) AS labelled,
  CAST(count(*) FILTER (WHERE label = 'block') AS DOUBLE) AS blocked, '' AS branch, '' AS plain FROM rows GROUP BY host, segments),{"".join(steps)}
total AS (SELECT coalesce(sum(blocked) / nullif(sum(labelled), 0), 0) AS share FROM {last}),
over_hosts AS (SELECT plain, (sum(blocked) + {PRIOR} * (SELECT share FROM total)) / (sum(labelled) + {PRIOR}) AS prior FROM {last} GROUP BY plain),
firsts AS (SELECT host, branch, min(plain) AS plain FROM {last} GROUP BY host, branch),
purities AS (SELECT t.host, t.branch, (sum(blocked) + {PRIOR} * min(prior)) / (sum(labelled) + {PRIOR}) AS purity
  FROM {last} t JOIN firsts f ON t.host = f.host AND t.branch = f.branch JOIN over_hosts o ON f.plain = o.plain GROUP BY t.host, t.branch)
SELECT page_id, r.host, path, rule, coalesce(label, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
  r.host || t.branch AS template, purity
FROM rows r JOIN {last} t ON r.host = t.host AND r.segments = t.segments JOIN purities p ON t.host = p.host AND t.branch = p.branch
"""


@query("op5_url_filters", _sql())
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return judged(table(spark, sf_dir, "pages"), RULES)
