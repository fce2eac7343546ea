"""URL filters with redirect equivalence, in DataFrame functions only.

``judge_pages`` reads each page's host and path, applies the longest fitting rule of an allow/block list, and
lets the other pages take the decision of their equivalence class: pages and link targets joined by redirect
(``<meta http-equiv=refresh>``) and canonical (``<link rel=canonical>``) edges.

Precedence: a page's own rule decides for it. In a class, an explicit allow of any member beats a block of any other;
without either, pages are allowed.

A short list is one expression. A longer one, or one given as a table (action, host, path), is joined: each distinct host is dealt to its suffixes, these meet
the lengths of the paths that rules of that host have, and host and path prefix then meet the rules, all by equality.

Classes are connected components (``graph.components``). Only pages with edges take part; the label table is joined
to the pages at the end.

Defined cases: a null url, or one without ``://``, has empty host and path and no aliases; a null html has no edges;
equal urls are one node; relative targets are resolved against the page; a target that is no page still counts, with
its own rule. Repeated pages repeat; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import scratch_table
from keelson.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_EXPRESSION_RULES = 256


@dataclass(frozen=True)
class Rule:
    action: str                     # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: Sequence[str]) -> list[Rule]:
    """``allow com/`` or ``block example.com/en/``: action, host, path from the first slash."""
    out = []
    for line in lines:
        action, _, rest = line.strip().partition(" ")
        host, slash, path = rest.partition("/")
        if action not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line!r}")
        out.append(Rule(action, host.lower(), slash + path))
    return out


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.substring_index(url, "://", 1)
    tail = F.when(F.instr(url, "://") > 0, url.substr(F.length(rest) + 4, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(tail, r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.substring_index(url, "://", 1)
    tail = F.when(F.instr(url, "://") > 0, url.substr(F.length(rest) + 4, F.length(url)))
    return F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct(rule, action) of the longest fitting rule, or null: the rules tried from the longest on."""
    none = F.lit(None).cast("struct<rule:string,action:string>")
    out = none
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def _rule_table(rules: DataFrame) -> DataFrame:
    """Distinct rules: host (lower case), path, rule, action. Of rules with one text allow beats block."""
    host = F.translate("host", UPPER, LOWER)
    return rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").where("host <> ''") \
        .groupBy("host", "path").agg(F.min("action").alias("action")).select("host", "path", F.concat("host", "path").alias("rule"), "action")


def with_rule(df: DataFrame, host_col: str, path_col: str, rules: list[Rule] | DataFrame) -> DataFrame:
    """``df`` with ``own``: struct(rule, action) of the longest fitting rule (of equally long ones the last by text), or null."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= MAX_EXPRESSION_RULES:
            return df.withColumn("own", longest_rule(F.col(host_col), F.col(path_col), rules))
        last = {(r.host, r.path): r.action for r in rules}      # a later rule of the same text replaces an earlier one
        rules = df.sparkSession.createDataFrame([(a, h, p) for (h, p), a in last.items()], "action string, host string, path string")
    table = scratch_table(_rule_table(rules), "url-rules")
    sizes = table.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes")).withColumnRenamed("host", "_suffix")
    places = df.select(F.col(host_col).alias("_host"), F.col(path_col).alias("_path")).where("_host <> ''").distinct()
    parts = F.split("_host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    asked = places.withColumn("_suffix", F.explode(suffixes)).join(sizes, "_suffix") \
        .withColumn("_size", F.explode("sizes")).where(F.col("_size") <= F.length("_path")) \
        .select("_host", "_path", "_suffix", F.expr("left(_path, _size)").alias("_prefix"))
    rule = table.select(F.col("host").alias("_suffix"), F.col("path").alias("_prefix"), "rule", "action")
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.col("rule")))
    found = asked.join(rule, ["_suffix", "_prefix"]).groupBy("_host", "_path").agg(best.alias("own"))
    return df.join(found, (df[host_col] == found["_host"]) & (df[path_col] == found["_path"]), "left").drop("_host", "_path")


def with_node(df: DataFrame, url_col: str, out: str) -> DataFrame:
    """Adds the name of a url's node: host (lower case), path and query; scheme and fragment don't matter. Null without
    a host. The parts are columns of their own, so that the plan computes each once."""
    df = df.withColumns({"_host": url_host(F.col(url_col)), "_rest": F.regexp_extract(url_col, r"://[^/?#]*([^#]*)", 1)})
    rest = F.when((F.col("_rest") == "") | F.col("_rest").startswith("?"), F.concat(F.lit("/"), "_rest")).otherwise(F.col("_rest"))
    return df.withColumn(out, F.when(F.col("_host") != "", F.concat("_host", rest))).drop("_host", "_rest")


_CANONICAL = (r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)")
_REFRESH = (r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*[;,]\s*"
            r"url\s*=\s*[\"']?([^\"'\s>]+)")


def _resolved(target: Column, scheme: Column, host: Column, path: Column) -> Column:
    """An absolute url for a link target found on a page, given the page's parts."""
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(root, target))
            .when(target.startswith("?"), F.concat(root, path, target))
            .when(target.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None))
            .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target)))


def link_targets(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url, target: what pages name as canonical or redirect to, as written."""
    html, url = F.col(html_col), F.col(url_col)
    marked = pages.where(html.rlike(r"(?i)canonical|refresh") & (F.instr(url, "://") > 0))
    targets = F.array(F.regexp_extract(html, _CANONICAL, 1), F.regexp_extract(html, _REFRESH, 1))
    return marked.select(url.alias("url"), F.explode(targets).alias("target")).where("target <> ''")


def link_edges(targets: DataFrame) -> DataFrame:
    """src, dst: distinct edges between different nodes. The named edges are written before they are filtered, since a
    filter on them would be pushed into, and multiply, the expressions that make them."""
    edges = targets.withColumns({"scheme": F.substring_index("url", "://", 1), "host": url_host(F.col("url")),
                                 "path": url_path(F.col("url")), "target": F.regexp_replace("target", "&amp;", "&")})
    edges = edges.withColumn("absolute", _resolved(*(F.col(c) for c in ("target", "scheme", "host", "path"))))
    named = scratch_table(with_node(with_node(edges, "url", "src"), "absolute", "dst").select("src", "dst"), "url-named")
    return named.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def judge_pages(pages: DataFrame, rules: Sequence[str] | DataFrame, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    parsed = rules if isinstance(rules, DataFrame) else parse_rules(rules)
    url = F.col("url")
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    judged = src.select("page_id", "url", url_host(url).alias("host"), url_path(url).alias("path"))
    judged = with_rule(judged, "host", "path", parsed)
    targets = scratch_table(link_targets(src), "url-links")
    if targets.isEmpty():
        verdict = F.coalesce(F.col("own.action"), F.lit("allow"))
        return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
    labels = components(link_edges(targets), "url")
    host = F.regexp_extract("node", r"^([^/?#]*)", 1)
    path = F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)
    members = with_rule(labels.select("node", "label", host.alias("host"), path.alias("path")), "host", "path", parsed)
    members = members.select("node", "label", F.col("own.action").alias("action"))
    decided = members.groupBy("label").agg(
        F.when(F.max((F.col("action") == "allow").cast("int")) == 1, "allow")
        .when(F.max((F.col("action") == "block").cast("int")) == 1, "block").otherwise("allow").alias("class_verdict"))
    by_node = members.join(decided, "label").select("node", "class_verdict")
    verdict = F.coalesce(F.col("own.action"), F.col("class_verdict"), F.lit("allow"))
    ruled = F.col("own").isNotNull()
    return (with_node(judged, "url", "node").withColumn("node", F.when(~ruled, F.col("node")))
            .join(by_node, "node", "left")
            .select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict")))


def oracle_sql(rules: Sequence[str]) -> str:
    """DuckDB SQL for ``judge_pages`` over the view ``pages``: recursive reachability in place of label exchange."""
    cases = "\n".join(
        f"    WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.action} {r.text}'"
        for r in sorted(parse_rules(rules), key=lambda r: (-len(r.text), r.text)))
    canonical = r"""regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)"""
    refresh = r"""regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1)"""
    node = ("translate(regexp_extract({u}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || "
            "CASE WHEN regexp_extract({u}, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '://[^/?#]*([^?#]*)', 1) END || "
            r"regexp_extract({u}, '://[^?#]*(\?[^#]*)', 1)")
    return f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
t AS (SELECT url, unnest([{canonical}, {refresh}]) AS target FROM p WHERE contains(url, '://')),
e AS (SELECT DISTINCT src, dst FROM (
  SELECT {node.format(u='url')} AS src,
    {node.format(u="(CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN split_part(url, '://', 1) || ':' || target WHEN starts_with(target, '/') THEN regexp_extract(url, '^[^:]*://[^/?#]*') || target ELSE '' END)")} AS dst
  FROM t WHERE target <> '') WHERE src <> dst AND dst <> '/'),
both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reach AS (SELECT DISTINCT src AS node, src AS other FROM both_ways
  UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON b.src = r.other),
nodes AS (SELECT DISTINCT other AS node, regexp_extract(other, '^([^/?#]*)', 1) AS host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
ruled AS (SELECT node, CASE
{cases}
    END AS hit FROM nodes),
class AS (SELECT r.node, max(starts_with(hit, 'allow ')) AS allowed, max(starts_with(hit, 'block ')) AS blocked
  FROM reach r JOIN ruled u ON u.node = r.other GROUP BY r.node),
own AS (SELECT page_id, url, host, path, CASE
{cases}
    END AS hit FROM p)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 1)
       WHEN coalesce(allowed, false) THEN 'allow' WHEN coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict
FROM own LEFT JOIN class ON class.node = CASE WHEN contains(url, '://') THEN {node.format(u='url')} END
"""
