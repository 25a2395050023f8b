"""URL filters: allow and block rules, and link-graph propagation between hosts.

Rules judge a url by host and path prefix; the longest that fits wins.  Urls
without a rule are judged by their host.  Pages that an allow rule fits seed
trust, pages that a block rule fits seed distrust.  Trust runs along links, a
host's share going evenly to those it links to, and distrust runs against them,
so that who links to blocked hosts is distrusted: personalised PageRank, both
ways in one table, kept in units of pages (a seed page counts 1 where it is, a
part ``damping`` of what a host has moves on in each round).  A host is blocked
if its distrust exceeds its trust by more than ``threshold`` of its pages.

Hosts link by the absolute urls in the ``href`` attributes of their pages.
All of it are DataFrame functions.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule, and is judged as the host of an empty name, which has no seeds and
no links and so is allowed; null or empty html links nowhere; links to the own
host and repeated links between two hosts count once or not at all; repeated
rows are pages each; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import written

#: (host, path, verdict)
Rule = tuple[str, str, str]


def lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased, and the path up to ``?``, ``#`` or the end."""
    rest = F.coalesce(F.regexp_extract(url, r"^(?s)(?:(?!://).)*://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower(host), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Place in ``rules`` of the longest rule that fits, else null."""
    found: Column = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: len(rules[k][0] + rules[k][1])):
        own, prefix, _ = rules[k]
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.lit(k)).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) of hosts of which one links to the other."""
    targets = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)\bhref\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1))
    src, _ = host_and_path(F.col(url_col))
    links = pages.select(src.alias("src"), F.explode(F.array_distinct(targets)).alias("to"))
    dst = lower(F.regexp_extract("to", r"//([^/?#]*)", 1))
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(kind, host, mass) after ``rounds`` of propagation of ``seeds`` (kind,
    host, mass); kind is trust, along links, or distrust, against them."""
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("next"))
    both = both.unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("next")))
    degree = both.groupBy("kind", "host").agg(F.count("*").alias("degree"))
    edges = written(both.join(degree, ["kind", "host"]), "host-edges")
    seeds = written(seeds, "host-seeds")
    if edges.isEmpty():
        return seeds
    mass = seeds
    for k in range(rounds):
        moved = edges.join(mass, ["kind", "host"]).groupBy("kind", F.col("next").alias("host")).agg(F.sum(F.lit(damping) * F.col("mass") / F.col("degree")).alias("mass"))
        mass = written(seeds.unionByName(moved).groupBy("kind", "host").agg(F.sum("mass").alias("mass")), f"mass-{k}")
    return mass


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", html_col: str = "html", id_col: str = "page_id", damping: float = 0.85, rounds: int = 10, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule and verdict of each row."""
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("k", rule_of(F.col("host"), F.col("path"), rules))
    names = F.array(*[F.lit(h + p) for h, p, _ in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(v) for _, _, v in rules]) if rules else F.array().cast("array<string>")
    # get() gives null for a null place
    ruled = ruled.select("page_id", "host", "path", F.get(names, F.col("k")).alias("rule"), F.get(verdicts, F.col("k")).alias("ruled"))
    hosts = written(ruled.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("trust"), F.count_if(F.col("ruled") == "block").alias("distrust")), "hosts")
    seeds = hosts.select("host", F.expr("stack(2, 'trust', CAST(trust AS DOUBLE), 'distrust', CAST(distrust AS DOUBLE)) AS (kind, mass)")).where("mass > 0").select("kind", "host", "mass")
    mass = propagate(seeds, host_links(pages, url_col, html_col), damping, rounds)
    surplus = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(-F.col("mass"))).alias("surplus"))
    blocked = written(hosts.join(surplus, "host").where(F.col("surplus") > threshold * F.col("pages")).select("host", F.lit("block").alias("by_host")), "blocked-hosts")
    return ruled.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))


def sql(rules: list[Rule], damping: float = 0.85, rounds: int = 10, threshold: float = 0.5) -> str:
    """The same for a table pages."""
    rest = "regexp_extract(coalesce(url, ''), '^(?:[^:]|:[^/]|:/[^/])*?://(.*)$', 1, 's')"
    low = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))

    def case(value) -> str:
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in by_length) + " END"

    steps = "".join(
        f""",
m{k + 1} AS (SELECT kind, host, sum(mass) AS mass FROM (SELECT * FROM m0 UNION ALL
  SELECT e.kind, e.next, {damping} * m.mass / e.degree FROM e JOIN m{k} m ON e.kind = m.kind AND e.host = m.host) x GROUP BY kind, host)"""
        for k in range(rounds)
    )
    return f"""
WITH r AS (SELECT page_id, html, {rest} AS rest FROM pages),
q AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {low}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, {case(lambda h, p, v: v)} AS ruled FROM q),
hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS trust, count(*) FILTER (ruled = 'block') AS distrust FROM j GROUP BY host),
t AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS u FROM q),
l AS (SELECT DISTINCT src, dst FROM (SELECT src, translate(regexp_extract(u, '//([^/?#]*)', 1), {low}) AS dst FROM t) x WHERE src <> '' AND dst <> '' AND src <> dst),
b AS (SELECT 'trust' AS kind, src AS host, dst AS next FROM l UNION ALL SELECT 'distrust', dst, src FROM l),
e AS (SELECT kind, host, next, count(*) OVER (PARTITION BY kind, host) AS degree FROM b),
m0 AS (SELECT 'trust' AS kind, host, CAST(trust AS DOUBLE) AS mass FROM hosts WHERE trust > 0 UNION ALL SELECT 'distrust', host, CAST(distrust AS DOUBLE) FROM hosts WHERE distrust > 0){steps},
s AS (SELECT host, sum(CASE kind WHEN 'distrust' THEN mass ELSE -mass END) AS surplus FROM m{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN surplus > {threshold} * hosts.pages THEN 'block' END, 'allow') AS verdict
FROM j JOIN hosts ON j.host = hosts.host LEFT JOIN s ON j.host = s.host"""
