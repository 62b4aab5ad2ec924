"""URL filter by a path-template tree per host, with explicit rules on top.

A path is cut into its first three segments; a segment with a digit is a
variable and becomes the wildcard "*", deeper segments become "**". URLs are
counted per template before anything is shuffled by host. From the root down,
sibling branches are merged into a wildcard when they are statistically alike:
labelled branches whose share of blocked URLs does not differ from that of
their siblings (chi-square test at 5 %), and unlabelled branches with few URLs.
Labels are the URLs that rules decide. A merged template is rejected when it
has enough labels and its smoothed blocked share (pulled to the corpus share)
reaches the threshold.

Defined results: a null URL or one without "://" has an empty host and path and
is judged like any other; repeated rows are judged each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import ascii_lower, join_checked, staged

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LEVELS = 3
FEW_URLS = 5
CHI_SQUARE = 3.841
PRIOR = 4.0
MIN_LABELS = 3
REJECT_SHARE = 0.7


def parts(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return pages.select("page_id", host.alias("host"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))


def rule_of(rules) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
    return F.coalesce(*[F.when(fits(host, path), F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, host, path in ordered])


def segments(df: DataFrame) -> DataFrame:
    """Columns s1..s3 (empty string: none), with variable segments generalised."""
    found = F.filter(F.split("path", "/"), lambda s: s != "")
    for k in range(LEVELS):
        s = F.coalesce(F.get(found, F.lit(k)), F.lit(""))
        general = F.when(s.rlike("[0-9]"), "*").otherwise(s)
        if k == LEVELS - 1:
            general = F.when(F.size(found) > LEVELS, F.concat(general, F.lit("/**"))).otherwise(general)
        df = df.withColumn(f"s{k + 1}", general)
    return df


SUMS = ("n", "labelled", "blocked")


def merged(templates: DataFrame) -> DataFrame:
    """Add m1..m3: the branch of each segment after alike siblings are merged, from the root down."""
    for k in range(1, LEVELS + 1):
        parent = ["host", *[f"m{i}" for i in range(1, k)]]
        child = templates.groupBy(*parent, f"s{k}").agg(*[F.sum(c).alias(f"c_{c}") for c in SUMS])
        total = child.groupBy(*parent).agg(*[F.sum(f"c_{c}").alias(f"t_{c}") for c in SUMS])
        both = child.join(total, parent)
        a, b = F.col("c_blocked").cast("double"), (F.col("c_labelled") - F.col("c_blocked")).cast("double")
        c, d = (F.col("t_blocked") - F.col("c_blocked")).cast("double"), (F.col("t_labelled") - F.col("c_labelled") - F.col("t_blocked") + F.col("c_blocked")).cast("double")
        alike = (a + b + c + d) * (a * d - b * c) * (a * d - b * c) <= F.lit(CHI_SQUARE) * (a + b) * (c + d) * (a + c) * (b + d)
        branch = (
            F.when((F.col("c_labelled") > 0) & (F.col("t_labelled") > F.col("c_labelled")) & alike, "*")
            .when((F.col("c_labelled") == 0) & (F.col("c_n") < FEW_URLS), "~")
            .otherwise(F.col(f"s{k}"))
        )
        names = both.select(*parent, f"s{k}", branch.alias(f"m{k}"))
        templates = templates.join(names, [*parent, f"s{k}"])
    return templates


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page."""
    urls = segments(parts(pages).withColumn("found", rule_of(rules)))
    keys = ["host", *[f"s{k}" for k in range(1, LEVELS + 1)]]
    blocked = F.coalesce((F.col("found.verdict") == "block").cast("long"), F.lit(0))
    counted = urls.groupBy(*keys).agg(F.count("*").alias("n"), F.count("found.verdict").alias("labelled"), F.sum(blocked).alias("blocked"))
    templates = staged(merged(staged(counted, "url-templates")), "url-merged")
    share = templates.agg((F.coalesce(F.sum("blocked"), F.lit(0)) / F.greatest(F.sum("labelled"), F.lit(1))).alias("share"))
    nodes = templates.groupBy("host", "m1", "m2", "m3").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + PRIOR * F.col("share")) / (F.col("labelled") + PRIOR)
    bad = nodes.crossJoin(F.broadcast(share)).where((F.col("labelled") >= MIN_LABELS) & (purity >= REJECT_SHARE)).select("host", "m1", "m2", "m3")
    # rules decide the URLs of templates without an undecided URL; only the others are joined
    rejected = templates.where("labelled < n").join(bad, ["host", "m1", "m2", "m3"], "left_semi").select(*keys, F.lit(True).alias("rejected"))
    out = join_checked(urls, staged(rejected, "url-rejected"), keys, "left", 256)
    verdict = F.coalesce("found.verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def op3_urls(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ordered) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered) + " END"
    seg = lambda k: f"coalesce(seg[{k}], '')"
    general = lambda k: f"CASE WHEN regexp_matches({seg(k)}, '[0-9]') THEN '*' ELSE {seg(k)} END"
    text = f"""
WITH p0 AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p1 AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p0),
u AS (SELECT *, {rule} AS rule, {ruled} AS ruled, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p1),
v AS (SELECT *, {general(1)} AS s1, {general(2)} AS s2, {general(3)} || CASE WHEN len(seg) > {LEVELS} THEN '/**' ELSE '' END AS s3 FROM u),
t0 AS (SELECT host, s1, s2, s3, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked FROM v GROUP BY ALL)"""
    for k in range(1, LEVELS + 1):
        parent = ", ".join(["host", *[f"m{i}" for i in range(1, k)]])
        text += f""",
c{k} AS (SELECT {parent}, s{k}, sum(n)::DOUBLE AS cn, sum(labelled)::DOUBLE AS cl, sum(blocked)::DOUBLE AS cb FROM t{k - 1} GROUP BY ALL),
d{k} AS (SELECT *, sum(cl) OVER (PARTITION BY {parent}) AS tl, sum(cb) OVER (PARTITION BY {parent}) AS tb FROM c{k}),
e{k} AS (SELECT *, cb AS a, cl - cb AS b, tb - cb AS c, tl - cl - tb + cb AS d FROM d{k}),
t{k} AS (SELECT t.*, CASE WHEN cl > 0 AND tl > cl AND (a + b + c + d) * (a * d - b * c) * (a * d - b * c) <= {CHI_SQUARE} * (a + b) * (c + d) * (a + c) * (b + d) THEN '*'
    WHEN cl = 0 AND cn < {FEW_URLS} THEN '~' ELSE s{k} END AS m{k} FROM t{k - 1} t JOIN e{k} USING ({parent}, s{k}))"""
    return text + f""",
g AS (SELECT coalesce(sum(blocked), 0) / greatest(sum(labelled), 1) AS share FROM t{LEVELS}),
bad AS (SELECT host, m1, m2, m3 FROM t{LEVELS}, g GROUP BY host, m1, m2, m3, share
  HAVING sum(labelled) >= {MIN_LABELS} AND (sum(blocked) + {PRIOR} * share) / (sum(labelled) + {PRIOR}) >= {REJECT_SHARE}),
rejected AS (SELECT host, s1, s2, s3 FROM t{LEVELS} SEMI JOIN bad USING (host, m1, m2, m3) WHERE labelled < n)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN r.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN rejected r USING (host, s1, s2, s3)
"""


QUERIES = {"op3_urls": op3_urls}
SQL = {"op3_urls": _sql()}
