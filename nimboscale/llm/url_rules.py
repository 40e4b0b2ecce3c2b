"""URL filters by a sort-merge range join on reversed-host keys.

A host becomes the key of its labels from right to left, each closed by a dot:
``www.example.net`` is ``net.example.www.``. A rule for host ``example.net`` and
all its subdomains is then the key interval from ``net.example.`` to
``net.example/`` ('/' is the byte after '.' and in no host). Intervals of rules
nest or are disjoint, so a sweep over the sorted keys needs only the stack of
the rules that are open. Boundary rows carry that stack: an opening boundary its
own rules on top of its ancestors', a closing boundary the ancestors' alone. URLs
and boundaries are sorted together inside each top-level label and the last
boundary before a URL gives its stack, from which the path decides.

Hot labels (``com``) are salted: each label's URLs are dealt over as many parts as
their number asks for, and the label's boundaries go to each of them. A part has at least as
many URLs as its label has boundaries, so copies of boundaries are never more than
URLs, and a rare label's boundaries are not copied at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from nimboscale.llm.text import ascii_lower, without
from nimboscale.session import gathered, stored

#: (host, path, action); action is allow or block.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
PART_ROWS = 1000
_RULE = "struct<size:int,host_size:int,path:string,rule:string,action:string>"


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` and ``path``. Null, or no ``://``: both empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    out = without(df, "host", "path").withColumn("_nb_rest", rest)
    out = out.withColumn("_nb_host", F.regexp_extract("_nb_rest", r"^([^/?#]*)", 1))
    tail = F.expr("substring(_nb_rest, char_length(_nb_host) + 1)")
    return (
        out.withColumn("host", ascii_lower(F.col("_nb_host")))
        .withColumn("path", F.regexp_extract(tail, r"^([^?#]*)", 1))
        .drop("_nb_rest", "_nb_host")
    )


def rule_boundaries(spark, rules) -> DataFrame:
    """(label, key, stack): the stack of open rules from ``key`` on."""
    listed = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("host", "path", "action"), r)]) for r in rules]
    listed = F.array(*listed).cast("array<struct<host:string,path:string,action:string>>")
    given = spark.range(1).select(F.inline(listed))
    given = given.where(F.col("host").isNotNull() & (F.col("host") != "")).withColumn("host", ascii_lower(F.col("host")))
    given = given.fillna({"path": "/"}).dropDuplicates(["host", "path"])
    entry = F.struct(
        (F.char_length("host") + F.char_length("path")).alias("size"),
        F.char_length("host").alias("host_size"),
        "path",
        F.concat("host", "path").alias("rule"),
        "action",
    )
    hosts = given.groupBy(host_key(F.col("host")).alias("key")).agg(F.collect_list(entry).alias("own"))
    labels = F.filter(F.split("key", r"\."), lambda x: x != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))
    )
    # Every rule host meets its ancestors by the prefixes of its own key.
    spread = hosts.select("key", F.explode(prefixes).alias("prefix"))
    open_ = (
        spread.join(hosts.select(F.col("key").alias("prefix"), "own"), "prefix")
        .groupBy("key")
        .agg(
            F.flatten(F.collect_list("own")).alias("stack"),
            F.flatten(F.collect_list(F.when(F.col("prefix") != F.col("key"), F.col("own")))).alias("under"),
        )
    )
    label = F.substring_index("key", ".", 1).alias("label")
    opened = open_.select(label, "key", "stack")
    closed = open_.select(label, F.concat(F.expr("substring(key, 1, char_length(key) - 1)"), F.lit("/")).alias("key"), F.col("under").alias("stack"))
    return opened.unionByName(closed)


def label_parts(urls: DataFrame, bounds: DataFrame, url_col: str, part_rows: int) -> DataFrame:
    """(label, parts) of the labels that have boundaries and more URLs than one part should hold: a row for ``part_rows`` URLs or more."""
    label = F.substring_index(host_key(F.col("host")), ".", 1)
    counts = split_url(urls.select(F.col(url_col)), url_col).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    size = bounds.groupBy("label").agg(F.count(F.lit(1)).alias("_b"))
    parts = F.ceil(F.col("n") / F.greatest(F.lit(part_rows), F.col("_b"))).cast("int")
    return counts.join(size, "label").select("label", parts.alias("parts")).where("parts > 1")


def judge_urls(urls: DataFrame, rules=RULES, url_col: str = "url", default: str = "allow", part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's
    path; the longest host plus path wins, then the longer host. ``rules`` is a
    driver-side list; a rule for an empty host is left out, a null path is '/'.

    Edge cases: null URLs and URLs without ``://`` have an empty host and path
    and get ``default``. Repeated rows are judged row by row. Input columns
    named like an output are replaced. No rules: every verdict is ``default``.
    A label with rules has ``part_rows`` URLs in a part, or as many as it has boundaries; labels without
    any are dealt freely.
    """
    spark = urls.sparkSession
    parts = split_url(without(urls, "rule", "verdict"), url_col)
    names = parts.columns
    key = host_key(F.col("host"))
    given = stored(rule_boundaries(spark, rules), "rule-boundaries")
    dealt = gathered(stored(label_parts(urls, given, url_col, part_rows), "label-parts"))
    ruled = F.broadcast(given.select(F.col("label").alias("_ruled")).distinct())  # as many as the rules of the driver's list at most
    spread = F.xxhash64(F.col(url_col), F.monotonically_increasing_id())
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    left = parts.select(row, key.alias("_key"), F.substring_index(key, ".", 1).alias("_label"), spread.alias("_spread"))
    left = left.join(ruled, F.col("_label") == F.col("_ruled"), "left").join(dealt, F.col("_label") == F.col("label"), "left")
    # A label without rules needs none of its URLs together.
    salt = F.when(F.col("_ruled").isNull(), F.col("_spread")).otherwise(F.pmod(F.col("_spread"), F.coalesce(F.col("parts"), F.lit(1)).cast("bigint")))
    left = left.select("_row", "_key", "_label", salt.alias("_salt"), F.lit(1).alias("_kind"), F.lit(None).cast(f"array<{_RULE}>").alias("_stack"))
    bounds = given.join(dealt.withColumnRenamed("label", "_of"), F.col("label") == F.col("_of"), "left").select(
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
        F.col("key").alias("_key"),
        F.col("label").alias("_label"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("parts"), F.lit(1)) - F.lit(1).cast("bigint"))).alias("_salt"),
        F.lit(0).alias("_kind"),
        F.col("stack").cast(f"array<{_RULE}>").alias("_stack"),
    )
    sweep = Window.partitionBy("_label", "_salt").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        left.unionByName(bounds)
        .withColumn("_stack", F.last("_stack", ignorenulls=True).over(sweep))
        .where(F.col("_kind") == 1)
    )
    fit = F.filter(F.coalesce(F.col("_stack"), F.array().cast(f"array<{_RULE}>")), lambda r: F.startswith(F.col("_row.path"), r["path"]))
    return (
        swept.withColumn("_best", F.array_max(fit))
        .select("_row.*", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))
    )


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    from nimboscale.session import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, rest FROM cut
),
parts AS (
  SELECT page_id,
         translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path
  FROM split
),
rules(rhost, rpath, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
fits AS (
  SELECT page_id, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.n = 1
"""
