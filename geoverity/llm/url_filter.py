"""URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules share one index. A host rule (host, path prefix) fits its
host and all subdomains. A pattern rule is a regular expression over the whole
url. Each rule names literal tokens that any url it fits must hold. The
frequency of every token is counted over all urls and each rule is filed under
its rarest token; a url's tokens fetch candidate rules by a join, and only those
are verified. Built-in functions only.

Verdict: that of the longest fitting host rule; else ``block`` if a pattern rule
blocks and no pattern rule allows; else ``allow``. Null url, or one without
``://``: host and path empty, no host rule fits. Repeated rows each get their
row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Fixed host rules of the contract: (host, path prefix, verdict).
HOST_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Pattern rules: (regular expression over the url, A-Z lower-cased; literal tokens; verdict).
PATTERN_RULES = [
    (r"^https?://([^/?#]*\.)?spam-farm\.", ["spam", "farm"], "block"),
    (r"^https?://([^/?#]*\.)?casino[^/?#]*\.(com|net|info)([/:?#]|$)", [], "block"),
    (r"^https?://ads?[0-9]*\.", [], "block"),
    (r"/wp-login\.php", ["wp", "login"], "block"),
    (r"/cgi-bin/", ["cgi", "bin"], "block"),
    (r"[?&]action=edit(&|#|$)", ["action", "edit"], "block"),
    (r"[?&]replytocom=[0-9]", ["replytocom"], "block"),
    (r"/search/?\?q=", ["search", "q"], "block"),
    (r"/tag/[^/?#]+/feed/?$", ["tag", "feed"], "block"),
    (r"^https?://[^/?#]+/robots\.txt$", ["robots", "txt"], "allow"),
    (r"^https?://([^/?#]*\.)?archive\.org/details/", ["archive", "org", "details"], "allow"),
    (r"\.(exe|msi)([?#]|$)", [], "block"),
]

#: The index is broadcast up to so many rows; a larger rule list is joined by shuffle.
BROADCAST_RULES = 20_000
#: Files a rule without a literal token under every url.
ANY = ""


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract defines them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def url_tokens(url: Column) -> Column:
    """Distinct runs of ``[0-9a-z]``, A-Z lower-cased, and ANY."""
    runs = F.split(ascii_lower(F.coalesce(url, F.lit(""))), "[^0-9a-z]+")
    return F.array_union(F.array(F.lit(ANY)), F.array_distinct(runs))


def _rules(spark: SparkSession, host_rules, pattern_rules) -> DataFrame:
    """One row per rule: rule_id, host, path, pattern, verdict, tokens, name."""
    rows = []
    for host, path, verdict in host_rules:
        # the last piece of a path prefix may be cut short, so it isn't a whole token
        words = host.lower().split(".") + [w.lower() for w in path.split("/")[1:-1]]
        rows.append((host, path, None, verdict, [w for w in words if w.isalnum() and w.isascii()], host + path))
    rows += [(None, None, rule, verdict, tokens, rule) for rule, tokens, verdict in pattern_rules]
    cells = [F.struct(F.lit(i).alias("rule_id"), F.lit(h).cast("string").alias("r_host"),
                      F.lit(p).cast("string").alias("r_path"), F.lit(x).cast("string").alias("r_pattern"),
                      F.lit(v).alias("r_verdict"),
                      F.array(*[F.lit(t) for t in tokens or [ANY]]).alias("tokens"), F.lit(n).alias("r_name"))
             for i, (h, p, x, v, tokens, n) in enumerate(rows)]
    return spark.range(1).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with ``token``: each one's rarest literal, counted over all urls."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = (urls.select(F.explode(url_tokens(F.col("_url"))).alias("token"))
              .join(F.broadcast(wanted), "token", "left_semi")
              .groupBy("token").agg(F.count("*").alias("n")))
    return (rules.select("*", F.explode("tokens").alias("token")).join(counts, "token", "left")
            .groupBy(*[c for c in rules.columns if c != "tokens"])
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
            .withColumn("token", F.col("rarest.token")).drop("rarest"))


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url",
                host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """One row per input row: the key, ``host``, ``path``, ``rule`` (the host rule that
    decided, else null), ``verdict``, ``patterns`` (fitting pattern rules, sorted)."""
    spark = df.sparkSession
    urls = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"))
    rules = _rules(spark, host_rules, pattern_rules)
    index = rule_index(urls, rules)
    if len(host_rules) + len(pattern_rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    host, path = url_parts(F.col("_url"))
    lower = ascii_lower(F.col("_url"))
    parts = urls.select("_url").distinct().withColumns({"host": host, "path": path, "lower": lower})
    fits_host = ((F.col("host") == F.col("r_host")) | F.col("host").endswith(F.concat(F.lit("."), "r_host"))) \
        & F.col("path").startswith(F.col("r_path"))
    fits = F.when(F.col("r_pattern").isNull(), fits_host).otherwise(F.rlike("lower", F.col("r_pattern")))
    is_host = F.col("r_pattern").isNull()
    hits = (parts.withColumn("token", F.explode(url_tokens(F.col("_url"))))
            .join(index, "token").where(fits)
            .groupBy("_url").agg(
                F.max(F.when(is_host, F.struct(F.length("r_name").alias("n"), "r_name", "r_verdict"))).alias("best"),
                F.max(F.when(~is_host & (F.col("r_verdict") == "allow"), 1)).alias("allows"),
                F.max(F.when(~is_host & (F.col("r_verdict") == "block"), 1)).alias("blocks"),
                F.array_sort(F.collect_set(F.when(~is_host, F.col("r_name")))).alias("patterns")))
    method = F.when(F.col("blocks").isNotNull() & F.col("allows").isNull(), "block").otherwise("allow")
    return (urls.join(hits, "_url", "left").select(
        F.col("_id").alias(id_col), host.alias("host"), path.alias("path"),
        F.col("best.r_name").alias("rule"), F.coalesce("best.r_verdict", method).alias("verdict"),
        F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every ``pages`` url."""
    return filter_urls(table(spark, sf_dir, "pages")).drop("patterns")


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hosts = ", ".join(f"({quote(h)}, {quote(p)}, {quote(v)})" for h, p, v in HOST_RULES)
    tests = {v: " OR ".join(f"regexp_matches(low, {quote(x)})" for x, _, y in PATTERN_RULES if y == v)
             for v in ("allow", "block")}
    return f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {hosts}),
rest AS (SELECT page_id, url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
cut AS (SELECT *, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM rest),
parts AS (SELECT *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(substr(coalesce(rest, ''), length(h) + 1), '^[^?#]*') AS path FROM cut),
judged AS (SELECT *, (SELECT arg_max(struct_pack(n := r_host || r_path, v := r_verdict), length(r_host || r_path))
   FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS best FROM parts)
SELECT page_id, host, path, best.n AS rule,
       coalesce(best.v, CASE WHEN ({tests['block']}) AND NOT ({tests['allow']}) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""


ORACLE = _oracle()
