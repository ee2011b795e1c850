"""URL verdicts from host/path rules and patterns, found through each rule's rarest literal token."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER_FROM, LOWER_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class PatternRule:
    """`literals`: tokens that stand in every url the pattern (on host and path) can match."""
    pattern: str
    literals: tuple[str, ...]
    verdict: str = "block"


# Fixed values of the registered query.
RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)
PATTERNS = (
    PatternRule(r"(^|[./])casino[./]", ("casino",)),
    PatternRule(r"(^|[./])xxx([./]|$)", ("xxx",)),
    PatternRule(r"/wp-login\.php$", ("wp", "login", "php")),
    PatternRule(r"^ads?[0-9]*\..*/click/", ("click",)),
    PatternRule(r"/(tag|label)/.*/page/[0-9]+$", ("page",)),
)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(raw, F.lit("")), LOWER_FROM, LOWER_TO)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct literal tokens of a url: the runs of letters and digits of its host and path."""
    return F.array_distinct(F.split(F.concat_ws("/", host, path), r"[^\p{L}\p{N}]+"))


def _tokens(text: str) -> list[str]:
    out, run = [], ""
    for ch in text + "/":
        if ch.isalnum():
            run += ch
        elif run:
            out.append(run)
            run = ""
    return out


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == "/" else f"\\{c}" for c in text)


def rule_table(spark: SparkSession, rules=RULES, patterns=PATTERNS) -> DataFrame:
    """One row per rule: id, name, expressions on the host and on the rest, verdict, length of the literal, its tokens.

    A host rule fits its host and all subdomains, and its path is a prefix; where that stops inside a segment, the
    segment is no token. A pattern has no host expression and runs on host and path together.
    """
    rows = []
    for r in rules:
        whole = r.path[:r.path.rfind("/") + 1]
        rows.append((len(rows), r.name, rf"(?s)^(?:.*\.)?{_literal(r.host)}\z", rf"(?s)^{_literal(r.path)}", r.verdict,
                     len(r.host) + len(r.path), _tokens(r.host) + _tokens(whole), True))
    for p in patterns:
        rows.append((len(rows), p.pattern, None, p.pattern, p.verdict, 0, list(p.literals), False))
    return spark.createDataFrame(rows, "rule_id int, name string, host_re string, rest_re string, verdict string, weight int, "
                                       "tokens array<string>, is_rule boolean")


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each rule under its rarest token, by the token's count over all urls (ties: the longer, then the smaller token)."""
    flat = rules.select("rule_id", F.explode("tokens").alias("token"))
    wanted = flat.select("token").distinct()
    seen = (urls.select(F.explode("tokens").alias("token")).join(F.broadcast(wanted), "token", "left_semi")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = (flat.join(seen, "token", "left")
              .groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token")).alias("r")))
    return rules.join(rarest, "rule_id").select("rule_id", "name", "host_re", "rest_re", "verdict", "weight", "is_rule", F.col("r.token").alias("token"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    The tokens of a url fetch the rules indexed under them; only those run their regular expression. The longest host
    rule decides; without one the patterns do (a match blocks), and `default` holds if none matches. The rule list is
    configuration whose size does not grow with the pages: its tokens are broadcast to count them, the index is joined
    by whatever the optimizer finds fit for its size.

    A url without tokens still keeps its row. Null urls and urls without `://` have an empty host and path and get
    `default`. Rows that repeat an id and url are judged once and given back as often as they came. Extra columns are
    ignored; an empty table gives an empty result.
    """
    urls = (pages.groupBy(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).agg(F.count(F.lit(1)).alias("_times"))
            .select("page_id", "_url", "_times", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
            .withColumn("tokens", tokens_of(F.col("host"), F.col("path"))))
    scan = pages.select(tokens_of(host_of(F.col(url_col)), path_of(F.col(url_col))).alias("tokens"))
    index = index_rules(rules, scan)
    asked = urls.select("page_id", "_url", "_times", "host", "path", F.explode_outer("tokens").alias("token"))
    fits = F.when(F.col("is_rule"), F.regexp_like("host", F.col("host_re")) & F.regexp_like("path", F.col("rest_re"))).otherwise(
        F.regexp_like(F.concat("host", "path"), F.col("rest_re")))
    hits = asked.join(index, "token", "left").withColumn("_hit", F.coalesce(F.col("is_rule").isNotNull() & fits, F.lit(False)))
    rule = F.when(F.col("_hit") & F.col("is_rule"), F.struct("weight", "name", "verdict"))
    judged = hits.groupBy("page_id", "_url", "_times", "host", "path").agg(
        F.max(rule).alias("_rule"), F.max(F.when(F.col("_hit") & ~F.col("is_rule"), F.col("verdict"))).alias("_pattern"))
    return judged.select(
        "page_id", "host", "path", F.col("_rule.name").alias("rule"),
        F.coalesce("_rule.verdict", "_pattern", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_copy")).drop("_copy")
