"""robots.txt: parsing, group choice, longest match, and the decision for a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphaudit.functions.scalars import url_path
from glyphaudit.functions.scripts import trimmed, utf16_length

#: UTF-16 units that are read of a file.
MOST_UNITS = 512_000
REASONS = {
    "robots-allows": "The robots file allows the page.",
    "no-robots-file": "The site has no robots file.",
    "robots-disallows": "The robots file does not allow the page.",
    "robots-unreachable": "The robots file could not be read.",
}


def truncated(body: Column) -> Column:
    """Whether a file is longer than what is read of it."""
    return F.coalesce(utf16_length(body) > MOST_UNITS, F.lit(False))


def _read(body: Column) -> Column:
    """The first units of a file; a pair that the limit cuts goes whole."""
    units = F.encode(body, "UTF-16BE")
    last = F.hex(F.substring(units, 2 * MOST_UNITS - 1, 1))
    n = F.when(last.between("D8", "DB"), F.lit(2 * MOST_UNITS - 2)).otherwise(F.lit(2 * MOST_UNITS))
    return F.when(truncated(body), F.decode(F.substring(units, F.lit(1), n), "UTF-16BE")).otherwise(body)


def lines(files: DataFrame) -> DataFrame:
    """``url, line_ord, field, value`` of the lines with a colon, comments cut off; files are read up to a limit."""
    body = _read(F.col("body"))
    split = files.select("url", F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("line_ord", "line"))
    bare = split.withColumn("line", trimmed(F.regexp_replace("line", "#.*$", ""))).where(F.col("line").contains(":"))
    return bare.select("url", "line_ord", F.lower(trimmed(F.substring_index("line", ":", 1))).alias("field"), trimmed(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


def groups(parsed: DataFrame) -> DataFrame:
    """Lines with the number of their group; consecutive user-agent lines share one, lines before the first are dropped."""
    order = Window.partitionBy("url").orderBy("line_ord")
    agent = F.col("field") == "user-agent"
    opens = agent & ~F.coalesce(F.lag(agent).over(order), F.lit(False))
    return parsed.withColumn("opens", opens).withColumn("group_id", F.sum(F.col("opens").cast("int")).over(order)).where("group_id > 0").drop("opens")


def chosen(grouped: DataFrame, token: str) -> DataFrame:
    """``url, group_id``: the first group that names the agent, else the first for all agents."""
    token = token.lower()
    named = grouped.where((F.col("field") == "user-agent") & F.lower("value").isin(token, "*"))
    return named.groupBy("url").agg(F.min(F.struct((F.lower("value") != token).alias("general"), "group_id")).alias("best")).select("url", F.col("best.group_id").alias("group_id"))


def pattern(path: Column) -> Column:
    """The regular expression of a rule's path: anchored, * for anything, $ at the end anchors there."""
    ended = path.endswith("$")
    body = F.when(ended, F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path)
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(ended, F.lit("$")).otherwise(F.lit("")))


def rules(grouped: DataFrame, token: str) -> DataFrame:
    """``url, allow, path`` of the chosen group; empty paths say nothing."""
    own = grouped.join(chosen(grouped, token), ["url", "group_id"], "left_semi").where(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    path = F.when(F.col("value").rlike("^[/*]"), F.col("value")).otherwise(F.concat(F.lit("/"), F.col("value")))
    return own.select("url", (F.col("field") == "allow").alias("allow"), path.alias("path"))


def crawl_delays(grouped: DataFrame, token: str) -> DataFrame:
    """``url, crawl_delay_s``: the last usable value of the chosen group."""
    own = grouped.join(chosen(grouped, token), ["url", "group_id"], "left_semi").where("field = 'crawl-delay'").withColumn("s", F.col("value").try_cast("double"))
    return own.where("s > 0 AND s < double('infinity')").groupBy("url").agg(F.max_by("s", "line_ord").alias("crawl_delay_s"))


def decisions(fetched: DataFrame, token: str = "glyphaudit") -> DataFrame:
    """``url, allowed, reason, crawl_delay_s`` from ``url, http_status, body, error``; one row for each address."""
    answered = F.coalesce(F.col("http_status").between(200, 299), F.lit(False)) & F.col("body").isNotNull()
    grouped = groups(lines(fetched.where(answered)))
    path = fetched.select("url", url_path(F.col("url")).alias("page_path"))
    met = rules(grouped, token).join(path, "url")
    met = met.withColumn("pattern", pattern(F.col("path"))).where("page_path RLIKE pattern")
    best = met.groupBy("url").agg(F.max_by("allow", F.struct(F.length("path"), "allow")).alias("allow"))
    out = fetched.join(best, "url", "left").join(crawl_delays(grouped, token), "url", "left")
    missing = F.coalesce(F.col("http_status").between(400, 499), F.lit(False))
    reason = F.when(missing, F.lit("no-robots-file")).when(~answered, F.lit("robots-unreachable")).when(F.coalesce("allow", F.lit(True)), F.lit("robots-allows")).otherwise(F.lit("robots-disallows"))
    out = out.withColumn("reason", reason)
    return out.select("url", F.col("reason").isin("robots-allows", "no-robots-file").alias("allowed"), "reason", F.when(F.col("reason") == "robots-allows", F.col("crawl_delay_s")).alias("crawl_delay_s"))
