"""URL allow and block rules by a sort-merge range join (DataFrame operations only).

A rule is a host and a path prefix. The canonical key of a host is its labels in
reverse, each followed by ``/`` (which no host contains), so a host and all its
subdomains are one key interval. Interval bounds and url keys are sorted together;
what is carried along the sweep is the stack of the rules whose intervals are open.
The stack at each bound is worked out beforehand from the nesting of the rule hosts,
so that the sweep is one ``last(stack, ignore nulls)``. The sweep runs within
(top-level label, salt): a url of one label can only meet rules of that label, and the
salt splits frequent labels and hosts.

Defined results: a url that is null or has no ``://`` has host and path ``""`` and no
rule; an empty path fits no rule path that starts with ``/``; repeated pages stay
repeated; equal-length rules go by code point order of the rule; without any rule each
url has the default verdict; other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.scratch import shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule rows times salts stay below this.
MOST_RULE_ROWS = 2_000_000


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def _bounds(rules: DataFrame) -> DataFrame:
    """(key, stack) for each bound of a rule interval; rules: host, path, verdict."""
    rule = F.struct(F.length(F.concat("host", "path")).alias("n"), F.concat("host", "path").alias("rule"), F.col("path"), F.col("verdict"))
    own = rules.select("host", rule.alias("r")).groupBy("host").agg(F.array_sort(F.collect_set("r")).alias("rs"))
    labels = F.split("host", r"\.")
    outer = own.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up"))
    met = outer.join(own.select(F.col("host").alias("up"), "rs"), "up")
    stacks = met.groupBy("host").agg(
        F.array_sort(F.flatten(F.collect_list("rs"))).alias("stack"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("up") != F.col("host"), F.col("rs"))))).alias("outside"),
    )
    key = host_key(F.col("host"))
    return stacks.select(
        F.element_at(F.split("host", r"\."), -1).alias("top"),
        F.explode(
            F.array(
                F.struct(key.alias("key"), F.col("stack").alias("stack")),
                F.struct(F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("0")).alias("key"), F.col("outside").alias("stack")),
            )
        ).alias("b"),
    ).select("top", "b.key", "b.stack")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """One row a page: id, host, path, rule (null if none fits), verdict; rules has host, path and verdict, all lower case."""
    spark = pages.sparkSession
    if salts is None:
        salts = max(1, min(shuffle_partitions(spark), MOST_RULE_ROWS // max(1, rules.count())))
    url = F.col(url_col)
    bounds = _bounds(rules)
    stack_type = bounds.schema["stack"].dataType
    urls = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"), F.xxhash64(F.col(id_col), url).alias("_h"))
    swept = urls.select(
        F.element_at(F.split("host", r"\."), -1).alias("top"), F.pmod(F.col("_h"), F.lit(salts)).cast("int").alias("salt"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"),
        F.lit(None).cast(stack_type).alias("stack"), F.col(id_col), "host", "path",
    )
    rule_rows = bounds.select("top", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.lit(0).alias("kind"), "stack", F.lit(None).cast(pages.schema[id_col].dataType).alias(id_col), F.lit("").alias("host"), F.lit("").alias("path"))
    sweep = Window.partitionBy("top", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.filter(F.coalesce("open", F.array().cast(stack_type)), lambda r: F.startswith(F.col("path"), r["path"]))
    return (
        swept.unionByName(rule_rows)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .where("kind = 1")
        .withColumn("best", F.try_element_at(fits, F.lit(-1)))
        .select(F.col(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
