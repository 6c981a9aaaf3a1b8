"""Lookup joins. Distinct names are classified once and joined back."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import file_suffix
from ..functions.url import Suffixes, registered_domain, url_host
from ..session import settle


def _plain_text(pattern: str) -> str | None:
    """The text a pattern stands for when it has no special signs left, else None."""
    bare = re.sub(r"\\([.\-/_ ])", r"\1", pattern)
    rest = re.sub(r"\\[.\-/_ ]", "", pattern)
    return bare if pattern and not re.search(r"[\\^$.|?*+()\[\]{}]", rest) else None


def substrings(text: Column, sizes: list[int] | Column) -> Column:
    """Distinct substrings of a text that have one of the given lengths, a list or an array column."""
    if isinstance(sizes, Column):
        def of(n: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))

        return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(text)), of)))

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[pieces(n) for n in sizes]))


def classify_hosts(hosts: DataFrame, host: str, rules: list[tuple[int, str, str]]) -> DataFrame:
    """Category of the lowest-numbered rule whose pattern is found in the host; (host, category), null when none.

    Rules that are plain texts are met by joining the substrings of a host by equality, so the work follows the length
    of the host and not the number of rules; the others are tried in place.
    """
    spark = hosts.sparkSession
    plain = [(no, _plain_text(p)) for no, p, _ in rules]
    words = [(n, t) for n, t in plain if t]
    other = F.lit(None).cast("int")
    for no, pattern, _ in rules:
        if _plain_text(pattern) is None:
            other = F.least(other, F.when(F.col(host).rlike(pattern), F.lit(no)))
    numbered = hosts.select(host, other.alias("_other"))
    if words:
        table = spark.createDataFrame(words, "rule_no INT, _word STRING").groupBy("_word").agg(F.min("rule_no").alias("rule_no"))
        sizes = sorted({len(t) for _, t in words})
        spread = numbered.select("*", F.explode_outer(substrings(F.col(host), sizes)).alias("_word"))
        numbered = spread.join(table, "_word", "left").groupBy(host).agg(F.least(F.min("rule_no"), F.min("_other")).alias("rule_no"))
    else:
        numbered = numbered.withColumnRenamed("_other", "rule_no")
    listed = spark.createDataFrame([(n, c) for n, _, c in rules], "rule_no INT, category STRING")
    return numbered.join(listed, "rule_no", "left").select(host, "category")


def add_service(df: DataFrame, host: str, rules, classes: DataFrame, class_names: DataFrame) -> DataFrame:
    """Add ``sp`` (category), ``scat`` (first class, its name when it has one) and ``scat2`` (second class)."""
    hosts = df.select(host).where(F.col(host).isNotNull()).distinct()
    known = (
        classify_hosts(hosts, host, rules)
        .join(classes, "category", "left")
        .join(class_names.select("cls1", F.col("name").alias("_name")), "cls1", "left")
        .select(host, F.col("category").alias("sp"),
                F.coalesce("_name", F.col("cls1").cast("string")).alias("scat"), F.col("cls2").cast("string").alias("scat2"))
    )
    return df.join(known, host, "left").select(*df.columns, "sp", "scat", "scat2")


def building_key(ap: Column) -> Column:
    """Building part of an access point name: before the floor, without a leading ``MH-``."""
    return F.regexp_replace(F.split(ap, r"-\d+F-", 2)[0], "^MH-", "")


def add_building(df: DataFrame, ap: str, buildings: DataFrame, fields=("name", "type", "user", "lon", "lat"),
                 full_name: bool = True, prefix: str = "building_") -> DataFrame:
    """Add the building of an access point: the longest code its name contains (an exact name is the longest).

    ``full_name=False`` takes the column as a code and looks for the same code only.
    """
    info = F.struct(*[F.col(f) for f in fields])
    if full_name:
        keys = df.select(building_key(F.col(ap)).alias("_key")).where(F.col("_key").isNotNull()).distinct()
        lengths = buildings.where(F.length("code") > 0).agg(F.array_sort(F.collect_set(F.length("code"))).alias("n")).scalar()
        spread = keys.withColumn("_sizes", lengths).select("_key", F.explode(substrings(F.col("_key"), F.col("_sizes"))).alias("code"))
        best = spread.join(buildings, "code").groupBy("_key").agg(F.max_by(info, F.struct(F.length("code"), F.col("code"))).alias("_b"))
        marked = df.withColumn("_key", building_key(F.col(ap)))
    else:
        best = buildings.select(F.col("code").alias("_key"), info.alias("_b"))
        marked = df.withColumn("_key", F.col(ap))
    return marked.join(best, "_key", "left").select(*df.columns, *[F.col(f"_b.{f}").alias(prefix + f) for f in fields])


def add_protocol(df: DataFrame, proto_id: str, protocols: DataFrame) -> DataFrame:
    """Add protocol name and category."""
    table = protocols.select(F.col("id").alias(proto_id), F.col("name").alias("proto"), F.col("category").alias("proto_category"))
    return df.join(table, proto_id, "left").select(*df.columns, "proto", "proto_category")


def protocols_of(protocols: DataFrame) -> DataFrame:
    """Per category its protocol numbers and names, in number order."""
    both = F.array_sort(F.collect_list(F.struct("id", "name")))
    return protocols.groupBy("category").agg(both.alias("_p")).select(
        "category", F.col("_p.id").alias("ids"), F.col("_p.name").alias("names"))


def add_country(df: DataFrame, suffix: Column, countries: DataFrame) -> DataFrame:
    """Add the country of the last label of a suffix, ``unknown`` when it is not listed."""
    table = countries.select(F.col("suffix").alias("_tld"), F.col("country").alias("_country"))
    tld = F.substring_index(F.btrim(suffix, F.lit(".")), ".", -1)
    return df.withColumn("_tld", tld).join(table, "_tld", "left").select(
        *df.columns, F.coalesce("_country", F.lit("unknown")).alias("country"))


def host_parts(df: DataFrame, url: str, suffixes: Suffixes) -> DataFrame:
    """Add subdomain, domain and suffix of an address."""
    host, reg = url_host(F.col(url)), registered_domain(F.col(url), suffixes)
    dots = reg.contains(".")
    rest = F.length(host) - F.length(reg)
    return df.withColumns({
        "subdomain": F.when(rest > 1, F.substring(host, F.lit(1), (rest - 1).cast("int"))).otherwise(F.lit("")),
        "domain": F.when(dots, F.substring_index(reg, ".", 1)).otherwise(reg),
        "suffix": F.when(dots, F.regexp_extract(reg, r"^[^.]+\.(.*)$", 1)).otherwise(F.lit("")),
    })


def add_file_category(df: DataFrame, name: str, categories: DataFrame) -> DataFrame:
    """Add the category of a file suffix; where several list it, the one with the lowest priority number."""
    one = categories.groupBy(F.col("suffix").alias("_suffix")).agg(
        F.min_by("category", F.struct("priority", "category")).alias("file_category"))
    return df.withColumn("_suffix", file_suffix(F.col(name))).join(one, "_suffix", "left").select(*df.columns, "file_category")


CELL = 1_000_000  # joined rows of two blocks in ``join_profiles``, on average


def join_profiles(sessions: DataFrame, profiles: DataFrame, by: str | None = None) -> DataFrame:
    """Sessions of accounts with a profile; an account with several profiles multiplies its sessions.

    The result can be far larger than both sides, so neither their sizes nor how few accounts there are decide how many tasks make it: both
    sides are written once and counted by account, an account's sessions and its profiles are dealt into blocks, and each pair of blocks is a cell
    of about ``CELL`` rows (fewer in a small result) that goes to a task by its hash. A side is sent once for each block of the other, so one
    row is sent for every 500 of the result or so. With ``by``, a column of the profiles, the rows lie in ranges of it if Catalyst's size check lets all
    sessions be sent to every task: only profiles are shuffled then, and a sort that begins with ``by`` moves no joined row.
    """
    spark = sessions.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sessions, profiles = settle(sessions, "sessions"), settle(profiles, "profiles")
    sizes = sessions.groupBy("account").agg(F.count("*").alias("_s")).join(profiles.groupBy("account").agg(F.count("*").alias("_p")), "account")
    total = sizes.agg(F.sum(F.col("_s").cast("double") * F.col("_p"))).first()[0] or 0.0
    tasks = max(parts, math.ceil(total / CELL))
    if by is not None and fits_broadcast(sessions):
        ranged = profiles.join(sizes.select("account"), "account", "left_semi").repartitionByRange(tasks, by)
        rest = [c for c in profiles.columns if c != "account"]
        return ranged.join(F.broadcast(sessions), "account").select("account", *[c for c in sessions.columns if c != "account"], *rest)
    side = max(1.0, min(total / (8 * parts), CELL)) ** 0.5
    blocks = sizes.select("account", F.ceil(F.col("_s") / side).alias("_a"), F.ceil(F.col("_p") / side).alias("_b"))
    keys = ["account", "_i", "_j"]

    def dealt(rows: DataFrame, own: str, other: str, i: str, j: str) -> DataFrame:
        numbered = rows.withColumn("_at", F.xxhash64(F.monotonically_increasing_id())).join(blocks, "account")
        placed = numbered.select(*rows.columns, F.pmod("_at", own).alias(i), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(j))
        return placed.repartition(tasks, *keys)

    return dealt(sessions, "_a", "_b", "_i", "_j").join(dealt(profiles, "_b", "_a", "_j", "_i"), keys).drop("_i", "_j")


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Catalyst's size check would send all rows to every task."""
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of two tables that occur in both."""
    return a.select(key).intersect(b.select(key))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of every key; Spark cuts each task's input to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def add_domain(df: DataFrame, url: str, rules: DataFrame, into: str = "domain") -> DataFrame:
    """Add the registered domain of an address or host: its longest public suffix and one label more; the host itself when no rule fits.

    ``rules`` is the table of ``read_suffix_rules``, of any size. Each different host is looked up once: its endings meet the rules
    by equality, the longest wins, and an exception rule takes its own first label out of the suffix. Null stays null.
    """
    host = url_host(F.col(url))
    hosts = df.select(host.alias("_host")).where(F.col("_host").isNotNull()).distinct()
    labels = F.split(F.lower("_host"), r"\.")
    ends = hosts.select("_host", F.size(labels).alias("_n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))).alias("_k", "suffix"))
    met = ends.join(rules, "suffix")
    # how many labels the suffix has by this rule
    depth = F.when(F.col("kind") == "plain", F.col("_k") + 1).when((F.col("kind") == "wildcard") & (F.col("_n") > F.col("_k") + 1), F.col("_k") + 2)
    found = met.groupBy("_host").agg(F.max(depth).alias("_deep"), F.max(F.when(F.col("kind") == "exception", F.col("_k"))).alias("_but"))
    parts = F.split("_host", r"\.")
    size = F.least(F.coalesce("_but", "_deep") + 1, F.size(parts))
    named = found.select("_host", F.when(size.isNotNull(), F.array_join(F.slice(parts, -size, size), ".")).alias("_domain"))
    return df.withColumn("_host", host).join(named, "_host", "left").select(*df.columns, F.coalesce("_domain", "_host").alias(into))


def with_domain(df: DataFrame, url: str, suffixes: Suffixes | DataFrame, into: str) -> DataFrame:
    """Add the registered domain by a list of suffixes (an expression) or a table of rules (a join)."""
    if isinstance(suffixes, DataFrame):
        return add_domain(df, url, suffixes, into)
    return df.withColumn(into, registered_domain(F.col(url), suffixes))
