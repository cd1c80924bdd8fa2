"""Robots rules as tables, and verdicts over a table of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def directives(snapshots: DataFrame) -> DataFrame:
    """Directive lines of each snapshot with the number of the agent group they belong to.

    A group opens at a User-agent line that follows anything but another User-agent line.
    The window runs within one robots file.
    """
    lines = snapshots.select("snapshot_id", F.posexplode(F.split("body", LINE_ENDS)).alias("line", "raw"))
    text = F.trim(F.element_at(F.split("raw", "#", 2), 1))
    parts = (
        lines.withColumn("text", text)
        .filter(F.contains("text", F.lit(":")))
        .select(
            "snapshot_id", "line",
            F.lower(F.trim(F.substring_index("text", ":", 1))).alias("field"),
            F.trim(F.element_at(F.split("text", ":", 2), 2)).alias("value"),
        )
    )
    order = Window.partitionBy("snapshot_id").orderBy("line")
    agent = F.col("field") == "user-agent"
    opens = agent & ~F.coalesce(F.lag(agent).over(order), F.lit(False))
    return parts.withColumn("_open", opens.cast("int")).withColumn("group_no", F.sum("_open").over(order)).drop("_open")


def pattern_regex(pattern: Column) -> Column:
    """Anchored regular expression of a path pattern: `*` is any run, a final `$` ends the path."""
    ends = F.endswith(pattern, F.lit("$"))
    body = F.when(ends, F.regexp_replace(pattern, "\\$$", "")).otherwise(pattern)
    literal = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.when(ends, "$").otherwise(""))


def rules(lines: DataFrame) -> DataFrame:
    """Allow and Disallow rules with their group; empty patterns and ownerless rules are void."""
    return lines.filter(F.col("field").isin("allow", "disallow") & (F.col("value") != "") & (F.col("group_no") > 0)).select(
        "snapshot_id", "group_no", "line",
        (F.col("field") == "allow").alias("allow"),
        F.col("value").alias("pattern"),
        pattern_regex(F.col("value")).alias("regex"),
    )


def crawl_delays(lines: DataFrame) -> DataFrame:
    """Last readable Crawl-delay of every group."""
    d = lines.filter((F.col("field") == "crawl-delay") & (F.col("group_no") > 0)).withColumn(
        "delay", F.col("value").try_cast("double")
    )
    return d.filter(F.col("delay").isNotNull()).groupBy("snapshot_id", "group_no").agg(
        F.max_by("delay", "line").alias("crawl_delay")
    )


def chosen_group(lines: DataFrame, user_agent: str) -> DataFrame:
    """The group that speaks to an agent: longest token it contains, else the first `*` group."""
    agents = lines.filter((F.col("field") == "user-agent")).withColumn("agent", F.lower("value"))
    ua = F.lit(user_agent.lower())
    named = (F.col("agent") != "*") & F.contains(ua, F.col("agent"))
    rank = F.struct(F.length("agent"), -F.col("line"))
    return (
        agents.groupBy("snapshot_id")
        .agg(
            F.max_by(F.when(named, F.col("group_no")), F.when(named, rank)).alias("named"),
            F.min(F.when(F.col("agent") == "*", F.col("group_no"))).alias("wildcard"),
        )
        .select("snapshot_id", F.coalesce("named", "wildcard").alias("group_no"))
        .filter(F.col("group_no").isNotNull())
    )


def policies(snapshots: DataFrame, user_agent: str) -> DataFrame:
    """One row per snapshot: verdict policy from the status and the packed rules for an agent.

    The rules of one file are one array, as its text is one row; rule_index() takes them apart again.
    """
    lines = directives(snapshots)
    group = chosen_group(lines, user_agent)
    mine = rules(lines).join(group, ["snapshot_id", "group_no"], "left_semi")
    packed = mine.groupBy("snapshot_id").agg(F.collect_list(F.struct("allow", "pattern", "regex")).alias("rules"))
    delay = crawl_delays(lines).join(group, ["snapshot_id", "group_no"], "left_semi").select("snapshot_id", "crawl_delay")
    status = F.col("http_status")
    policy = (
        F.when(status == 200, "parse")
        .when(status.isNull() | status.isin(401, 403) | (status >= 500), "disallow_all")
        .otherwise("allow_all")
    )
    return (
        snapshots.select("snapshot_id", "host", "http_status", policy.alias("policy"))
        .join(packed, "snapshot_id", "left")
        .join(delay, "snapshot_id", "left")
    )


URL_PARTS = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 1)


def bare_path(url: Column) -> Column:
    p = F.regexp_extract(url, URL_PARTS, 2)
    return F.when(p == "", "/").otherwise(p)


def match_path(url: Column) -> Column:
    """Path with its query string, as rules see it."""
    q = F.regexp_extract(url, URL_PARTS, 3)
    return F.concat(bare_path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def literal_head(pattern: Column) -> Column:
    """What a path must begin with to match: the pattern up to its first wildcard, without a final `$`."""
    return F.substring_index(F.regexp_replace(pattern, r"\$$", ""), "*", 1)


def rule_index(policy: DataFrame) -> DataFrame:
    """(snapshot_id, head, plain, allow, pattern, regex): rules by their literal head; plain ones are nothing else."""
    rules = policy.filter(F.col("policy") == "parse").select("snapshot_id", F.inline("rules"))
    head = literal_head(F.col("pattern"))
    return rules.select("snapshot_id", head.alias("head"), (head == F.col("pattern")).alias("plain"), "allow", "pattern", "regex")


def winning_rules(paths: DataFrame, index: DataFrame) -> DataFrame:
    """(snapshot_id, path, win) for distinct paths: the longest matching pattern; Allow wins among equals.

    A path is looked up by its beginnings of the lengths that heads of its file have, an equi-join. Only rules that go on
    after their head are tried as expressions, and only on paths that begin with it.
    """
    sizes = index.groupBy("snapshot_id").agg(F.collect_set(F.length("head")).alias("sizes"))
    probes = paths.join(sizes, "snapshot_id").select(
        "snapshot_id", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("size")
    )
    probes = probes.withColumn("head", F.expr("substring(path, 1, size)")).drop("size")
    hits = probes.join(index, ["snapshot_id", "head"]).filter(F.col("plain") | F.rlike("path", F.col("regex")))
    rank = F.struct(F.length("pattern").alias("size"), "allow", "pattern")
    return hits.groupBy("snapshot_id", "path").agg(F.max(rank).alias("win"))


def judge(urls: DataFrame, policy: DataFrame, intent_denied: list[str], url: str = "url") -> DataFrame:
    """Allowed or not, and the rule that decided, for every URL.

    Rules meet distinct paths only, and never travel with the URLs.
    """
    u = F.col(url)
    j = urls.withColumn("host", url_host(u)).withColumn("path", match_path(u))
    known = policy.select("host", F.col("snapshot_id").alias("_snapshot"), "policy", "crawl_delay")
    j = j.join(known, "host", "left")
    paths = j.filter(F.col("policy") == "parse").select(F.col("_snapshot").alias("snapshot_id"), "path").distinct()
    won = winning_rules(paths, rule_index(policy)).select(F.col("snapshot_id").alias("_snapshot"), "path", "win")
    j = j.join(won, ["_snapshot", "path"], "left")
    hit = F.array_compact(F.array(*[F.when(F.startswith(bare_path(u), F.lit(p)), F.lit(p)) for p in intent_denied]))
    intent = F.get(hit, F.lit(0)) if intent_denied else F.lit(None).cast("string")
    unknown = F.col("policy").isNull()
    allowed = (
        F.when(intent.isNotNull(), False)
        .when(unknown | (F.col("policy") == "disallow_all"), False)
        .when(F.col("policy") == "allow_all", True)
        .otherwise(F.coalesce(F.col("win.allow"), F.lit(True)))
    )
    reason = (
        F.when(intent.isNotNull(), F.concat(F.lit("intent_denied:"), intent))
        .when(unknown | (F.col("policy") == "disallow_all"), "robots:disallow_all")
        .when(F.col("policy") == "allow_all", "robots:allow_all")
        .when(F.col("win").isNull(), "robots:no_matching_rule")
        .otherwise(F.concat(F.lit("robots:"), F.when(F.col("win.allow"), "allow:").otherwise("disallow:"), F.col("win.pattern")))
    )
    return j.select(
        *urls.columns, "host", "path", allowed.alias("allowed"), reason.alias("rule"),
        intent.isNotNull().alias("intent_denied"), "crawl_delay",
    )


def recheck_landing(fetches: DataFrame, policy: DataFrame, intent_denied: list[str]) -> DataFrame:
    """Fetches whose final URL after redirects was not allowed, although the first one was."""
    moved = fetches.filter(F.col("final_url").isNotNull() & (F.col("final_url") != F.col("url")))
    return judge(moved, policy, intent_denied, "final_url").filter(~F.col("allowed"))


def snapshot_inventory(snapshots: DataFrame) -> DataFrame:
    """Size and digest of every stored robots file."""
    return snapshots.select(
        "snapshot_id", "host", "http_status", F.length("body").alias("body_bytes"),
        F.sha2("body", 256).alias("body_sha256"),
    )
