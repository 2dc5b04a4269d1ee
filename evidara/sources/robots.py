"""robots.txt files as rules, and addresses judged by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many bytes of files are broadcast to the addresses; beyond, both are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_RULES = "array<struct<agent:string,pattern:string,allow:boolean>>"


def robots_rules(files: DataFrame, host: str = "host", text: str = "text") -> DataFrame:
    """(host, agents, rules): which agents a host's file speaks to, and its rules for each.

    Lines are ``key: value``, ``#`` begins a comment, keys and agents are read in lower case. Agents named one after
    another share the rules that follow. A rule without a path says nothing; other keys are passed over. A null
    text, a file that could not be read, has neither agents nor rules. Of rows that repeat a host one is read.
    """
    one = files.groupBy(F.lower(host).alias("host")).agg(F.max(text).alias("text"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), lambda line: F.trim(F.substring_index(line, "#", 1)))
    pairs = F.transform(F.filter(lines, lambda line: F.contains(line, F.lit(":"))), lambda line: F.struct(F.lower(F.trim(F.substring_index(line, ":", 1))).alias("key"), F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("value")))
    start = F.struct(F.array().cast("array<string>").alias("named"), F.lit(False).alias("naming"), F.array().cast("array<string>").alias("agents"), F.array().cast(_RULES).alias("rules"))

    def read(state: Column, pair: Column) -> Column:
        names, rule = pair["key"] == "user-agent", pair["key"].isin("allow", "disallow")
        agent = F.array(F.lower(pair["value"]))
        own = F.transform(state["named"], lambda a: F.struct(a.alias("agent"), pair["value"].alias("pattern"), (pair["key"] == "allow").alias("allow")))
        return F.struct(
            F.when(names & state["naming"], F.concat(state["named"], agent)).when(names, agent).otherwise(state["named"]).alias("named"),
            F.when(names, True).when(rule, False).otherwise(state["naming"]).alias("naming"),
            F.when(names, F.array_union(state["agents"], agent)).otherwise(state["agents"]).alias("agents"),
            F.when(rule & (pair["value"] != ""), F.concat(state["rules"], own)).otherwise(state["rules"]).alias("rules"),
        )

    return one.select("host", F.aggregate(pairs, start, read).alias("read")).select("host", "read.agents", "read.rules")


def _covers(pattern: Column, path: Column) -> Column:
    """Whether a rule's pattern covers a path: as its beginning, ``*`` standing for anything and a last ``$`` for the end."""
    ended = F.endswith(pattern, F.lit("$"))
    bare = F.when(ended, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.transform(F.split(bare, r"\*"), lambda part: F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    regex = F.concat(F.lit("(?s)^"), F.array_join(quoted, ".*"), F.when(ended, "$").otherwise(""))
    return F.when(ended | F.contains(pattern, F.lit("*")), F.rlike(path, regex)).otherwise(F.startswith(path, pattern))


def may_fetch(agents: Column, rules: Column, agent: str, path: Column) -> Column:
    """Whether a file lets the agent read a path.

    The rules for the longest agent name that stands in the agent's own apply, else those for ``*``. Of the rules that
    cover the path the one with the longest pattern decides, of equally long ones one that allows; none, or no file, allows.
    """
    own = F.filter(agents, lambda a: (a != "*") & (a != "") & F.contains(F.lit(agent.lower()), a))
    longest = F.array_max(F.transform(own, lambda a: F.struct(F.length(a).alias("n"), a.alias("agent"))))
    chosen = F.coalesce(longest["agent"], F.lit("*"))
    fitting = F.filter(rules, lambda r: (r["agent"] == chosen) & _covers(r["pattern"], path))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return (path == "/robots.txt") | F.coalesce(best["allow"], F.lit(True))


def gate_urls(urls: DataFrame, files: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """The addresses with ``allowed``, by their hosts' files (host, text). Hosts without a file allow everything; an address without a host is not allowed.

    Each file is parsed once and meets its host's addresses as one row with all its rules, so a host with very many
    addresses multiplies nothing.
    """
    rules = robots_rules(files)
    small = (files.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rest = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^#]*)", 1)
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    read = rules.select(F.col("host").alias("_host"), F.col("agents").alias("_agents"), F.col("rules").alias("_rules"))
    joined = urls.join(F.broadcast(read) if small else read, host == F.col("_host"), "left")
    return joined.select(*[urls[c] for c in urls.columns], (host.isNotNull() & may_fetch(F.coalesce("_agents", F.array().cast("array<string>")), F.coalesce("_rules", F.array().cast(_RULES)), agent, path)).alias("allowed"))
