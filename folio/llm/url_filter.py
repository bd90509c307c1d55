"""URL rules and empirical-Bayes host reputation, as DataFrame expressions.

Labelled outcomes of pages (bad or not) are counted by host. The rate of a suffix is shrunk towards the rate of all pages, a
registered domain's towards its suffix's, a host's towards its domain's: each level's posterior mean is the mean of the beta
prior of the level below, whose strength is the moment estimate of how much rates differ between that level's units. A page
is blocked when even the lower posterior bound of its host's bad rate, a quantile of its beta posterior, exceeds the cut-off.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


# Second labels under which country domains are registered.
SECOND_LEVEL = "ac asn biz co com edu firm gen go gob gouv gov gv id ind info ltd me mil ne net nhs nic nom or org plc police sch web".split()
SECOND = rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$"
ADDRESS = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$|^\["


def bare_host(host: Column) -> Column:
    """The host without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$|\.+$", "")


def suffix_of(host: Column) -> Column:
    """What domains are registered under: the last label, or two of a country that registers under second labels; an address has
    none but itself."""
    name = bare_host(host)
    return F.when(name.rlike(ADDRESS), name).when(name.rlike(SECOND), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    name = bare_host(host)
    return F.when(name.rlike(ADDRESS), name).when(name.rlike(SECOND), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def domains_by_list(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts`` with ``domain`` and ``suffix`` by a public suffix list, a table of one column ``rule`` (``uk``, ``co.uk``, ``*.ck``, ``!www.ck``).

    An exception wins over all, else the rule of most labels; a host that no rule fits has its last label as its suffix. ``hosts`` has one
    row a host; comments, blank and null rules count for none, case does not matter. The list is joined, not sent out, so it may be of any length.
    """
    rule = F.lower(F.trim("rule"))
    listed = rules.select(rule.alias("rule")).where("rule <> '' AND NOT startswith(rule, '//')").distinct()
    named = hosts.withColumn("_name", bare_host(F.col("host")))
    tails = named.where(~F.col("_name").rlike(ADDRESS)).select("host", F.split("_name", r"\.").alias("l")).select("host", "l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("n"))
    tail = F.array_join(F.slice("l", -F.col("n"), F.col("n")), ".")
    form = lambda rule, labels, excepted: F.struct(rule.alias("rule"), labels.alias("labels"), F.lit(excepted).alias("excepted"))
    forms = F.array(form(tail, F.col("n"), False), form(F.regexp_replace(tail, r"^[^.]*", "*"), F.col("n"), False), form(F.concat(F.lit("!"), tail), F.col("n") - 1, True))
    fits = tails.select("host", F.inline(forms)).join(listed, "rule").groupBy("host").agg(F.max(F.struct("excepted", "labels")).alias("best"))
    whole, n = F.col("_name").rlike(ADDRESS), F.coalesce("best.labels", F.lit(1))
    labels = F.split("_name", r"\.")
    last = lambda n: F.array_join(F.slice(labels, -F.least(n, F.size(labels)), n), ".")
    return named.join(fits, "host", "left").withColumns({"domain": F.when(whole, F.col("_name")).otherwise(last(n + 1)), "suffix": F.when(whole, F.col("_name")).otherwise(last(n))}).drop("_name", "best")


def beta_quantile(mean: Column, weight: Column, p: float) -> Column:
    """The lower quantile of a beta distribution with this mean and weight (both parameters together), by the usual closed
    approximations: Abramowitz and Stegun 26.5.22 where both parameters are 1 or more (right to 0.01), else the two power-law tails (right to 0.06)."""
    a, b = mean * weight, (1 - mean) * weight
    y = F.lit(NormalDist().inv_cdf(1 - p))
    lam = (y * y - 3) / 6
    h = 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1))
    w = y * F.sqrt(lam + h) / h - (1 / (2 * b - 1) - 1 / (2 * a - 1)) * (lam + F.lit(5 / 6) - 2 / (3 * h))
    low, high = F.exp(a * F.log(a / (a + b))) / a, F.exp(b * F.log(b / (a + b))) / b
    whole = low + high
    tails = F.when(F.lit(p) < low / whole, F.pow(a * whole * F.lit(p), 1 / a)).otherwise(1 - F.pow(b * whole * F.lit(1 - p), 1 / b))
    return F.when((a >= 1) & (b >= 1), a / (a + b * F.exp(2 * w))).when((a > 0) & (b > 0), tails).otherwise(mean)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. Rules are (verdict, ``host/path``), few and fixed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _strength(units: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Per parent (``keys``): posterior strength of the beta prior from the spread of its units' rates (method of moments)."""
    rate = F.col("bad") / F.col("n")
    got = units.groupBy(*keys).agg(
        F.sum("n").alias("pn"), F.sum("bad").alias("pbad"), F.count("*").alias("k"), F.sum(F.col("n") * rate * rate).alias("ss"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    )
    mean = F.col("pbad") / F.col("pn")
    within = mean * (1 - mean)
    between = F.col("ss") - F.col("pn") * mean * mean
    freedom = F.col("pn") - F.col("nn") / F.col("pn")
    variance = (between - (F.col("k") - 1) * within) / F.nullif(freedom, F.lit(0.0))
    strength = F.when((variance > 0) & (within > 0), within / variance - 1).otherwise(F.lit(high))
    return got.select(*keys, "pn", "pbad", "k", F.greatest(F.lit(low), F.least(F.lit(high), strength)).alias("strength"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", p: float = 0.05, low: float = 2.0, high: float = 200.0, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, mean, bound) of every host with a labelled page.

    Domains are registered under the rules of ``suffixes`` (see ``domains_by_list``), without it under the last label, or the last two of
    a country with second labels.

    ``pages`` has (id_col, host), ``outcomes`` (id_col, bad 0/1). ``bound`` is the posterior's quantile of probability ``p``.
    The counts are pre-aggregated, so a hot host costs one row per task. Null outcomes and rows without a host do not count.
    """
    seen = pages.where("host <> ''").join(outcomes.where("bad IS NOT NULL").groupBy(id_col).agg(F.max("bad").alias("bad")), id_col)
    hosts = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    if suffixes is None:
        hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    else:
        hosts = domains_by_list(hosts, suffixes)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    # a unit's posterior under the prior of its parent; an only child is its parent, whose outcomes must not count twice
    alone = F.col("k") == 1
    weight = F.when(alone, F.col("prior_weight")).otherwise(F.col("n") + F.col("strength"))
    mean = F.when(alone, F.col("prior")).otherwise((F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))
    top = _strength(suffixes, [], low, high).select("strength", ((F.col("pbad") + 1) / (F.col("pn") + 2)).alias("prior")).first()
    given = {"strength": F.lit(top["strength"]), "prior": F.lit(top["prior"]), "prior_weight": F.lit(0.0), "k": F.lit(0)}
    by_suffix = suffixes.withColumns(given).select("suffix", mean.alias("prior"), weight.alias("prior_weight"))
    up = by_suffix.join(_strength(domains, ["suffix"], low, high).select("suffix", "strength", "k"), "suffix")
    by_domain = domains.join(up, "suffix").select("domain", mean.alias("prior"), weight.alias("prior_weight"))
    up = by_domain.join(_strength(hosts, ["domain"], low, high).select("domain", "strength", "k"), "domain")
    by_host = hosts.join(up, "domain").withColumns({"mean": mean, "weight": weight})
    return by_host.select("host", "n", "bad", "mean", beta_quantile(F.col("mean"), F.col("weight"), p).alias("bound"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", cut_off: float = 0.5, p: float = 0.05,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """Every row's (id_col, host, path, rule, verdict, bad_rate, bound).

    The longest fitting rule decides (of rules of one length the last given); else a host whose posterior lower bound of the bad rate exceeds ``cut_off`` is blocked.
    A null url or one without ``://`` has empty host and path, no rule, and is allowed. A host without outcomes is allowed and
    has null rates. Repeated rows are judged each; a page's outcomes count once, the bad one first. Pages without an id count for no
    host. An address is its own domain; ports and users belong to no domain. Empty tables are fine; other columns are not read.
    """
    parsed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = host_reputation(parsed.where("id IS NOT NULL"), outcomes.select(F.col(id_col).alias("id"), "bad"), "id", p, suffixes=suffixes)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > cut_off, "block").otherwise("allow")
    return parsed.join(known.select("host", F.col("mean").alias("bad_rate"), "bound"), "host", "left").select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_rate", "bound"
    )
