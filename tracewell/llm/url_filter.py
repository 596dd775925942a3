"""URL filter: fixed rules first, and an empirical-Bayes reputation of hosts for what no rule decides.

Pages that a rule decides are the labelled outcomes. Each host's share of good
outcomes is shrunk towards its registered domain's, that one towards its suffix's,
and that one towards the corpus's, by beta-binomial priors whose strength is
estimated from how much the shares differ at each level. A page is blocked when the
upper bound of its host's posterior is below one half, else allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Labels under which names are registered below a country's two letters.
REGISTERING = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "govt", "go", "gv", "ltd", "me", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "sch")
#: A public suffix of two labels: one of these and a country.
TWO_LABEL_SUFFIX = f"^({'|'.join(REGISTERING)})[.][a-z][a-z]$"
#: Normal quantile of the posterior bound, and the share that the bound is held against.
Z, CUT = 1.645, 0.5
#: Range of the within-group correlation that sets the strength of a prior.
LEAST_RHO, MOST_RHO = 0.001, 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two where a country registers names below the one before it."""
    two = F.substring_index(name_of(host), ".", -2)
    return F.when(two.rlike(TWO_LABEL_SUFFIX), two).otherwise(F.substring_index(two, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more; a numeric address is its own domain."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike("^[0-9.]+$"), name).when(two.rlike(TWO_LABEL_SUFFIX), F.substring_index(name, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    fits = F.lit(None)
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        inside = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fits = F.when(inside, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def strength(children: DataFrame) -> float:
    """Prior strength from rows (n, good, parent_n, parent_good): method of moments over all groups.

    One row of sums comes to the driver. With too few groups to tell, the strongest prior.
    """
    p, share = F.try_divide("parent_good", "parent_n"), F.try_divide("n", "parent_n")
    sums = children.where("n > 0 and parent_n > 0").agg(
        F.sum(F.col("n") * (F.try_divide("good", "n") - p) ** 2).alias("spread"),
        F.sum(p * (1 - p) * (1 - share)).alias("within"),
        F.sum(F.col("n") * p * (1 - p) * (1 - share)).alias("between"),
    ).first()
    room = (sums["between"] or 0.0) - (sums["within"] or 0.0)
    rho = ((sums["spread"] or 0.0) - (sums["within"] or 0.0)) / room if room > 1e-9 else LEAST_RHO
    rho = min(MOST_RHO, max(LEAST_RHO, rho))
    return round(1 / rho - 1, 6)


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, good, mean, lower, upper) of every host in outcomes (host, good int or null).

    good is 1 or 0 for a labelled page and null for others; hosts without labelled pages
    get their domain's, suffix's or the corpus's estimate with a wide bound. Empty hosts
    are left out. Rows are counted by host before anything is joined, and the upper levels
    are built from the lower ones' counts.
    """
    hosts = outcomes.where("host is not null and host <> ''").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n_d"), F.sum("good").alias("good_d"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n_d").alias("n_s"), F.sum("good_d").alias("good_s"))
    total = suffixes.agg(F.sum("n_s").alias("n"), F.sum("good_s").alias("good")).first()
    n_all, good_all = total["n"] or 0, total["good"] or 0
    by_suffix = strength(suffixes.select(F.col("n_s").alias("n"), F.col("good_s").alias("good"), F.lit(n_all).alias("parent_n"), F.lit(good_all).alias("parent_good")))
    by_domain = strength(domains.join(suffixes, "suffix").select(F.col("n_d").alias("n"), F.col("good_d").alias("good"), F.col("n_s").alias("parent_n"), F.col("good_s").alias("parent_good")))
    by_host = strength(hosts.join(domains, ["domain", "suffix"]).select("n", "good", F.col("n_d").alias("parent_n"), F.col("good_d").alias("parent_good")))
    mean = F.lit((good_all + 1) / (n_all + 2))
    mean = (F.col("good_s") + by_suffix * mean) / (F.col("n_s") + by_suffix)
    mean = (F.col("good_d") + by_domain * mean) / (F.col("n_d") + by_domain)
    a, b = F.col("good") + by_host * mean, F.col("n") - F.col("good") + by_host * (1 - mean)
    levels = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").withColumns({"a": a, "b": b})
    mean, sd = F.col("a") / (F.col("a") + F.col("b")), F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    return levels.select("host", "n", "good", mean.alias("mean"), (mean - z * sd).alias("lower"), (mean + z * sd).alias("upper"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, z: float = Z, cut: float = CUT) -> DataFrame:
    """(id, host, path, rule, verdict, posterior_mean, posterior_upper) of every row of pages.

    The longest rule that fits decides; else the host's reputation does. Null urls and
    urls without :// have an empty host and path, no rule, and are blocked: there is no
    host to trust. Repeated rows give repeated rows, an empty table none. Other columns
    are ignored. The reputation is joined on the host with a plain equi-join, whose hot
    hosts AQE can split.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).select("id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    outcomes = urls.select("host", F.when(F.col("fit.verdict") == "allow", 1).when(F.col("fit.verdict") == "block", 0).alias("good"))
    known = host_reputation(outcomes, z).select(F.col("host").alias("known_host"), "mean", "upper")
    judged = urls.join(known, urls["host"] == known["known_host"], "left")
    own = F.when((F.col("host") == "") | (F.col("upper") < cut), "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), F.col("mean").alias("posterior_mean"), F.col("upper").alias("posterior_upper"))


def filter_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """The rows of pages, with all their columns, whose url is allowed.

    Rules and reputation are those of judge_urls(); a host's reputation is joined to the rows.
    Null urls and urls without :// go, each of repeated rows is judged alike, null ids
    stay where their url does, an empty table stays empty; other columns are carried along.
    """
    rules = options.get("rules", RULES)
    host, path = host_of(pages[url_col]), path_of(pages[url_col])
    known = judge_urls(pages, id_col, url_col, **options).where("rule is null").groupBy("host").agg(F.min("verdict").alias("verdict"))
    blocked = known.where("verdict = 'block'").select(F.col("host").alias("blocked_host"))
    fit = rule_of(host, path, rules)["verdict"]
    return pages.where(fit == "allow").unionByName(pages.where(fit.isNull()).join(blocked, host == F.col("blocked_host"), "left_anti"))


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, z: float = Z, cut: float = CUT) -> str:
    """DuckDB SQL for judge_urls() over the table pages."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    case = lambda value: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{value(h, p, v)}'" for h, p, v in ordered) + " end"
    last = lambda n: f"array_to_string(list_slice(string_split(name, '.'), -{n}, -1), '.')"
    moments = lambda q: f"""(select round(1 / least({MOST_RHO}, greatest({LEAST_RHO}, case when b - w > 1e-9 then (s - w) / (b - w) else {LEAST_RHO} end)) - 1, 6) from (
      select coalesce(sum(n * pow(good / n - p, 2)), 0) s, coalesce(sum(p * (1 - p) * (1 - n / pn)), 0) w, coalesce(sum(n * p * (1 - p) * (1 - n / pn)), 0) b
      from (select n, good, pn, pg / pn p from ({q}) where n > 0 and pn > 0)))"""  # noqa: E731
    return f"""
with u as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path from pages),
f as (select *, {case(lambda h, p, v: h + p)} rule, {case(lambda h, p, v: v)} fixed from u),
h0 as (select host, count(fixed)::double n, count(*) filter (fixed = 'allow')::double good, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name from f where host <> '' group by host),
h as (select host, n, good, case when regexp_matches(name, '^[0-9.]+$') then name when regexp_matches({last(2)}, '{TWO_LABEL_SUFFIX}') then {last(3)} else {last(2)} end dom, case when regexp_matches({last(2)}, '{TWO_LABEL_SUFFIX}') then {last(2)} else {last(1)} end suf from h0),
d as (select dom, suf, sum(n) nd, sum(good) gd from h group by dom, suf),
s as (select suf, sum(nd) ns, sum(gd) gs from d group by suf),
t as (select coalesce(sum(ns), 0) na, coalesce(sum(gs), 0) ga from s),
k as (select na, ga, {moments("select ns n, gs good, na pn, ga pg from s, t")} ks, {moments("select nd n, gd good, ns pn, gs pg from d join s using (suf)")} kd, {moments("select n, good, nd pn, gd pg from h join d using (dom, suf)")} kh from t),
m as (select h.*, (gd + kd * ((gs + ks * ((ga + 1) / (na + 2))) / (ns + ks))) / (nd + kd) md, kh from h join d using (dom, suf) join s using (suf), k),
ab as (select host, good + kh * md a, n - good + kh * (1 - md) b from m),
r as (select host, a / (a + b) mean, a / (a + b) + {z} * sqrt(a * b / (a + b + 1)) / (a + b) upper from ab)
select page_id, f.host, path, rule, coalesce(fixed, case when f.host = '' or upper < {cut} then 'block' else 'allow' end) verdict from f left join r on f.host = r.host
"""

