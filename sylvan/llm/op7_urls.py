"""URL filters: a temporal join of captures with dated list entries, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm import common

#: Entries of the query's list as (list, domain, path prefix, action, date). A list names a domain from an "add" until the next
#: "remove". GENERATED more follow a rule (`generated`), so that the list has the size of a small real one.
ENTRIES = (
    ("spam", "spam-farm.example.org", "", "add", "2024-01-10"),
    ("spam", "spam-farm.example.org", "", "remove", "2024-06-01"),
    ("spam", "spam-farm.example.org", "", "add", "2024-09-15"),
    ("spam", "cheap-pills.example.com", "", "add", "2024-02-01"),
    ("spam", "tiontion.example.com", "/de", "add", "2024-03-01"),
    ("spam", "tiontion.example.com", "/de", "remove", "2024-11-01"),
    ("adult", "ththth.example.org", "", "add", "2024-04-01"),
    ("adult", "ththth.example.org", "", "add", "2024-05-01"),
    ("adult", "ththth.example.org", "", "remove", "2024-08-01"),
    ("adult", "m.ththin.example.org", "", "add", "2024-01-01"),
    ("malware", "cheap-pills.example.com", "/en", "add", "2024-07-01"),
    ("malware", "tionsh.example.net", "/fr", "add", "2024-05-05"),
    ("malware", "tionsh.example.net", "/fr", "remove", "2024-05-20"),
    ("malware", "example.net", "/es/9", "add", "2024-10-01"),
    ("malware", "ththing.example.org", "", "remove", "2024-03-03"),
)
FIRST_DAY = "2024-01-01"
GENERATED = 24_000
_SYLLABLES = "tion th sh the re er on an in ly es ed nd le he ble al ing st or".split()


def generated(array, day) -> str:
    """A SELECT of GENERATED entries from `ids(id)`: four of a kind are adds and removes of one list, domain and path. `array`
    writes an element of a list by its number, `day` a date so many days after FIRST_DAY, in a dialect of SQL."""
    key = "floor(id / 4)"
    pick = lambda values, every: array(values, f"CAST(floor({key} / {every}) % {len(values)} AS INTEGER)")
    domain = f"concat({pick(_SYLLABLES, 1)}, {pick(_SYLLABLES, 20)}, '.example.', {pick(['com', 'org', 'net'], 400)})"
    path = f"CASE WHEN {key} % 2 = 0 THEN '' ELSE {pick(['/de', '/en', '/fr', '/es/1'], 3)} END"
    return f"SELECT {pick(['spam', 'adult', 'malware', 'phishing', 'piracy'], 1200)} AS list, {domain} AS domain, {path} AS path, CASE WHEN id % 2 = 0 THEN 'add' ELSE 'remove' END AS action, {day(f'CAST({key} * 31 % 120 + id % 4 * 75 AS INTEGER)')} AS at FROM ids"


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Dated entries from a table at rest: Parquet, or CSV with a header if the path ends so. Columns list, domain, path,
    action (add or remove) and at."""
    return spark.read.csv(path, header=True) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, path, since, until): an "add" holds from its date until the entry that follows it for the same list,
    domain and path, or for good; a "remove" only ends what it follows. Entries of one date: the "remove" comes last.
    Rows that lack a list, domain, date or action are no entries; a null path is an empty one."""
    e = entries.select(F.col("list").cast("string"), F.lower(F.trim(F.col("domain").cast("string"))).alias("domain"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("action").cast("string"), F.col("at").cast("timestamp").alias("since"))
    e = e.where(F.col("list").isNotNull() & F.col("domain").isNotNull() & F.col("since").isNotNull() & F.col("action").isin("add", "remove"))
    until = F.lead("since").over(Window.partitionBy("list", "domain", "path").orderBy("since", "action"))
    return e.withColumn("until", until).where((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("since")))).drop("action")


def host_of(url):
    """The lower-case host of a URL, without user, port and a last dot; null where there is none."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    return F.when(host != "", host)


def path_of(url):
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)", 1)


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Adds host, n_active, blocked and lists to every row of `captures`.

    An entry matches a capture if it names the capture's host or a domain above it, its path is a prefix of the URL's, and
    it was active when the capture was fetched. n_active counts such entries, lists joins their lists' names in order (null
    without any). Rows whose URL or time is null or has no host stay, unblocked; repeated rows stay repeated; an empty table
    or list is no special case. Columns of these names are replaced, others may have any name.

    Distinct hosts, which a hot host enters once, meet the list by equality on each of their domains, and the few with
    entries go back to the captures. Hosts of many captures, and domains of many hosts, meet their entries by broadcast and
    aren't shuffled. Entries of one host are held in one row.
    """
    held = [c for c in captures.columns if c not in {"host", "n_active", "blocked", "lists"}]
    url = F.col(f"`{url_col}`").cast("string")
    rows = captures.select(F.struct(*common.columns(captures)).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(f"`{time_col}`").cast("timestamp").alias("at"))
    parts = F.split("host", r"\.")
    hosts = rows.where(F.col("host").isNotNull()).select("host").distinct()
    named = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("domain"))
    by_domain = intervals(entries).groupBy("domain").agg(F.collect_list(F.struct("list", "path", "since", "until")).alias("rules"))
    rules = common.spread_join(named, by_domain, "domain").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    rules = common.written(rules, "op7-rules")
    path, at = F.col("path"), F.col("at")
    active = F.filter("rules", lambda r: path.startswith(r["path"]) & (r["since"] <= at) & (r["until"].isNull() | (at < r["until"])))
    out = common.spread_join(rows, rules, "host", "left").withColumn("on", active)
    n = F.when(F.col("on").isNull(), F.lit(0)).otherwise(F.size("on")).cast("long")
    lists = F.array_join(F.array_sort(F.array_distinct(F.transform("on", lambda r: r["list"]))), ",")
    return out.select(*[F.col("row")[c].alias(c) for c in held], "host", n.alias("n_active"), (n > 0).alias("blocked"), F.when(n > 0, lists).alias("lists"))


def query_list(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in ENTRIES)
    rule = generated(lambda values, i: f"element_at(array({', '.join(map(repr, values))}), {i} + 1)", lambda n: f"date_add(DATE '{FIRST_DAY}', {n})")
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(list, domain, path, action, at) UNION ALL (WITH ids AS (SELECT id FROM range({GENERATED})) {rule})")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no time; each is taken as fetched on a day of 2024 that its id tells."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    return evaluate(pages, query_list(spark)).select("page_id", "host", "fetched", "n_active", "blocked", "lists")


SQL = (
    f"WITH ids AS (SELECT range AS id FROM range({GENERATED})), e(list, domain, path, action, since) AS (SELECT c1, c2, c3, c4, CAST(c5 AS DATE) FROM (VALUES {', '.join(map(str, ENTRIES))}) AS t(c1, c2, c3, c4, c5) UNION ALL "
    + generated(lambda values, i: f"{values}[{i} + 1]", lambda n: f"(DATE '{FIRST_DAY}' + {n})")
    + r"""),
i AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, domain, path ORDER BY since, action) AS until FROM e) WHERE action = 'add'),
p AS (SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '') AS host,
        regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)', 1) AS path, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched FROM pages)
SELECT p.page_id, p.host, p.fetched, count(i.list) AS n_active, count(i.list) > 0 AS blocked, string_agg(DISTINCT i.list, ',' ORDER BY i.list) AS lists
FROM p LEFT JOIN i ON (p.host = i.domain OR ends_with(p.host, '.' || i.domain)) AND starts_with(p.path, i.path) AND i.since <= p.fetched AND (i.until IS NULL OR p.fetched < i.until)
GROUP BY ALL
"""
)
