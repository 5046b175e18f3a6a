"""Source governance, ranking and the flagship slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.catalog import query, table
from siftwork.catalog.scans import _HOST, SECRET, SOURCE_FORM, TRACKING, sql_form
from siftwork.functions import urls
from siftwork.operators import govern, match, provenance, rank
from siftwork.plans.model import SourcePolicy

DENIED = ("spam-farm.example.org",)
#: Hosts and whether they are public, for the checks of names and addresses.
HOSTS = (
    "example.com", "localhost", "redis", "db.internal", "a.local", "metadata.google", "10.0.0.1", "11.0.0.1", "100.64.0.1", "100.128.0.1", "127.0.0.1", "169.254.169.254", "172.15.0.1", "172.16.9.9", "172.32.0.1", "192.0.0.8", "192.0.2.1", "192.88.99.1", "192.168.1.1",
    "198.17.0.1", "198.19.0.1", "198.51.100.7", "203.0.113.9", "223.255.255.1", "224.0.0.1", "240.0.0.1", "8.8.8.8", "256.1.1.1", "[::1]", "[::ffff:10.0.0.1]", "[::ffff:8.8.8.8]", "[fd00:ec2::254]", "[fe80::1]", "[2001:db8::1]", "[2606:4700::1]", "[2002::1]", "", "shop.home", "x.corp",
)
PUBLIC = ("example.com", "11.0.0.1", "100.128.0.1", "172.15.0.1", "172.32.0.1", "198.17.0.1", "223.255.255.1", "8.8.8.8", "[::ffff:8.8.8.8]", "[2606:4700::1]")
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)


@query(f"""WITH c AS (SELECT page_id, {SOURCE_FORM} AS canonical, regexp_replace({_HOST}, '\\.$', '') AS host FROM pages),
d AS (SELECT *, NOT (host IN ({_LIST(DENIED)}) OR {" OR ".join(f"host LIKE '%.{d}'" for d in DENIED)}) AS allowed, min(page_id) OVER (PARTITION BY canonical) AS first FROM c)
SELECT host, count(*) AS pages, count(*) FILTER (WHERE allowed AND page_id = first) AS canonical, count(*) FILTER (WHERE page_id > first) AS duplicates, count(*) FILTER (WHERE NOT allowed) AS blocked FROM d GROUP BY host""")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to canonical URLs, policy decisions and duplicates, counted by host."""
    decided = govern.decide(table(spark, sf_dir, "pages").select("page_id", "url"), SourcePolicy(blocked=DENIED))
    linked = match.first_of_key(decided, F.col("canonical_url"), "page_id")
    return linked.groupBy(F.col("domain").alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("allowed") & F.col("duplicate_of").isNull()).alias("canonical"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"), F.count_if(~F.col("allowed")).alias("blocked"),
    )


@query(f"""SELECT page_id, {SOURCE_FORM} AS canonical_url, sha256({SOURCE_FORM}) AS url_hash, {sql_form(TRACKING, f"regexp_replace({_HOST}, '^www\\.', '')")} AS ranking_url,
regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_HOST} || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS plain
FROM pages""")
def g1_g2_source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    p = urls.parts(u)
    plain = F.concat(p.scheme, F.lit("://"), p.authority, p.path, p.query)
    return table(spark, sf_dir, "pages").select("page_id", urls.source_form(u).alias("canonical_url"), F.sha2(urls.source_form(u), 256).alias("url_hash"), urls.ranking_form(u).alias("ranking_url"), plain.alias("plain"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://xn--bcher-' || 'kva.' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '\\.$', '') || '/' AS canonical_url, page_id % 2 = 0 AS allowed FROM pages""")
def g1_international_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with a label beyond ASCII meet their ASCII form, also in rules."""
    p = urls.parts(F.col("url"))
    raw = F.concat(p.scheme, F.lit("://B\u00dcCHER."), F.when(F.col("page_id") % 2 == 0, p.host).otherwise(F.concat(p.host, F.lit("."))), F.lit("/"))
    pages = table(spark, sf_dir, "pages").select("page_id", raw.alias("url"), p.host.alias("_host"))
    decided = govern.decide(pages.select("page_id", "url"), SourcePolicy(), international=True)
    return decided.select("page_id", "canonical_url", (F.col("allowed") & (F.col("page_id") % 2 == 0)).alias("allowed"))


@query("""SELECT page_id, regexp_replace(split_part(url, '#', 1), '/$', '') AS evidence_url FROM pages""")
def g3_evidence_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.evidence_form(F.col("url")).alias("evidence_url"))


@query("""SELECT page_id, 'https://h.example.com/p?a=' || page_id AS safe_url, '[invalid-source-url]' AS invalid FROM pages""")
def g4_safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("https://user:pw@h.example.com/p?token=secret&a="), F.col("page_id").cast("string"), F.lit("&auth=1#frag"))
    return table(spark, sf_dir, "pages").select("page_id", urls.safe_form(raw).alias("safe_url"), urls.safe_form(F.lit("no url")).alias("invalid"))


@query(f"""WITH c AS (SELECT page_id, {_HOST} AS host, page_id % 6 AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'INVALID_URL' WHEN 1 THEN 'UNSUPPORTED_SCHEME' WHEN 2 THEN 'URL_CREDENTIALS_BLOCKED' WHEN 3 THEN 'NON_PUBLIC_HOST_BLOCKED'
ELSE CASE WHEN host = '{DENIED[0]}' OR host LIKE '%.{DENIED[0]}' THEN 'DOMAIN_DENYLISTED' WHEN NOT (host = 'example.com' OR host LIKE '%.example.com') THEN 'DOMAIN_NOT_ALLOWLISTED' END END AS code FROM c""")
def g5_p14_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("page_id") % 6, F.col("url")
    raw = F.when(k == 0, "not a url").when(k == 1, "ftp://a.example.com/").when(k == 2, "https://me:pw@a.example.com/").when(k == 3, "http://192.168.0.1/x").otherwise(u)
    pages = table(spark, sf_dir, "pages").select("page_id", raw.alias("url"))
    return govern.decide(pages, SourcePolicy(allowed=("*.example.com",), blocked=DENIED)).select("page_id", "code")


@query(f"""SELECT host, host IN ({_LIST(PUBLIC)}) AS is_public FROM (VALUES {", ".join(f"('{h}')" for h in HOSTS)}) t(host)""")
def p15_p16_p17_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    return hosts.select("host", (~urls.non_public_host(F.col("host"))).alias("is_public"))


@query("""SELECT s_suppkey, s_suppkey % 3 = 0 AS safe FROM supplier""")
def p18_resolved_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    addresses = F.when(k == 0, F.array(F.lit("8.8.8.8"), F.lit("2606:4700::1"))).when(k == 1, F.array(F.lit("8.8.8.8"), F.lit("10.1.1.1"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", govern.safe_addresses(addresses).alias("safe"))


ROBOTS = "# rules\nUser-agent: *\nDisallow: /private\nAllow: /private/public\nCrawl-delay: 2\n\nUser-agent: OtherBot\nDisallow: /\n"


@query("""WITH r AS (SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN '/private/item' WHEN 1 THEN '/private/public/x' WHEN 2 THEN '/a.pdf?x=1' ELSE '/open' END AS target FROM pages)
SELECT id, target NOT IN ('/private/item', '/a.pdf?x=1') AS allowed, CASE WHEN target IN ('/private/item', '/a.pdf?x=1') THEN 'DISALLOWED' ELSE 'ALLOWED' END AS robots_status, CAST(2000 AS BIGINT) AS delay_ms FROM r""")
def g6_g7_g8_w6_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("https://r.example.com", ROBOTS.replace("Crawl-delay", "Disallow: /*.pdf$\nDisallow: /*.pdf?\nCrawl-delay"))], "origin string, body string")
    k = F.col("page_id") % 4
    target = F.when(k == 0, "/private/item").when(k == 1, "/private/public/x").when(k == 2, "/a.pdf?x=1").otherwise("/open")
    requests = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("https://r.example.com"), target).alias("url"))
    return govern.robots_decisions(requests, govern.robots_rules(files)).select("id", "allowed", "robots_status", "delay_ms")


@query(f"""WITH p AS (SELECT page_id AS id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS target FROM pages),
o AS (SELECT DISTINCT lower(origin) AS origin FROM p), r AS (SELECT origin, length(o.origin) % 2 = 0 AS allow, substr(target, 1, k) AS path FROM o, (SELECT DISTINCT substr(target, 1, 4) AS target FROM p), (VALUES (3), (4)) v(k)
UNION ALL SELECT origin, false, '/*?page' FROM o UNION ALL SELECT origin, true, '/en/' FROM o),
h AS (SELECT p.id, arg_max(allow, length(replace(path, '*', '')) * 2 + CASE WHEN allow THEN 1 ELSE 0 END) AS verdict FROM p JOIN r ON lower(p.origin) = r.origin AND CASE WHEN path LIKE '%*%' THEN contains(substr(target, 2), '?page') ELSE starts_with(target, path) END GROUP BY p.id)
SELECT p.id, coalesce(verdict, true) AS allowed FROM p LEFT JOIN h ON p.id = h.id""")
def g8_w6_page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' own paths under rules made of the paths that occur, on every origin, and a wildcard."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    asked = urls.with_parts(F.col("url"), lambda p: F.struct(F.concat(p.scheme, F.lit("://"), p.authority).alias("origin"), F.concat(p.path, p.query).alias("target")))
    seen = pages.select(asked.alias("a"))
    origins, heads = seen.select("a.origin").distinct(), seen.select(F.substring("a.target", 1, 4).alias("head")).distinct()
    paths = heads.select(F.explode(F.array(F.substring("head", 1, 3), "head")).alias("path")).distinct()
    listed = paths.agg(F.collect_list("path").alias("paths"))  # one robots file for all origins
    both = origins.join(F.broadcast(listed)).select("origin", F.explode("paths").alias("path")).select("origin", (F.length("origin") % 2 == 0).alias("allow"), "path")
    more = origins.select("origin", F.explode(F.array(F.struct(F.lit(False).alias("allow"), F.lit("/*?page").alias("path")), F.struct(F.lit(True).alias("allow"), F.lit("/en/").alias("path")))).alias("r")).select("origin", "r.*")
    rules = both.unionByName(more).withColumn("delay_ms", F.lit(None).cast("long"))
    return govern.robots_decisions(pages, rules).select("id", "allowed")


@query("""SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'DISALLOWED' ELSE 'UNAVAILABLE' END AS robots_status, page_id % 4 = 0 AS allowed FROM pages""")
def g9_robots_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = [(f"https://r{k}.example.com", s) for k, s in enumerate((404, 503, 200))]
    files = spark.createDataFrame([(o, "User-agent: siftworkbot\nDisallow: /x") for o, _ in origins], "origin string, body string")
    requests = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("https://r"), (F.col("page_id") % 4).cast("string"), F.lit(".example.com/x")).alias("url"))
    responses = spark.createDataFrame(origins, "origin string, status int")
    return govern.robots_decisions(requests, govern.robots_rules(files), responses).select("id", "robots_status", "allowed")


@query("""WITH RECURSIVE e AS (SELECT event_type AS key, event_id AS id, epoch_us(ts) // 1000 AS "at", row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT key, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS "at", CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS wait, CAST([] AS BIGINT[]) AS times FROM e UNION ALL
SELECT key, id, "at", n, wait, CASE WHEN wait = 0 THEN list_append(kept, "at") ELSE kept END FROM (SELECT *, CAST(greatest(0, CASE WHEN len(kept) >= 3 THEN kept[1] + 3600000 - "at" ELSE 0 END, CASE WHEN len(kept) > 0 THEN kept[-1] + 60000 - "at" ELSE 0 END) AS BIGINT) AS wait
FROM (SELECT e.key, e.id, e."at", e.n, list_filter(r.times, lambda t: t > e."at" - 3600000) AS kept FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)))
SELECT key, id, "at", wait = 0 AS allowed, wait AS retry_after_ms, greatest(0, 3 - len(times)) AS remaining FROM r WHERE n > 0""")
def g10_g11_sliding_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each kind, three an hour at most: what is let through depends on what was let through before."""
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return govern.limit_calls(calls, 3, 3_600_000, 60_000)


@query("""WITH RECURSIVE e AS (SELECT page_id % 3 AS key, page_id AS id, page_id * 7000 AS "at", row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id) AS n FROM pages),
r AS (SELECT DISTINCT key, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS n, true AS ok, CAST([] AS BIGINT[]) AS times FROM e UNION ALL
SELECT key, id, n, len(kept) < 2, CASE WHEN len(kept) < 2 THEN list_append(kept, "at") ELSE kept END FROM (SELECT e.key, e.id, e."at", e.n, list_filter(r.times, lambda t: e."at" - t < 60000) AS kept FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
SELECT id, CASE WHEN ok THEN NULL ELSE 'SOURCE_RATE_LIMITED' END AS error FROM r WHERE n > 0""")
def r8_host_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback by host: so many calls within the last minute, without an interval."""
    calls = table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("key"), F.col("page_id").alias("id"), (F.col("page_id") * 7000).alias("at"))
    return govern.limit_calls(calls, 2).select("id", F.when(~F.col("allowed"), "SOURCE_RATE_LIMITED").alias("error"))


@query("""SELECT event_id, CAST(least(60000, 1000 * power(2, event_id % 8)) AS DOUBLE) AS delay_ms, greatest(CAST(least(60000, 1000 * power(2, event_id % 8)) AS DOUBLE), CAST(5000 AS DOUBLE)) AS asked_ms FROM events""")
def g12_retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.col("event_id") % 8 + 1
    return table(spark, sf_dir, "events").select("event_id", govern.retry_delay(attempt, 1000, 2.0, 60_000).alias("delay_ms"), govern.retry_delay(attempt, 1000, 2.0, 60_000, F.lit(5000)).alias("asked_ms"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'RATE_LIMIT' WHEN 1 THEN 'SERVER_ERROR' WHEN 2 THEN 'TIMEOUT' WHEN 3 THEN 'TRANSIENT_NETWORK' END AS kind, event_id % 5 IN (0, 1) AS again FROM events""")
def g13_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    status = F.when(k == 0, 429).when(k == 1, 503)
    message = F.when(k == 2, "Request timed out").when(k == 3, "socket hang up").otherwise("no")
    kind = govern.error_class(status, message)
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), govern.should_retry(kind, F.lit(1), 3, ("RATE_LIMIT", "SERVER_ERROR")).alias("again"))


@query("""SELECT doc_id, 'key [REDACTED] in ' || substr(text, 1, 482) AS message FROM documents""")
def g14_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("key fc-abcdefghijkl0123 in "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", govern.safe_message(raw).alias("message")).withColumn("message", F.substring("message", 1, 500))


@query("""SELECT CAST(user_id AS VARCHAR) AS run, event_type AS url_hash, CASE WHEN max(event_id) % 2 = 0 THEN 'COLLECTED' ELSE 'PROCESSING' END AS status, count(*) FILTER (WHERE event_id % 2 = 1) AS attempts FROM events GROUP BY user_id, event_type""")
def g15_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 2 == 0, "COLLECTED").otherwise("PROCESSING")
    changes = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("url_hash"), F.col("event_id").alias("seq"), status.alias("status"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("reason"))
    return govern.lifecycle(changes).select("run", "url_hash", "status", "attempts")


@query(f"""WITH RECURSIVE p AS (SELECT page_id AS id, url, regexp_replace({_HOST}, '\\.$', '') AS domain, {SOURCE_FORM} AS canonical, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin FROM pages),
q AS (SELECT id, url, domain, domain IN ({_LIST(DENIED)}) OR {" OR ".join(f"domain LIKE '%.{d}'" for d in DENIED)} AS denied,
regexp_extract(canonical, '^([a-z]+://[^/?#]+)', 1) IN (SELECT origin FROM p) AND regexp_matches(regexp_replace(canonical, '^[a-z]+://[^/?#]+', ''), '^/.*\\.html') AS forbidden FROM p),
e AS (SELECT domain AS key, id, id * 1000 AS "at", row_number() OVER (PARTITION BY domain ORDER BY id) AS n FROM q WHERE NOT denied AND NOT forbidden),
r AS (SELECT DISTINCT key, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS n, true AS ok, CAST([] AS BIGINT[]) AS times FROM e UNION ALL
SELECT key, id, n, len(kept) < 5, CASE WHEN len(kept) < 5 THEN list_append(kept, "at") ELSE kept END FROM (SELECT e.key, e.id, e."at", e.n, list_filter(r.times, lambda t: e."at" - t < 60000) AS kept FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
SELECT q.id, url, domain, CASE WHEN denied OR forbidden THEN 'BLOCKED' WHEN ok THEN 'QUEUED' ELSE 'SKIPPED' END AS status, CASE WHEN denied THEN 'DOMAIN_DENYLISTED' WHEN forbidden THEN 'ROBOTS_DISALLOW' WHEN NOT ok THEN 'RATE_LIMIT' END AS code FROM q LEFT JOIN r ON r.id = q.id""")
def g16_governed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", (F.col("page_id") * 1000).alias("at"))
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    files = pages.select(origin.alias("origin")).distinct().withColumn("body", F.lit("User-agent: *\nDisallow: /*.html"))
    return govern.governed(pages, SourcePolicy(blocked=DENIED, per_minute=5), govern.robots_rules(files))


@query(f"""SELECT page_id, len(list_distinct(list_filter(['https://a.example.com/', 'http://10.0.0.1/', url, 'https://a.example.com/', 'https://{DENIED[0]}/'], lambda u: NOT (u LIKE 'http://10.%' OR regexp_matches(u, '^[a-z]+://([^/?#]*\\.)?spam-farm\\.example\\.org')) ))) AS n_seeds FROM pages""")
def r6_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = govern.seeds(F.array(F.lit("https://a.example.com/"), F.lit("http://10.0.0.1/")), F.array(F.col("url"), F.lit("https://a.example.com/"), F.lit(f"https://{DENIED[0]}/")), SourcePolicy(blocked=DENIED), 10)
    return table(spark, sf_dir, "pages").select("page_id", F.size(made).cast("long").alias("n_seeds"))


QUERIES = ["The list of and thnd", "data for heed the"]
TERMS = ("thnd", "heed")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), "url", title.alias("title"), F.regexp_replace(F.regexp_extract("html", "<article>(.{0,400})", 1), "<[^>]*>", " ").alias("snippet"))


_WORDS = "string_split(trim(regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_SNIPPET = "regexp_replace(regexp_extract(html, '<article>(.{0,400})', 1), '<[^>]*>', ' ', 'g')"
_COVER = "(" + " + ".join(f"CASE WHEN list_contains({{0}}, '{t}') THEN 1 ELSE 0 END" for t in TERMS) + f") / {len(TERMS)}.0"
_BARE = f"regexp_replace({_HOST}, '^www\\.', '')"
_SCORED = f"""t AS (SELECT page_id AS idx, url, {_BARE} AS domain, {sql_form(TRACKING, _BARE)} AS canonical, {_WORDS.format(_TITLE)} AS tw, {_WORDS.format(_SNIPPET)} AS sw, {_WORDS.format('url')} AS uw,
trim(regexp_replace(lower(strip_accents({_TITLE})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS tt FROM pages),
s AS (SELECT idx, domain, canonical, CAST(round(least(1.0, 0.55 * {_COVER.format('tw')} + 0.3 * {_COVER.format('sw')} + 0.15 * {_COVER.format('uw')} + CASE WHEN contains(tt, '{" ".join(TERMS)}') THEN 0.25 ELSE 0 END + CASE WHEN domain = 'example.com' OR domain LIKE '%.example.com' THEN 0.15 ELSE 0 END) * 1000000) AS BIGINT) AS points FROM t),
b AS (SELECT * FROM s WHERE points >= 120000 QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY points DESC, idx) = 1)"""


@query(f"WITH {_SCORED} SELECT idx, canonical, domain, points FROM b")
def w1_w2_w3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.best_by_url(_candidates(spark, sf_dir), rank.query_terms(QUERIES), ["example.com"])


@query(f"""WITH {_SCORED}, a AS (SELECT *, points - 80000 * (row_number() OVER (PARTITION BY domain ORDER BY points DESC, idx) - 1) AS adjusted FROM b)
SELECT idx, canonical, domain, points, adjusted FROM a ORDER BY adjusted DESC, points DESC, idx LIMIT 10""")
def w4_r7_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(_candidates(spark, sf_dir), QUERIES, 10, ["example.com"])


@query(f"""SELECT page_id AS idx, {_BARE} AS domain FROM pages ORDER BY page_id LIMIT 7""")
def w5_no_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(_candidates(spark, sf_dir), ["the of"], 7).select("idx", "domain")


@query("""WITH b AS (SELECT item_id, lower(trim(text)) AS v, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda w: length(w) >= 3) AS w FROM benchmark
UNION ALL SELECT -1 - c_custkey, lower(c_mktsegment || ' ' || substr(CAST(c_custkey AS VARCHAR), 1, 2)), [lower(c_mktsegment)] FROM customer UNION ALL SELECT 1000000 + n_nationkey, lower(substr(n_name, 1, 2)), [] FROM nation),
d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE trim(text) <> '')
SELECT doc_id, item_id FROM d JOIN b ON (length(v) >= 2 AND contains(t, v)) OR (len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(t, x))) = 0)""")
def e1_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that verify a value: a benchmark passage, a market segment with a number, two letters of a nation; as a whole or by all words of three characters or more."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("vid"), F.col("text").alias("value"))
    segments = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).cast("long").alias("vid"), F.concat("c_mktsegment", F.lit(" "), F.substring(F.col("c_custkey").cast("string"), 1, 2)).alias("value"))
    nations = table(spark, sf_dir, "nation").select((F.lit(1_000_000) + F.col("n_nationkey")).cast("long").alias("vid"), F.substring("n_name", 1, 2).alias("value"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), F.col("text").alias("snippet"))
    return provenance.verified_pairs(d, passages.unionByName(segments).unionByName(nations)).select(F.col("sid").alias("doc_id"), F.col("vid").alias("item_id"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order is evidence from a supplier for one of three fields, some without a field."""
    li = table(spark, sf_dir, "lineitem")
    field = F.when(F.col("l_linenumber") % 4 == 1, "price").when(F.col("l_linenumber") % 4 == 2, "flag").when(F.col("l_linenumber") % 4 == 3, "status")
    return li.select(F.col("l_orderkey").alias("rec_idx"), F.col("l_suppkey").alias("source_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), field.alias("field"), F.concat_ws(" ", F.col("l_returnflag"), F.col("l_linestatus"), F.lit("flag is"), F.col("l_returnflag")).alias("snippet"))


_EVIDENCE = """e AS (SELECT l_orderkey AS rec_idx, l_suppkey AS source_id, l_orderkey * 10 + l_linenumber AS evidence_id, CASE l_linenumber % 4 WHEN 1 THEN 'price' WHEN 2 THEN 'flag' WHEN 3 THEN 'status' END AS field,
l_returnflag || ' ' || l_linestatus || ' flag is ' || l_returnflag AS snippet FROM lineitem)"""


@query(f"""WITH {_EVIDENCE}, f AS (SELECT rec_idx, source_id, field, min(evidence_id) AS first FROM e WHERE field IS NOT NULL GROUP BY ALL)
SELECT e.rec_idx, e.source_id, count(*) AS n_evidence, coalesce((SELECT string_agg(field, ',' ORDER BY first) FROM f WHERE f.rec_idx = e.rec_idx AND f.source_id = e.source_id), '') AS fields FROM e GROUP BY e.rec_idx, e.source_id""")
def e2_sources_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.sources_of_rows(_evidence(spark, sf_dir)).withColumn("fields", F.array_join("fields", ","))


_CITED = f"""{_EVIDENCE}, r AS (SELECT o_orderkey AS rec_idx, field, 'flag is r' AS value FROM orders, (VALUES ('price'), ('flag'), ('status')) v(field)),
o AS (SELECT DISTINCT rec_idx, field FROM e WHERE field IS NOT NULL),
c AS (SELECT r.rec_idx, r.field, e.evidence_id, contains(lower(e.snippet), r.value) OR (contains(lower(e.snippet), 'flag')) AS verified
FROM r JOIN e ON r.rec_idx = e.rec_idx LEFT JOIN o ON o.rec_idx = r.rec_idx AND o.field = r.field WHERE o.field IS NULL OR e.field = r.field)"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_idx"), F.explode(F.array(*[F.lit(x) for x in ("price", "flag", "status")])).alias("field"), F.lit("flag is R").alias("value"))


@query(f"WITH {_CITED} SELECT rec_idx, field, evidence_id, verified FROM c")
def e3_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.field_citations(_fields(spark, sf_dir), _evidence(spark, sf_dir))


@query(f"WITH {_CITED} SELECT rec_idx, field, count(*) AS n_sources, bool_or(verified) AS is_verified FROM c GROUP BY rec_idx, field")
def e4_field_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.field_view(provenance.field_citations(_fields(spark, sf_dir), _evidence(spark, sf_dir)))


@query(f"""WITH {_CITED}, s AS (SELECT rec_idx, count(DISTINCT source_id) AS n_sources FROM e GROUP BY rec_idx), f AS (SELECT rec_idx, count(DISTINCT field) AS n_fields, count(*) AS n_citations FROM c GROUP BY rec_idx)
SELECT o_orderkey AS rec_idx, coalesce(n_fields, 0) AS n_fields, coalesce(n_citations, 0) AS n_citations, coalesce(n_sources, 0) AS n_sources FROM orders LEFT JOIN s ON s.rec_idx = o_orderkey LEFT JOIN f ON f.rec_idx = o_orderkey""")
def e5_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_idx"))
    doc = provenance.explorer(rows, provenance.field_citations(_fields(spark, sf_dir), evidence), provenance.sources_of_rows(evidence))
    n = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("long")
    cited = F.coalesce(F.aggregate("fields", F.lit(0), lambda a, x: a + F.size(x["citations"])), F.lit(0)).cast("long")
    return doc.select("rec_idx", n(F.col("fields")).alias("n_fields"), cited.alias("n_citations"), n(F.col("sources")).alias("n_sources"))


@query(f"""SELECT page_id AS rec_idx, CAST(0 AS INT) AS at, page_id AS source_id FROM pages WHERE NOT (page_id % 2 = 1)""")
def e7_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    own = F.concat(F.lit("https://e.example.com/p/"), F.col("page_id").cast("string"))
    records = pages.select(F.col("page_id").alias("rec_idx"), F.array(F.concat(own, F.lit("?utm_source=x#y")), F.lit("https://unknown.example.com/")).alias("source_urls"))
    sources = pages.where("page_id % 2 = 0").select(F.col("page_id").alias("source_id"), F.sha2(own, 256).alias("url_hash"))
    return provenance.attach(records, sources).select("rec_idx", "at", "source_id")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def e8_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return provenance.delete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query("""SELECT o_orderkey AS rec_idx FROM orders WHERE o_orderkey % 2 = 1""")
def e6_insert_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a dataset doesn't hold yet are added with their evidence; rows without evidence are refused."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_idx"))
    rows, _ = provenance.insert(orders.where("rec_idx % 2 = 0"), orders, orders.withColumn("source_id", F.lit(1)))
    return rows
