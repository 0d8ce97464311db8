"""Not-modified revisits of WARC captures resolved to the responses they stand for.

A revisit record says that a resource had not changed. It is joined, as of its time, to the latest
earlier full response with the same canonical URL; the validators that it names must be those of that
response; and of its headers those that a 304 answer may update are merged into the stored ones.

The as-of join is a running last value. So that one URL with a large share of all captures stays spread
out, time is cut into slabs: the last response of each URL and slab is a grouped maximum, the last before a slab is a
running maximum over the slabs of a URL, and only within one slab are captures put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import query, table

SLAB = 3600

# Headers of a 304 answer that do not replace stored ones (RFC 9111 3.2, hop-by-hop fields
# of RFC 9110 7.6.1, and what describes a body that was not sent).
KEPT_BACK = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade",
)

# Query parameters that name where a visitor came from, not what is shown.
TRACKING = "utm_[a-z]+|fbclid|gclid|ref"


def canonical_url(url: Column) -> Column:
    """Host in lower case without `www.`, path without a last slash, query without tracking parameters,
    no scheme, default port or fragment. Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    search = F.concat(F.lit("&"), F.regexp_extract(bare, "\\?(.*)$", 1))
    search = F.regexp_replace(F.regexp_replace(search, f"&({TRACKING})=[^&]*", ""), "^&+|&+$", "")
    return F.concat(host, path, F.when(search != "", F.concat(F.lit("?"), search)).otherwise(""))


def weak(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(captures: DataFrame, slab: int = SLAB) -> DataFrame:
    """`record_id, url_key, captured, outcome, target_id, headers`, one row per revisit.

    `captures` has record_id, kind ('response' or 'revisit'), url, captured (timestamp), digest and
    headers (map, names in any case). Other kinds are ignored. Outcomes: `resolved`; `mismatch` where a validator
    differs (entity tag if both have one, else last-modified, else payload digest); `unverified`
    where no validator is in both; `unresolved` without an earlier response. Merged headers come with
    `resolved` alone. Of responses at one time the largest record_id is the latest; one at the time of
    the revisit is not earlier. Null URLs and times match nothing; null headers are empty ones;
    repeated rows each give a row. An empty table gives an empty result.
    """
    lower = F.transform_keys(
        F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k)
    )
    rows = captures.where("kind in ('response', 'revisit')").select(
        "record_id",
        "kind",
        canonical_url(F.col("url")).alias("url_key"),
        "captured",
        F.unix_micros("captured").alias("at"),
        F.struct("record_id", "digest", lower.alias("headers")).alias("capture"),
    )
    rows = rows.withColumn("slab", F.floor(F.col("at") / F.lit(slab * 1_000_000)))
    known = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    is_response = F.col("kind") == "response"
    place = F.struct("at", "record_id")
    per_slab = rows.where(known & is_response).groupBy("url_key", "slab").agg(
        F.max(place).alias("last_place"), F.max_by("capture", place).alias("last_capture")
    )
    asked = rows.where(known & ~is_response).select("url_key", "slab").distinct()
    slabs = per_slab.join(asked, ["url_key", "slab"], "full")
    before = Window.partitionBy("url_key").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = slabs.select(
        "url_key", "slab", F.last("last_capture", ignorenulls=True).over(before).alias("earlier")
    )
    # A revisit comes before a response of its own time; rows that match nothing are groups of their own.
    order = [F.col("at"), is_response.cast("int"), F.col("record_id")]
    within = Window.partitionBy("url_key", "slab").orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_slab = F.last(F.when(is_response, F.col("capture")), ignorenulls=True).over(within)
    found = rows.where(known).withColumn("same_slab", same_slab).where(~is_response)
    found = found.join(slabs, ["url_key", "slab"], "left")
    found = found.withColumn("target", F.coalesce("same_slab", "earlier")).select(
        "record_id", "url_key", "captured", "capture", "target"
    )
    lost = rows.where(~known & ~is_response).select(
        "record_id", "url_key", "captured", "capture", F.lit(None).cast(found.schema["target"].dataType).alias("target")
    )
    return found.unionByName(lost).select(
        "record_id", "url_key", "captured", *_judged(F.col("capture"), F.col("target"))
    )


def _judged(revisit: Column, target: Column) -> list[Column]:
    new, old = revisit["headers"], target["headers"]

    def compared(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), a == b)

    agree = F.coalesce(
        compared(weak(new["etag"]), weak(old["etag"])),
        compared(new["last-modified"], old["last-modified"]),
        compared(revisit["digest"], target["digest"]),
    )
    outcome = (
        F.when(target.isNull(), "unresolved").when(agree.isNull(), "unverified").when(agree, "resolved")
    ).otherwise("mismatch")
    allowed = F.map_filter(new, lambda k, _: ~k.isin(*KEPT_BACK))
    stored = F.map_filter(old, lambda k, _: ~F.map_contains_key(allowed, k))
    merged = F.when(outcome == "resolved", F.map_concat(stored, allowed))
    return [outcome.alias("outcome"), target["record_id"].alias("target_id"), merged.alias("headers")]


def captures(pages: DataFrame) -> DataFrame:
    """Captures of a crawl over `pages(page_id, url, html)`: a response per page, and three revisits.

    The page's id and the digest of its html decide times and validators. The first revisit
    names the right entity tag, the second a right one for two pages in three, the third only a date; each comes
    days later, some before the response of another page with the same canonical URL.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    page = F.coalesce(F.col("page_id"), F.lit(-1)).cast("long")
    number = F.explode(F.sequence(F.lit(0), F.lit(3)))
    facts = pages.select(page.alias("page"), "url", digest.alias("digest"), F.length("html").alias("n")).select(
        "*", number.alias("visit")
    )
    day = F.pmod(F.col("page") * 7 + F.col("visit") * 11, F.lit(97))
    seconds = F.lit(1_700_000_000) + day * 86400 + F.pmod(F.col("page") * 131 + F.col("visit") * 17, F.lit(86400))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    changed = (F.col("visit") == 2) & (F.pmod("page", F.lit(3)) == 0)
    modified = F.concat(F.lit("day "), F.pmod(F.col("page"), F.lit(29)).cast("string"))
    headers = F.map_filter(
        F.create_map(
            F.lit("Date"), F.concat(F.lit("t"), seconds.cast("string")),
            F.lit("ETag"), F.when(changed, '"changed"').when(F.col("visit") == 1, F.concat(F.lit("W/"), tag)).when(F.col("visit") < 3, tag),
            F.lit("Last-Modified"), F.when((F.col("visit") == 0) | (F.col("visit") == 3), modified),
            F.lit("Content-Type"), F.when(F.col("visit") == 0, "text/html").when(F.col("visit") == 1, "text/plain"),
            F.lit("Content-Length"), F.when(F.col("visit") == 0, F.col("n").cast("string")).otherwise("0"),
            F.lit("Cache-Control"), F.when(F.col("visit") > 0, F.concat(F.lit("max-age="), (F.col("visit") * 60).cast("string"))),
        ),
        lambda _, v: v.isNotNull(),
    )
    return facts.select(
        (F.col("page") * 4 + F.col("visit")).alias("record_id"),
        F.when(F.col("visit") == 0, "response").otherwise("revisit").alias("kind"),
        "url",
        F.timestamp_seconds(seconds).alias("captured"),
        F.when(F.col("visit") == 0, F.col("digest")).alias("digest"),
        headers.alias("headers"),
    )


_KEY = f"""regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^www\\.|:(80|443)$', '', 'g')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
  || case when search <> '' then '?' || search else '' end"""

ORACLE = f"""
with bare as (
  select coalesce(page_id, -1) page, md5(coalesce(html, '')) digest, length(html) n,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') bare from pages),
keyed as (
  select *, regexp_replace(regexp_replace('&' || regexp_extract(bare, '\\?(.*)$', 1), '&({TRACKING})=[^&]*', '', 'g'),
    '^&+|&+$', '', 'g') search from bare),
visits as (
  select page, digest, n, {_KEY} url_key, visit, 1700000000 + ((page * 7 + visit * 11) % 97) * 86400
    + (page * 131 + visit * 17) % 86400 ts from keyed, (select unnest([0, 1, 2, 3]) visit)),
response as (select page * 4 record_id, * from visits where visit = 0),
latest as (
  select url_key, ts, max_by(struct_pack(record_id, digest, n, page), record_id) r from response group by url_key, ts),
joined as (
  select v.page * 4 + v.visit record_id, v.url_key, v.ts, v.visit, v.page, v.digest, l.r
  from visits v asof left join latest l on v.url_key = l.url_key and v.ts > l.ts where v.visit > 0),
judged as (
  select *, case when r is null then 'unresolved'
    when visit = 3 then case when page % 29 = r.page % 29 then 'resolved' else 'mismatch' end
    when visit = 2 and page % 3 = 0 then 'mismatch'
    when left(digest, 16) = left(r.digest, 16) then 'resolved' else 'mismatch' end outcome from joined)
select record_id, url_key, ts captured, outcome, r.record_id target_id, case when outcome = 'resolved' then
  'cache-control: max-age=' || visit * 60 || chr(10) || 'content-length: ' || r.n || chr(10)
  || 'content-type: text/html' || chr(10) || 'date: t' || ts || chr(10)
  || 'etag: ' || case visit when 1 then 'W/' else '' end || '"' || left(r.digest, 16) || '"' || chr(10)
  || 'last-modified: day ' || r.page % 29 end headers from judged
"""


@query("op8_revisit_resolution", ORACLE)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve(captures(table(spark, folder, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(
        "record_id",
        "url_key",
        F.unix_seconds("captured").alias("captured"),
        "outcome",
        "target_id",
        F.array_join(lines, "\n").alias("headers"),
    )
