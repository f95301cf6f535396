"""Web captures that the server answered with "not modified".

A revisit record holds no body; it stands for the latest earlier full response
of the same canonical URL. The as-of join is cut by range of (URL, time), so a
URL with very many captures is spread over tasks, and each range takes over
the last full response before it. Only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Headers that a 304 response does not update (they describe
#: the body or the connection).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
              "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")
#: Parameters that do not select another resource.
TRACKING = "^(utm_[a-z]+|gclid|fbclid)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www`` and default port, path without
    trailing slashes, parameters sorted and without tracking; no scheme or
    fragment. An address without a host stays as it is."""
    rest = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_extract(rest, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)", 1)
    short = F.regexp_replace(F.regexp_replace(F.lower(host), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    parameters = F.filter(F.array_sort(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&")), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.when(host == "", rest).otherwise(F.concat(short, path, F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records(record_id, url, ts, status, headers, digest, ...)``, headers a
    map of lower-case names, -> one row per revisit (status 304): ``record_id,
    canonical_url, ts, refers_to, outcome, status, digest, headers``.

    The response is the latest one before the revisit, with a status other
    than 304; responses of the same moment are not earlier, and of several the
    one with the largest record_id counts. ``outcome``: ``resolved`` if the
    revisit's etag (compared weakly), or without one its last-modified, is the
    response's or it has neither; ``validator_mismatch`` with no status, digest
    or headers otherwise; ``no_response`` without any. Headers are the
    response's, updated by the revisit's but for those that describe body or
    connection. Null urls and times meet no response; null headers are empty;
    repeated rows are resolved each; an empty table gives none. Bodies are not
    read, ``digest`` names them."""
    spark = records.sparkSession
    empty = F.expr("cast(map() as map<string,string>)")
    own = records.select("record_id", canonical_url(F.col("url")).alias("key"), "ts", "status", F.coalesce("headers", empty).alias("headers"), "digest")
    full = F.coalesce(F.col("status"), F.lit(0)) != 304
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(own.where("key is not null and ts is not null").withColumn("full", full)
                     .repartitionByRange(n, "key", "ts", "full", "record_id").withColumn("range", F.spark_partition_id()))
    order = ("ts", "full", "record_id")
    response = F.struct("record_id", "ts", "status", "headers", "digest")
    within = Window.partitionBy("range", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last(F.when(F.col("full"), response), ignorenulls=True).over(within)).where("not full")
    ends = placed.where("full").groupBy("key", "range").agg(F.max_by(response, F.struct(*order)).alias("last"))
    spans = placed.select("key", "range").distinct().join(ends, ["key", "range"], "left")
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = durable(spans.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried is not null").select("key", "range", "carried"))
    met = near.join(carried, ["key", "range"], "left").withColumn("found", F.coalesce("near", "carried"))
    lost = own.where((F.col("key").isNull() | F.col("ts").isNull()) & ~full).select("record_id", "key", "ts", "headers", F.lit(None).cast(met.schema["found"].dataType).alias("found"))
    met = met.select("record_id", "key", "ts", "headers", "found").union(lost)
    etag, since = F.col("headers")["etag"], F.col("headers")["last-modified"]
    valid = (F.when(etag.isNotNull(), _weak(etag).eqNullSafe(_weak(F.col("found.headers")["etag"])))
             .when(since.isNotNull(), since.eqNullSafe(F.col("found.headers")["last-modified"])).otherwise(True))
    outcome = F.when(F.col("found").isNull(), "no_response").when(valid, "resolved").otherwise("validator_mismatch")
    update = F.map_filter("headers", lambda k, _: ~k.isin(*NOT_MERGED))
    merged = F.map_concat(F.map_filter("found.headers", lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    met = met.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    return met.select("record_id", F.col("key").alias("canonical_url"), "ts", F.col("found.record_id").alias("refers_to"), "outcome",
                      F.when(done, F.col("found.status")).alias("status"), F.when(done, F.col("found.digest")).alias("digest"), F.when(done, merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records from ``pages(page_id, url, html)``: each page fetched
    once in full, then asked for again twice. The second time its url is
    written another way; every seventh of the later requests got another etag
    in between, every fifth sends only the date."""
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))
    page = pages.select("page_id", "url", etag.alias("etag"), day.alias("day"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))

    def record(k: int, url: Column, ts: Column, status: int, **headers: Column) -> DataFrame:
        pairs = [x for name, value in headers.items() for x in (F.lit(name.replace("_", "-")), value)]
        return page.select((F.col("page_id") * 3 + k).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(status).alias("status"),
                           F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("headers"), F.when(F.lit(k == 0), F.col("etag")).alias("digest"))

    id_ = F.col("page_id")
    changed = F.when(id_ % 5 == 0, F.lit(None)).when(id_ % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), F.col("etag")))
    return (record(0, F.col("url"), id_ * 10, 200, etag=F.col("etag"), last_modified=F.col("day"), content_length=F.col("size"), content_type=F.lit("text/html"), cache_control=F.lit("max-age=60"))
            .union(record(1, F.col("url"), id_ * 10 + 5, 304, etag=F.col("etag"), content_length=F.lit("0"), cache_control=F.lit("max-age=600")))
            .union(record(2, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")), id_ * 10 + 5_000_000, 304, etag=changed, last_modified=F.col("day"), content_length=F.lit("0"), x_cache=F.lit("hit"))))


_KEY = f"""
  case when host = '' then rest else
    regexp_replace(regexp_replace(lower(host), ':(80|443)$', ''), '^www[0-9]*[.]', '')
    || regexp_replace(regexp_extract(rest, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '')
    || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end"""

#: The result of the query over :func:`captures`, in DuckDB SQL.
SQL = f"""
with p as (select page_id, url, '"' || md5(coalesce(html, '')) || '"' as etag, 'day ' || (page_id % 1000) as day, strlen(coalesce(html, ''))::varchar as size from pages),
c as (
  select page_id * 3 as record_id, url, page_id * 10 as ts, 200 as status, etag, day as since, size, 'max-age=60' as cache, null as x, etag as digest from p
  union all select page_id * 3 + 1, url, page_id * 10 + 5, 304, etag, null, '0', 'max-age=600', null, null from p
  union all select page_id * 3 + 2, regexp_replace(url, '#.*$', '') || '#again', page_id * 10 + 5000000, 304,
    case when page_id % 5 = 0 then null when page_id % 7 = 0 then '"changed"' else 'W/' || etag end, day, '0', null, 'hit', null from p),
u as (
  select *, regexp_extract(rest, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)', 1) as host,
    list_filter(list_sort(string_split(regexp_extract(rest, '[?](.*)$', 1), '&')), lambda q: q <> '' and not regexp_matches(q, '{TRACKING}')) as params
  from (select *, regexp_replace(trim(url), '#.*$', '') as rest from c)),
k as (select *, {_KEY} as key from u),
j as (
  select r.*, f.record_id as refers_to, f.status as f_status, f.digest as f_digest, f.etag as f_etag, f.since as f_since, f.size as f_size, f.cache as f_cache,
    row_number() over (partition by r.record_id order by f.ts desc, f.record_id desc) as place
  from (select * from k where status = 304) r left join (select * from k where status <> 304) f on f.key = r.key and f.ts < r.ts),
v as (
  select *, case when refers_to is null then 'no_response'
    when etag is not null then case when regexp_replace(etag, '^W/', '') = regexp_replace(f_etag, '^W/', '') then 'resolved' else 'validator_mismatch' end
    when since is not null then case when since = f_since then 'resolved' else 'validator_mismatch' end
    else 'resolved' end as outcome
  from j where place = 1)
select record_id, key as canonical_url, ts, refers_to, outcome,
  case when outcome = 'resolved' then f_status end as status, case when outcome = 'resolved' then f_digest end as digest,
  case when outcome = 'resolved' then coalesce(etag, f_etag) end as etag, case when outcome = 'resolved' then coalesce(since, f_since) end as last_modified,
  case when outcome = 'resolved' then f_size end as content_length, case when outcome = 'resolved' then coalesce(cache, f_cache) end as cache_control,
  case when outcome = 'resolved' then x end as x_cache
from v
"""
