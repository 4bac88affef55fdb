"""Resolution of not-modified revisits in web archives.

A revisit (a 304 answer, or a record that says the payload has not changed) carries no
payload. It refers to the latest earlier full response of the same canonical URL. The as-of join
looks that up with windows over slices of time: within a slice by the slice's own responses,
else by the last one of the slices before, so a URL that holds much of the archive is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import _common as C

COLUMNS = ("record_id", "kind", "url", "at", "headers")
#: Headers of a not-modified answer that replace those of the stored response; others describe the payload and stay as they were.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column | str) -> Column:
    """Scheme, www., default ports, fragment, tracking parameters and trailing slashes dropped, host in lower case, parameters sorted."""
    url = F.trim(F.col(url) if isinstance(url, str) else url)
    plain = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_replace(plain, r"\?.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, r"^[^/]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"/.*$", 0), r"/+$", "")
    given = F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|fbclid|gclid|sessionid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _slice(rows: DataFrame, slices: int) -> Column:
    bounds = sorted({int(b) for b in rows.select("at").dropna().approxQuantile("at", [k / slices for k in range(1, slices)], 0.5 / slices)}) if slices > 1 else []
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("at"))) if bounds else F.lit(0)


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """record_id, url_key, status, response_id, headers: a row for each revisit.

    records: record_id (long), kind ('response' or 'revisit'; others are ignored), url, at (long, a time), headers (map of
    lower-case names to values); other columns are ignored. status is 'resolved' with the merged headers; 'changed' where etag,
    or without it on both sides last-modified, is on both sides and differs (the response's id is given, headers are null);
    'unvalidated' where no validator is on both sides (merged all the same); or 'missing' without an earlier response. Earlier means a
    smaller ``at``; among responses of one time the largest record_id counts. Revisits without url or time are 'missing', responses without are
    ignored; null headers are empty; repeated revisits give repeated rows; an empty table gives an empty one. slices: parts of the time, as many as shuffle partitions unless given.
    """
    slices = slices or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = C.pick(records, *COLUMNS).filter(F.col("kind").isin("response", "revisit"))
    rows = rows.withColumn("url_key", canonical_url("url")).withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>"))).drop("url")
    known = rows.filter(F.col("url_key").isNotNull() & F.col("at").isNotNull())
    known = known.withColumn("slice", _slice(known, slices))
    response = F.when(F.col("kind") == "response", F.struct("at", "record_id"))
    last = known.groupBy("url_key", "slice").agg(F.max(response).alias("last"))  # a row for each URL and slice
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("url_key", "slice", F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = known.select("record_id", "kind", "url_key", "at", "slice", "headers", F.max(response).over(within).alias("own"))
    wanted = found.filter("kind = 'revisit'").join(carried, ["url_key", "slice"], "left").withColumn("response_id", F.coalesce("own.record_id", "carried.record_id"))
    wanted = C.checkpointed(wanted.select("record_id", "url_key", "response_id", "headers"))
    # a response may have any number of revisits; those without one take no part in the join
    times = wanted.filter("response_id is not null").groupBy("response_id").agg(F.count("*").alias("times"))
    stored = known.filter("kind = 'response'").select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored")).dropDuplicates(["response_id"])
    stored = C.checkpointed(stored.join(times, "response_id"))
    both = C.looked_up(wanted.filter("response_id is not null"), stored, ["response_id"], "times").select("record_id", "url_key", "response_id", "headers", "stored")
    lost = rows.filter((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("at").isNull())).select("record_id", "url_key", F.lit(None).cast("long").alias("response_id"), "headers")
    lost = lost.unionByName(wanted.filter("response_id is null")).withColumn("stored", F.lit(None).cast("map<string,string>"))
    both = both.unionByName(lost)
    tag, old_tag = F.col("headers")["etag"], F.col("stored")["etag"]
    time, old_time = F.col("headers")["last-modified"], F.col("stored")["last-modified"]
    by_tag, by_time = tag.isNotNull() & old_tag.isNotNull(), time.isNotNull() & old_time.isNotNull()
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    status = (
        F.when(F.col("response_id").isNull(), "missing")
        .when(by_tag, F.when(weak(tag) == weak(old_tag), "resolved").otherwise("changed"))
        .when(by_time, F.when(time == old_time, "resolved").otherwise("changed"))
        .otherwise("unvalidated")
    )
    allowed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    return both.withColumn("status", status).select("record_id", "url_key", "status", "response_id", F.when(F.col("status").isin("resolved", "unvalidated"), merged).alias("headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """Records of an archive made from pages: each page as a response at the time of its id, and, later, a revisit by another spelling of its URL.

    The revisit comes 1000 time units after and carries the page's validators, so it resolves unless the URL had another response in between.
    """
    tag, modified = F.concat(F.lit('"'), F.md5(F.col("html")), F.lit('"')), (F.col("page_id") * 60).cast("string")
    response = F.create_map(F.lit("etag"), tag, F.lit("last-modified"), modified, F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("date"), F.col("page_id").cast("string"))
    revisit = F.create_map(F.lit("etag"), tag, F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("page_id") + 1000).cast("string"))
    first = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("at"), response.alias("headers"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), (F.col("page_id") + 1000).alias("at"), revisit.alias("headers"))
    return first.unionByName(again)
