"""Not-modified revisits of a web archive (operator 5).

A revisit record says that a page had not changed since an earlier full response.  Each
one is resolved by an as-of join: by canonical URL, to the latest full response before
it in time.  The validators are checked, the headers that a 304 answer may update are
merged over those of the full response, and the full response's record is named as the payload.

The join works on slim rows (no payloads).  Captures of one URL are cut into slices of at most
``slice_rows`` or so along time; a window runs within a slice, and the last full response of each
slice is carried to the later slices by a second window over one row per slice.  So a URL
may hold any share of the table.

Rules:

* canonical URL: scheme and ``www.`` dropped, host in lower case, default port, fragment and tracking
  parameters dropped, other parameters sorted, a trailing slash and ``.html`` of the path dropped;
* a full response has status 200; of several at one time the one of the largest record id counts; a
  response at the very time of a revisit is not earlier;
* validators: where both records have an ``etag``, the weakly compared tags must be equal; else,
  where both have ``last_modified``, these must be equal; else the verdict is ``unchecked``;
* merged headers: the full response's, replaced by the revisit's for the names a 304 may update.

Edge cases: a revisit without an earlier full response is kept, as ``missing``; a null URL, date or id
resolves to nothing (``missing``) and is no candidate; null headers count as none; header names are compared in lower case;
repeated rows are resolved alike; columns of the input beyond the record's are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Captures of one URL that one task may sort.
SLICE_ROWS = 5000
#: Header names that a not-modified answer may update (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not name another page (fixed values).
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid|sid"


def canonical_url(url: Column) -> Column:
    """The key under which captures of one page meet; null for a null or blank URL."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "(?i)^[a-z][a-z0-9+.-]*://", "")
    head = F.regexp_extract(bare, "^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(head), "^www[0-9]*\\.", ""), ":(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, "(\\.html?|/)+$", "")
    query = F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&")
    query = F.filter(query, lambda p: (F.length(p) > 0) & ~p.rlike(f"(?i)^({TRACKING})="))
    query = F.array_join(F.array_sort(query), "&")
    whole = F.concat(host, path, F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.length(F.trim(url)) > 0, whole)


def _lower_keys(headers: Column) -> Column:
    """Headers with lower-case names; of names that differ in case only, the last counts."""
    entries = F.coalesce(F.map_entries(headers), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(
        F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(
    records: DataFrame,
    slice_rows: int = SLICE_ROWS,
    permitted: tuple[str, ...] = PERMITTED,
) -> DataFrame:
    """One row per revisit of ``records``.

    Input columns: ``record_id`` long, ``kind`` (``response`` or ``revisit``), ``url``, ``at`` timestamp,
    ``status`` int, ``headers`` map<string,string>.  Output: ``record_id``, ``url``, ``canonical``, ``at``,
    ``full_id``, ``full_at``, ``verdict`` (``matched``, ``mismatched``, ``unchecked``, ``missing``) and
    ``headers`` (the merged ones for ``matched`` and ``unchecked``, else the revisit's own).
    """
    rows = records.select(
        "record_id", F.lower("kind").alias("kind"), "url", canonical_url(F.col("url")).alias("canonical"), "at",
        F.unix_micros("at").alias("t"), "status", _lower_keys(F.col("headers")).alias("own"))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull()
    asks = F.col("kind") == "revisit"
    # captures of one URL at one time are one point; points carry no headers
    keyed = rows.where((full | asks) & F.col("canonical").isNotNull() & F.col("t").isNotNull())
    points = keyed.groupBy("canonical", "t").agg(F.max(F.when(full, F.col("record_id"))).alias("id"))
    per_url = points.groupBy("canonical").agg(
        F.ceil(F.count("*") / F.lit(slice_rows)).alias("slices"), F.min("t").alias("from"), F.max("t").alias("to"))
    sliced = points.join(per_url.where("slices > 1"), "canonical", "left")
    share = (F.col("t") - F.col("from")) / F.greatest(F.col("to") - F.col("from"), F.lit(1))
    number = F.least(F.floor(share * F.col("slices")), F.col("slices") - 1)
    sliced = sliced.withColumn("slice", F.coalesce(number, F.lit(0)).cast("long"))
    response = F.when(F.col("id").isNotNull(), F.struct("t", "id"))
    earlier = Window.partitionBy("canonical", "slice").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.select("canonical", "slice", "t", F.max(response).over(earlier).alias("found"))
    # one row per slice of a URL that has several: the last full response of the slices before
    ends = sliced.where("slices > 1").groupBy("canonical", "slice").agg(F.max(response).alias("end"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("canonical", "slice", F.max("end").over(before).alias("carried"))
    found = local.join(carried, ["canonical", "slice"], "left")
    found = found.select("canonical", "t", F.coalesce("found", "carried").alias("full")).select(
        "canonical", "t", F.col("full.id").alias("full_id")).where("full_id is not null")
    bodies = rows.where(full).select(
        F.col("record_id").alias("full_id"), "canonical", F.col("at").alias("full_at"), F.col("own").alias("base"))
    bodies = bodies.dropDuplicates(["full_id", "canonical"])
    out = rows.where(asks).join(found, ["canonical", "t"], "left").join(bodies, ["full_id", "canonical"], "left")

    mine, theirs = F.col("own"), F.col("base")
    both = lambda name: mine[name].isNotNull() & theirs[name].isNotNull()
    verdict = (
        F.when(F.col("full_id").isNull(), "missing")
        .when(both("etag"), F.when(_tag(mine["etag"]) == _tag(theirs["etag"]), "matched").otherwise("mismatched"))
        .when(both("last-modified"),
              F.when(mine["last-modified"] == theirs["last-modified"], "matched").otherwise("mismatched"))
        .otherwise("unchecked"))
    may = F.map_filter(mine, lambda k, v: k.isin(*permitted))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(may), k)), may)
    return out.withColumn("verdict", verdict).select(
        "record_id", "url", "canonical", "at", "full_id", "full_at", "verdict",
        F.when(F.col("verdict").isin("matched", "unchecked"), merged).otherwise(mine).alias("headers"))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records that the page table implies: one full response and one later revisit of every page.

    A page is captured at second ``page_id``; its revisit asks up to eleven days later with the validator of
    that capture, so another capture of the same canonical URL in between is a mismatch.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit(""))), F.lit('"'))
    age = F.concat(F.lit("max-age="), (F.col("page_id") % 3600).cast("string"))
    later = F.col("page_id") + 1 + (F.col("page_id") * 7919) % 1000000
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url",
        F.timestamp_seconds("page_id").alias("at"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), age,
                     F.lit("Server"), F.lit("origin")).alias("headers"))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url",
        F.timestamp_seconds(later).alias("at"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Cache-Control"), F.lit("no-cache"),
                     F.lit("Server"), F.lit("cache")).alias("headers"))
    return response.unionByName(revisit)


#: DuckDB SQL for the registered query (the same rules over ``pages``).
ORACLE = r"""
WITH split AS (
  SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare
  FROM pages),
keyed AS (
  SELECT page_id, url, tag,
         CASE WHEN length(trim(url)) > 0 THEN
           regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '')
           || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '(\.html?|/)+$', '')
           || CASE WHEN length(q) > 0 THEN '?' || q ELSE '' END END AS canonical
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
          lambda p: length(p) > 0 AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)='))), '&') AS q
        FROM split)),
full_ AS (SELECT canonical, page_id AS t, page_id * 2 AS id, tag, page_id FROM keyed),
asks AS (SELECT page_id * 2 + 1 AS record_id, url, canonical, tag, page_id + 1 + (page_id * 7919) % 1000000 AS t FROM keyed),
best AS (
  SELECT a.record_id, max(f.t) AS t FROM asks a JOIN full_ f ON a.canonical = f.canonical AND f.t < a.t GROUP BY a.record_id)
SELECT a.record_id, a.url, a.canonical, f.id AS full_id,
       CASE WHEN f.id IS NULL THEN 'missing' WHEN f.tag = a.tag THEN 'matched' ELSE 'mismatched' END AS verdict,
       'W/' || a.tag AS etag, 'no-cache' AS cache_control,
       CASE WHEN f.tag = a.tag THEN 'text/html' END AS content_type,
       CASE WHEN f.tag = a.tag THEN 'origin' ELSE 'cache' END AS server
FROM asks a LEFT JOIN best b USING (record_id)
LEFT JOIN full_ f ON f.canonical = a.canonical AND f.t = b.t
"""
