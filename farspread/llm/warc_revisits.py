"""WARC: resolving not-modified revisits.

A revisit record says that the server answered 304: the resource is as in an earlier capture. It is joined, as of its
time, to the latest earlier full response of the same canonical URL. Its validators are checked against that response,
and the headers that a 304 may update are merged into the response's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header fields that a 304 response carries or may update (RFC 9110, 15.4.5; RFC 9111, 3.2).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
HOUR = 3_600_000_000
# Codes of the characters that need no escape in a URL (RFC 3986, 2.3): - . _ ~, digits and letters.
_UNRESERVED = "^(2D|2E|5F|7E|3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])$"


def _plain_escapes(part: Column) -> Column:
    """Escapes of characters that need none become those, others get upper-case digits."""
    code = lambda x: F.upper(F.substring(x, 1, 2))
    known = lambda x: x.rlike("^[0-9A-Fa-f]{2}")
    char = lambda x: F.when(code(x).rlike(_UNRESERVED), F.decode(F.unhex(code(x)), "UTF-8")).otherwise(F.concat(F.lit("%"), code(x)))
    fixed = lambda x, i: F.when(i == 0, x).when(known(x), F.concat(char(x), x.substr(F.lit(3), F.length(x)))).otherwise(F.concat(F.lit("%"), x))
    return F.when(F.contains(part, F.lit("%")), F.array_join(F.transform(F.split(part, "%", -1), fixed), "")).otherwise(part)


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x)))
    segments = F.split(path, "/", -1)
    plain = F.array_join(F.aggregate(F.slice(segments, 2, F.size(segments)), F.slice(segments, 1, 1), step), "/")
    return F.when(F.contains(path, F.lit("/.")), plain).otherwise(path)


def canonical_url(url: Column, *, host_prefix: str | None = None, dropped: str | None = None) -> Column:
    """The URL without scheme, user, default port, fragment and last slash, its host in lower case, escapes and dot segments
    resolved and query parameters sorted.

    ``host_prefix`` (such as ``(www\\d?|m)\\.``) and ``dropped`` (names of parameters such as ``utm_[a-z]+|fbclid``) are
    patterns of what shall go besides; without them hosts and parameters that differ are different resources.
    """
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "(?i)^https?://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(u, r"^([^/?]*)", 1), r"^[^@]*@", ""))
    host = F.regexp_replace(host, r":(80|443)$", "")
    if host_prefix:
        host = F.regexp_replace(host, f"^({host_prefix})", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    path = F.regexp_replace(_without_dots(_plain_escapes(F.regexp_extract(rest, r"^([^?]*)", 1))), "/+$", "")
    given = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&", -1), lambda x: x != "")
    if dropped:
        given = F.filter(given, lambda x: ~x.rlike(f"^({dropped})(=|$)"))
    asked = F.array_join(F.array_sort(F.transform(given, _plain_escapes)), "&")
    return F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))


def weak_tag(tag: Column) -> Column:
    """An entity tag for weak comparison: without W/ and quotes."""
    return F.regexp_replace(F.regexp_replace(F.trim(tag), "^W/", ""), '^"|"$', "")


def _lower_keys(headers: Column) -> Column:
    """A header map with lower-case names; of names that then agree the last wins."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def resolve_revisits(records: DataFrame, *, permitted: tuple[str, ...] = PERMITTED, span: int = HOUR, host_prefix: str | None = None, dropped: str | None = None) -> DataFrame:
    """One row per revisit of records: record_id, url, ts, response_id, response_ts, verdict, headers.

    records: record_id long, url string, ts long (microseconds), kind string ('response' or 'revisit'), headers
    map<string, string>. ``verdict`` is 'matched' where the entity tags agree (weakly), or without two tags the
    Last-Modified dates; 'unverified' where neither can be compared; 'mismatch' where they differ; 'orphan' without an
    earlier response. A mismatch keeps the response's id but its headers stay unmerged (null), as for an orphan.

    ``host_prefix`` and ``dropped`` are those of canonical_url. Captures of a URL are dealt by spans of time: the last response of a span is found first, the last before a span
    from these, so that no task gets a URL's whole history.

    * Responses at the same time as the revisit aren't earlier. Of responses at one time the largest id counts.
    * A null url or ts leaves a revisit an orphan; such a response is never found. Records of other kinds are dropped.
    * Headers and URLs of any length are taken whole. Null headers count as none. Rows that repeat a record are all returned. Other columns are not read. Empty in, empty out.
    """
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), F.col("url").cast("string").alias("url"), F.col("ts").cast("long").alias("ts"), F.col("kind").alias("kind"),
        _lower_keys(F.coalesce(F.col("headers"), F.expr("map()").cast("map<string,string>"))).alias("headers"),
    ).where("kind in ('response', 'revisit')")
    rows = rows.withColumn("key", canonical_url(F.col("url"), host_prefix=host_prefix, dropped=dropped)).withColumn("span", F.floor(F.col("ts") / span))
    response = F.struct("ts", "record_id", "headers")
    is_response = (F.col("kind") == "response") & F.col("key").isNotNull() & F.col("ts").isNotNull()
    # The last response of each span, and from these the last before it; a URL has one row per span that it has captures in.
    spans = rows.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).groupBy("key", "span").agg(F.max_by(response, F.when(is_response, F.struct("ts", "record_id"))).alias("of"), F.max(F.when(is_response, 1)).alias("has"))
    before = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("key", "span", F.last(F.when(F.col("has") == 1, F.col("of")), ignorenulls=True).over(before).alias("carried"))
    earlier = Window.partitionBy("key", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    # max_by keeps one response per window, not all of them
    within = rows.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).withColumn("found", F.max_by(response, F.when(is_response, F.struct("ts", "record_id"))).over(earlier))
    within = within.withColumn("any", F.max(F.when(is_response, 1)).over(earlier)).where("kind = 'revisit'")
    joined = within.join(carried, ["key", "span"], "left").withColumn("r", F.when(F.col("any") == 1, F.col("found")).otherwise(F.col("carried")))
    lost = rows.where("kind = 'revisit'").where(F.col("key").isNull() | F.col("ts").isNull())
    joined = joined.select("record_id", "url", "ts", "headers", "r").unionByName(lost.select("record_id", "url", "ts", "headers").withColumn("r", F.lit(None)), allowMissingColumns=True)

    own, theirs = (lambda k: F.element_at(F.col("headers"), k)), (lambda k: F.element_at(F.col("r.headers"), k))
    tags = own("etag").isNotNull() & theirs("etag").isNotNull()
    dates = own("last-modified").isNotNull() & theirs("last-modified").isNotNull()
    verdict = (
        F.when(F.col("r").isNull(), "orphan")
        .when(tags, F.when(weak_tag(own("etag")) == weak_tag(theirs("etag")), "matched").otherwise("mismatch"))
        .when(dates, F.when(own("last-modified") == theirs("last-modified"), "matched").otherwise("mismatch"))
        .otherwise("unverified")
    )
    names = F.array(*[F.lit(p) for p in permitted])
    update = F.map_filter(F.col("headers"), lambda k, v: F.array_contains(names, k))
    kept = F.map_filter(F.col("r.headers"), lambda k, v: ~F.map_contains_key(update, k))
    out = joined.withColumn("verdict", verdict)
    return out.select("record_id", "url", "ts", F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"), "verdict", F.when(F.col("verdict").isin("matched", "unverified"), F.map_concat(kept, update)).alias("headers"))
