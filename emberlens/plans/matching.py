"""Canonical values, pairs, suffixes, grams, medians and intervals on the driver's tables."""

from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, lines_of
from ..operators import containment, grams, pairs, quantiles, suffixes
from .registry import query

# an event as nested JSON whose keys are in no order, with spaces and a key twice
NESTED = """concat('{"z" : ', props, ', "a":[ ', CAST(event_id % 7 AS STRING), ' ,"', event_type, '", {"y": null,"b":', CAST(event_id % 2 = 0 AS STRING), '}], "z":  ', props, '}')"""


@query("""WITH c AS (SELECT event_id, '{"a":[' || event_id % 7 || ',"' || event_type || '",{"b":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"y":null}],"z":' || replace(props, ': ', ':') || '}' AS canonical FROM events)
SELECT event_id, canonical, sha256(canonical) AS digest FROM c""")
def canonical_events(t):
    """Canonical form and digest of nested values: events with their properties."""
    rows = t.events.select("event_id", canonical_json(F.expr(NESTED)).alias("canonical"))
    return rows.withColumn("digest", F.sha2(F.col("canonical").cast("binary"), 256))


@query("""WITH i AS (SELECT event_id, user_id, event_type, value, ts FROM events), d AS (SELECT event_id, list_filter([CASE WHEN event_id % 13 = 0 THEN 'commit_sha' END, CASE WHEN event_id % 17 = 0 THEN 'context' END, CASE WHEN event_id % 19 = 0 THEN 'scope' END], lambda x: x IS NOT NULL) AS f FROM i)
SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'no input' ELSE array_to_string(f, ',') END AS fields FROM d WHERE event_id % 23 = 0 OR len(f) > 0""")
def pair_identity(t):
    """Results that differ from their inputs in one of eight fields: events as inputs, copies with other key orders as results."""
    fields = {"schema_version": "'1'", "repository_id": "user_id", "scan_id": "event_id", "commit_sha": "event_type", "check_id": "event_type", "detector_version": "NULL"}
    context, scope = """concat('{"k": ', value, ', "list": [1, 2]}')""", """concat('["', event_type, '", "b"]')"""
    inputs = t.events.where("event_id % 23 != 0").select("event_id", *(F.expr(f"CAST({v} AS STRING)").alias(k) for k, v in fields.items()), F.expr(context).alias("context"), F.expr(scope).alias("scope"))
    other = fields | {"commit_sha": "IF(event_id % 13 = 0, 'changed', event_type)"}
    context = """concat('{"list":[1,', IF(event_id % 17 = 0, '3', '2'), '],"k":', value, '}')"""
    scope = """concat('["', event_type, '"', IF(event_id % 19 = 0, '', ',"b"'), ']')"""
    results = t.events.select("event_id", *(F.expr(f"CAST({v} AS STRING)").alias(k) for k, v in other.items()), F.expr(context).alias("context"), F.expr(scope).alias("scope"))
    return pairs.same_identity(inputs, results, "event_id")


# each document is a source and quotes its own second line and the next; some quotes are changed, cite another document, or a field
SQL_EVIDENCE = """l AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '\\n$', ''), '\\n') AS l FROM documents WHERE text <> '' AND NOT regexp_matches(text, '[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\x{2028}\\x{2029}]')),
 e AS (SELECT doc_id, len(l) AS n, l, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 2 END AS line, array_to_string(l[2:3], chr(10)) AS quote FROM l)"""


@query(f"""WITH {SQL_EVIDENCE} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'unknown source' WHEN doc_id % 7 = 0 THEN 'different scope' WHEN doc_id % 9 = 0 THEN 'locator or kind' ELSE 'source lines' END AS reason FROM e
WHERE doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 9 = 0 OR array_to_string(l[line:line + len(regexp_split_to_array(regexp_replace(quote, '\\n$', ''), '\\n')) - 1], chr(10)) IS DISTINCT FROM regexp_replace(quote, '\\n$', '') OR quote = ''""")
def pair_quotes(t):
    """Evidence against the lines of its source: documents that quote themselves."""
    docs = t.documents.where((F.col("text") != "") & ~F.col("text").rlike("[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"))
    sources = docs.select("doc_id", F.lit("s").alias("source_id"), F.col("lang").alias("scope_id"), F.col("source").alias("locator"), F.lit("static").alias("kind"), F.col("text").alias("content"), F.lit(None).cast("string").alias("data"))
    quote = F.array_join(F.slice(lines_of(F.col("text")), 2, 2), "\n")
    evidence = docs.select(
        "doc_id", F.when(F.col("doc_id") % 11 == 0, "other").otherwise("s").alias("source_id"), F.when(F.col("doc_id") % 7 == 0, "else").otherwise(F.col("lang")).alias("scope_id"), F.when(F.col("doc_id") % 9 == 0, "there").otherwise(F.col("source")).alias("locator"),
        F.lit("static").alias("kind"), F.when(F.col("doc_id") % 5 == 0, 3).otherwise(2).alias("line"), F.lit(None).cast("string").alias("field"), quote.alias("value"),
    )
    return pairs.rejected_evidence(evidence, sources, "doc_id").select("doc_id", "reason")


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'data field' WHEN event_id % 10 = 1 THEN 'data field' END AS reason FROM events WHERE event_id % 10 IN (0, 1)""")
def pair_values(t):
    """Evidence against a field of its source's data: events' properties, some cited with another value or a missing field."""
    sources = t.events.select("event_id", F.lit("s").alias("source_id"), F.lit("x").alias("scope_id"), F.lit("m").alias("locator"), F.lit("data").alias("kind"), F.lit(None).cast("string").alias("content"), F.expr("""concat('{"props": ', props, ', "n": [1, 2.50]}')""").alias("data"))
    k = F.col("event_id") % 10
    evidence = t.events.select(
        "event_id", F.lit("s").alias("source_id"), F.lit("x").alias("scope_id"), F.lit("m").alias("locator"), F.lit("data").alias("kind"), F.lit(None).cast("int").alias("line"),
        F.when(k == 1, "nothing").when(k == 2, "n").otherwise("props").alias("field"), F.when(k == 0, F.lit('{"k": "other"}')).when(k == 2, "[1,2.5]").otherwise(F.replace("props", F.lit(" "), F.lit("  "))).alias("value"),
    )
    return pairs.rejected_evidence(evidence, sources, "event_id").select("event_id", "reason")


SQL_FILES = """p AS (SELECT url, ltrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, page_id FROM pages),
 f AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN host || '/' || path WHEN page_id % 3 = 1 THEN regexp_extract(path, '[^/]*/?$') ELSE path END AS file FROM p WHERE page_id % 2 = 0)"""


@query(f"""WITH {SQL_FILES}, m AS (SELECT url, any_value(path) AS path, count(file) AS fits, min(file) AS file FROM (SELECT DISTINCT url, path FROM p) u LEFT JOIN f ON file <> '' AND path <> '' AND (file = path OR ends_with(file, '/' || path) OR ends_with(path, '/' || file)) GROUP BY url)
SELECT url, fits, CASE WHEN fits = 1 THEN file ELSE 'page:/' || path END AS scope_key FROM m""")
def url_scopes(t):
    """Pages' URLs and the one file that each means: files with and without the host's folder, and bare names."""
    rows = t.pages.withColumns({"path": suffixes.url_path(F.col("url")), "host": F.regexp_extract("url", "^https?://([^/?#]+)", 1)})
    file = F.when(F.col("page_id") % 3 == 0, F.concat_ws("/", "host", "path")).when(F.col("page_id") % 3 == 1, F.regexp_extract("path", "[^/]*/?$", 0)).otherwise(F.col("path"))
    return suffixes.scope_keys(t.pages, "url", rows.where("page_id % 2 = 0").select(file.alias("file")), "file")


SQL_PATTERNS = "p AS (SELECT 4 * item_id AS id, text AS pattern FROM benchmark UNION ALL SELECT 4 * item_id + 1, substring(text, 5, 20) FROM benchmark UNION ALL SELECT 4 * item_id + 2, substring(text, 3, 4) FROM benchmark UNION ALL SELECT 4 * item_id + 3, upper(text) FROM benchmark)"


# letters whose one capital the SQL takes; Spark's upper() writes them as two letters
CAPITALS = {"ß": "ẞ"} | {chr(a + k): chr(a + 8 + k) for a in (0x1F80, 0x1F90, 0x1FA0) for k in range(8)} | {chr(c): chr(c + 9) for c in (0x1FB3, 0x1FC3, 0x1FF3)}


def _upper(text):
    """Each letter's one capital, as the SQL's upper(); letters without one stay."""
    letters = F.split(F.translate(text, "".join(CAPITALS), "".join(CAPITALS.values())), "")
    # a capital of CAPITALS would be written as two letters again
    return F.array_join(F.transform(letters, lambda c: F.when(F.char_length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def _patterns(t):
    text = F.element_at(F.array(F.col("text"), F.substring("text", 5, 20), F.substring("text", 3, 4), _upper(F.col("text"))), (F.col("k") + 1).cast("int"))
    return t.benchmark.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select((4 * F.col("item_id") + F.col("k")).alias("id"), text.alias("pattern"))


@query(f"WITH {SQL_PATTERNS} SELECT doc_id, id FROM documents JOIN p ON contains(text, pattern)")
def pattern_texts(t):
    """Benchmark passages, parts of them and a few letters in documents."""
    patterns = _patterns(t)
    # the operator gives empty patterns to no text, SQL to every one that is not null
    empty = t.documents.where("text IS NOT NULL").select("doc_id").crossJoin(patterns.where("pattern = ''").select("id"))
    return grams.contained(t.documents, "doc_id", "text", patterns, "id", "pattern").unionByName(empty)


@query("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(documents.text, substring(b.text, 1, 60)))")
def obs13_undropped(t):
    """OBS-13 on documents as paths: those that hold the beginning of no benchmark passage."""
    filters = t.benchmark.select("item_id", F.substring("text", 1, 60).alias("pattern"))
    return grams.undropped(t.documents.select("doc_id", "lang", "text"), "doc_id", "text", filters, "item_id", "pattern").select("doc_id", "lang")


@query("""SELECT l_returnflag, l_linestatus, unnest([0.0::DOUBLE, 0.05::DOUBLE, 0.5::DOUBLE, 0.99::DOUBLE, 1.0::DOUBLE]) AS share, unnest([quantile_cont(l_extendedprice, 0.0), quantile_cont(l_extendedprice, 0.05), quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.99), quantile_cont(l_extendedprice, 1.0)]) AS price, count(*) AS samples FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def exact_quantiles(t):
    """Exact quantiles of prices; groups of over 1000 rows count as large."""
    out = quantiles.exact_percentiles(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.0, 0.05, 0.5, 0.99, 1.0], most=1000)
    return out.withColumnRenamed("percentile", "price")


SQL_SPANS = """s AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS span, min(epoch(CAST(l_shipdate AS DATE)) // 86400)::BIGINT AS first, max(epoch(CAST(l_shipdate AS DATE)) // 86400 + CAST(l_quantity AS BIGINT) * (1 + l_linenumber % 3 * 8))::BIGINT AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
 p AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS point, min(epoch(CAST(l_shipdate AS DATE)) // 86400)::BIGINT AS day FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)"""


def _spans(t):
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = t.lineitem.withColumns({"day": day, "key": key, "until": day + F.col("l_quantity").cast("long") * (1 + F.col("l_linenumber") % 3 * 8)})
    spans = rows.where("l_returnflag = 'R'").groupBy("l_suppkey", F.col("key").alias("span")).agg(F.min("day").alias("first"), F.max("until").alias("last"))
    points = rows.where("l_returnflag = 'A'").groupBy("l_suppkey", F.col("key").alias("point")).agg(F.min("day").alias("day"))
    return points.withColumn("id", F.concat_ws(":", "l_suppkey", "point")), spans


@query(f"""WITH {SQL_SPANS}, j AS (SELECT p.l_suppkey, p.point, span, last - first AS size FROM p JOIN s ON s.l_suppkey = p.l_suppkey AND day BETWEEN first AND last),
 b AS (SELECT l_suppkey, point, count(*) AS around, min(size) AS size FROM j GROUP BY ALL), n AS (SELECT j.l_suppkey, j.point, around, min(span) AS span, count(*) = 1 AS alone FROM j JOIN b USING (l_suppkey, point, size) GROUP BY ALL)
SELECT p.l_suppkey, p.point, coalesce(around, 0) AS around, span, alone FROM p LEFT JOIN n USING (l_suppkey, point)""")
def innermost_spans(t):
    """Deliveries within the periods of other deliveries of their supplier: the shortest period around each."""
    points, spans = _spans(t)
    return containment.innermost(points, "id", "day", spans, "span", "first", "last", ["l_suppkey"]).select("l_suppkey", "point", "around", "span", "alone")


@query(f"""WITH {SQL_SPANS}, w AS (SELECT l_suppkey AS file, span AS job, first, last FROM s WHERE span % 11 = 0), t AS (SELECT w.file, w.job, s.span AS step, s.first, s.last FROM w JOIN s ON s.l_suppkey = w.file AND s.first >= w.first AND s.last <= w.last AND s.span <> w.job),
 f AS (SELECT l_suppkey || ':' || point AS id, l_suppkey AS file, day FROM p), jobs AS (SELECT id, min(job) AS job FROM f JOIN w ON w.file = f.file AND day BETWEEN first AND last GROUP BY id HAVING count(*) = 1),
 steps AS (SELECT f.id, min(step) AS step FROM f JOIN jobs USING (id) JOIN t ON t.file = f.file AND t.job = jobs.job AND day BETWEEN t.first AND t.last GROUP BY f.id HAVING count(*) = 1)
SELECT f.id, CASE WHEN f.file NOT IN (SELECT file FROM w) THEN 'none' WHEN job IS NULL THEN 'workflow' WHEN step IS NULL THEN 'job' ELSE 'step' END AS level, job, step FROM f LEFT JOIN jobs USING (id) LEFT JOIN steps USING (id)""")
def finding_places(t):
    """Findings linked to the one job and step around their line: suppliers as workflows, long and inner periods as jobs and steps."""
    points, spans = _spans(t)
    jobs = spans.where("span % 11 = 0").select(F.col("l_suppkey").alias("file"), F.col("span").alias("job"), "first", "last")
    inner = spans.select(F.col("l_suppkey").alias("file"), F.col("span").alias("step"), F.col("first").alias("f"), F.col("last").alias("l"))
    steps = jobs.join(inner, "file").where("f >= first AND l <= last AND step != job").select("file", "job", "step", F.col("f").alias("first"), F.col("l").alias("last"))
    findings = points.select("id", F.col("l_suppkey").alias("file"), F.col("day").alias("line"))
    return containment.linked_findings(findings, jobs, steps).select("id", "level", "job", "step")
