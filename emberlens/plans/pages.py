"""Page and prompt rules on pages, documents and conversations."""

from pyspark.sql import functions as F

from ..operators import pages as op
from ..operators import trees
from ..sources import html
from .registry import query

# The pages' links as images, a third each: with a library's class, with sizes, and with a style that leaves the width open;
# and a comment, a script and a quoted bracket that are no images.
LINK = '<a href='
IMAGES = ('<img class="big lazyload" data-src=', '<img width="10" style="Height: 5px" src=', '<img id="x" style="WIDTH: auto; height:3px" data-x="a > b" loading="lazy" class=lozad data-src=')
TRAPS = '<!-- <img src="no"> --><script>var x = "<img src=1>";</script><IMG src="end.png" alt="a>b"/></BODY>'
SQL_IMAGES = f"""i AS (SELECT page_id, replace(replace(html, '{LINK}', CASE page_id % 3 WHEN 0 THEN '{IMAGES[0]}' WHEN 1 THEN '{IMAGES[1]}' ELSE '{IMAGES[2]}' END), '</body>', '{TRAPS}') AS html FROM pages),
 g AS (SELECT page_id, unnest(list_filter(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>', '', 'g'), '(?is)<img(?:[^>"'']|"[^"]*"|''[^'']*'')*>'), lambda x: TRUE)) AS tag FROM i)"""


def _images(t):
    page = F.element_at(F.array(*(F.lit(x) for x in IMAGES)), (F.col("page_id") % 3 + 1).cast("int"))
    return t.pages.select("page_id", F.replace(F.replace("html", F.lit(LINK), page), F.lit("</body>"), F.lit(TRAPS)).alias("html"))


# Tags and texts in order by one pattern; the stack of open elements by recursion. Only p and li have implied ends on these pages.
SQL_TREE = """tok AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS k, x FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<[^>]*>|[^<]+')) AS x, generate_subscripts(regexp_extract_all(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<[^>]*>|[^<]+'), 1) AS k FROM pages)),
 tag AS (SELECT page_id, k, x, CASE WHEN x LIKE '<!%' THEN 'none' WHEN x NOT LIKE '<%' THEN 'text' WHEN x LIKE '</%' THEN 'end' WHEN regexp_matches(x, '^<(script|style|title|meta|br)[^a-z]') THEN 'leaf' ELSE 'start' END AS kind, lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM tok),
 st AS (SELECT page_id, 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS ids, 'none' AS kind, '' AS name, '' AS x, CAST(NULL AS BIGINT) AS parent, 0::BIGINT AS depth FROM pages
  UNION ALL SELECT page_id, k, names2, ids2, kind, name, x, parent, depth FROM (SELECT *,
   CASE WHEN kind = 'end' THEN names[1:greatest(at_end - 1, 0)] WHEN kind = 'start' THEN list_append(names[1:keep], name) WHEN kind = 'leaf' THEN names[1:keep] ELSE names END AS names2,
   CASE WHEN kind = 'end' THEN ids[1:greatest(at_end - 1, 0)] WHEN kind = 'start' THEN list_append(ids[1:keep], k) WHEN kind = 'leaf' THEN ids[1:keep] ELSE ids END AS ids2,
   CASE WHEN kind IN ('start', 'leaf') THEN ids[keep] WHEN kind = 'text' THEN ids[len(ids)] END AS parent, keep AS depth FROM (SELECT s.names, s.ids, g.page_id, g.k, g.kind, g.name, g.x,
    coalesce(list_max(list_filter(range(1, len(s.names) + 1), lambda i: s.names[i] = g.name)), len(s.names) + 1) AS at_end,
    CASE WHEN g.kind NOT IN ('start', 'leaf') THEN len(s.names) WHEN s.names[list_max(list_filter(range(1, len(s.names) + 1), lambda i: s.names[i] NOT IN ('a', 'b')))] = 'p' AND g.name IN ('p', 'h1', 'div', 'article', 'footer', 'ul', 'li', 'nav') OR s.names[list_max(list_filter(range(1, len(s.names) + 1), lambda i: s.names[i] NOT IN ('a', 'b')))] = 'li' AND g.name = 'li'
     THEN list_max(list_filter(range(1, len(s.names) + 1), lambda i: s.names[i] NOT IN ('a', 'b'))) - 1 ELSE len(s.names) END AS keep
    FROM st s JOIN tag g ON g.page_id = s.page_id AND g.k = s.k + 1))),
 el AS (SELECT * FROM st WHERE kind IN ('start', 'leaf'))"""


@query(f"""WITH {SQL_IMAGES}, v AS (SELECT page_id, tag, regexp_matches(tag, 'width="10"') AS sized, regexp_matches(tag, '(class|id)=') AS low FROM g),
 a AS (SELECT page_id, count(*) AS images, count(*) FILTER (NOT sized) AS bare, count(*) FILTER (NOT sized AND NOT low) AS sure FROM v GROUP BY ALL)
SELECT page_id, coalesce(images, 0) AS images, coalesce(bare, 0) AS bare, coalesce(sure, 0) AS sure, CASE WHEN bare > 0 THEN 'detected' ELSE 'clean' END AS status FROM pages LEFT JOIN a USING (page_id)""")
def fe03_img_dimensions(t):
    """FE-03 on pages whose links are images."""
    pages = _images(t)
    return op.images_without_size(pages, html.nodes(pages, "page_id", "html"), "page_id")


@query(f"""WITH RECURSIVE {SQL_TREE}, c AS (SELECT page_id, parent, count(*) AS n FROM el GROUP BY ALL), m AS (SELECT page_id, max(n) AS n FROM c WHERE parent IS NOT NULL GROUP BY ALL)
SELECT el.page_id, count(*) AS elements, CAST(max(depth) + 1 AS INT) AS max_depth, coalesce(any_value(m.n), 0) AS most_children, CASE WHEN count(*) > 40 THEN 'detected' ELSE 'clean' END AS status FROM el LEFT JOIN m USING (page_id) GROUP BY el.page_id""")
def fe16_dom_size(t):
    """FE-16 on pages; 40 elements are many here."""
    return op.shape(html.nodes(t.pages, "page_id", "html"), "page_id", 40)


@query(f"""WITH RECURSIVE {SQL_TREE}, own AS (SELECT page_id, parent AS id, sum(strlen(x)) AS bytes FROM st WHERE kind = 'text' GROUP BY ALL UNION ALL SELECT page_id, k, strlen(regexp_extract(x, '(?is)^<[^>]*>(.*)</[a-z]+>$', 1)) FROM el WHERE kind = 'leaf' AND name IN ('script', 'style', 'title')),
 up AS (SELECT page_id, k AS id, k AS above, parent FROM el UNION ALL SELECT up.page_id, up.id, el.k, el.parent FROM up JOIN el ON el.page_id = up.page_id AND el.k = up.parent),
 place AS (SELECT page_id, k, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS n, name FROM el)
SELECT p.page_id, CAST(p.n AS INT) AS n, p.name, count(DISTINCT up.id) AS elements, CAST(coalesce(sum(own.bytes), 0) AS BIGINT) AS bytes FROM place p JOIN up ON up.page_id = p.page_id AND up.above = p.k LEFT JOIN own ON own.page_id = up.page_id AND own.id = up.id WHERE p.name IN ('html', 'body', 'nav', 'ul', 'article', 'p', 'footer', 'head') GROUP BY ALL""")
def page_subtrees(t):
    """Elements and bytes of text in each larger part of a page, whatever it holds."""
    nodes = html.nodes(t.pages, "page_id", "html")
    rows = trees.subtree_by_interval(nodes, "page_id", "text_bytes", "bytes").withColumn("elements", (F.col("last") - F.col("n") + 1).cast("long"))
    return rows.where("name IN ('html', 'body', 'nav', 'ul', 'article', 'p', 'footer', 'head')").select("page_id", "n", "name", "elements", "bytes")


@query(f"""WITH {SQL_IMAGES} SELECT page_id, count(*) AS lazy, min(regexp_extract(tag, 'data-src="([^"]*)"', 1)) AS first_src FROM g WHERE regexp_matches(tag, 'lazyload') GROUP BY ALL""")
def fe04_lazy_library(t):
    """FE-04 on pages whose links are images: those that a library loads."""
    found = op.lazy_images(html.nodes(_images(t), "page_id", "html"), "page_id")
    return found.groupBy("page_id").agg(F.count("*").alias("lazy"), F.min("data_src").alias("first_src"))


# a customer's orders as a tree: an order hangs below the one at half its place; finished ones are built-in frames, urgent ones modules
SQL_FRAMES = """f AS (SELECT o_custkey, place, CASE WHEN place > 1 THEN place // 2 END AS parent, o_orderstatus AS kind, o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS size FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders)),
 up AS (SELECT o_custkey, place, place AS above, parent, kind FROM f UNION ALL SELECT up.o_custkey, up.place, f.place, f.parent, f.kind FROM up JOIN f ON f.o_custkey = up.o_custkey AND f.place = up.parent)"""


def _frames(t):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    rows = t.orders.select("o_custkey", place.alias("place"), F.col("o_orderstatus").alias("kind"), "o_orderpriority", F.col("o_totalprice").alias("price"))
    return rows.withColumns({"parent": F.when(F.col("place") > 1, F.floor(F.col("place") / 2)), "size": F.floor("price").cast("long")}).drop("price")


@query(f"WITH RECURSIVE {SQL_FRAMES} SELECT up.o_custkey, up.above AS place, CAST(sum(f.size) AS BIGINT) AS bytes FROM up JOIN f ON f.o_custkey = up.o_custkey AND f.place = up.place GROUP BY ALL")
def heap_subtrees(t):
    """Bytes of whole subtrees of calls: a customer's orders as a tree of frames, by doubling."""
    return trees.subtree_by_doubling(_frames(t), ["o_custkey", "place"], "parent", "size", "bytes").select("o_custkey", "place", "bytes")


@query(f"""WITH RECURSIVE {SQL_FRAMES}, o AS (SELECT o_custkey, place, max(above) AS owner FROM up WHERE kind <> 'F' GROUP BY ALL),
 near AS (SELECT f.o_custkey, f.place, f.size, (SELECT max(above) FROM up WHERE up.o_custkey = f.o_custkey AND up.place = f.place AND up.kind <> 'F') AS owner FROM f)
SELECT near.o_custkey, w.o_orderpriority, CAST(sum(near.size) AS BIGINT) AS allocated_bytes FROM near JOIN f w ON w.o_custkey = near.o_custkey AND w.place = near.owner WHERE w.o_orderpriority <> '1-URGENT' AND near.size > 0 GROUP BY ALL HAVING sum(near.size) >= 65536""")
def heap_owned(t):
    """Allocated bytes by place in a profile: finished orders are built-in frames, urgent ones modules, a priority is a place."""
    url = F.when(F.col("kind") != "F", F.col("o_orderpriority"))
    return trees.owned_bytes(_frames(t), ["o_custkey", "place"], "parent", url, F.col("o_orderpriority") == "1-URGENT", ["o_orderpriority"], "size", 65536)


@query("""WITH s AS (SELECT doc_id, trim(regexp_replace(lower(x), '[ \t\r\n\f]+', ' ', 'g')) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS x FROM documents)),
 c AS (SELECT doc_id, s, count(*) AS n FROM s WHERE length(s) >= 40 GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, count(*) AS sentences, CAST(sum(n - 1) AS BIGINT) AS repeats, CAST(sum((n - 1) * length(s)) AS BIGINT) AS chars FROM c GROUP BY doc_id""")
def llm03_repeated_sentences(t):
    """LLM-03 on documents as prompts."""
    return op.repeated_sentences(t.documents, "doc_id", "text")


@query("""WITH c AS (SELECT role, substring(text, 1, 20) AS prefix, count(*) AS n FROM conversations WHERE length(text) >= 20 GROUP BY ALL HAVING count(*) > 1)
SELECT role, count(*) AS prefixes, CAST(sum(n) AS BIGINT) AS prompts, sum(n - 1) * 20 / 4.0 AS tokens_again, CASE WHEN sum(n - 1) * 20 / 4.0 >= 100 THEN 'detected' ELSE 'clean' END AS status FROM c GROUP BY role""")
def llm01_prefix_tokens(t):
    """LLM-01 on conversations: the first 20 characters of texts by role."""
    return op.prefix_tokens(t.conversations, "role", "text", 20, 100)
