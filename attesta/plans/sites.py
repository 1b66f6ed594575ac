"""Catalogue: pages, links, scans and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import passages, scan, site
from attesta.plans.content import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SOURCES = tuple(f"src{i}" for i in range(26))
EMAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


HREF_SQL = """(SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages)"""
PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1)"


def edges(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(site.hrefs(F.col("html"))).alias("href"))


@query("q29_link_edges", f"SELECT page_id, href, count(*) AS n FROM {HREF_SQL} GROUP BY ALL")
def q29(spark, sf):
    return edges(spark, sf).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("q30_broken_links", f"SELECT page_id, href FROM {HREF_SQL} WHERE href NOT IN (SELECT {PATH_SQL} FROM pages)")
def q30(spark, sf):
    """Root-relative links that name no page's path."""
    paths = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path")).distinct()
    links = edges(spark, sf)
    # a link that is on every page is looked up once
    dead = links.select("href").distinct().join(paths, F.col("href") == F.col("path"), "left_anti").withColumnRenamed("href", "dead")
    return links.join(dead, F.col("href") == F.col("dead"), "left_semi")


@query("q31_tag_counts", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def q31(spark, sf):
    tags = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "q32_missing_tags",
    "SELECT page_id, tag FROM pages, (SELECT unnest(['html', 'head', 'body', 'main', 'nav']) AS tag) WHERE NOT regexp_matches(html, '<' || tag || '[ >]')",
)
def q32(spark, sf):
    pages = table(spark, sf, "pages")
    tags = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[ >]"), F.lit(1))).alias("tag"))
    return site.missing(pages, "page_id", tags, "tag", (*site.REQUIRED_TAGS, "main", "nav"))


@query("q33_duplicate_refs", f"SELECT page_id, href FROM {HREF_SQL} GROUP BY ALL HAVING count(*) > 1")
def q33(spark, sf):
    return edges(spark, sf).groupBy("page_id", "href").count().filter("count > 1").select("page_id", "href")


@query("q34_title", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def q34(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.collapse(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(
    "q35_sitemap_checks",
    "SELECT 'not_https' AS check_name, url AS subject FROM pages WHERE url NOT LIKE 'https://%' UNION ALL SELECT 'duplicate_loc', url FROM pages GROUP BY url HAVING count(*) > 1",
)
def q35(spark, sf):
    return site.sitemap_findings(table(spark, sf, "pages"), "url")


@query("q36_fragments", "SELECT page_id, regexp_extract(url, '#(.*)$', 1) AS fragment, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages")
def q36(spark, sf):
    frag = F.coalesce(F.try_url_decode(F.try_parse_url("url", F.lit("REF"))), F.lit(""))
    return table(spark, sf, "pages").select("page_id", frag.alias("fragment"), F.coalesce(F.try_parse_url("url", F.lit("QUERY")), F.lit("")).alias("query"))


@query(
    "q37_scan_with_line",
    f"""WITH p(kind, pattern) AS (VALUES ('ipv4', '{IPV4}'), ('email', '{EMAIL}')),
        m AS (SELECT doc_id, kind, string_split_regex(text, pattern) AS parts, regexp_extract_all(text, pattern) AS found FROM documents, p WHERE regexp_matches(text, pattern)),
        k AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)
        SELECT doc_id, kind, len(string_split(array_to_string(parts[1:i], ''), chr(10))) AS line, found[i] AS detail FROM k""",
)
def q37(spark, sf):
    """Every finding of each kind in a document, with its line."""
    rules = [scan.Rule("ipv4", IPV4, (".",), "[0-9]", 3), scan.Rule("email", EMAIL, ("@",), "[A-Za-z0-9._]", 1 << 30)]
    found = scan.matches(table(spark, sf, "documents"), "doc_id", "text", {"text": rules}, F.lit("text"))
    return found.select("doc_id", F.col("check_name").alias("kind"), "line", "detail")


@query(
    "q38_error_union",
    f"""SELECT check_name, count(*) AS n FROM (
            SELECT 'not_https' AS check_name FROM pages WHERE url NOT LIKE 'https://%'
            UNION ALL SELECT 'missing_main' FROM pages WHERE NOT regexp_matches(html, '<main[ >]')
            UNION ALL SELECT 'broken_link' FROM {HREF_SQL} WHERE href NOT IN (SELECT {PATH_SQL} FROM pages)
            UNION ALL SELECT 'address' FROM documents WHERE regexp_matches(text, '{IPV4}')) GROUP BY check_name""",
)
def q38(spark, sf):
    parts = [
        q35(spark, sf).filter("check_name = 'not_https'").select("check_name"),
        q32(spark, sf).filter("tag = 'main'").select(F.lit("missing_main").alias("check_name")),
        q30(spark, sf).select(F.lit("broken_link").alias("check_name")),
        table(spark, sf, "documents").filter(F.rlike("text", F.lit(IPV4))).select(F.lit("address").alias("check_name")),
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("check_name").agg(F.count("*").alias("n"))


@query(
    "q39_budgets",
    """WITH m AS (SELECT CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, count(*) AS requests FROM pages)
       SELECT 'bytes' AS metric, bytes AS value, 3000000 AS budget, bytes > 3000000 AS over FROM m UNION ALL SELECT 'requests', requests, 100, requests > 100 FROM m""",
)
def q39(spark, sf):
    return scan.over_budget(table(spark, sf, "pages").agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("requests")))


@query("q41_matrix", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def q41(spark, sf):
    """Every viewport with every selector: two small fixed relations."""
    return table(spark, sf, "region").select("r_name").crossJoin(table(spark, sf, "nation").select("n_name"))


@query(
    "q42_overflow_filter",
    """SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * 20 + 0.5) AS BIGINT) AS right_px FROM lineitem
       WHERE l_quantity > 0 AND (l_linenumber - 4 < -2 OR floor(l_quantity * 20 + 0.5) > 902)""",
)
def q42(spark, sf):
    rows = table(spark, sf, "lineitem").filter("l_quantity > 0").withColumns({"left_px": F.col("l_linenumber") - 4, "right_px": scan.rounded(F.col("l_quantity") * 20)})
    return rows.filter(scan.overflows(F.col("left_px"), F.col("right_px"), F.lit(900))).select("l_orderkey", "l_linenumber", "right_px")


@query(
    "q47_html_facts",
    r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-z][a-z0-9]*[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '<[a-z][a-z0-9]*[^>]*>'), 1) AS i FROM pages),
            f AS (SELECT page_id, i, 1 AS j, 'tag' AS kind, regexp_extract(tag, '^<([a-z0-9]+)', 1) AS key, '' AS value FROM t
                  UNION ALL SELECT page_id, i, 2, 'ref', 'href', regexp_extract(tag, ' href="([^"]*)"', 1) FROM t WHERE regexp_matches(tag, '^<a [^>]*href="[^"]')
                  UNION ALL SELECT page_id, 1000000000, 1, 'title', '', trim(regexp_replace(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) FROM pages)
        SELECT page_id, kind, key, value, row_number() OVER (PARTITION BY page_id ORDER BY i, j) AS pos FROM f""",
)
def q47(spark, sf):
    """Facts of every page by the HTML parser; these pages have no ids, metadata or images (q68 has)."""
    return site.html_facts(table(spark, sf, "pages"), "page_id", "html")


#: Markup that is put into pages by their number modulo 8, so that every kind of fact and finding occurs.
MARKUP = (
    '<a target="_blank" href="http://x.example/">x</a>\n<a target="_blank" href="http://x.example/">x</a>',
    '<a target="_blank" rel="noopener noreferrer" href="../y/">y</a>\n<img src="http://localhost/a.png" srcset="a.png 1x, b.png 2x">',
    '<button id="go" onclick="go()">go</button>\n<div id="go" ONLOAD = "x"></div>',
    "-----BEGIN RSA PRIVATE KEY-----",
    "ghp_abcdefghijklmnopqrstuv ghp_short xghp_abcdefghijklmnopqrstuv",
    '<meta name="Description" content=" about "><meta property="og:title" content="t"><meta name="description" content="again">',
    '<link rel="canonical icon" href="c.html#top"><video src="v.mp4" poster="p.png"></video>',
    "<a target='_blank' rel=\"noopener\" href=\"#go\">z</a>",
)
SCRIPT = ("eval (x)", "new  Function(1)", "document.write (y)", "evaluate(x); anew Function(z)")


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


FILES_SQL = f"""
    f AS (
        SELECT 'p' || page_id || '.html' AS path, html || chr(10) || [{", ".join(map(sql_text, MARKUP))}][page_id % 8 + 1] AS text FROM pages
        UNION ALL SELECT 'd' || doc_id || '.js', coalesce(text, '') || chr(10) || [{", ".join(map(sql_text, SCRIPT))}][doc_id % 4 + 1] FROM documents
        UNION ALL SELECT 'scripts/a.js', 'eval(x)')
"""


def site_files(spark, sf) -> DataFrame:
    """Pages with added markup as HTML files, documents with an added line as scripts."""

    def nth(values: tuple[str, ...], key: str):
        return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))

    pages = table(spark, sf, "pages").select(F.format_string("p%d.html", "page_id").alias("path"), F.concat_ws("\n", "html", nth(MARKUP, "page_id")).alias("text"))
    docs = table(spark, sf, "documents").select(F.format_string("d%d.js", "doc_id").alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), nth(SCRIPT, "doc_id")).alias("text"))
    own = spark.range(1).select(F.lit("scripts/a.js").alias("path"), F.lit("eval(x)").alias("text"))
    return pages.unionByName(docs).unionByName(own)


@query(
    "q67_security_findings",
    rf"""WITH {FILES_SQL},
        p(check_name, suffix, pattern) AS (VALUES ('private-key', 'l|js', '-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----'), ('github-token', 'l|js', '\bgh[pousr]_[A-Za-z0-9]{{20,}}\b'),
            ('insecure-resource', 'l', '(?i)\b(?:src|href)\s*=\s*["'']http://[^"'']+["'']'), ('inline-handler', 'l', '(?i)\son[a-z]+\s*=\s*["'']'),
            ('blank-target', 'l', '(?i)<a\b[^>]*target\s*=\s*["'']_blank["''][^>]*>'), ('eval', 'js', '\beval\s*\('), ('new-function', 'js', '\bnew\s+Function\s*\('), ('document-write', 'js', '\bdocument\.write\s*\(')),
        m AS (SELECT path, text, check_name, string_split_regex(text, pattern) AS parts, regexp_extract_all(text, pattern) AS found FROM f, p
              WHERE regexp_matches(path, '(' || suffix || ')$') AND NOT starts_with(path, 'scripts/') AND regexp_matches(text, pattern)),
        k AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
        o AS (SELECT path, check_name, found[i] AS detail, CASE check_name WHEN 'blank-target' THEN left(text, strpos(text, found[i]) - 1)
                     ELSE array_to_string(list_transform(range(1, i + 1), lambda j: parts[j] || CASE WHEN j < i THEN found[j] ELSE '' END), '') END AS head FROM k)
        SELECT check_name, path AS subject, len(string_split(head, chr(10))) AS line, regexp_replace(detail, '^\s+', '') AS detail FROM o
        WHERE NOT (check_name = 'insecure-resource' AND regexp_matches(detail, 'http://(127\.0\.0\.1|localhost)'))
          AND NOT (check_name = 'blank-target' AND list_has_all(string_split_regex(lower(regexp_extract(detail, '(?i)\brel\s*=\s*["'']([^"'']*)["'']', 1)), '\s+'), ['noopener', 'noreferrer']))""",
)
def q67(spark, sf):
    """Every unsafe pattern with its line in the files of a site."""
    return scan.security_findings(site_files(spark, sf)).withColumn("line", F.col("line").cast("bigint"))


@query(
    "q68_marked_up_facts",
    rf"""WITH {FILES_SQL}, h AS (SELECT path, string_split(text, chr(10))[-2:] AS tail, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) % 8 AS k FROM f WHERE ends_with(path, 'l'))
        SELECT path, kind, key, value, n FROM (
            SELECT path, 'id' AS kind, 'go' AS key, '' AS value, 2 AS n FROM h WHERE k = 2
            UNION ALL SELECT path, 'ref', 'href', 'http://x.example/', 2 FROM h WHERE k = 0
            UNION ALL SELECT path, 'ref', unnest(['href', 'src', 'srcset', 'srcset']), unnest(['../y/', 'http://localhost/a.png', 'a.png', 'b.png']), 1 FROM h WHERE k = 1
            UNION ALL SELECT path, unnest(['name', 'name', 'property']), unnest(['description', 'description', 'og:title']), unnest(['about', 'again', 't']), 1 FROM h WHERE k = 5
            UNION ALL SELECT path, unnest(['ref', 'canonical', 'icon', 'ref', 'ref']), unnest(['href', '', '', 'src', 'poster']), unnest(['c.html#top', 'c.html#top', 'c.html#top', 'v.mp4', 'p.png']), 1 FROM h WHERE k = 6
            UNION ALL SELECT path, 'ref', 'href', '#go', 1 FROM h WHERE k = 7)""",
)
def q68(spark, sf):
    """Facts of the added markup: what pages with it have besides tags, titles and links from the site's root."""
    facts = site.html_facts(site_files(spark, sf).filter("path LIKE 'p%.html'"), "path", "text")
    mine = facts.filter("kind NOT IN ('tag', 'title') AND NOT (kind = 'ref' AND value LIKE '/%')")
    return mine.groupBy("path", "kind", "key", "value").agg(F.count("*").cast("int").alias("n"))


@query(
    "q70_text_scans",
    r"""WITH d AS (SELECT doc_id, '/* ' || coalesce(text, '') || ' */' || chr(10) || 'a{background:URL( ''i' || doc_id || '.png'' )} b{src:url(data:1)} c{src:url(#p)} d{x:url(var(--q))} e{y:url("z.css")}' AS css,
                       CASE doc_id % 3 WHEN 0 THEN 'x' || chr(10) || '<<<<<<< HEAD' WHEN 1 THEN 'x <<<<<<< HEAD' ELSE '>>>>>>> b' END AS merged,
                       ' a' || doc_id || '.png 1x, ,b.png 2x,c' AS srcset, CASE doc_id % 4 WHEN 0 THEN 'Juan 3:16?' WHEN 1 THEN '3 : ' || doc_id WHEN 2 THEN 'a3:16' ELSE 'a las tres' END AS question FROM documents)
        SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(css, '(?i)url\(\s*([^)]+?)\s*\)', 1), lambda u: trim(u, chr(34) || chr(39))),
                                       lambda u: u <> '' AND NOT regexp_matches(u, '^(#|data:|var\()')), ' ') AS urls,
               regexp_matches(merged, '(?m)^(<<<<<<< |>>>>>>> )') AS conflict, array_to_string(list_filter(list_transform(string_split(srcset, ','), lambda x: regexp_extract(x, '^\s*(\S+)', 1)), lambda x: x <> ''), ' ') AS sources,
               regexp_matches(question, '\b\d+\s*:\s*\d+\b') AS cites FROM d""",
)
def q70(spark, sf):
    """References of style sheets and srcset, conflict markers and citations in texts with such marks added."""
    d = F.col("doc_id")
    marks = F.format_string("a{background:URL( 'i%d.png' )} b{src:url(data:1)} c{src:url(#p)} d{x:url(var(--q))} e{y:url(\"z.css\")}", d)
    css = F.concat(F.lit("/* "), F.coalesce("text", F.lit("")), F.lit(" */\n"), marks)
    merged = F.when(d % 3 == 0, "x\n<<<<<<< HEAD").when(d % 3 == 1, "x <<<<<<< HEAD").otherwise(">>>>>>> b")
    question = F.when(d % 4 == 0, "Juan 3:16?").when(d % 4 == 1, F.format_string("3 : %d", d)).when(d % 4 == 2, "a3:16").otherwise("a las tres")
    urls = F.transform(tx.css_urls(css), lambda u: F.regexp_replace(u, "^[\"']+|[\"']+$", ""))
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(F.filter(urls, tx.is_checked_css_url), " ").alias("urls"), tx.has_conflict_marker(merged).alias("conflict"),
        F.array_join(tx.srcset_urls(F.format_string(" a%d.png 1x, ,b.png 2x,c", d)), " ").alias("sources"), tx.has_citation(question).alias("cites"),
    )


REFERENCE_CASES = ("a.html#top", "sub/../b.html", "../out.html", "sub/", "#here", "", "/root", "http://else.example/x", "mailto:x@y", "c%20d.html", "./e.html?q=1", "sub/../../../x")


@query(
    "q69_resolved_links",
    f"""WITH c AS (SELECT unnest([{", ".join(map(sql_text, REFERENCE_CASES))}]) AS reference,
                          unnest(['docs/a.html', 'docs/b.html', 'out.html', 'docs/sub/index.html', NULL, NULL, NULL, NULL, NULL, 'docs/c d.html', 'docs/e.html', NULL]) AS path,
                          unnest(['top', '', '', '', 'here', '', '', '', '', '', '', '']) AS fragment, unnest([NULL, NULL, NULL, NULL, 1, 1, NULL, NULL, NULL, NULL, NULL, NULL]) AS own)
        SELECT page_id, reference, CASE WHEN own = 1 THEN 'docs/p' || page_id || '.html' ELSE path END AS path, fragment, reference = 'sub/../../../x' AS escapes FROM pages, c""",
)
def q69(spark, sf):
    """Where references of each kind lead to from a page in a folder."""
    cases = F.explode(F.array(*map(F.lit, REFERENCE_CASES))).alias("reference")
    edges = table(spark, sf, "pages").select("page_id", F.format_string("docs/p%d.html", "page_id").alias("source"), cases)
    return edges.withColumn("t", site.resolve("source", "reference")).select("page_id", "reference", "t.path", "t.fragment", "t.escapes")


@query(
    "q50_missing_fragments",
    """SELECT page_id, regexp_extract(url, '#(.+)$', 1) AS fragment FROM pages
       WHERE regexp_matches(url, '#.') AND NOT list_contains(regexp_extract_all(html, ' id="([^"]*)"', 1), regexp_extract(url, '#(.+)$', 1))""",
)
def q50(spark, sf):
    pages = table(spark, sf, "pages")
    ids = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(' id="([^"]*)"'), F.lit(1))).alias("fragment"))
    asked = pages.select("page_id", F.regexp_extract("url", "#(.+)$", 1).alias("fragment")).filter("fragment <> ''")
    return asked.join(ids, ["page_id", "fragment"], "left_anti")


@query("q51_required_missing", "SELECT 'src' || i AS source FROM (SELECT unnest(range(0, 26)) AS i) WHERE 'src' || i NOT IN (SELECT source FROM documents)")
def q51(spark, sf):
    required = spark.range(1).select(F.explode(F.array(*map(F.lit, SOURCES))).alias("source"))
    return required.join(table(spark, sf, "documents").select("source"), "source", "left_anti")


@query(
    "q52_canonical",
    """WITH c AS (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS canonical FROM pages)
       SELECT page_id, canonical, canonical IN (SELECT url FROM pages WHERE url LIKE 'https://%') AS in_sitemap, canonical = url AS same FROM c""",
)
def q52(spark, sf):
    locs = table(spark, sf, "pages").select(F.col("url").alias("loc")).filter(F.startswith("loc", F.lit("https://"))).distinct().withColumn("known", F.lit(True))
    rows = table(spark, sf, "pages").select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("canonical"))
    return rows.join(locs, F.col("canonical") == F.col("loc"), "left").select(
        "page_id", "canonical", F.coalesce("known", F.lit(False)).alias("in_sitemap"), (F.col("canonical") == F.col("url")).alias("same")
    )


@query("q55_kind_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def q55(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query(
    "q56_link_kinds",
    f"""SELECT kind, local, count(*) AS n FROM (
            SELECT CASE WHEN regexp_matches(href, '^(mailto|tel|data|javascript):') THEN 'other' WHEN regexp_matches(href, '^(https?:|//)') THEN 'remote' WHEN href LIKE '/%' THEN 'root'
                        WHEN href = '' OR href LIKE '#%' THEN 'fragment' ELSE 'local' END AS kind, false AS local FROM {HREF_SQL}
            UNION ALL SELECT 'remote', regexp_matches(url, '^https://[^/?#]*[.]example[.]com([/?#]|$)') AND regexp_extract(url, '^https://([^/?#]*)', 1) = 'm.example.com' FROM pages) GROUP BY ALL""",
)
def q56(spark, sf):
    links = edges(spark, sf).select(site.link_kind(F.col("href")).alias("kind"), F.lit(False).alias("local"))
    urls = table(spark, sf, "pages").select(site.link_kind(F.col("url")).alias("kind"), site.same_origin(F.col("url"), "https://m.example.com").alias("local"))
    return links.unionByName(urls).groupBy("kind", "local").agg(F.count("*").alias("n"))


@query(
    "q59_control_label",
    r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 80) AS label, CAST(floor(n_chars / 16.0 - 30 + 0.5) AS BIGINT) AS px FROM documents",
)
def q59(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scan.control_label(F.col("text")).alias("label"), scan.rounded(F.col("n_chars") / 16.0 - 30).alias("px"))


@query(
    "q60_clamp",
    """SELECT p_partkey, translate(trim(CASE WHEN p_size % 5 = 0 THEN 'Génesis' ELSE '<' || p_name || '> ' END), '<>', '') AS name,
              greatest(1.0, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE p_size - 10.0 END)::DOUBLE AS chapter FROM part""",
)
def q60(spark, sf):
    raw = F.when(F.col("p_size") % 3 == 0, "x").otherwise((F.col("p_size") - 10).cast("string"))
    name, number = passages.prepared(F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.concat(F.lit("<"), "p_name", F.lit("> "))), raw, "Génesis")
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), number.alias("chapter"))


@query(
    "q64_sitemap_xml",
    "SELECT page_id, CASE WHEN page_id % 5 < 2 THEN 0 ELSE 1 END AS n, CASE WHEN page_id % 5 >= 2 THEN url END AS loc, page_id % 5 < 2 AS broken FROM pages",
)
def q64(spark, sf):
    """Locations read back from a namespaced sitemap made of each page's URL; some are cut off, some have text after their end."""
    k = F.col("page_id") % 5
    safe = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    end = F.when(k == 0, "<url>").when(k == 1, "</urlset>more").otherwise("</urlset>")
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), safe, F.lit(" </loc></url><url><loc> </loc></url>"), end)
    found = table(spark, sf, "pages").select("page_id", site.parsed_sitemap(xml).alias("s"))
    return found.select("page_id", F.size("s.locs").alias("n"), F.try_element_at("s.locs", F.lit(1)).alias("loc"), F.col("s.error").isNotNull().alias("broken"))
