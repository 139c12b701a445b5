"""Evidence queries over the driver's tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions import quotes as Q
from corrobora.functions import replies as P
from corrobora.functions import text as T
from corrobora.functions import urls as U
from corrobora.operators import citations as X
from corrobora.operators import enrichment as N
from corrobora.operators import findings as K
from corrobora.operators import groups as G
from corrobora.operators import wice as W
from corrobora.operators.contains import containing, containing_normalized
from corrobora.plans.adapters import RAW_SQL, raw_results, table
from corrobora.sources import models as M
from corrobora.streaming import sweep as S


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def claim_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", F.lower(F.hex(T.claim_hash(F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301"))))).alias("claim_hash"), F.lower(F.hex(T.source_url_hash(F.concat(F.lit(" "), "source", F.lit("\n"))))).alias("url_hash"))


_COLLAPSED = rf"trim(regexp_replace(text, '[{T.JS_SPACE_RE2}]+', ' ', 'g'))"
_CLAIM_FORM = rf"trim(regexp_replace(nfc_normalize(replace(coalesce(text, ''), 'é', 'e' || chr(769))), '[{T.JS_SPACE_RE2}]+', ' ', 'g'))"
HASH_SQL = f"SELECT doc_id, sha256({_CLAIM_FORM}) AS claim_hash, sha256(source) AS url_hash FROM documents"


def url_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one host and path counted once a key."""
    key = F.regexp_extract("url", r"^([^?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(F.lower(F.hex(T.source_url_hash(key))).alias("url_hash")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


URL_DEDUP_SQL = "SELECT sha256(regexp_extract(url, '^([^?#]*)', 1)) AS url_hash, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1"


def page_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.html_text("html")
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(text).alias("n_chars"), F.sha2(text, 256).alias("text_hash"))


def _inside(tag: str) -> str:
    return f"regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)"


def _has(tag: str) -> str:
    return f"regexp_matches(html, '(?is)<{tag}[^>]*>.*?</{tag}>')"


PAGE_TEXT_SQL = rf"""WITH b AS (SELECT page_id, CASE WHEN {_has("article")} THEN {_inside("article")} WHEN {_has("main")} THEN {_inside("main")} WHEN {_has("body")} THEN {_inside("body")} END AS body FROM pages),
t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[{T.JS_SPACE_RE2}]+', ' ', 'g')) AS text FROM b)
SELECT page_id, CASE WHEN length(text) > 100 THEN least(length(text), 50000)::INTEGER END AS n_chars, CASE WHEN length(text) > 100 THEN sha256(substr(text, 1, 50000)) END AS text_hash FROM t"""


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(U.host("url").alias("host")).agg(F.count("*").alias("pages"), F.count_if(U.is_archive("url")).alias("archives"), F.count_if(U.is_internal("url")).alias("internal"), F.count_if(U.is_google_books("url")).alias("books"))


HOSTS_SQL = r"""SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, count(*) AS pages, count(*) FILTER (WHERE regexp_matches(url, '(?i)web\.archive\.org|archive\.(today|is|ph)|webcitation\.org')) AS archives,
  count(*) FILTER (WHERE regexp_matches(url, '(?i)Special:BookSources|^https?://[a-z0-9-]+\.wiki[a-z]+\.org/wiki/')) AS internal, count(*) FILTER (WHERE contains(url, 'books.google.')) AS books FROM pages GROUP BY 1"""


def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL functions over the pages' addresses and links made from them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    archived = F.concat(F.lit("https://web.archive.org/web/2024"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, "id_/").otherwise("/"), "url")
    links = F.array(F.lit("https://en.wikipedia.org/wiki/X"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://archive.ph/"), "url")).otherwise(F.col("url")), F.when(F.col("page_id") % 5 == 0, archived).otherwise(F.lit("https://b.example/")))
    note = F.concat(F.lit("See pp. "), (F.col("page_id") % 7).cast("string"), F.lit("-9"))
    return pages.select(
        "page_id", U.archive_parts(archived)["timestamp"].alias("stamp"), U.archive_parts(archived)["original_url"].alias("original"), U.footnote_url(links).alias("footnote"), U.dataset_url(links).alias("dataset_link"),
        U.page_number(note).alias("page"), U.fragment("url").alias("fragment"), U.source_key("url", F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 4)).alias("source_key"),
    )


URL_SQL = """WITH p AS (SELECT page_id, url, 'https://web.archive.org/web/2024' || page_id || CASE WHEN page_id % 2 = 0 THEN 'id_/' ELSE '/' END || url AS archived FROM pages),
l AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'https://archive.ph/' || url ELSE url END AS a, CASE WHEN page_id % 5 = 0 THEN archived ELSE 'https://b.example/' END AS b FROM p)
SELECT page_id, '2024' || page_id AS stamp, url AS original, CASE WHEN page_id % 5 = 0 THEN archived WHEN page_id % 3 <> 0 THEN url ELSE 'https://b.example/' END AS footnote,
  CASE WHEN page_id % 3 = 0 THEN a WHEN page_id % 5 = 0 THEN b ELSE url END AS dataset_link, (page_id % 7)::INTEGER AS page, nullif(CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#') + 1) END, '') AS fragment,
  CASE WHEN page_id % 4 <> 0 THEN url || '|page=' || (page_id % 4) ELSE url END AS source_key FROM l"""


def source_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to fetch: each (address, page) once, with how often it is cited."""
    pages = table(spark, sf_dir, "pages")
    key = U.source_key(F.regexp_extract("url", r"^([^?#]*)", 1), F.col("page_id") % 3)
    return pages.groupBy(key.alias("source_key")).agg(F.count("*").alias("cited"))


SOURCE_KEY_SQL = "WITH p AS (SELECT regexp_extract(url, '^([^?#]*)', 1) AS u, page_id % 3 AS n FROM pages) SELECT CASE WHEN n <> 0 THEN u || '|page=' || n ELSE u END AS source_key, count(*) AS cited FROM p GROUP BY 1"


def quote_exact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return containing(_documents(spark, sf_dir).select("doc_id", "text"), quotes)


QUOTE_JOIN_SQL = "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


def quote_normalized_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts with other quotation marks, dashes, spaces and case, and their first one and two words, in all documents."""
    items = table(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    other = F.translate(F.replace(F.replace(F.regexp_replace("text", " ", "  "), F.lit("'"), F.lit("\u2019")), F.lit("-"), F.lit("\u2013 ")), ascii_lowercase, ascii_uppercase)
    first = lambda n: F.concat_ws(" ", F.slice(F.split("text", " "), 1, n))
    quotes = items.select(F.explode(F.array(*(F.struct(F.concat("item_id", F.lit(kind)).alias("item_id"), q.alias("quote")) for kind, q in (("", other), ("/1", first(1)), ("/2", first(2)))))).alias("x")).select("x.*")
    return containing_normalized(_documents(spark, sf_dir).select("doc_id", "text"), quotes)


def _comparable_sql(c: str) -> str:
    space = f"[{T.JS_SPACE_RE2}]+"
    return f"lower(trim(regexp_replace(regexp_replace(translate({c}, chr(39) || '`\u2019\u2018\u201c\u201d\u2013\u2014', repeat(chr(34), 6) || '--'), '-{space}', '-', 'g'), '{space}', ' ', 'g')))"


NORMALIZED_JOIN_SQL = f"""
WITH q AS (SELECT item_id, unnest([
  {{'k': '', 'q': translate(replace(replace(replace(text, ' ', '  '), chr(39), '\u2019'), '-', '\u2013 '), '{ascii_lowercase}', '{ascii_uppercase}')}}, {{'k': '/1', 'q': string_split(text, ' ')[1]}}, {{'k': '/2', 'q': array_to_string(string_split(text, ' ')[:2], ' ')}}]) AS x FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT item_id || x.k AS item_id, {_comparable_sql("x.q")} AS q FROM q), d AS (SELECT doc_id, {_comparable_sql("text")} AS t FROM documents)
SELECT DISTINCT doc_id, item_id FROM d JOIN n ON q <> '' AND contains(t, q)"""


def quote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text held against the documents that contain it: verbatim ones are exact."""
    found = quote_exact_join(spark, sf_dir)
    docs, items = _documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    rows = found.join(docs, "doc_id").join(items, "item_id").withColumn("q", Q.check("text", "quote"))
    return rows.select("doc_id", "item_id", F.col("q.status").alias("status"), F.col("q.verified").alias("verified"))


QUOTE_CHECK_SQL = "SELECT doc_id, item_id, 'exact' AS status, true AS verified FROM documents d JOIN benchmark b ON contains(d.text, b.text)"


def quote_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with other quotation marks, dashes and spaces, held against their own texts."""
    quote = F.concat(F.lit("“"), F.replace(F.expr("substring(text, 1, length(text) div 2)"), F.lit(" "), F.lit("  ")), F.lit(" … "), F.upper(F.expr("substring(text, length(text) div 2 + 1)")), F.lit("”"))
    rows = _documents(spark, sf_dir).select("doc_id", Q.check("text", quote).alias("q"))
    return rows.select("doc_id", "q.status", "q.verified", F.size("q.segments").alias("segments"))


def quote_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of one and two segments made of each document, held against it: all seven statuses."""
    head, tail = (F.regexp_replace(F.regexp_replace(F.substring("text", at, 60), r"(?s)[.\u2026].*$", ""), f"^[{T.JS_SPACE},;:]+|[{T.JS_SPACE},;:]+$", "") for at in (1, 100))
    loud = F.replace(F.translate(head, ascii_lowercase, ascii_uppercase), F.lit(" "), F.lit("  "))
    none, two = F.lit("Nowhere in any of these texts"), lambda a, b: F.concat(a, F.lit(" ... "), b)
    made = {"blank": F.lit("  "), "gone": head, "few": F.substring(head, 1, 5), "same": head, "loud": loud, "half": two(head, none), "none": none, "both": two(loud, tail), "turned": two(tail, head)}
    rows = _documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), q.alias("quote")) for k, q in made.items()))).alias("x"))
    source = F.when(F.col("x.kind") != "gone", F.col("text"))
    return rows.select("doc_id", "x.kind", Q.check(source, "x.quote").alias("q")).select("doc_id", "kind", "q.status", "q.verified", F.size("q.segments").cast("long").alias("segments"))


def _part_sql(at: int) -> str:
    edge = f"[{T.JS_SPACE_RE2},;:]+"
    return f"regexp_replace(regexp_replace(substring(text, {at}, 60), '(?s)[.\u2026].*$', ''), '^{edge}|{edge}$', '', 'g')"


STATUS_SQL = f"""
WITH p AS (SELECT doc_id, text, {_part_sql(1)} AS a, {_part_sql(100)} AS b, 'Nowhere in any of these texts' AS none FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, replace(translate(a, '{ascii_lowercase}', '{ascii_uppercase}'), ' ', '  ') AS loud FROM p),
k AS (SELECT doc_id, text, unnest([
  {{'k': 'blank', 'x': '', 'y': ''}}, {{'k': 'gone', 'x': a, 'y': ''}}, {{'k': 'few', 'x': substring(a, 1, 5), 'y': ''}}, {{'k': 'same', 'x': a, 'y': ''}}, {{'k': 'loud', 'x': loud, 'y': ''}},
  {{'k': 'half', 'x': a, 'y': none}}, {{'k': 'none', 'x': none, 'y': ''}}, {{'k': 'both', 'x': loud, 'y': b}}, {{'k': 'turned', 'x': b, 'y': a}}]) AS v FROM l),
q AS (SELECT doc_id, v.k AS kind, CASE WHEN v.k = 'gone' THEN '' ELSE text END AS src, v.x AS x, v.y AS y, v.x <> '' AND v.y <> '' AS two,
  CASE WHEN v.k IN ('half', 'both', 'turned') THEN trim(v.x || ' ... ' || v.y) ELSE trim(v.x) END AS quote FROM k),
n AS (SELECT *, {_comparable_sql("src")} AS h, {_comparable_sql("x")} AS nx, {_comparable_sql("y")} AS ny, length({_comparable_sql("quote")}) AS size FROM q),
f AS (SELECT *, two AND length(nx) < 12 AS sx, two AND length(ny) < 12 AS sy, CASE WHEN nx = '' THEN 0 ELSE strpos(h, nx) END AS px FROM n),
g AS (SELECT *, (x <> '')::INT + (y <> '')::INT AS many, CASE WHEN x = '' THEN 0 ELSE (sx OR px > 0)::INT END
  + CASE WHEN y = '' THEN 0 ELSE (sy OR (ny <> '' AND strpos(substring(h, CASE WHEN NOT sx AND px > 0 THEN px + length(nx) ELSE 1 END), ny) > 0))::INT END AS hits FROM f),
s AS (SELECT *, CASE WHEN quote = '' THEN 'empty' WHEN trim(src) = '' THEN 'no-source' WHEN size < 12 THEN 'too-short' WHEN contains(src, quote) THEN 'exact'
  WHEN hits = 0 THEN 'not-found' WHEN hits = many THEN 'normalized' ELSE 'partial' END AS status FROM g)
SELECT doc_id, kind, status, status IN ('exact', 'normalized') AS verified, CASE WHEN status IN ('empty', 'no-source', 'too-short') THEN 0 WHEN status = 'exact' THEN 1 ELSE many END::BIGINT AS segments FROM s"""


def _replica(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tl_from"), F.col("l_partkey").alias("tl_target_id"), F.lit(0).alias("tl_from_namespace"))
    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lt_id"), F.lit(10).alias("lt_namespace"), F.col("p_type").alias("lt_title"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("page_title"), F.col("o_custkey").alias("page_latest"), F.lit(0).alias("page_namespace"), (F.col("o_orderstatus") == "P").cast("int").alias("page_is_redirect"))
    return links, targets, pages


def selection_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of candidates: orders that use a part, by order key above a mark."""
    return K.candidates(*_replica(spark, sf_dir), "ECONOMY", after=100, most=500)


def selection_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1,000 candidates in pages of 300, the last one shorter."""
    tables = _replica(spark, sf_dir)
    return K.all_candidates(lambda after, limit: K.candidates(*tables, "ECONOMY", after=after, most=limit), most=1000, page=300)


SELECTION_SQL = """SELECT o_orderkey AS page_id, replace(o_orderpriority, '_', ' ') AS title, o_custkey AS revision_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey > 100
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY') ORDER BY o_orderkey LIMIT 500"""


PAGES_SQL = SELECTION_SQL.replace("o_orderkey > 100", "o_orderkey > 0").replace("LIMIT 500", "LIMIT 1000")


def findings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the hash of their claim; a second batch is written over the first."""
    docs = _documents(spark, sf_dir).select(F.lower(F.hex(T.claim_hash("text"))).alias("claim_hash"), "doc_id", F.col("lang").alias("verdict"), F.col("doc_id").alias("created_at"))
    old = docs.groupBy("claim_hash").agg(F.min("doc_id").alias("doc_id"), F.min_by("verdict", "doc_id").alias("verdict"), F.min("created_at").alias("created_at"))
    new = docs.where("doc_id % 3 = 0").withColumn("verdict", F.upper("verdict"))
    return K.upsert(old, new, ["claim_hash"], ["doc_id"])


UPSERT_SQL = f"""WITH d AS (SELECT sha256({_CLAIM_FORM}) AS claim_hash, doc_id, lang AS verdict FROM documents),
o AS (SELECT claim_hash, min(doc_id) AS doc_id, arg_min(verdict, doc_id) AS verdict FROM d GROUP BY 1), n AS (SELECT claim_hash, max(doc_id) AS doc_id, upper(arg_max(verdict, doc_id)) AS verdict FROM d WHERE doc_id % 3 = 0 GROUP BY 1)
SELECT o.claim_hash, coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.verdict, o.verdict) AS verdict, o.doc_id AS created_at FROM o LEFT JOIN n USING (claim_hash)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("wiki"), F.col("event_id").alias("revid"), F.col("ts").cast("timestamp").alias("timestamp"), F.concat("event_type", F.lit(" "), "props").alias("comment"))


def sweep_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second sweep over the last 48 hours adds only edits that the log lacks."""
    changes = _changes(spark, sf_dir)
    log = changes.where("revid % 2 = 0")
    end = changes.agg(F.max("timestamp").alias("now"))
    recent = changes.crossJoin(F.broadcast(end))  # one row
    recent = S.within(recent, 48, F.col("now")).drop("now")
    return S.sweep(recent.union(recent), log, 'VIEW {"k": 1', F.lit("now")).select("wiki", "revid", "first_seen")


SWEEP_SQL = """WITH e AS (SELECT *, event_type || ' ' || props AS c FROM events)
SELECT event_type AS wiki, event_id AS revid, 'now' AS first_seen FROM e WHERE event_id % 2 = 1 AND contains(lower(c), 'view {"k": 1') AND ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3 == 0).alias("text_between"), "role")
    return G.islands(rows, ["conv_id"], "turn", F.col("text_between"))


def adjacency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns; every third one opens a new run."""
    return _turns(spark, sf_dir).select("conv_id", "turn", "island", "group_size", "group_index")


ADJACENCY_SQL = """WITH i AS (SELECT conv_id, turn, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM conversations)
SELECT conv_id, turn, island, count(*) OVER (PARTITION BY conv_id, island) AS group_size, (row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1)::INTEGER AS group_index FROM i"""


def group_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts of groups, one a conversation, of its turns as sources."""
    members = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("group_id"), F.col("turn").alias("group_index"), F.col("turn").cast("string").alias("citation_number"), F.when(F.col("turn") % 4 != 3, F.concat(F.lit("u"), "role")).alias("url"),
        F.lit(None).cast("int").alias("page_num"), F.when(F.col("turn") % 4 < 2, F.concat(F.lit("Source Content:\n"), "text")).alias("content"), F.lit(404).alias("status"), F.lit("gone").alias("error"),
    )
    return G.assemble(members).select("group_id", F.sha2("text", 256).alias("text_hash"), "sources", "available", "skipped")


GROUP_SQL = r"""WITH m AS (SELECT conv_id AS g, turn AS i, CASE WHEN turn % 4 <> 3 THEN 'u' || role END AS url, CASE WHEN turn % 4 < 2 THEN text END AS content FROM conversations),
k AS (SELECT *, coalesce(url, '__nourl_' || i) AS key FROM m),
s AS (SELECT g, key, min(i) AS "at", string_agg('[' || i || ']', '' ORDER BY i) AS nums, arg_min(coalesce(url, '-'), i) AS url, arg_min(coalesce(content, ''), i) AS content FROM k GROUP BY g, key),
b AS (SELECT g, "at", regexp_replace(regexp_replace(content, '^\s+', ''), '\s+$', '') AS body, 'Source ' || nums || CASE WHEN url = '-' THEN '' ELSE ' (' || url || ')' END || ':' || chr(10) AS label FROM s)
SELECT g AS group_id, sha256(string_agg(label || CASE WHEN body <> '' THEN body ELSE '[This source could not be retrieved: HTTP 404]' END, chr(10) || chr(10) ORDER BY "at")) AS text_hash, count(*) AS sources, count(*) FILTER (WHERE body <> '') AS available,
  count(*) FILTER (WHERE body <> '') <= 1 AS skipped FROM b GROUP BY g"""


def _judge_together(prompt: str) -> str:
    """A model that goes by the number of sources it is shown."""
    n = prompt.count("\nSource [")
    return f'{{"verdict": "{"SUPPORTED" if n > 2 else "NOT SUPPORTED"}", "confidence": {10 * min(n, 9)}, "source_quote": "", "comments": "c"}}'


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("group_id"), F.col("turn").alias("group_index"), F.col("turn").cast("string").alias("citation_number"), F.concat(F.lit("u"), F.col("turn").cast("string")).alias("url"), F.lit(None).cast("int").alias("page_num"),
        F.when(F.col("turn") % 3 != 1, F.concat(F.lit("Source Content:\n"), F.replace(F.col("text"), F.lit("Source"), F.lit("source")))).alias("content"), F.lit(404).alias("status"), F.lit("gone").alias("error"),
    )


def collective_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict a conversation on its turns as sources; those with at most one source are skipped."""
    members = _members(spark, sf_dir)
    claims = members.select("group_id").distinct().withColumn("claim_text", F.lit("c"))
    return N.verify_groups(members, claims, _judge_together).select("group_id", "skipped", "sources", "available", "verdict", "confidence", "quote_status")


COLLECTIVE_SQL = rf"""WITH m AS (SELECT conv_id, CASE WHEN turn % 3 <> 1 THEN regexp_replace(coalesce(text, ''), '^[{T.JS_SPACE_RE2}]+|[{T.JS_SPACE_RE2}]+$', '', 'g') ELSE '' END AS body FROM conversations),
g AS (SELECT conv_id AS group_id, count(*) AS sources, count(*) FILTER (WHERE body <> '') AS available FROM m GROUP BY 1)
SELECT group_id, available <= 1 AS skipped, sources, available, CASE WHEN available <= 1 THEN NULL WHEN sources > 2 THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END AS verdict,
  CASE WHEN available > 1 THEN (10 * least(sources, 9))::INTEGER END AS confidence, CASE WHEN available > 1 THEN 'empty' END AS quote_status FROM g"""


#: Calls of the query below go round these: all registered providers, and one name that isn't.
_CALLED = (*M.REGISTRY, "retired-model")


def provider_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made of events, joined with the registry of providers: how many went to each and how they ended; names without an entry stay."""
    calls = table(spark, sf_dir, "events").select(F.get(F.array(*map(F.lit, _CALLED)), (F.col("event_id") % len(_CALLED)).cast("int")).alias("provider"), "user_id", (F.col("event_type") == "error").alias("failed"))
    counted = calls.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failed"), F.count_distinct("user_id").alias("users"))
    known = M.dimension(spark, M.REGISTRY).select("provider", "model", "kind", F.col("key_env").isNotNull().alias("has_key"))
    return counted.join(known, "provider", "left").select("provider", "model", "kind", "has_key", "calls", "failed", "users")


_ENTRIES = ", ".join(f"('{k}', '{p.model}', '{p.kind}', {'true' if p.key_env else 'false'})" for k, p in M.REGISTRY.items())
REGISTRY_SQL = f"""WITH r(provider, model, kind, has_key) AS (VALUES {_ENTRIES}),
c AS (SELECT [{", ".join(f"'{k}'" for k in _CALLED)}][event_id % {len(_CALLED)} + 1] AS provider, user_id, event_type = 'error' AS failed FROM events)
SELECT provider, any_value(model) AS model, any_value(kind) AS kind, any_value(has_key) AS has_key, count(*) AS calls, count(*) FILTER (failed) AS failed, count(DISTINCT user_id) AS users FROM c LEFT JOIN r USING (provider) GROUP BY provider"""


def manual_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents entered by hand as sources, at most 80,000 characters each."""
    made = _documents(spark, sf_dir).select("doc_id", T.manual_source("text").alias("m"))
    return made.select("doc_id", F.char_length("m.content").alias("chars"), F.sha2("m.content", 256).alias("content_hash"), F.col("m.truncated").alias("truncated"))


MANUAL_SQL = rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[{T.JS_SPACE_RE2}]+|[{T.JS_SPACE_RE2}]+$', '', 'g') AS x FROM documents), f AS (SELECT doc_id, x, CASE WHEN x <> '' THEN 'Manual source text:' || chr(10) || chr(10) || substr(x, 1, 80000) END AS c FROM t)
SELECT doc_id, length(c)::INTEGER AS chars, sha256(c) AS content_hash, CASE WHEN c IS NOT NULL THEN length(x) > 80000 END AS truncated FROM f"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.get(F.array(*map(F.lit, ["SUPPORTED", "PARTIALLY SUPPORTED", "NOT SUPPORTED", "SOURCE UNAVAILABLE", "ERROR"])), (F.col("pos") % 5).cast("int"))
    turns = _turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("island").cast("string")).alias("group_id"), "group_size", "conv_id")
    results = turns.withColumn("verdict", verdict)
    collective = results.where("group_size > 1 AND conv_id % 5 <> 0").groupBy("group_id").agg(F.max(F.col("conv_id") % 3 == 0).alias("skipped"), F.min("verdict").alias("verdict"))
    return G.report_units(results, collective)


def report_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir)


_UNITS = """WITH i AS (SELECT conv_id, conv_id * 1000 + turn AS pos, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM conversations),
r AS (SELECT *, conv_id || '/' || island AS group_id, count(*) OVER (PARTITION BY conv_id, island) AS size, (['SUPPORTED', 'PARTIALLY SUPPORTED', 'NOT SUPPORTED', 'SOURCE UNAVAILABLE', 'ERROR'])[pos % 5 + 1] AS verdict FROM i),
g AS (SELECT group_id, conv_id % 3 = 0 AS skipped, min(verdict) AS verdict, min(pos) AS "at", count(*) AS n FROM r WHERE size > 1 AND conv_id % 5 <> 0 GROUP BY ALL),
units AS (
  SELECT pos AS "at", pos, 'solo' AS kind, verdict, 1::BIGINT AS citations FROM r WHERE size = 1
  UNION ALL SELECT "at", "at", 'group', verdict, n FROM g WHERE NOT skipped
  UNION ALL SELECT g."at", r.pos, 'member', r.verdict, 1 FROM r JOIN g USING (group_id) WHERE g.skipped)"""
UNITS_SQL = f"{_UNITS} SELECT * FROM units"


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.report_counts(_units(spark, sf_dir))


_BUCKET = "CASE verdict WHEN 'SUPPORTED' THEN 'supported' WHEN 'PARTIALLY SUPPORTED' THEN 'partial' WHEN 'NOT SUPPORTED' THEN 'not_supported' WHEN 'SOURCE UNAVAILABLE' THEN 'unavailable' ELSE 'error' END"
COUNTS_SQL = f"{_UNITS} SELECT {_BUCKET} AS bucket, count(*) AS units, sum(citations)::BIGINT AS citations FROM units GROUP BY 1"


def report_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.visible(_units(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


VISIBLE_SQL = f"{_UNITS} SELECT kind, count(*) AS n FROM units WHERE verdict <> 'SUPPORTED' GROUP BY kind"


def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return G.section_number(rows, ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "section")


SECTION_SQL = "SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS section FROM conversations"


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as claims with their lines as evidence, conversations as subclaims."""
    docs = _documents(spark, sf_dir)
    lines = F.split("text", "\n", -1)
    claims = docs.select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.get(F.array(F.lit("supported"), F.lit("partially_supported"), F.lit("not_supported")), (F.col("doc_id") % 3).cast("int")).alias("label"), F.col("text").alias("claim"),
        F.concat(F.array(F.concat(F.lit("(meta data) TITLE: T"), F.col("doc_id").cast("string"))), lines).alias("evidence"), F.array(F.array(F.lit(2), F.lit(1)), F.array(F.lit(1), (F.col("doc_id") % 30).cast("int"))).alias("supporting_sentences"),
        F.concat(F.lit("A b"), F.col("doc_id").cast("string")).alias("claim_title"), F.lit("").alias("claim_section"), F.when(F.col("doc_id") % 2 == 0, "Before").alias("claim_context"),
    )
    labels = F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 0), "not_supported").otherwise("supported")
    subclaims = table(spark, sf_dir, "conversations").select(F.col("turn").alias("pos"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), labels.alias("label"))
    return claims, subclaims


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.convert(*_claims(spark, sf_dir), "dev")


def wice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["id", "article_url", "article_title", "claim_container", "ground_truth", "needs_manual_review", "wice_label_projection", "wice_subclaim_count", "wice_evidence_sentence_count", "wice_source_truncated", "source_title"]
    return _converted(spark, sf_dir).select(*columns, F.sha2("source_text", 256).alias("source_hash"), F.array_join(F.transform("wice_supporting_sentences", lambda x: x.cast("string")), ",").alias("supporting"))


_WICE = f"""WITH d AS (SELECT doc_id, text, list_concat(['T' || doc_id], string_split(text, chr(10))) AS raw FROM documents),
e AS (SELECT doc_id, text, list_concat(['TITLE: T' || doc_id], string_split(text, chr(10))) AS ev FROM d),
x AS (SELECT doc_id, unnest(ev) AS s, generate_subscripts(ev, 1) AS i FROM e),
y AS (SELECT *, sum(length(s) + CASE WHEN i = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM x),
k AS (SELECT doc_id, count(*) AS n, coalesce(min(i) FILTER (WHERE total > {W.MOST_CHARS}) - 1, count(*)) AS kept FROM y GROUP BY doc_id),
t AS (SELECT y.doc_id, coalesce(string_agg(s, ' ' ORDER BY i), '') AS source_text FROM y JOIN k USING (doc_id) WHERE i <= kept GROUP BY y.doc_id),
sub AS (SELECT conv_id AS doc_id, count(*) AS n_sub, count(DISTINCT CASE WHEN conv_id % 4 = 0 AND turn = 0 THEN 'not_supported' ELSE 'supported' END) AS n_labels FROM conversations GROUP BY 1),
r AS (
  SELECT e.doc_id, text, k.n, k.kept, coalesce(source_text, '') AS source_text, coalesce(n_sub, 0) AS n_sub, coalesce(n_labels, 0) AS n_labels, list_sort(list_distinct([2, 1, (e.doc_id % 30)::INTEGER])) AS sup
  FROM e JOIN k USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN sub USING (doc_id)),
w AS (SELECT *, len(list_filter(sup, lambda v: v >= kept)) > 0 AS lost, CASE n_labels WHEN 0 THEN 'unknown' WHEN 1 THEN 'unanimous' ELSE 'mixed' END AS projection, (['Supported', 'Partially supported', 'Not supported'])[doc_id % 3 + 1] AS truth FROM r)"""
WICE_SQL = f"""{_WICE} SELECT 'wice_c' || doc_id AS id, 'https://en.wikipedia.org/wiki/A_b' || doc_id AS article_url, 'A b' || doc_id AS article_title, CASE WHEN doc_id % 2 = 0 THEN 'Before ' ELSE '' END || text AS claim_container,
  truth AS ground_truth, lost AS needs_manual_review, projection AS wice_label_projection, n_sub::INTEGER AS wice_subclaim_count, n::INTEGER AS wice_evidence_sentence_count, kept < n AS wice_source_truncated, 'T' || doc_id AS source_title,
  sha256(source_text) AS source_hash, array_to_string(sup, ',') AS supporting FROM w"""


def split_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.summary(_converted(spark, sf_dir))


TALLY_SQL = f"""{_WICE}, f AS (SELECT 'dev' AS a, truth AS b, projection AS c, kept < n AS cut, lost FROM w)
SELECT CASE WHEN grouping(a) = 0 THEN 'split' WHEN grouping(b) = 0 THEN 'ground_truth' WHEN grouping(c) = 0 THEN 'projection' ELSE 'total' END AS tally, coalesce(a, b, c, 'all') AS value, count(*) AS n, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE lost) AS flagged
FROM f GROUP BY GROUPING SETS ((a), (b), (c), ())"""


def log_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("check_id"), F.col("source").alias("provider"), F.concat(F.lit("  "), "text").alias("claim_text"), F.lit(" ").alias("comments"), F.concat(F.lit("0"), F.col("doc_id").cast("string")).alias("revision_id"))
    return N.log_payload(rows).select("check_id", "kind", "provider", "revision_id", F.char_length("claim_text").alias("claim_chars"), F.sha2("claim_text", 256).alias("claim_hash"), "llm_comments")


_TRIMMED = rf"regexp_replace(text, '^[{T.JS_SPACE_RE2}]+|[{T.JS_SPACE_RE2}]+$', '', 'g')"
LOG_SQL = f"""WITH t AS (SELECT doc_id, source, {_TRIMMED} AS x FROM documents), c AS (SELECT *, CASE WHEN x = '' THEN NULL WHEN length(x) > 2000 THEN substr(x, 1, 1999) || '…' ELSE x END AS y FROM t)
SELECT doc_id::VARCHAR AS check_id, 'source' AS kind, source AS provider, nullif(doc_id, 0) AS revision_id, length(y)::INTEGER AS claim_chars, sha256(y) AS claim_hash, NULL::VARCHAR AS llm_comments FROM c"""


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean claims, excerpts, escapes and statuses over the documents."""
    docs = _documents(spark, sf_dir).where(F.col("text").isNotNull())
    marked = F.concat(F.lit(" [12]\n"), "text", F.lit("[citation needed]"), F.lit("  x[3]"))
    return docs.select(
        "doc_id", T.clean_claim(marked, "text").alias("claim"), T.excerpt("text", 60).alias("short"), T.escape_html(F.concat(F.lit("<a href='x'>&"), "text")).alias("escaped"),
        T.extraction_status(F.when(F.col("doc_id") % 4 != 0, F.col("text")), F.when(F.col("doc_id") % 3 != 0, F.col("source")), F.when(F.col("doc_id") % 5 != 0, F.col("text"))).alias("status"),
        T.minutes_left(F.col("doc_id"), F.col("doc_id") % 7).alias("minutes"), F.sha2(T.user_prompt(F.lit("c"), F.concat(F.lit("x\nSource Content:\n"), "text")), 256).alias("prompt_hash"),
    )


_CLAIM = rf"trim(regexp_replace(text || '  x', '[{T.JS_SPACE_RE2}]+', ' ', 'g'))"
TEXT_SQL = rf"""SELECT doc_id, CASE WHEN length({_CLAIM}) < 10 THEN {_COLLAPSED} ELSE {_CLAIM} END AS claim, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '…' ELSE text END AS short,
  '&lt;a href=&#39;x&#39;&gt;&amp;' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  CASE WHEN doc_id % 4 = 0 OR text = '' THEN 'claim_extraction_failed' WHEN doc_id % 3 = 0 THEN 'no_source_url' WHEN doc_id % 5 = 0 THEN 'source_fetch_failed' ELSE 'complete' END AS status,
  ceil((doc_id * 7 + doc_id % 7 * 8) / 60.0)::BIGINT AS minutes, sha256('Claim: "c"' || chr(10) || chr(10) || 'Source text:' || chr(10) || text) AS prompt_hash FROM documents WHERE text IS NOT NULL"""


def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in several forms, read as verdicts."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"verdict": "NOT SUPPORTED", "confidence": '), k, F.lit(', "comments": "c", "quote": " q "}'))
    forms = [body, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```")), F.concat(F.lit("I think "), body, F.lit(" is it")), F.lit("**Verdict:** Partially supported"), F.concat(F.lit("no idea "), k)]
    reply = F.get(F.array(*forms), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", P.parsed(reply).alias("r")).select("event_id", "r.*")


REPLY_SQL = """WITH e AS (SELECT event_id, event_id % 5 AS f, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE WHEN f < 3 THEN 'NOT SUPPORTED' WHEN f = 3 THEN 'PARTIALLY SUPPORTED' ELSE 'PARSE_ERROR' END AS verdict, CASE WHEN f < 3 THEN k::INTEGER END AS confidence,
  CASE WHEN f < 3 THEN 'c' WHEN f = 3 THEN '<extracted from non-JSON response>' ELSE 'Failed to parse AI response: no idea ' || k END AS comments, NULL::VARCHAR AS reason_type, CASE WHEN f < 3 THEN 'q' ELSE '' END AS source_quote FROM e"""


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles made of documents: each line a paragraph with two references, adjacent, parted by a comma or in mid-sentence; footnotes with links of all kinds, short cites among them."""
    half = lambda s: F.floor(F.char_length(s) / 2).cast("int")
    line = lambda s, i: F.concat(
        F.when(i % 10 == 9, "<h2>h</h2>").otherwise(""), F.lit("<p>"), F.when(i % 3 == 2, F.substr(s, F.lit(1), half(s))).otherwise(s),
        F.format_string('<sup id="r%d" class="reference"><a href="./T#n%d">[%d]</a></sup>', i, i % 6, i + 1), F.when(i % 3 == 0, "").when(i % 3 == 1, ", ").otherwise(F.substr(s, half(s) + 1)),
        F.format_string('<sup id="s%d" class="reference"><a href="#m">[0]</a></sup></p>', i),
    )
    notes = F.lit(
        '<ol><li id="n0"><a href="https://a.example/">a</a> pp. 7</li><li id="n1"><a href="https://en.wikipedia.org/wiki/X">x</a></li><li id="n2"><a href="#CITEREFa">A</a>, p. 3</li><li id="n3"><a href="#CITEREFb">B</a> p 12</li>'
        '<li id="n4"><a href="https://archive.is/x">y</a><a href="https://web.archive.org/web/1/https://c.example/">c</a></li><li id="m"><a href="https://archive.is/x">y</a><a href="https://b.example/">b</a></li>'
        '<li><cite id="CITEREFa">A</cite> <a href="https://full.example/a">f</a></li><li><cite id="CITEREFb">B <a href="https://full.example/b">f</a></cite></li></ol>'
    )
    lines = F.transform(F.split(F.regexp_replace("text", "[<>&\\[\\]]", ""), "\n", -1), lambda s, i: line(s, i))
    docs = _documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.concat(F.array_join(lines, ""), notes).alias("html"))
    found = X.extract_citations(docs, containers=False)
    return found.select("doc_id", "pos", "ref_id", "citation_number", "claim_text", "url", "page_num", "group_id", "group_size", "group_index", F.array_join("group_citation_numbers", " ").alias("group_numbers"), "section", "occurrence", "total_occurrences")


CITATION_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '[<>&\[\]]', '', 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, left(s, (length(s) // 2)::BIGINT) AS a, substr(s, (length(s) // 2 + 1)::BIGINT) AS b FROM l),
r AS (
  SELECT doc_id, i, 0 AS k, 'n' || i % 6 AS ref_id, (i + 1)::VARCHAR AS num, CASE WHEN i % 3 = 2 THEN a ELSE s END AS said, s || CASE WHEN i % 3 = 1 THEN ', ' ELSE '' END AS whole FROM h
  UNION ALL SELECT doc_id, i, 1, 'm', '0', CASE i % 3 WHEN 0 THEN s WHEN 1 THEN ', ' ELSE b END, s || CASE WHEN i % 3 = 1 THEN ', ' ELSE '' END FROM h),
c AS (SELECT *, trim(regexp_replace(said, '[{T.JS_SPACE_RE2}]+', ' ', 'g')) AS said1, trim(regexp_replace(whole, '[{T.JS_SPACE_RE2}]+', ' ', 'g')) AS whole1 FROM r),
k AS (SELECT *, CASE WHEN length(said1) < 10 THEN whole1 ELSE said1 END AS claim_text FROM c),
n(ref_id, url, page_num) AS (VALUES ('n0', 'https://a.example/', 7), ('n1', NULL, NULL), ('n2', 'https://full.example/a', 3), ('n3', 'https://full.example/b', 12), ('n4', 'https://web.archive.org/web/1/https://c.example/', NULL), ('m', 'https://b.example/', NULL)),
f AS (SELECT * FROM k WHERE length(claim_text) >= 10)
SELECT doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INTEGER AS pos, ref_id, num AS citation_number, claim_text, url, page_num,
  CASE WHEN i % 3 = 0 OR k = 0 THEN 'r' ELSE 's' END || i AS group_id, CASE WHEN i % 3 = 0 THEN 2 ELSE 1 END AS group_size, CASE WHEN i % 3 = 0 THEN k ELSE 0 END AS group_index,
  CASE WHEN i % 3 = 0 THEN (i + 1) || ' 0' ELSE num END AS group_numbers, ((i + 1) // 10)::INTEGER AS section,
  (row_number() OVER (PARTITION BY doc_id, num ORDER BY i, k))::INTEGER AS occurrence, (count(*) OVER (PARTITION BY doc_id, num))::INTEGER AS total_occurrences
FROM f LEFT JOIN n USING (ref_id)
"""


def feedback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged checks and their ratings; a check without any stays, a rating without a check goes."""
    logs = raw_results(spark, sf_dir).select(F.col("pos").alias("check_id"), "provider")
    ratings = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("check_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("rating"))
    return logs.join(ratings, "check_id", "left").groupBy("provider").agg(F.count("*").alias("checks"), F.count("rating").alias("rated"), F.count_if(F.col("rating") == 1).alias("up"))


FEEDBACK_SQL = f"WITH {RAW_SQL} SELECT provider, count(*) AS checks, count(quality) AS rated, count(*) FILTER (WHERE quality = 1) AS up FROM raw_results LEFT JOIN labels ON doc_id = pos GROUP BY provider"

QUERIES = {
    "claim_hash": (claim_hashes, HASH_SQL), "url_hash_dedup": (url_hash_dedup, URL_DEDUP_SQL), "page_text_extract": (page_text_extract, PAGE_TEXT_SQL), "page_hosts": (page_hosts, HOSTS_SQL), "url_functions": (url_functions, URL_SQL),
    "source_key_dedup": (source_key_dedup, SOURCE_KEY_SQL), "quote_exact_join": (quote_exact_join, QUOTE_JOIN_SQL), "quote_normalized_join": (quote_normalized_join, NORMALIZED_JOIN_SQL), "selection_pages": (selection_pages, PAGES_SQL), "quote_checks": (quote_checks, QUOTE_CHECK_SQL), "quote_normalized": (quote_normalized, None), "quote_statuses": (quote_statuses, STATUS_SQL),
    "selection_keyset": (selection_keyset, SELECTION_SQL), "findings_upsert": (findings_upsert, UPSERT_SQL), "sweep_dedup": (sweep_dedup, SWEEP_SQL), "adjacency_groups": (adjacency_groups, ADJACENCY_SQL), "group_assembly": (group_assembly, GROUP_SQL),
    "report_units": (report_units, UNITS_SQL), "report_counts": (report_counts, COUNTS_SQL), "report_visible": (report_visible, VISIBLE_SQL), "section_numbers": (section_numbers, SECTION_SQL), "wice_rows": (wice_rows, WICE_SQL), "split_tallies": (split_tallies, TALLY_SQL),
    "log_payload": (log_payload, LOG_SQL), "text_functions": (text_functions, TEXT_SQL), "reply_parse": (reply_parse, REPLY_SQL), "citation_extract": (citation_extract, CITATION_SQL), "feedback_join": (feedback_join, FEEDBACK_SQL), "collective_verdicts": (collective_verdicts, COLLECTIVE_SQL), "provider_registry": (provider_registry, REGISTRY_SQL),
    "manual_sources": (manual_sources, MANUAL_SQL),
}
