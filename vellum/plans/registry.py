"""Registered queries over the engine's operators and the SQL that they are held against."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.operators import fix, json_output, tables, validate
from vellum.operators.query import Query
from vellum.operators.resolve import resolve, with_path_type
from vellum.sources import corpus
from vellum.sources.schema import Schema, presets, schema
from vellum.sources.store import materialise
from vellum.streaming import revalidate

TYPES = {
    "order": """
paths: ['orders/*.md']
fields:
  status: {type: enum, values: [F, O], required: true}
  priority: {type: string, required: true}
  cust: {type: integer}
  rush: {type: bool}
  note: {type: string}
structure:
  title: required
  sections:
    - {title: Items, bullets: unordered, properties: {quantity: {type: integer}, flag: {type: string}}}
    - {title: Customer, template: '- [Name](path)', links: {target_type: customer, bidirectional: true}}
""",
    "customer": """
paths: ['customers/*.md']
fields:
  name: {type: string, required: true}
  segment: {type: enum, values: [BUILDING, MACHINERY, FURNITURE, HOUSEHOLD]}
  nation: {type: integer, required: true}
structure:
  title: from_filename
  sections:
    - {title: Orders, links: {target_type: order}}
""",
    "log": """
paths: ['log/*/????-??.md']
fields:
  user: {type: integer, required: true}
structure:
  title: from_date
  date_headings: {sort: newest_first}
""",
    "supplier": """
structure:
  title: required
  intro: {bullets: unordered}
  sections:
    - {title: Facts, properties: {code: {type: integer, required: true}, balance: {type: float}}}
    - {title: Notes, bullets: unordered}
    - {title: Old Rules, required: false}
    - title: Rules
      required: false
      managed_content: {template: "## Rules\\n\\n- be fair\\n", migrate_from: [Old Rules]}
""",
    "prose": """
fields:
  lang: {type: string}
structure:
  size_warning: 4000
""",
}


@cache
def _schema() -> Schema:
    return schema(TYPES)


def _orders(spark, d):
    return Query(corpus.orders(spark, d), _schema())


def _docs(spark: SparkSession, files: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    return materialise(_once(files, columns))


def _once(files: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Resolved documents for a plan that reads them once."""
    return resolve(tables.parse(files, columns), _schema())


def _parsed(files: DataFrame, *columns: str) -> DataFrame:
    """Parsed columns by path alone."""
    return tables.parse(files.select("rel_path", "dir", "content"), columns)


def _both(spark, d, columns=None):
    return _docs(spark, corpus.orders(spark, d).unionByName(corpus.customers(spark, d)), columns)


#: Parsed columns that ``tables.links``, ``tables.properties`` and ``tables.sections`` need.
LINKS = ("links.line", "links.url", "links.is_image", "links.section_idx", "links.section_title")
PROPERTIES = ("items.item_id", "items.parent", "items.text", "items.section_idx", "items.section_title")
SECTIONS = ("blocks.idx", "blocks.kind", "blocks.level", "blocks.line", "blocks.text")


def _diag(rows: DataFrame) -> DataFrame:
    return rows.select("rel_path", "code", F.col("line").cast("long").alias("line"), "message")


O_PATH = "'orders/' || strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '.md'"
C_PATH = "'customers/' || c_custkey || '.md'"
#: A text is one paragraph once it is escaped, where its lines begin with a letter and don't end in a space; else a fence.
PARAGRAPH = r"regexp_full_match(text, '\p{L}([^\n\r]*\S)?(\n\p{L}([^\n\r]*\S)?)*')"
BODY = f"CASE WHEN coalesce(text, '') = '' THEN '' WHEN {PARAGRAPH} THEN replace(text, chr(10), ' ') || chr(10) ELSE rtrim(text, chr(10)) || chr(10) END"
MARKED = r"'[*&|!#_<>\[\]\\`~]'"
TICKS = "greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1)"
FENCED = f"repeat('`', {TICKS}) || chr(10) || text || chr(10) || repeat('`', {TICKS})"
#: Suppliers whose front matter can be read.
S = "(SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 23 <> 0)"
NEWEST = f"CAST(o_orderdate AS DATE) DESC, {O_PATH} DESC"
LOG_ORDER = "CASE WHEN user_id % 3 = 0 THEN event_id ELSE epoch_us(ts) END"
TITLE = "CASE WHEN c_custkey % 7 = 0 THEN 'Customer ' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END"


def _property_rows(spark, d):
    p = tables.properties(_parsed(corpus.orders(spark, d), *PROPERTIES))
    return p.groupBy("section_title", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("try_cast(value AS BIGINT)")).alias("total"))


def _fixed_logs(spark, d):
    return fix.format_documents(with_path_type(corpus.logs(spark, d), _schema()), _schema())


def _fixed_heads(spark, d):
    again = corpus.with_path_columns(_fixed_logs(spark, d).select("rel_path", F.col("formatted").alias("content")))
    return tables.parse(again).select("rel_path", F.posexplode(F.filter("blocks", lambda b: b.level == 2)).alias("n", "b")).select("rel_path", F.col("n").cast("long").alias("n"), F.left("b.text", F.lit(16)).alias("at"))


def _not_idempotent(spark, d):
    once = corpus.with_path_columns(_fixed_logs(spark, d).select("rel_path", F.col("formatted").alias("content")))
    return fix.format_documents(with_path_type(once, _schema()), _schema()).where("changed").select("rel_path")


def _fixed_titles(spark, d):
    out = fix.format_documents(with_path_type(corpus.customers(spark, d), _schema()), _schema())
    again = corpus.with_path_columns(out.select("rel_path", F.col("formatted").alias("content")))
    return tables.parse(again).select("rel_path", "title")


def _fixed_suppliers(spark, d):
    out = fix.format_documents(with_path_type(corpus.suppliers(spark, d), _schema()), _schema())
    docs = tables.parse(corpus.with_path_columns(out.select("rel_path", F.col("formatted").alias("content")))).where("fm_present")
    within = tables.items(docs).groupBy("rel_path").agg(F.max((F.col("section_title") == "Rules") & (F.col("text") == "be fair")).alias("rules"), F.max(F.col("text") == "own rule").alias("own_rule"), F.max(F.col("section_title") == "Old Rules").alias("old"))
    return within


def _known(spark, d):
    docs = _both(spark, d, LINKS)
    return docs.where("NOT (rel_path LIKE 'customers/%' AND CAST(stem AS BIGINT) % 10 = 3)")


def _bfs(spark, d):
    docs = _both(spark, d, LINKS)
    return json_output.reachable(docs, docs.where("rel_path LIKE 'orders/%-0000000001.md'").select("rel_path"), 2).select("rel_path", F.col("depth").cast("long").alias("depth"))


def _stale(spark, d):
    docs = _docs(spark, corpus.customers(spark, d))
    found = validate.titles(docs, _schema())
    return revalidate.stale(found, found.where("rel_path NOT LIKE '%7.md'"))


def _types_of(spark, d):
    files = corpus.orders(spark, d).unionByName(corpus.customers(spark, d)).unionByName(corpus.logs(spark, d)).unionByName(corpus.documents(spark, d))
    return _once(files, ()).groupBy("doc_type", "resolution").agg(F.count(F.lit(1)).alias("n"))


def _codes(spark, d):
    files = corpus.orders(spark, d).unionByName(corpus.customers(spark, d))
    docs = materialise(validate.with_hits(_once(files), _schema()).select(*validate.LINKED))
    return validate.check(docs, _schema()).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


#: name: (query, SQL)
_ALL = {
    "q_property_eq": (lambda s, d: _orders(s, d).type("order").property("status=F").last(10).paths(), f"SELECT {O_PATH} AS rel_path FROM orders WHERE o_orderstatus = 'F' ORDER BY {NEWEST} LIMIT 10"),
    "q_property_multi": (lambda s, d: _orders(s, d).property("status=O").property("rush=yes").count(), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 0"),
    "q_property_number": (lambda s, d: _orders(s, d).property("cust=7").paths(), f"SELECT {O_PATH} AS rel_path FROM orders WHERE o_custkey = 7"),
    "q_last_n": (lambda s, d: _orders(s, d).last(25).paths(), f"SELECT {O_PATH} AS rel_path FROM orders ORDER BY {NEWEST} LIMIT 25"),
    "q_filename_glob": (lambda s, d: _orders(s, d).filename_glob("????-0[13]-*.md").paths(), f"SELECT {O_PATH} AS rel_path FROM orders WHERE month(o_orderdate) IN (1, 3)"),
    "q_days_asof": (lambda s, d: _orders(s, d).days(90, "1998-01-01").count(), "SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01' - 90"),
    "q_count_cap": (lambda s, d: _orders(s, d).property("status=P").last(20).count(), "SELECT least(20, count(*)) AS n FROM orders WHERE o_orderstatus = 'P'"),
    "q_has_link": (lambda s, d: _orders(s, d).has_link("customers/1").paths(), f"SELECT {O_PATH} AS rel_path FROM orders WHERE CAST(o_custkey AS VARCHAR) LIKE '1%'"),
    "q_type_path": (lambda s, d: Query(corpus.customers(s, d), _schema()).type("customer").count(), "SELECT count(*) AS n FROM customer"),
    "r_types": (_types_of, f"SELECT * FROM (SELECT 'order' AS doc_type, 'explicit' AS resolution, count(*) AS n FROM orders UNION ALL SELECT 'customer', 'path', count(*) FROM customer UNION ALL SELECT 'log', 'path', count(DISTINCT user_id) FROM events UNION ALL SELECT 'prose', 'explicit', count(*) FROM documents) WHERE n > 0"),
    "x_body_text": (lambda s, d: _parsed(corpus.documents(s, d), "body_text").select("rel_path", "body_text"), f"SELECT 'documents/' || doc_id || '.md' AS rel_path, {BODY} AS body_text FROM documents"),
    "q_grep_ci": (lambda s, d: Query(corpus.documents(s, d), _schema()).grep("The AND").paths(), f"SELECT 'documents/' || doc_id || '.md' AS rel_path FROM documents WHERE contains(lower({BODY}), 'the and')"),
    "v_size_warning": (lambda s, d: validate.sizes_and_types(_once(corpus.documents(s, d), ()), _schema()).select("rel_path", "code"), f"SELECT 'documents/' || doc_id || '.md' AS rel_path, 'FileTooLarge' AS code FROM documents WHERE octet_length(encode(coalesce(text, ''))) + CASE WHEN coalesce(text, '') = '' THEN 0 WHEN {PARAGRAPH} THEN length(text) - length(regexp_replace(text, {MARKED}, '', 'g')) ELSE 2 * {TICKS} + 2 END + octet_length(encode('---' || chr(10) || 'type: prose' || chr(10) || 'lang: ' || coalesce(lang, '') || chr(10) || 'source: ' || coalesce(source, '') || chr(10) || '---' || chr(10))) + 1 > 4000"),
    "j_json": (lambda s, d: Query(corpus.documents(s, d), _schema()).json().select("rel_path", F.get_json_object("json", "$.type").alias("type"), F.get_json_object("json", "$.frontmatter.lang").alias("lang"), F.get_json_object("json", "$.intro").alias("intro")), f"SELECT 'documents/' || doc_id || '.md' AS rel_path, 'prose' AS type, lang, CASE WHEN coalesce(text, '') = '' THEN NULL WHEN {PARAGRAPH} THEN text ELSE {FENCED} END AS intro FROM documents"),
    "x_fields": (lambda s, d: tables.fields(_parsed(corpus.orders(s, d))).where("key IN ('cust', 'rush', 'status')").select("rel_path", "key", "kind", "json"), f"SELECT {O_PATH} AS rel_path, 'cust' AS key, 'int' AS kind, CAST(o_custkey AS VARCHAR) AS json FROM orders UNION ALL SELECT {O_PATH}, 'rush', 'bool', 'true' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT {O_PATH}, 'status', 'string', '\"' || o_orderstatus || '\"' FROM orders"),
    "x_items": (lambda s, d: tables.items(_parsed(corpus.orders(s, d), "items.depth", "items.text", "items.has_children", "items.section_title")).where("depth = 0 AND section_title = 'Items'").select("rel_path", "text", "has_children"), f"SELECT {O_PATH} AS rel_path, 'Part ' || l_partkey AS text, true AS has_children FROM orders JOIN lineitem ON l_orderkey = o_orderkey"),
    "x_properties": (_property_rows, "SELECT 'Items' AS section_title, 'quantity' AS key, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'Items', 'flag', count(*), CAST(NULL AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "x_links": (lambda s, d: tables.links(_parsed(corpus.orders(s, d), *LINKS)).select("rel_path", "section_title", "url", "target"), f"SELECT {O_PATH} AS rel_path, 'Customer' AS section_title, '../customers/' || o_custkey || '.md' AS url, 'customers/' || o_custkey || '.md' AS target FROM orders"),
    "x_sections": (lambda s, d: tables.sections(_parsed(corpus.orders(s, d), *SECTIONS)).select("rel_path", "heading", F.col("level").cast("long").alias("level")), f"SELECT {O_PATH} AS rel_path, h AS heading, CAST(2 AS BIGINT) AS level FROM orders, (VALUES ('Items'), ('Customer')) v(h)"),
    "x_blocks": (lambda s, d: tables.blocks(_parsed(corpus.logs(s, d), "blocks.kind", "blocks.section_title")).where("kind = 'paragraph'").groupBy("rel_path").agg(F.count(F.lit(1)).alias("n"), F.count("section_title").alias("inside")), "SELECT 'log/' || user_id || '/2024-01.md' AS rel_path, count(*) AS n, count(*) AS inside FROM events GROUP BY user_id"),
    "j_title": (lambda s, d: _parsed(corpus.customers(s, d), "title").select("rel_path", "title"), f"SELECT {C_PATH} AS rel_path, {TITLE} AS title FROM customer"),
    "j_sections": (lambda s, d: _orders(s, d).json().select("rel_path", F.get_json_object("json", "$.sections[0].items").alias("items"), F.get_json_object("json", "$.sections[1].links[0].url").alias("url")), f"SELECT {O_PATH} AS rel_path, '[' || string_agg('{{\"text\":\"Part ' || l_partkey || '\",\"properties\":{{\"quantity\":' || CAST(l_quantity AS BIGINT) || ',\"flag\":\"' || l_returnflag || '\"}}}}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) || ']' AS items, '../customers/' || o_custkey || '.md' AS url FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_custkey"),
    "j_bfs_depth2": (_bfs, f"WITH o AS (SELECT {O_PATH} AS p, o_orderkey, o_custkey FROM orders), s AS (SELECT * FROM o WHERE o_orderkey = 1) SELECT p AS rel_path, CAST(0 AS BIGINT) AS depth FROM s UNION ALL SELECT {C_PATH}, 1 FROM s JOIN customer ON c_custkey = s.o_custkey UNION ALL SELECT o.p, 2 FROM s JOIN customer ON c_custkey = s.o_custkey JOIN o ON o.o_custkey = c_custkey WHERE o.o_orderkey % 2 = 0"),
    "v_field_enum": (lambda s, d: _diag(validate.fields(_once(corpus.orders(s, d), ()), _schema())), f"SELECT {O_PATH} AS rel_path, 'InvalidFieldType' AS code, CAST(1 AS BIGINT) AS line, 'field ''status'': invalid value ''P'' (allowed: F, O)' AS message FROM orders WHERE o_orderstatus = 'P'"),
    "v_fields_customer": (lambda s, d: _diag(validate.fields(_once(corpus.customers(s, d), ()), _schema())), f"""SELECT {C_PATH} AS rel_path, 'MissingRequiredField' AS code, CAST(1 AS BIGINT) AS line, 'missing required field ''nation''' AS message FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 11 <> 0
UNION ALL SELECT {C_PATH}, 'InvalidFieldType', 1, 'field ''nation'': expected integer, got string' FROM customer WHERE c_custkey % 11 = 0
UNION ALL SELECT {C_PATH}, 'InvalidFieldType', 1, 'field ''segment'': invalid value ''' || c_mktsegment || ''' (allowed: BUILDING, MACHINERY, FURNITURE, HOUSEHOLD)' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD')"""),
    "v_title_mismatch": (lambda s, d: validate.titles(_once(corpus.customers(s, d)), _schema()).select("rel_path", "code", "message"), f"SELECT {C_PATH} AS rel_path, 'H1Mismatch' AS code, 'H1 ''Customer ' || c_custkey || ''' does not match expected ''' || c_custkey || '''' AS message FROM customer WHERE c_custkey % 7 = 0"),
    "v_entries_order": (lambda s, d: validate.date_headings(_once(corpus.logs(s, d)), _schema()).select("rel_path", "code"), f"WITH h AS (SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M') AS k, lag(strftime(ts, '%Y-%m-%d %H:%M')) OVER (PARTITION BY user_id ORDER BY {LOG_ORDER}, event_id) AS p FROM events) SELECT DISTINCT 'log/' || user_id || '/2024-01.md' AS rel_path, 'EntriesOutOfOrder' AS code FROM h WHERE p < k"),
    "v_link_broken": (lambda s, d: validate.broken_links(_known(s, d)).where("rel_path LIKE 'orders/%'").select("rel_path", "message"), f"SELECT {O_PATH} AS rel_path, 'broken link: ''../customers/' || o_custkey || '.md''' AS message FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL OR c_custkey % 10 = 3"),
    "v_backlink_missing": (lambda s, d: validate.section_links(_both(s, d, LINKS), _schema()).select("rel_path", "code", "message"), f"SELECT {O_PATH} AS rel_path, 'MissingBacklink' AS code, 'link to ''../customers/' || o_custkey || '.md'' requires a backlink in section ''Orders''' AS message FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 1"),
    "v_sections": (lambda s, d: validate.sections(_once(corpus.suppliers(s, d)), _schema()).groupBy("code", "message").agg(F.count(F.lit(1)).alias("n")), f"SELECT * FROM (SELECT 'MissingSection' AS code, 'required section ''Facts'' is missing' AS message, count(*) AS n FROM {S} WHERE k % 17 = 0 UNION ALL SELECT 'UnexpectedSection', 'unexpected section ''Extra'' (allowed: Facts, Notes, Old Rules, Rules)', count(*) FROM {S} WHERE k % 11 = 0 UNION ALL SELECT 'SectionOutOfOrder', 'section ''Facts'' appears out of order', count(*) FROM {S} WHERE k % 13 = 0 AND k % 17 <> 0 UNION ALL SELECT 'SectionsOutOfOrder', 'sections are out of order', count(*) FROM {S} WHERE k % 13 = 0 AND k % 17 <> 0 UNION ALL SELECT 'WrongListType', 'section ''Notes'': expected unordered list', count(*) FROM {S} WHERE k % 3 = 0 UNION ALL SELECT 'SectionNotBullets', 'section ''Notes'': only bullet lists are allowed here', count(*) FROM {S} WHERE k % 3 <> 0 AND k % 7 = 0) WHERE n > 0"),
    "v_intro": (lambda s, d: _diag(validate.intros(_once(corpus.suppliers(s, d)), _schema())), f"SELECT 'suppliers/' || k || '.md' AS rel_path, 'SectionNotBullets' AS code, CAST(6 AS BIGINT) AS line, 'intro: only bullet lists are allowed here' AS message FROM {S} WHERE k % 2 = 1"),
    "v_properties": (lambda s, d: _diag(validate.properties(_once(corpus.suppliers(s, d)), _schema())).drop("line"), f"SELECT 'suppliers/' || k || '.md' AS rel_path, 'MissingRequiredField' AS code, 'missing required field ''Facts/code''' AS message FROM {S} WHERE k % 6 = 0 AND k % 17 <> 0 UNION ALL SELECT 'suppliers/' || k || '.md', 'InvalidFieldType', 'field ''Facts/balance'': must be a number (got ''none'')' FROM {S} WHERE k % 5 = 0 AND k % 17 <> 0"),
    "v_managed": (lambda s, d: validate.managed_sections(_once(corpus.suppliers(s, d)), _schema()).select("rel_path", "code"), f"SELECT 'suppliers/' || k || '.md' AS rel_path, 'ManagedSectionNeedsUpdate' AS code FROM {S} WHERE k % 19 = 0 OR k % 9 = 0 OR k % 8 = 0"),
    "v_malformed": (lambda s, d: validate.spaced_links(_once(corpus.suppliers(s, d))).select("rel_path", "code", "message"), "SELECT 'suppliers/' || s_suppkey || '.md' AS rel_path, 'MalformedLink' AS code, 'link ''a b.md'' contains an unencoded space (use %20 or rename the file)' AS message FROM supplier WHERE s_suppkey % 4 = 0"),
    "v_unreadable": (lambda s, d: validate.sizes_and_types(_once(corpus.suppliers(s, d)), _schema()).select("rel_path", "code", "line", F.substring_index("message", ":", 1).alias("message")), "SELECT 'suppliers/' || s_suppkey || '.md' AS rel_path, 'UnknownType' AS code, 1 AS line, 'frontmatter parse error' AS message FROM supplier WHERE s_suppkey % 23 = 0"),
    "f_managed": (_fixed_suppliers, f"SELECT 'suppliers/' || k || '.md' AS rel_path, true AS rules, k % 10 = 0 AND k % 19 <> 0 AND k % 9 <> 0 AND k % 8 <> 0 AS own_rule, k % 9 = 0 AND k % 19 <> 0 AND false AS old FROM {S}"),
    "f_titles": (_fixed_titles, f"SELECT {C_PATH} AS rel_path, CAST(c_custkey AS VARCHAR) AS title FROM customer"),
    "f_sort_entries": (_fixed_heads, "SELECT 'log/' || user_id || '/2024-01.md' AS rel_path, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M') DESC) - 1 AS n, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events"),
    "f_idempotent": (_not_idempotent, "SELECT '' AS rel_path WHERE false"),
    "l_stale_clear": (_stale, f"SELECT {C_PATH} AS rel_path FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 10 = 7"),
    "agg_diagnostics": (_codes, None),
    "s_presets": (lambda s, d: presets(s).select("name"), "SELECT * FROM (VALUES ('agent'), ('agents'), ('command'), ('journal'), ('journal-entry'), ('readme'), ('roadmap'), ('skill')) v(name)"),
}

QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _ALL.items() if sql}
#: All diagnostics of orders and customers are those of five queries, with every missing customer a broken link.
_BROKEN = "SELECT 'UnknownType' AS code FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL"
ORACLE_SQL["agg_diagnostics"] = "SELECT code, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT code FROM ({ORACLE_SQL[k]})" for k in ("v_field_enum", "v_fields_customer", "v_title_mismatch", "v_backlink_missing")) + f" UNION ALL {_BROKEN}) GROUP BY code"
FLAGSHIP = "q_property_eq"
