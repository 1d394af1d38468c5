"""Queries over text functions, table payloads, annotation payloads and record files."""

from pyspark.sql import functions as F

from secondpass.catalog import views
from secondpass.catalog.common import Catalog, rounded
from secondpass.catalog.views import with_views
from secondpass.functions import text
from secondpass.operators import records as alignment
from secondpass.operators import tables
from secondpass.session import pin, scratch_path, spread
from secondpass.sources import payloads, records

catalog = Catalog()

WS = r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NORMAL = f"trim(regexp_replace(nfc_normalize(%s), '{WS}+', ' ', 'g'), ' ')"

TEXTS = """texts AS (SELECT 'document-' || doc_id AS id, text FROM documents
  UNION ALL SELECT 'page-' || page_id, html FROM pages
  UNION ALL SELECT 'turn-' || conv_id || '-' || turn, text FROM conversations)
"""


def texts(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").selectExpr("concat('document-', doc_id) AS id", "text")
    p = views.table(spark, sf_dir, "pages").selectExpr("concat('page-', page_id) AS id", "html AS text")
    c = views.table(spark, sf_dir, "conversations").selectExpr("concat('turn-', conv_id, '-', turn) AS id", "text")
    return d.unionByName(p).unionByName(c)


@catalog.add("normalize_text", "WITH " + TEXTS + f"SELECT id, sha256({NORMAL % 'text'}) AS digest, length({NORMAL % 'text'}) AS n FROM texts")
def normalize_text(spark, sf_dir):
    normal = texts(spark, sf_dir).select("id", text.normalize_text(F.col("text")).alias("t"))
    return normal.selectExpr("id", "sha2(t, 256) AS digest", "CAST(length(t) AS BIGINT) AS n")


@catalog.add("normalize_numeric_token", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  '-' || l_suppkey || '%' AS token FROM lineitem""")
def normalize_numeric_token(spark, sf_dir):
    dashes = F.array(*[F.lit(d) for d in text.DASHES])
    raw = F.concat(F.element_at(dashes, (F.col("l_partkey") % 9 + 1).cast("int")), F.lit(" "), F.col("l_suppkey").cast("string"), F.lit(" %"))
    return views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", text.normalize_numeric_token(raw).alias("token"))


@catalog.add("extract_numeric_tokens")
def extract_numeric_tokens(spark, sf_dir):
    found = texts(spark, sf_dir).select("id", text.extract_numeric_tokens(F.col("text")).alias("tokens"))
    return found.select("id", F.size("tokens").alias("token_count"), F.array_join("tokens", "|").alias("tokens"))


@catalog.add("cell_numeric_tokens", with_views("lines cells", """
SELECT sample_id, row_start, column_start, CASE WHEN regexp_matches(text, '[0-9]') THEN
  CASE WHEN contains(text, '-') THEN replace(text, '-', '|') ELSE text END ELSE '' END AS tokens FROM cells"""))
def cell_numeric_tokens(spark, sf_dir):
    return views.cells(spark, sf_dir).select(
        "sample_id", "row_start", "column_start", F.array_join(text.extract_numeric_tokens(F.col("text")), "|").alias("tokens"))


@catalog.add("is_numeric_looking", with_views("lines cells", """
SELECT column_start, count(*) AS cells, count(*) FILTER (regexp_matches(text, '[0-9]')) AS numeric_cells FROM cells GROUP BY ALL"""))
def is_numeric_looking(spark, sf_dir):
    return views.cells(spark, sf_dir).withColumn("_n", text.is_numeric_looking(F.col("text"))).groupBy("column_start").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if("_n").alias("numeric_cells"))


@catalog.add("native_format", "WITH " + TEXTS + f"""SELECT coalesce(CASE WHEN contains(lower(text), '<table') THEN 'html'
  WHEN starts_with(lower(regexp_replace(text, '^{WS}+', '')), '<fcel>') THEN 'paddle_table_tokens'
  WHEN contains(text, '|') THEN 'markdown' END, 'none') AS format, count(*) AS texts FROM texts GROUP BY 1""")
def native_format(spark, sf_dir):
    return texts(spark, sf_dir).groupBy(F.coalesce(text.native_format(F.col("text")), F.lit("none")).alias("format")).agg(
        F.count(F.lit(1)).alias("texts"))


@catalog.add("strip_special_tokens", f"""SELECT conv_id, turn,
  sha256(regexp_replace(regexp_replace(text, '^{WS}+', ''), '{WS}+$', '')) AS digest FROM conversations""")
def strip_special_tokens(spark, sf_dir):
    tails = F.array(F.lit(""), F.lit("<|user|>"), F.lit(" <|assistant|> \n<|endoftext|> "), F.lit("<|end_of_text|>"))
    c = views.table(spark, sf_dir, "conversations")
    raw = F.concat(F.col("text"), F.element_at(tails, (F.col("turn") % 4 + 1).cast("int")))
    return c.select("conv_id", "turn", F.sha2(text.strip_special_tokens(raw), 256).alias("digest"))


@catalog.add("sanitize_error", r"""SELECT page_id, left(trim(regexp_replace(regexp_replace('bad  input at ' || url || ' : ' || title,
  '[\t\n\r \x{A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g'), '([A-Za-z]:[\\/]|/)[^\s,;"'']+', '<path>', 'g')), 500) AS message
FROM (SELECT page_id, url, repeat(url || ' ', 20) AS title FROM pages)""")
def sanitize_error(spark, sf_dir):
    raw = F.expr("concat('bad  input at ', url, ' : ', repeat(concat(url, ' '), 20))")
    return views.table(spark, sf_dir, "pages").select("page_id", text.sanitize_error(raw).alias("message"))


@catalog.add("normalize_label", """SELECT p_type, p_name, count(*) AS parts,
  regexp_replace(regexp_replace(lower('-' || p_type || ' / ' || p_name || '!'), '[^a-z0-9]', '_', 'g'), '^_+|_+$', '', 'g') AS label
FROM part GROUP BY p_type, p_name""")
def normalize_label(spark, sf_dir):
    raw = F.concat(F.lit("-"), "p_type", F.lit(" / "), "p_name", F.lit("!"))
    return views.table(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.count(F.lit(1)).alias("parts")).withColumn(
        "label", text.normalize_label(raw))


@catalog.add("safe_path", """SELECT c_custkey, c_custkey % 7 IN (0, 1) AS safe FROM customer""")
def safe_path(spark, sf_dir):
    kinds = F.array(*[F.lit(p) for p in ("pdf_files/%s.pdf", "./pdf_files//%s.PDF", "/pdf_files/%s.pdf", "pdf_files/../%s.pdf",
                                          "other/%s.pdf", "pdf_files/%s.txt", " ")])
    pattern = F.element_at(kinds, (F.col("c_custkey") % 7 + 1).cast("int"))
    return views.table(spark, sf_dir, "customer").select(
        "c_custkey", text.is_safe_path(F.replace(pattern, F.lit("%s"), F.col("c_name")), "pdf_files", ".pdf").alias("safe"))


# ---------------------------------------------------------------- table payloads

def html_payloads(spark, sf_dir):
    """One HTML table per sheet; every 17th order lacks its closing tag."""
    span = F.when(F.col("column_end") - F.col("column_start") > 1, ' colspan="2"').otherwise("")
    opening = F.when(F.col("column_start") > 0, "").when(F.col("row_start") > 0, "</tr><tr>").otherwise("<tr>")
    piece = F.concat(opening, F.lit("<td"), span, F.lit(">"), F.col("text"), F.lit("</td>"))
    return spread(views.cells(spark, sf_dir), "sample_id", "order_key").groupBy("sample_id", "order_key").agg(
        F.array_sort(F.collect_list(F.struct("row_start", "column_start", piece.alias("piece")))).alias("pieces")
    ).selectExpr("sample_id", "order_key", "concat('<table>', array_join(pieces.piece, ''), '</tr>', "
                 "if(order_key % 17 = 0, '', '</table>')) AS payload")


BAD_HTML = """SELECT sample_id, 'parse_failed' AS status, NULL::VARCHAR AS format, 'html: ends in place table' AS error,
  NULL::INTEGER AS row_start, NULL::INTEGER AS row_end, NULL::INTEGER AS column_start, NULL::INTEGER AS column_end,
  NULL::VARCHAR AS text, NULL::BOOLEAN AS is_column_header, NULL::BOOLEAN AS is_row_header
FROM (SELECT DISTINCT sample_id FROM cells WHERE order_key % 17 = 0)"""
GOOD_HTML = """SELECT sample_id, 'success' AS status, 'html' AS format, NULL AS error, row_start, row_end, column_start, column_end, text,
  false AS is_column_header, false AS is_row_header FROM cells WHERE order_key % 17 <> 0"""


@catalog.add("parse_html_table", with_views("lines cells", GOOD_HTML + " UNION ALL " + BAD_HTML))
def parse_html_table(spark, sf_dir):
    return tables.parse_tables(html_payloads(spark, sf_dir), ["sample_id"], "payload", "html")


@catalog.add("canonicalize_reference_html", with_views("lines cells", GOOD_HTML + " UNION ALL " + BAD_HTML))
def canonicalize_reference_html(spark, sf_dir):
    return tables.parse_tables(html_payloads(spark, sf_dir), ["sample_id"], "payload", "html", strict=False)


def markdown_payloads(spark, sf_dir):
    """One pipe table per sheet; every 17th order has a code fence."""
    row = F.expr("concat('| ', concat_ws(' | ', t0, t1, replace(concat(t2, '|'), '|', '\\\\|'), t3), ' |', "
                 "if(r = 0, '\\n|---|:--|--:|:-:|', ''))")
    return spread(views.lines(spark, sf_dir).select("sample_id", "order_key", "r", row.alias("row")), "sample_id", "order_key").groupBy("sample_id", "order_key").agg(
        F.array_sort(F.collect_list(F.struct("r", "row"))).alias("rows")
    ).selectExpr("sample_id", "order_key", "concat(if(order_key % 17 = 0, '```\\n', ''), array_join(rows.row, '\\n')) AS payload")


MARKDOWN = """SELECT sample_id, 'success' AS status, 'markdown' AS format, NULL AS error, r AS row_start, r + 1 AS row_end,
  c AS column_start, c + 1 AS column_end, CASE WHEN c = 2 THEN text || '|' ELSE text END AS text,
  r = 0 AS is_column_header, false AS is_row_header FROM base_cells WHERE order_key % 17 <> 0
UNION ALL SELECT sample_id, 'parse_failed', NULL, 'pipes: no plain table', NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM (SELECT DISTINCT sample_id FROM base_cells WHERE order_key % 17 = 0)"""


@catalog.add("parse_markdown_table", with_views("lines", MARKDOWN))
def parse_markdown_table(spark, sf_dir):
    return tables.parse_tables(markdown_payloads(spark, sf_dir), ["sample_id"], "payload", "markdown")


@catalog.add("canonicalize_output", with_views("lines cells", f"""SELECT 'h' || sample_id AS sample_id, * EXCLUDE (sample_id) FROM ({GOOD_HTML} UNION ALL {BAD_HTML})
UNION ALL SELECT 'm' || sample_id, * EXCLUDE (sample_id) FROM ({MARKDOWN})"""))
def canonicalize_output(spark, sf_dir):
    both = html_payloads(spark, sf_dir).selectExpr("concat('h', sample_id) AS sample_id", "concat(payload, '<|endoftext|>') AS payload").unionByName(
        markdown_payloads(spark, sf_dir).selectExpr("concat('m', sample_id) AS sample_id", "concat(' ', payload) AS payload"))
    return tables.parse_tables(both, ["sample_id"], "payload")


@catalog.add("span_placement", with_views("lines", """
SELECT sample_id, 'success' AS status, 2 * r AS row_start, 2 * r + 2 AS row_end, 0 AS column_start, 1 AS column_end, t0 AS text FROM lines
UNION ALL SELECT sample_id, 'success', 2 * r, 2 * r + 1, 1, 3, t2 FROM lines
UNION ALL SELECT sample_id, 'success', 2 * r + 1, 2 * r + 2, 1, 2, t1 FROM lines
UNION ALL SELECT sample_id, 'success', 2 * r + 1, 2 * r + 2, 2, 3, t3 FROM lines"""))
def span_placement(spark, sf_dir):
    row = F.expr("concat('<tr><td rowspan=2>', t0, '</td><td colspan=2>', t2, '</td></tr><tr><td>', t1, '</td><td>', t3, '</td></tr>')")
    payload = spread(views.lines(spark, sf_dir).select("sample_id", "r", row.alias("row")), "sample_id").groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("r", "row"))).alias("rows")
    ).selectExpr("sample_id", "concat('<table>', array_join(rows.row, ''), '</table>') AS payload")
    return tables.parse_tables(payload, ["sample_id"], "payload", "html").select(
        "sample_id", "status", "row_start", "row_end", "column_start", "column_end", "text")


def page_markup(spark, sf_dir):
    """Report pages with zero to two tables; some nested, some unbalanced."""
    return views.turns(spark, sf_dir).selectExpr(
        "report_id", "page_number - 1 AS page_index", "page_number", "length(text) AS n",
        "concat('<p>intro</p>', repeat(concat('<TABLE><tr><td>', length(text), if(length(text) % 7 = 1, '<table></table>', ''), "
        "'</td></tr></table>'), length(text) % 3), if(length(text) % 11 = 1, '</table>', '')) AS markup")


@catalog.add("extract_top_level_tables", with_views("turns", """, m AS (SELECT report_id, page_number - 1 AS page_index, length(text) AS n FROM turns)
SELECT report_id, page_index, (n % 3)::INTEGER AS table_count, n % 3 > 0 AND n % 7 = 1 AS nested, n % 11 = 1 AS malformed,
  repeat('<TABLE><tr><td>' || n || CASE WHEN n % 7 = 1 THEN '<table></table>' ELSE '' END || '</td></tr></table>', (n % 3)::INTEGER) AS blocks FROM m"""))
def extract_top_level_tables(spark, sf_dir):
    found = tables.top_level_tables(page_markup(spark, sf_dir), ["report_id", "page_index"], "markup")
    return found.withColumn("blocks", F.array_join("blocks", ""))


@catalog.add("canonicalizable_funnel", with_views("turns", """, m AS (SELECT length(text) AS n,
  CASE WHEN length(text) % 5 = 0 THEN 0 WHEN length(text) % 4 = 0 THEN 2 ELSE 1 END AS detected FROM turns),
c AS (SELECT *, n % 3 = 1 AND n % 7 <> 1 AND n % 11 <> 1 AS clean FROM m)
SELECT count(*) AS pages, count(*) FILTER (n % 3 = 1) AS one_table_pages, count(*) FILTER (clean) AS clean_table_pages,
  count(*) FILTER (clean AND detected = 1) AS aligned_pages, count(*) FILTER (clean AND detected = 1 AND n % 13 <> 1) AS canonicalizable_tables,
  sum(detected)::BIGINT AS detections FROM c"""))
def canonicalizable_funnel(spark, sf_dir):
    # Blocks of pages whose text length leaves 1 modulo 13 get a span beyond their last row, so they cannot be read.
    markup = page_markup(spark, sf_dir).withColumn("markup", F.expr("if(n % 13 = 1, replace(markup, '<td>', '<td rowspan=2>'), markup)"))
    keys = ["report_id", "page_index"]
    found = pin(tables.top_level_tables(markup, keys, "markup"), "found")
    detections = views.turns(spark, sf_dir).where("length(text) % 5 <> 0").selectExpr(
        "report_id", "page_number - 1 AS page_index", "explode(sequence(0, if(length(text) % 4 = 0, 1, 0))) AS detection_index")
    blocks = found.where("table_count = 1 AND NOT nested AND NOT malformed").selectExpr(*keys, "blocks[0] AS block")
    readable = tables.parse_table_records(blocks, keys, "block", "html", strict=False).where("status = 'success'")
    return alignment.alignment_funnel(found, detections, readable=readable)


@catalog.add("validate_cells", with_views("lines cells", """
SELECT sample_id, column_start + 4 * row_start AS cell_no, 'cells overlap' AS problem FROM cells
WHERE order_key % 19 = 0 AND order_key % 23 <> 0 AND column_start = 3 AND row_start = 0
UNION ALL SELECT sample_id, column_start + 4 * row_start, 'invalid range' FROM cells WHERE order_key % 23 = 0 AND column_start = 2"""))
def validate_cells(spark, sf_dir):
    broken = views.cells(spark, sf_dir).selectExpr(
        "sample_id", "column_start + 4 * row_start AS cell_no", "row_start", "row_end",
        "if(order_key % 19 = 0 AND column_start = 3 AND row_start = 0, 2, column_start) AS column_start",
        "if(order_key % 23 = 0 AND column_start = 2, 2, column_end) AS column_end", "text")
    # A cell without a valid range takes up no position, so it cannot collide.
    return tables.validate_cells(broken, bounded=True)


@catalog.add("validate_prediction_cells", with_views("lines cells", """
SELECT sample_id, column_start + 4 * row_start AS cell_no, 'invalid range' AS problem FROM cells WHERE order_key % 23 = 0 AND column_start = 2"""))
def validate_prediction_cells(spark, sf_dir):
    broken = views.cells(spark, sf_dir).selectExpr(
        "sample_id", "column_start + 4 * row_start AS cell_no", "row_start", "row_end", "if(column_start = 3, 2, column_start) AS column_start",
        "if(order_key % 23 = 0 AND column_start = 2, 2, column_end) AS column_end", "text")
    return tables.validate_cells(broken, allow_overlaps=True)


@catalog.add("canonical_primary_cells", with_views("lines cells", """
SELECT sample_id, row_start, row_end, column_start, column_end, text, x0, y0, x1, y1, row_start = 0 AS is_column_header,
  column_start = 0 AS is_row_header, row_number() OVER (PARTITION BY sample_id ORDER BY row_start, column_start) - 1 AS cell_no,
  NULL::VARCHAR AS reason
FROM cells WHERE order_key % 29 <> 0
UNION ALL SELECT DISTINCT sample_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid range'
FROM cells WHERE order_key % 29 = 0"""))
def canonical_primary_cells(spark, sf_dir):
    raw = views.cells(spark, sf_dir).selectExpr(
        "sample_id", "row_start", "row_end", "column_start",
        "if(order_key % 29 = 0 AND row_start = 0 AND column_start = 3, column_start, column_end) AS column_end",
        "if(text = '', NULL, text) AS text", "x1 AS xa", "1000D - y0 AS ya", "x0 AS xb", "1000D - y1 AS yb",
        "'BOTTOM_LEFT' AS origin", "1000D AS image_height", "row_start = 0 AS column_header", "column_start = 0 AS row_header",
        "CAST(NULL AS BOOLEAN) AS row_section")
    raw = pin(raw, "cells")
    return tables.canonical_cells(raw, bounded=True).unionByName(tables.cell_failures(raw), allowMissingColumns=True)


@catalog.add("dedupe_ocr", with_views("lines ocr_boxes", """
SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY record_no) - 1 AS record_no, text, x0, y0, x1, y1,
  round(confidence, 9) AS confidence FROM ocr_boxes"""))
def dedupe_ocr(spark, sf_dir):
    boxes = views.ocr_boxes(spark, sf_dir).selectExpr(
        "sample_id", "record_no", "text", "x0 AS xa", "y0 AS ya", "x1 AS xb", "y1 AS yb", "'TOPLEFT' AS origin", "confidence", "500D AS image_height")
    copies = boxes.selectExpr("*", "explode(array(record_no * 2, record_no * 2 + 1)) AS index").drop("record_no")
    return rounded(tables.dedupe_ocr(copies, bounded=True))


@catalog.add("cell_order", with_views("lines cells", """
SELECT sample_id, row_start, column_start, row_number() OVER (PARTITION BY sample_id ORDER BY row_start, column_start, row_end, column_end, text) AS position FROM cells"""))
def cell_order(spark, sf_dir):
    from secondpass.operators.order import with_rank

    return with_rank(views.cells(spark, sf_dir), tables.cell_order(), ["sample_id"], "position", bounded=True).select(
        "sample_id", "row_start", "column_start", "position")


# ---------------------------------------------------------------- annotation payloads

def structure_payloads(spark, sf_dir):
    """Structure XML per sheet: table, rows, columns, header and span objects; every 31st order has two sizes."""
    box = "concat('<bndbox><xmin>', {0}, '</xmin><ymin>', {1}, '</ymin><xmax>', {2}, '</xmax><ymax>', {3}, '</ymax></bndbox></object>')"
    obj = lambda name, *sides: f"concat('<object><name>{name}</name>', {box.format(*sides)})"
    per_row = spread(views.lines(spark, sf_dir), "sample_id", "order_key").groupBy("sample_id", "order_key").agg(F.max("r").alias("top"))
    columns = [obj("table column", 100 * c, 0, 100 * c + 90, "top * 20 + 18") for c in range(4)]
    return per_row.selectExpr("sample_id", "order_key", f"""concat('<annotation xmlns="urn:x"><size><width>400</width><height>', top * 20 + 20,
      '</height></size>', if(order_key % 31 = 0, '<size/>', ''), {obj("table", 0, 0, 390, "top * 20 + 18")},
      array_join(transform(sequence(0, top), r -> {obj("table row", 0, "r * 20", 390, "r * 20 + 18")}), ''), '<group>', {", ".join(columns)}, '</group>',
      {obj("table column header", 0, 0, 390, 18)}, if(order_key % 4 = 0, {obj("table spanning cell", 0, 0, 190, 18)}, ''), '</annotation>') AS payload""")


STRUCTURE = """, tops AS (SELECT sample_id, order_key, max(r) AS top FROM lines GROUP BY ALL),
objects AS (
  SELECT sample_id, order_key, top, 0 AS object_no, 'table' AS category, 0 AS x0, 0 AS y0, 390 AS x1, top * 20 + 18 AS y1 FROM tops
  UNION ALL SELECT sample_id, order_key, top, 1 + r, 'table row', 0, r * 20, 390, r * 20 + 18 FROM tops, unnest(range(0, top + 1)) u(r)
  UNION ALL SELECT sample_id, order_key, top, 2 + top + c, 'table column', 100 * c, 0, 100 * c + 90, top * 20 + 18 FROM tops, unnest(range(4)) u(c)
  UNION ALL SELECT sample_id, order_key, top, 6 + top, 'table column header', 0, 0, 390, 18 FROM tops
  UNION ALL SELECT sample_id, order_key, top, 7 + top, 'table spanning cell', 0, 0, 190, 18 FROM tops WHERE order_key % 4 = 0)
"""


@catalog.add("parse_structure_xml", with_views("lines", STRUCTURE + """
SELECT sample_id, 400.0::DOUBLE AS width, (top * 20 + 20)::DOUBLE AS height, object_no::INTEGER AS object_no, category, x0::DOUBLE AS x0,
  y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, NULL::VARCHAR AS reason FROM objects WHERE order_key % 31 <> 0
UNION ALL SELECT sample_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'size: 2 found, one wanted' FROM tops WHERE order_key % 31 = 0"""))
def parse_structure_xml(spark, sf_dir):
    return payloads.structure_rows(structure_payloads(spark, sf_dir), ["sample_id"], "payload")


@catalog.add("parse_content_json", with_views("lines ocr_boxes", """
SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY record_no) - 1)::INTEGER AS record_no, text, x0, y0, x1, y1, NULL::VARCHAR AS reason
FROM ocr_boxes WHERE order_key % 37 NOT IN (0, 1)
UNION ALL SELECT sample_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN order_key % 37 = 0 THEN 'invalid JSON' ELSE 'bad record' END
FROM (SELECT DISTINCT sample_id, order_key FROM ocr_boxes WHERE order_key % 37 IN (0, 1))"""))
def parse_content_json(spark, sf_dir):
    record = "struct(record_no, struct(text, array(x0, y0, x1, y1) AS bbox) AS entry)"
    df = views.ocr_boxes(spark, sf_dir).groupBy("sample_id", "order_key").agg(
        F.expr(f"array_sort(collect_list({record})).entry AS ocr")).selectExpr(
        "sample_id", "concat(regexp_replace(to_json(struct(ocr)), '\"text\":\"([^\"]*)\"', if(order_key % 37 = 1, '\"text\":5', '\"text\":\"$1\"')), "
        "if(order_key % 37 = 0, '}', '')) AS payload")
    return payloads.content_rows(df, ["sample_id"], "payload")


def page_texts(spark, sf_dir):
    """Page-marked text per report; every 7th report repeats a page number."""
    piece = F.expr("concat('==== PAGE ', if(conv_id % 7 = 0 AND page_number = 2, 1, page_number), ' ==== ====\\n', text, '\\n')")
    return views.turns(spark, sf_dir).select("report_id", "conv_id", "page_number", piece.alias("piece")).groupBy("report_id", "conv_id").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "piece"))).alias("pieces"), F.max("page_number").alias("top")
    ).selectExpr("report_id", "conv_id", "top", "concat('preface\\n', array_join(pieces.piece, '')) AS text")


@catalog.add("split_pages", with_views("turns", """, n AS (SELECT report_id, conv_id, max(page_number) AS top FROM turns GROUP BY ALL)
SELECT report_id, page_number::BIGINT AS page_number, (page_number - 1)::BIGINT AS page_index, sha256(chr(10) || text || chr(10)) AS digest, NULL::VARCHAR AS reason
FROM turns JOIN n USING (report_id, conv_id) WHERE conv_id % 7 <> 0 OR top < 2
UNION ALL SELECT report_id, NULL, NULL, NULL, 'page numbers not unique and positive' FROM n WHERE conv_id % 7 = 0 AND top >= 2"""))
def split_pages(spark, sf_dir):
    pages = payloads.page_rows(page_texts(spark, sf_dir), ["report_id"], "text")
    return pages.withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "digest")


@catalog.add("report_inputs", with_views("turns", """, n AS (SELECT report_id, conv_id, max(page_number) AS top FROM turns GROUP BY ALL)
SELECT report_id, (top + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END)::INTEGER AS page_count,
  CASE WHEN conv_id % 7 = 0 AND top >= 2 THEN 0 ELSE top END::BIGINT AS marker_pages,
  CASE WHEN conv_id % 7 = 0 AND top >= 2 THEN 0 ELSE top END = top + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS accepted FROM n"""))
def report_inputs(spark, sf_dir):
    source = page_texts(spark, sf_dir)
    good, _ = payloads.split_pages(source, ["report_id"], "text")
    declared = source.selectExpr("report_id", "top + if(conv_id % 5 = 0, 1, 0) AS page_count")
    return payloads.report_inputs(declared, good)


# ---------------------------------------------------------------- record files

METADATA_CASES = """CASE WHEN order_key % 97 = 1 THEN 'invalid JSON' WHEN order_key % 101 = 1 THEN 'not an object'
  WHEN order_key % 103 = 1 THEN 'no sample id' WHEN order_key % 107 = 1 THEN 'duplicate sample id'
  WHEN order_key % 109 = 1 THEN 'no image path' END"""


def metadata_path(spark, sf_dir):
    """Metadata written as JSON Lines, with planted faults and blank lines."""
    s = views.scores(spark, sf_dir)
    fields = "'id', sample_id, 'company', issuer, 'file_name', concat('images/', sample_id, '.png'), 'year', string(order_key % 5 + 2015)"
    good = "to_json(named_struct(" + fields + "))"
    lines = s.selectExpr(f"""explode(CASE WHEN order_key % 97 = 1 THEN array(concat('{{', sample_id))
      WHEN order_key % 101 = 1 THEN array('[1]') WHEN order_key % 103 = 1 THEN array('{{"id": 7, "file_name": "x"}}', '  ')
      WHEN order_key % 107 = 1 THEN array({good}, {good}) WHEN order_key % 109 = 1 THEN array(concat('{{"id": "', sample_id, '"}}'))
      ELSE array({good}) END) AS value""")
    path = scratch_path(spark, "metadata")
    lines.write.text(path)
    return path


@catalog.add("read_metadata", with_views("scores", f"""
SELECT sample_id AS id, issuer AS company, 'images/' || sample_id || '.png' AS file_name, (order_key % 5 + 2015)::VARCHAR AS year
FROM scores WHERE ({METADATA_CASES}) IS NULL"""))
def read_metadata(spark, sf_dir):
    return records.read_metadata(spark, metadata_path(spark, sf_dir))[0].select("id", "company", "file_name", "year")


@catalog.add("metadata_rejects", with_views("scores", f"""
SELECT {METADATA_CASES} AS reason, (CASE WHEN ({METADATA_CASES}) = 'duplicate sample id' THEN 2 ELSE 1 END * count(*))::BIGINT AS lines
FROM scores WHERE ({METADATA_CASES}) IS NOT NULL GROUP BY 1"""))
def metadata_rejects(spark, sf_dir):
    rejects = records.read_metadata(spark, metadata_path(spark, sf_dir))[1]
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@catalog.add("read_membership", with_views("scores membership", """
SELECT cohort, sample_id, issuer, spanning, true AS valid FROM membership WHERE right(sample_id, 6) <> '13-000'
UNION ALL SELECT cohort, sample_id, NULL, spanning, false FROM membership WHERE right(sample_id, 6) = '13-000'"""))
def read_membership(spark, sf_dir):
    # Manifests hold at most a thousand members each.
    m = views.membership(spark, sf_dir).selectExpr(
        "cohort", "sample_id", "if(right(sample_id, 6) = '13-000', NULL, issuer) AS issuer", "spanning", "substring(sample_id, 1, 7) AS shard")
    entry = F.struct("sample_id", "issuer", "spanning")
    lists = {c: F.collect_list(F.when(F.col("cohort") == c, entry)) for c in ("development", "final", "reserve", "calibration")}
    docs = m.groupBy("shard").agg(*[column.alias(c) for c, column in lists.items()]).select(
        F.struct("development", "final", "reserve").alias("splits"), "calibration")
    path = scratch_path(spark, "membership")
    records.write_records(docs, path)
    good, bad = records.read_membership(spark, path)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


@catalog.add("membership_problems", with_views("scores membership", """, wanted AS (
  SELECT cohort, count(*) + CASE WHEN cohort = 'final' THEN 3 ELSE 0 END AS members,
    CASE WHEN cohort = 'final' THEN count(*) FILTER (spanning) END AS spanning FROM membership GROUP BY cohort),
found AS (SELECT * FROM membership UNION ALL SELECT 'reserve', sample_id, issuer, spanning FROM membership WHERE right(sample_id, 6) = '13-000' OR right(sample_id, 3) = '777'),
n AS (SELECT cohort, count(*) AS members, count(*) FILTER (spanning) AS spanning FROM found GROUP BY cohort)
SELECT 'member count' AS problem, cohort, NULL AS sample_id, n.members AS found, w.members AS wanted FROM n JOIN wanted w USING (cohort) WHERE n.members <> w.members
UNION ALL SELECT 'spanning count', cohort, NULL, n.spanning, w.spanning FROM n JOIN wanted w USING (cohort) WHERE n.spanning <> w.spanning
UNION ALL SELECT 'duplicate member', NULL, sample_id, count(*), 1 FROM found GROUP BY sample_id HAVING count(*) > 1"""))
def membership_problems(spark, sf_dir):
    # Samples ending in 777 are members of the reserve once more, and the final cohort is announced with three members too many.
    m = views.membership(spark, sf_dir)
    wanted = m.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count_if("spanning").alias("s")).selectExpr(
        "cohort", "n + if(cohort = 'final', 3, 0) AS members", "if(cohort = 'final', s, NULL) AS spanning")
    again = m.where("right(sample_id, 6) = '13-000' OR right(sample_id, 3) = '777'").withColumn("cohort", F.lit("reserve"))
    return records.membership_problems(m.unionByName(again), wanted)


@catalog.add("manifest_problems", """SELECT 'entity count' AS problem, count(DISTINCT c_mktsegment) AS found, 50::BIGINT AS wanted FROM customer
HAVING count(DISTINCT c_mktsegment) <> 50
UNION ALL SELECT 'report count', count(*), 52 FROM customer HAVING count(*) <> 52""")
def manifest_problems(spark, sf_dir):
    reports = views.table(spark, sf_dir, "customer").selectExpr("c_name AS report_id", "c_mktsegment AS reporting_entity")
    return records.manifest_problems(reports, 52, 50)


@catalog.add("read_report_manifest", """SELECT c_name AS report_id, c_mktsegment AS reporting_entity, (2000 + c_custkey % 20)::VARCHAR AS year,
  CASE WHEN c_custkey % 41 = 0 THEN 'no year' WHEN c_custkey % 43 = 0 THEN 'unsafe report path' END AS reason FROM customer WHERE c_custkey % 41 <> 0
UNION ALL SELECT c_name, c_mktsegment, NULL, 'no year' FROM customer WHERE c_custkey % 41 = 0""")
def read_report_manifest(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").selectExpr(
        "c_name AS report_id", "c_mktsegment AS reporting_entity", "if(c_custkey % 41 = 0, NULL, 2000 + c_custkey % 20) AS year",
        "concat(if(c_custkey % 43 = 0, '../', ''), 'pdf_files/', c_custkey, '.pdf') AS pdf_repository_path",
        "concat('ocr_results/', c_custkey, '_extracted.txt') AS ocr_repository_path", "floor(c_custkey / 1000) AS shard")
    docs = c.groupBy("shard").agg(F.collect_list(F.struct(*c.columns[:-1])).alias("reports")).select("reports")
    path = scratch_path(spark, "reports")
    records.write_records(docs, path)
    good, bad = records.read_report_manifest(spark, path)
    return good.unionByName(bad, allowMissingColumns=True).select("report_id", "reporting_entity", "year", "reason")


@catalog.add("write_and_read_records", with_views("scores", """
SELECT sample_id, issuer, cohort, primary_con, expert_status, expert_con FROM scores"""))
def write_and_read_records(spark, sf_dir):
    s = views.scores(spark, sf_dir).select("sample_id", "issuer", "cohort", "primary_con", "expert_status", "expert_con")
    path = scratch_path(spark, "records")
    records.write_records(s, path, partition_by=["cohort"])
    return records.read_records(spark, path, s.schema, multiline=False).select(*s.columns)


@catalog.add("missing_records", with_views("scores", """
SELECT 'primary' AS kind, sample_id FROM scores WHERE order_key % 59 = 0
UNION ALL SELECT 'expert', sample_id FROM scores WHERE expert_status <> 'success'"""))
def missing_records(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    return records.missing_records(s, {"primary": s.where("order_key % 59 <> 0"), "expert": s.where("expert_status = 'success'")})
