"""Registered queries over documents, pages, vectors, model responses and files derived from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.embedding import embed, hashed_terms_all
from ..operators import chunking, pivots, shipments, vectors
from ..sources import readers, tables
from ..sources.stored import Stored
from .orders_doc import ORDERS_DOC_SQL, stored_orders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, source, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(source(spark, sf_dir))
    if sql:
        SQL[name] = sql


# vectors: queries are all vectors whose id is divisible by 20, the namespace is the label
EMB = table("embeddings")
SCORES = """q AS (SELECT vec_id AS query_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 20 = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT query_id, vec_id, list_cosine_similarity(q.e, v.e) AS score FROM q JOIN v ON q.label = v.label AND query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def rounded() -> Column:
    return F.round("score", 6).alias("score")


def every(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 20 = 0")


def ranked(e: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    return vectors.top_k_in_blocks(e, every(e), k, min_score)


register("vector_cosine", EMB, lambda e: vectors.vector_scores(e, every(e)).select("query_id", "vec_id", rounded()), f"WITH {SCORES} SELECT query_id, vec_id, round(score, 6) AS score FROM s")
register("vector_topk", EMB, lambda e: ranked(e, 15).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", rounded()), f"WITH {SCORES} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 15")
register("vector_topk_min_score", EMB, lambda e: ranked(e, 40, 0.28).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", rounded()), f"WITH {SCORES} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 40 AND score >= 0.28")
register("vector_topk_pivots", EMB, lambda e: pivots.top_k_by_pivots(e, every(e), 15, 0.28).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", rounded()), f"WITH {SCORES} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 15 AND score >= 0.28")
QUERIES["vector_topk_context"] = lambda spark, sf_dir: vectors.with_context(
    ranked(EMB(spark, sf_dir), 15), table("documents")(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "text")
).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", rounded(), "context")
SQL["vector_topk_context"] = f"WITH {SCORES} SELECT query_id, rank, vec_id, round(score, 6) AS score, text[1:2500] AS context FROM r LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 15"

# chunks
DOCS = table("documents")
register("chunk_recursive", DOCS, chunking.chunk_recursive)
register("chunk_semantic", DOCS, lambda d: chunking.chunk_semantic(d, embed, embed_all=hashed_terms_all, gaps_all=vectors.neighbour_gaps))
register("chunk_no_split", DOCS, chunking.chunk_no_split, "SELECT doc_id, CAST(0 AS INTEGER) AS pos, text AS chunk FROM documents WHERE trim(text) <> ''")
LINES = r"""l AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS chunk, unnest(range(0, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))) AS pos FROM documents)"""


def lines(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("pos", "chunk"))


register(
    "chunk_links", DOCS, lambda d: chunking.chunk_links(lines(d)).drop("chunk"),
    f"WITH {LINES}, i AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, doc_id || '-' || pos AS chunk_id FROM l) SELECT *, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY pos)",
)


def merged(d: DataFrame) -> DataFrame:
    base = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    extra = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("source"), F.lit("override"), F.lit("page"), F.lit("0"))).otherwise(F.create_map().cast("map<string,string>"))
    m = chunking.with_metadata(d, base, extra)
    return m.select("doc_id", *(F.col("metadata")[k].alias(f"m_{k}") for k in ("lang", "source", "page")))


register("chunk_metadata", DOCS, merged, "SELECT doc_id, lang AS m_lang, CASE WHEN doc_id % 2 = 0 THEN 'override' ELSE source END AS m_source, CASE WHEN doc_id % 2 = 0 THEN '0' END AS m_page FROM documents")

# two texts of one page, without loss: odd lines of the whole text as the text layer, even lines as what was read from the image
HALVES = r"""h AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents),
p AS (SELECT doc_id, trim(coalesce(array_to_string(list_filter(w, lambda x, i: i % 2 = 1), chr(10)), '')) AS t, trim(coalesce(array_to_string(list_filter(w, lambda x, i: i % 2 = 0), chr(10)), '')) AS o FROM h),
n AS (SELECT *, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: length(w) > 1)) AS n FROM p)"""


def halves(d: DataFrame) -> DataFrame:
    every = F.split("text", "\n")
    part = lambda r: F.array_join(F.filter(every, lambda _, i: i % 2 == r), "\n")
    return d.select("doc_id", part(0).alias("t"), part(1).alias("o"))


def pair(f: Callable[[Column, Column], Column]):
    return lambda d: halves(d).select("doc_id", f(F.col("t"), F.col("o")).alias("text"))


register("text_reconcile_pdf", DOCS, pair(chunking.reconcile_pdf), f"WITH {HALVES} SELECT doc_id, CASE WHEN o = '' THEN t WHEN n >= 30 THEN t || chr(10) || chr(10) || '=== EMBEDDED IMAGE OCR ===' || chr(10) || o WHEN length(o) >= length(t) THEN o ELSE t END AS text FROM n")
register("text_reconcile_render", DOCS, pair(chunking.reconcile_render), f"WITH {HALVES} SELECT doc_id, CASE WHEN n >= 30 OR o = '' THEN t WHEN n >= 10 THEN t || chr(10) || chr(10) || '=== PAGE RENDER OCR ===' || chr(10) || o WHEN length(o) > length(t) THEN o ELSE t END AS text FROM n")
register(
    "text_reconcile_word", DOCS, lambda d: pair(chunking.reconcile_word)(d).select("doc_id", "text.*"),
    f"WITH {HALVES}, c AS (SELECT doc_id, CASE WHEN n < 30 AND o <> '' AND length(o) >= length(t) THEN o ELSE t END AS text FROM n) SELECT *, CASE WHEN text = '' THEN 'no text' END AS error FROM c",
)


def forms(d: DataFrame) -> DataFrame:
    """Form fields from the lines of the documents: the field's kind goes by the line's place."""
    field = F.element_at(F.array(*(F.lit(f) for f in ("shipper", "fragile_check", "scac_label", "notes"))), (F.col("pos") % 4 + 1).cast("int"))
    value = F.when(F.col("pos") % 12 == 1, "Yes").when(F.col("pos") % 12 == 2, "SCAC :").when(F.col("pos") % 12 == 3, "  ").otherwise(F.col("chunk"))
    return lines(d).select("doc_id", "pos", field.alias("field"), value.alias("value"))


FORM_SQL = f"""WITH {LINES}, f AS (SELECT doc_id, pos, (['shipper', 'fragile_check', 'scac_label', 'notes'])[pos % 4 + 1] AS field,
  trim(CASE pos % 12 WHEN 1 THEN 'Yes' WHEN 2 THEN 'SCAC :' WHEN 3 THEN '  ' ELSE chunk END) AS value FROM l)
  SELECT doc_id, '=== PDF FORM FIELD VALUES ===' || chr(10) || string_agg(field || ': ' || value, chr(10) ORDER BY pos) AS text FROM f
  WHERE value <> '' AND NOT (value IN ('/', 'Off', 'Yes', 'No') AND field = 'fragile_check') AND NOT (field = 'scac_label' AND value LIKE '%:') GROUP BY doc_id"""
register("form_fields_text", DOCS, lambda d: chunking.form_fields_text(forms(d)), FORM_SQL)


def pages_with_forms(d: DataFrame) -> DataFrame:
    """Lines as pages, the forms behind page 0."""
    return chunking.with_form_fields(lines(d).select("doc_id", F.col("pos").alias("page"), F.col("chunk").alias("text")), chunking.form_fields_text(forms(d)))


register(
    "form_fields_page", DOCS, pages_with_forms,
    f"WITH {LINES}, t AS ({FORM_SQL}) SELECT l.doc_id, CAST(pos AS INTEGER) AS page, CASE WHEN pos = 0 AND t.text IS NOT NULL THEN chunk || chr(10) || chr(10) || t.text ELSE chunk END AS text FROM l LEFT JOIN t ON t.doc_id = l.doc_id",
)
register(
    "document_text", DOCS, lambda d: chunking.document_text(lines(d).select("doc_id", F.col("pos").alias("page"), F.col("chunk").alias("text"))),
    f"WITH {LINES} SELECT doc_id, string_agg(chunk, chr(10) ORDER BY pos)[1:12000] AS text FROM l GROUP BY doc_id",
)
register("embed_text", DOCS, lambda d: d.select("doc_id", embed(F.col("text")).alias("embedding")))

# files: orders as JSON texts in five shapes, and documents as plain texts
ORDERS = stored_orders
RECORD = "{'orderid': orderid, 'ordernumber': ordernumber, 'orderstatus': orderstatus}"


def files(o: DataFrame) -> DataFrame:
    rec = F.to_json(F.struct("orderid", "ordernumber", "orderstatus"))
    k = F.col("orderid") % 5
    quoted = F.to_json(F.struct(F.concat(F.lit("["), rec, F.lit("]")).alias("details")))
    text = (
        F.when(k == 0, F.concat(F.lit("["), rec, F.lit(", 7]")))
        .when(k == 1, F.concat(F.lit('[{"details":['), rec, F.lit("]}]")))
        .when(k == 2, F.concat(F.lit('{"details":['), rec, F.lit("]}")))
        .when(k == 3, quoted)
        .otherwise(F.concat(F.lit('[{"details":['), rec, F.lit(']},{"details":['), rec, F.lit("]}]")))
    )
    return o.select(F.concat(F.lit("orders/"), F.col("orderid").cast("string"), F.lit(".json")).alias("path"), text.alias("text"))


FIELDS = {"orderid": "bigint", "ordernumber": "string", "orderstatus": "string"}
WITH = f"WITH orders_doc AS ({ORDERS_DOC_SQL})"
TWICE = "UNION ALL SELECT {0} FROM orders_doc WHERE orderid % 5 = 4"
register(
    "src_orders_json", ORDERS, lambda o: readers.typed(readers.unwrap_records(files(o)), FIELDS).select(*FIELDS),
    f"{WITH} SELECT orderid, ordernumber, orderstatus FROM orders_doc {TWICE.format('orderid, ordernumber, orderstatus')}",
)
register(
    "src_json_documents", ORDERS, lambda o: readers.json_documents(files(o)).select("path", "no_split", "orderid", "ordernumber"),
    f"{WITH} SELECT 'orders/' || orderid || '.json' AS path, true AS no_split, orderid, ordernumber FROM orders_doc {TWICE.format(chr(39) + 'orders/' + chr(39) + ' || orderid || ' + chr(39) + '.json' + chr(39) + ', true, orderid, ordernumber')}",
)
NAMED = lambda d: d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.element_at(F.array(*(F.lit(e) for e in (".TXT", ".pdf", ".csv", ".json", ""))), (F.col("doc_id") % 5 + 1).cast("int"))).alias("path"), "text")
PATH = "source || '/' || doc_id || (['.TXT', '.pdf', '.csv', '.json', ''])[doc_id % 5 + 1]"
register("src_text_documents", DOCS, lambda d: readers.text_documents(NAMED(d)), f"SELECT {PATH} AS path, text, false AS no_split FROM documents WHERE trim(text) <> ''")
register("src_extension_filter", DOCS, lambda d: NAMED(d).filter(readers.readable(F.col("path"))).select("path"), f"SELECT {PATH} AS path FROM documents WHERE doc_id % 5 IN (0, 1, 3)")

# numbers that DuckDB and Spark write alike: exact to six digits
NUMBERS = ("grosstotalfreight", "totalfreight", "pretaxamount", "taxes", "totaltaxamount", "othercharges", "offeredamount", "fuelcharges")
COLUMNS = (
    "namespace", "doc_type", "orderid", "ordernumber", "tempordernumber", "orderstatus", "customername", "customercode", "companycode", "currencycode", "salesmanname", "commodityname",
    *NUMBERS, "distance_raw", "distanceunit", "tripno", "orderdate", "pickupdate", "deliverydate", "pickuplocationname", "deliverylocationname", "pickupfulladdress", "deliveryfulladdress",
)
CONTENT = [c for c in tables.PREFERRED if c in COLUMNS]


def written(o: DataFrame) -> DataFrame:
    """Orders with their amounts as decimals, and remarks so long that some texts are cut."""
    remarks = F.when(F.col("orderid") % 5 == 0, F.repeat(F.concat(F.col("ordernumber"), F.lit(" ")), 900))
    return o.select(*(F.col(c).cast("decimal(18,6)").alias(c) if c in NUMBERS else F.col(c) for c in COLUMNS), remarks.alias("remarks"))


CONTENT_SQL = f"""{{WITH}}, w AS (SELECT {', '.join(f'CAST({c} AS DECIMAL(18,6)) AS {c}' if c in NUMBERS else c for c in COLUMNS)},
  CASE WHEN orderid % 5 = 0 THEN repeat(ordernumber || ' ', 900) END AS remarks FROM orders_doc),
  f AS (SELECT orderid, concat_ws(chr(10), {', '.join(f"CASE WHEN CAST({c} AS STRING) <> '' THEN '{c}: ' || CAST({c} AS STRING) END" for c in CONTENT)}) AS lines,
  '{{{{' || concat_ws(',', {', '.join(f"CASE WHEN {c} IS NOT NULL THEN '{chr(34)}{c}{chr(34)}:' || " + (f"CAST({c} AS STRING)" if c in NUMBERS or c == 'orderid' else f"to_json({c})") + " END" for c in (*COLUMNS, 'remarks'))}) || '}}}}' AS whole FROM w)
  SELECT orderid, lines || chr(10) || 'full_order_json: ' || CASE WHEN length(whole) > 6000 THEN whole[1:6000] || '...' ELSE whole END AS page_content FROM f"""


def documents(o: DataFrame) -> DataFrame:
    return tables.build_documents(o, "orders", F.lit("2001-08-01"))


register("doc_page_content", ORDERS, lambda o: written(o).select("orderid", tables.page_content(written(o)).alias("page_content")), CONTENT_SQL.replace("{WITH}", WITH).replace("{{", "{").replace("}}", "}"))
register(
    "doc_build", ORDERS, lambda o: documents(o).select("orderid", F.col("metadata.type").alias("type"), F.col("metadata.source_document").alias("source_document"), F.col("metadata.ordernumber").alias("ordernumber"), F.col("metadata.embedding_dimensions").alias("embedding_dimensions"), F.col("metadata.structured").alias("structured")),
    f"{WITH} SELECT orderid, doc_type AS type, 'orders' AS source_document, ordernumber, CAST(0 AS INTEGER) AS embedding_dimensions, true AS structured FROM orders_doc",
)
register(
    "ingest_summary", ORDERS, lambda o: tables.ingest_summary(o, documents(o)),
    f"{WITH} SELECT count(*) AS loaded, count(*) AS stored, min(orderid) AS sample_id, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT unnest([{', '.join(repr(c) for c in sorted(['namespace', 'doc_type', 'orderid', 'ordernumber', 'tempordernumber', 'orderstatus', 'customername', 'customercode', 'companycode', 'currencycode', 'salesmanname', 'commodityname', 'grosstotalfreight', 'totalfreight', 'pretaxamount', 'taxes', 'totaltaxamount', 'othercharges', 'offeredamount', 'fuelcharges', 'distance_raw', 'distanceunit', 'tripno', 'orderdate', 'pickupdate', 'deliverydate', 'pickuplocationname', 'deliverylocationname', 'pickupfulladdress', 'deliveryfulladdress', 'page_content', 'embedding', 'metadata'])[:25])}]) AS c)) AS fields FROM orders_doc",
)


def preview(d: DataFrame) -> DataFrame:
    c = chunking.chunk_links(lines(d.filter("source = 'src1'")))
    c = c.withColumn("pos", F.col("doc_id") * 100000 + F.col("pos")).withColumn("source_document", F.lit("src1")).withColumn("embedding", F.array(F.lit(0.0)))
    return tables.chunk_preview(c, "src1")


register("chunk_preview", DOCS, preview, f"WITH {LINES}, c AS (SELECT l.* FROM l JOIN documents d ON d.doc_id = l.doc_id WHERE source = 'src1') SELECT doc_id || '-' || pos AS chunk_id, chunk[1:350] AS text, CAST(1 AS INTEGER) AS dimensions, (SELECT count(*) FROM c) AS total FROM c ORDER BY doc_id, pos LIMIT 5")

# model responses made from the orders
K = "orderid % 8"


def responses(o: DataFrame) -> DataFrame:
    one = "named_struct('shipment', named_struct('commodity', coalesce(commodityname, ''), 'weight', '4 lbs', 'pickup_location', pickuplocationname))"
    pack = "named_struct('shipment', named_struct('commodity', concat(orderid, ' pcs'), 'No.OfPackage', '7'))"
    three = "named_struct('shipment', named_struct('commodity', array('A', 'B', 'C'), 'weight', array('1 lb', '2 lb'), 'No.OfPackage', '10', 'pickup_location', ordernumber))"
    text = f"""CASE {K} WHEN 0 THEN concat('```json\\n', to_json({one}), '\\n```') WHEN 1 THEN concat('Here it is: ', to_json({one}), ' as asked.')
      WHEN 2 THEN to_json({three}) WHEN 3 THEN to_json(named_struct('shipment', array({one}.shipment))) WHEN 4 THEN '{{"shipment":[]}}'
      WHEN 5 THEN concat(to_json({one}), '\\n', to_json({pack})) WHEN 6 THEN concat('no order ', orderid) ELSE to_json({pack}) END"""
    return o.select(F.col("orderid").alias("resp_id"), F.expr(text).alias("response"))


def rows(o: DataFrame) -> DataFrame:
    out = shipments.shipment_rows(shipments.parse_responses(responses(o)))
    return out.select("resp_id", "pos", "line", "commodity", F.col("`No.OfPackage`").alias("packages"), "weight", "pickup_location")


ROWS_SQL = f"""{WITH}, o AS (SELECT *, {K} AS k, nullif(commodityname, '') AS c FROM orders_doc)
SELECT orderid AS resp_id, CAST(0 AS INTEGER) AS pos, CAST(0 AS INTEGER) AS line, c AS commodity, CAST(NULL AS STRING) AS packages, '4 lbs' AS weight, pickuplocationname AS pickup_location FROM o WHERE k IN (0, 1, 3, 5)
UNION ALL SELECT orderid, CASE WHEN k = 5 THEN 1 ELSE 0 END, 0, NULL, '7', NULL, NULL FROM o WHERE k IN (5, 7)
UNION ALL SELECT orderid, 0, 0, NULL, NULL, NULL, NULL FROM o WHERE k = 4
UNION ALL SELECT orderid, 0, CAST(i AS INTEGER), (['A', 'B', 'C'])[i + 1], '10', (['1 lb', '2 lb', NULL])[i + 1], ordernumber FROM (SELECT *, unnest([0, 1, 2]) AS i FROM o WHERE k = 2)"""
register("shipment_rows", ORDERS, rows, ROWS_SQL)
register("shipment_explode", ORDERS, lambda o: rows(o).groupBy("resp_id").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_list("commodity"))).alias("goods")), f"SELECT resp_id, count(*) AS n, coalesce(string_agg(commodity, ',' ORDER BY commodity), '') AS goods FROM ({ROWS_SQL}) GROUP BY 1")
FILL = {"commodity": "commodity", "pickup_location": "pickup_location", "No.OfPackage": "packages", "weight": "weight"}
FILL_SQL = f"SELECT resp_id, pos, CAST(0 AS INTEGER) AS ship, line, {', '.join(FILL.get(k, 'CAST(NULL AS STRING)') + ' AS ' + chr(34) + k.replace('.', '_') + chr(34) for k in shipments.SHIPMENT_KEYS)} FROM ({ROWS_SQL})"
register("shipment_fill", ORDERS, lambda o: shipments.shipment_rows(shipments.parse_responses(responses(o))).select("resp_id", "pos", "ship", "line", *(F.col(f"`{k}`").alias(k.replace(".", "_")) for k in shipments.SHIPMENT_KEYS)), FILL_SQL)
SHIPMENT = """'{"commodity":' || to_json(coalesce(commodityname, '')) || CASE WHEN pickuplocationname IS NULL THEN '' ELSE ',"pickup_location":' || to_json(pickuplocationname) END || ',"weight":"4 lbs"}'"""
PACKED = """'{"shipment":{"No.OfPackage":"7","commodity":"' || orderid || ' pcs"}}'"""
PARSED_SQL = f"""{WITH}, o AS (SELECT *, {K} AS k, {SHIPMENT} AS one, {PACKED} AS pack FROM orders_doc)
SELECT orderid AS resp_id, CASE WHEN k <> 6 THEN 0 END AS pos, CASE WHEN k IN (0, 1, 5) THEN '{{"shipment":' || one || '}}' WHEN k = 3 THEN '{{"shipment":[' || one || ']}}' WHEN k = 4 THEN '{{"shipment":[]}}' WHEN k = 7 THEN pack
  WHEN k = 2 THEN '{{"shipment":{{"No.OfPackage":"10","commodity":["A","B","C"],"pickup_location":"' || ordernumber || '","weight":["1 lb","2 lb"]}}}}' END AS obj,
  CASE WHEN k = 6 THEN 'no order ' || orderid END AS raw FROM o
UNION ALL SELECT orderid, 1, pack, NULL FROM o WHERE k = 5"""
register("parse_response_json", ORDERS, lambda o: shipments.parse_responses(responses(o)).select("resp_id", "pos", F.to_json("obj").alias("obj"), "raw"), PARSED_SQL)
COMMODITY = "CASE orderid % 6 WHEN 0 THEN '4 pcs, 4624 lbs' WHEN 1 THEN orderid || ' pallets' WHEN 2 THEN '44000 LB' WHEN 3 THEN '4624 lbs steel coils' WHEN 4 THEN commodityname ELSE '' END"
register("commodity_valid", ORDERS, lambda o: o.selectExpr("orderid", f"{COMMODITY} AS c").select("orderid", "c", (~shipments.invalid_commodity(F.col("c"))).alias("valid")), f"{WITH} SELECT orderid, {COMMODITY} AS c, orderid % 6 NOT IN (0, 1, 2) AS valid FROM orders_doc")


# vectors are stored by label, then one label's are replaced by half of them and another one's by none
def stored_vectors(e: DataFrame) -> DataFrame:
    table = Stored(e.sparkSession, tables.scratch(e.sparkSession), "vec_id long, embedding array<float>, namespace string")
    chunks = e.select("vec_id", "embedding", F.concat(F.lit("label "), F.col("label").cast("string")).alias("namespace"))
    table.write(chunks)
    tables.write_vectors(table, chunks.filter("namespace = 'label 1' and vec_id % 2 = 0"), "label 1")
    tables.write_vectors(table, chunks.limit(0), "label 2")
    tables.write_vectors(table, chunks.filter("namespace = 'label 3' and vec_id % 2 = 0"), "label 3", replace=False)
    table.vacuum()
    return table.read().select("vec_id", "namespace", F.size("embedding").alias("dimensions"))


register(
    "sink_vectors", EMB, stored_vectors,
    """SELECT vec_id, 'label ' || label AS namespace, CAST(len(embedding) AS INTEGER) AS dimensions FROM embeddings WHERE label <> 2 AND (label <> 1 OR vec_id % 2 = 0)
    UNION ALL SELECT vec_id, 'label 3', CAST(len(embedding) AS INTEGER) FROM embeddings WHERE label = 3 AND vec_id % 2 = 0""",
)
