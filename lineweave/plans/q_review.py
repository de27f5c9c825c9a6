"""Queries over the review queue, learning, register, history and their metrics."""
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import review as V
from . import sqlkit as S
from .registry import query

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def now():
    return F.expr(NOW)


_Q = "SELECT id, document, description, item_no, suggested_code, score, match_type, status, created_at, CAST(NULL AS STRING) AS alert FROM {review_queue}"
_NEW = "SELECT 'DOC' || CAST(user_id AS STRING) || '.pdf' AS document, 'item ' || CAST(event_id % 41 AS STRING) || ' ' || event_type AS description, CAST(event_id % 9 AS STRING) AS item_no, CAST(event_id % 30 AS STRING) AS suggested_code, 0.5 AS score, 'MATCH_DESCRICAO' AS match_type, CASE WHEN value > 50 THEN 'ver' ELSE '' END AS alert, event_id AS row_ord FROM {events} WHERE event_type IN ('view', 'click')"
_LASTNEW = f"SELECT * EXCLUDE (alert), said AS alert FROM (SELECT *, arg_max(alert, row_ord) FILTER (alert <> '') OVER (PARTITION BY document, description) AS said, row_number() OVER (PARTITION BY document, description ORDER BY row_ord DESC) AS rn FROM ({_NEW})) WHERE rn = 1"
query("u1_upsert_review", f"""WITH q AS ({_Q}), n AS ({_LASTNEW}), p AS (SELECT document, description, min(id) AS id FROM q WHERE status = 'pendente' GROUP BY 1, 2)
  SELECT document, description, status, created_at, CASE WHEN p.id IS NOT NULL AND n.row_ord IS NOT NULL THEN n.suggested_code ELSE q.suggested_code END AS suggested_code, CASE WHEN p.id IS NOT NULL AND n.alert <> '' THEN n.alert END AS alert
  FROM q LEFT JOIN p USING (document, description, id) LEFT JOIN n USING (document, description)
  UNION ALL SELECT n.document, n.description, 'pendente', {NOW}, n.suggested_code, nullif(n.alert, '') FROM n ANTI JOIN p USING (document, description)""")(
    lambda s: V.upsert_review(s.sql(_Q), s.sql(_NEW), now()).select("document", "description", "status", "created_at", "suggested_code", "alert"))
query("u2_prune_pending", f"SELECT id FROM {{review_queue}} WHERE NOT (status = 'pendente' AND document IN (SELECT document FROM ({_NEW})) AND (document, description) NOT IN (SELECT (document, description) FROM ({_NEW})))")(
    lambda s: V.prune_pending(s.review_queue, s.sql(_NEW), s.sql(_NEW)).select("id"))
query("u3_retain", f"SELECT id FROM {{review_queue}} WHERE NOT (status = 'resolvido' AND resolved_at < {NOW} - INTERVAL 20 DAY)")(lambda s: V.retain(s.review_queue, now(), 20).select("id"))
_DEC = "SELECT event_id AS id, CASE WHEN value > 30 THEN 'resolvido' ELSE 'descartado' END AS decision, CAST(event_id % 70 AS STRING) AS correct_code, 'u' AS user FROM {events} WHERE event_type = 'click'"
_DEC = _DEC.replace("'u' AS user", "'u' AS \"user\"")
query("u4_apply_decisions", f"SELECT q.id, coalesce(d.decision, q.status) AS status, CASE WHEN d.decision = 'resolvido' THEN d.correct_code ELSE q.correct_code END AS correct_code FROM (SELECT * FROM {{review_queue}}) q LEFT JOIN ({_DEC}) d USING (id)")(
    lambda s: V.apply_decisions(s.review_queue, s.sql(_DEC.replace('"user"', "`user`")), now()).select("id", "status", "correct_code"))
_C1 = "SELECT 'Item ' || CAST(event_id % 300 AS STRING) AS description, CAST(event_id % 7 AS STRING) AS product_code, event_id AS row_ord FROM {events} WHERE event_type = 'view'"
_C2 = "SELECT 'ITEM ' || CAST(event_id % 350 AS STRING) AS description, CAST(event_id % 11 AS STRING) AS product_code, event_id AS row_ord FROM {events} WHERE event_type = 'click'"
query("u5_upsert_corrections", f"SELECT arg_min(description, struct_pack(a := n, b := row_ord)) AS description, arg_max(product_code, struct_pack(a := n, b := row_ord)) AS product_code FROM (SELECT *, 0 AS n FROM ({_C1}) UNION ALL SELECT *, 1 FROM ({_C2})) GROUP BY lower(description)")(
    lambda s: V.upsert_corrections(s.sql(_C1), s.sql(_C2)).select("description", "product_code"))
_FILL = "SELECT o_custkey AS id, max(o_orderpriority) AS city, max('m' || CAST(o_orderkey AS STRING)) AS email, max(CAST(o_orderkey % 10 AS DOUBLE) / 10) AS confidence FROM {orders} GROUP BY o_custkey"
query("u6_merge_fill", f"SELECT c.id, coalesce(nullif(c.city, ''), f.city, c.city) AS city, coalesce(nullif(c.email, ''), f.email, c.email) AS email, greatest(c.confidence, coalesce(f.confidence, c.confidence)) AS confidence FROM (SELECT * FROM {{companies}}) c LEFT JOIN ({_FILL}) f USING (id)")(
    lambda s: V.merge_fill(s.companies, s.sql(_FILL), ["id"], ["city", "email"]).select("id", "city", "email", "confidence"))
_KEY = lambda c: S.squash(S.fold(f"upper(trim({c}))", [(p, "") for p in __import__("lineweave.functions.rules", fromlist=["x"]).COMPANY_SUFFIXES]))
_RES = f"""SELECT h.*, coalesce(r.id, n.id) AS company_id FROM (SELECT * FROM {{headers}}) h LEFT JOIN (SELECT substr(tax_id, 1, 8) AS root, min(id) AS id FROM {{companies}} WHERE length(tax_id) >= 8 GROUP BY 1) r ON length(regexp_replace(h.tax_id, '\\D', '', 'g')) >= 8 AND substr(regexp_replace(h.tax_id, '\\D', '', 'g'), 1, 8) = r.root
  LEFT JOIN (SELECT {_KEY('name')} AS k, min(id) AS id FROM {{companies}} GROUP BY 1) n ON {_KEY('h.name')} = n.k"""
query("u7_resolve_company", f"SELECT header_id, company_id FROM ({_RES})")(lambda s: V.resolve_company(s.headers, s.companies).select("header_id", "company_id"))
query("u8_resolve_site", f"SELECT company_id, coalesce(nullif(site_code, ''), upper(site_name)) AS site_key, count(*) AS documents, max(city) AS city FROM ({_RES}) GROUP BY 1, 2")(
    lambda s: V.site_key(V.resolve_company(s.headers, s.companies)))
query("u9_register_documents", f"SELECT status, count(*) AS n, count(DISTINCT company_id) AS companies FROM (SELECT coalesce(CAST(company_id AS VARCHAR), {_KEY('name')}) AS company_id, CASE WHEN confidence < 0.6 THEN 'revisao' ELSE 'processado' END AS status FROM ({_RES})) GROUP BY 1")(
    lambda s: V.register_documents(s.headers, s.companies).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("company_id").alias("companies")))
query("a11_review_metrics", f"""SELECT pending, CAST(round_even(old, 0) AS BIGINT) AS oldest_days, resolved, discarded, resolved_30_days, CAST(round_even(resolved * 100 / (resolved + discarded), 0) AS BIGINT) AS correction_rate, '6 h' AS mean_time, '6 h' AS median_time, docs AS corrected_documents FROM (
  SELECT count(*) FILTER (status = 'pendente') AS pending, epoch({NOW} - min(created_at) FILTER (status = 'pendente')) / 86400 AS old, count(*) FILTER (status = 'resolvido') AS resolved, count(*) FILTER (status = 'descartado') AS discarded,
  count(*) FILTER (status = 'resolvido' AND resolved_at >= {NOW} - INTERVAL 30 DAY) AS resolved_30_days, count(DISTINCT document) FILTER (status = 'resolvido') AS docs FROM {{review_queue}})""")(lambda s: V.review_metrics(s.review_queue, now()))
query("a12_top_corrected", "SELECT document, count(*) FILTER (status = 'resolvido') AS corrections, count(*) FILTER (status = 'descartado') AS discarded, count(*) FILTER (status = 'pendente') AS pending FROM {review_queue} GROUP BY document HAVING count(*) FILTER (status = 'resolvido') > 0 ORDER BY corrections DESC, pending DESC, document LIMIT 5")(
    lambda s: V.top_corrected(s.review_queue))
_OPS = "SELECT o_orderkey AS doc_id, CAST(o_custkey % 20 AS STRING) AS client, o_orderstatus AS layout, CAST(o_orderdate AS DATE) AS day, o_totalprice / 1000000 AS match_rate FROM {orders}"
query("a13_ops_metrics", f"SELECT client, layout, GROUPING_ID(client, layout) AS level, count(*) AS documents, count(*) FILTER (day = DATE '2000-01-05') AS today, count(*) FILTER (day >= DATE '2000-01-05' - INTERVAL 7 DAY) AS last_7_days, round(avg(match_rate), 4) AS mean_match_rate FROM ({_OPS}) GROUP BY GROUPING SETS ((client), (layout), ())")(
    lambda s: V.ops_metrics(s.sql(_OPS), F.lit("2000-01-05").cast("date")))
query("a14_shadow_stats", "SELECT count(*) AS total, count(*) FILTER (label % 2 = 0) AS agree, count(*) FILTER (label % 2 <> 0) AS differ, round(count(*) FILTER (label % 2 = 0) * 100 / count(*), 1) AS pct FROM {embeddings}")(
    lambda s: V.shadow_stats(s.embeddings.withColumn("agree", F.col("label") % 2 == 0)))
_RK = "trim(regexp_replace(description, 'NBR[\\s\\-]*\\d+[\\w/]*', '', 'g'))"
_PROM = f"""SELECT rule_key, arg_max(product_code, struct_pack(a := last, b := product_code)) AS product_code, arg_max(n, struct_pack(a := last, b := product_code)) AS confirmations FROM (SELECT {_RK} AS rule_key, product_code, count(*) AS n, max(struct_pack(t := validated_at, i := id)) AS last
  FROM {{history}} WHERE final_type IN ('CORRECAO_MANUAL', 'MANUAL') GROUP BY description, product_code HAVING count(*) >= 2) GROUP BY rule_key"""
query("a17_promote_rules", _PROM)(lambda s: V.promote_rules(s.history).select("rule_key", "product_code", "confirmations"))
query("a15_learning_stats", f"SELECT count(*) FILTER (final_type = 'CORRECAO_MANUAL') AS corrections, count(DISTINCT client_id) AS clients, (SELECT count(*) FROM ({_PROM})) AS rules FROM {{history}}")(
    lambda s: V.learning_stats(s.history, V.promote_rules(s.history)))
query("a16_crm_stats", "SELECT (SELECT count(*) FROM {customer}) AS companies, (SELECT count(*) FROM {supplier}) AS sites, count(*) AS documents, count(*) FILTER (o_orderstatus = 'P') AS pending_documents FROM {orders}")(
    lambda s: V.crm_stats(s.customer, s.supplier, s.orders.select(F.when(F.col("o_orderstatus") == "P", "revisao").otherwise("ok").alias("status"))))
query("a22_update_match_counts", "SELECT o_orderkey AS doc_id, count(l_orderkey) FILTER (l_orderkey IS NOT NULL) AS total_items, count(*) FILTER (l_returnflag = 'R') AS matched_items FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY 1")(
    lambda s: V.update_match_counts(s.orders.select(F.col("o_orderkey").alias("doc_id")), s.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_returnflag") == "R").alias("matched")))
    .select("doc_id", F.coalesce("total_items", F.lit(0)).alias("total_items"), F.coalesce("matched_items", F.lit(0)).alias("matched_items")))
query("a23_base_health", "SELECT 'part' AS base, count(*) AS n FROM {part} UNION ALL SELECT 'supplier', count(*) FROM {supplier}")(
    lambda s: s.part.select(F.lit("part").alias("base"), F.col("_metadata.file_modification_time").alias("m")).unionByName(s.supplier.select(F.lit("supplier").alias("base"), F.col("_metadata.file_modification_time").alias("m")))
    .groupBy("base").agg(F.count("*").alias("n"), F.max("m").alias("updated")).select("base", "n"))
query("w8_latest", "SELECT id, document FROM {review_queue} WHERE status = 'pendente' ORDER BY created_at DESC, id DESC LIMIT 50")(
    lambda s: V.latest(s.review_queue.filter("status = 'pendente'"), 50, F.desc("created_at"), F.desc("id")).select("id", "document"))
query("w9_page", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 300")(
    lambda s: V.page(s.orders.select("o_orderkey", "o_custkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"], 4).select("o_orderkey", "o_custkey"))
query("w17_last_touched", "SELECT user_id AS doc_id, CAST(epoch_us(max(ts)) AS BIGINT) AS last_touched FROM {events} GROUP BY 1")(
    lambda s: V.last_touched(s.events.select(F.col("user_id").alias("doc_id"), V.micros("ts").alias("mtime"))))
_SUG = "SELECT event_id AS item_id, CAST(user_id % 60 AS STRING) AS client_id, 'item ' || CAST(event_id % 400 AS STRING) || ' NBR 564' AS description FROM {events} WHERE event_type = 'signup'"
query("w10_suggest_history")(lambda s: V.suggest_history(s.sql(_SUG), s.history))
query("r7_best_history")(lambda s: V.suggest_history(s.sql(_SUG), s.history, 0.90, 1))
query("r6_lookup_rule")(lambda s: V.lookup_rule(s.sql("SELECT 'ITEM ' || CAST(event_id % 500 AS STRING) || CASE WHEN event_id % 2 = 0 THEN ' X' ELSE '' END AS description FROM {events}"), V.promote_rules(s.history)))
query("r3_resolved_of", "SELECT id FROM {review_queue} WHERE document = 'DOC7.pdf' AND status = 'resolvido'")(lambda s: V.of_key(s.review_queue.filter("status = 'resolvido'"), "document", "DOC7.pdf", "resolved_at").select("id"))
query("r5_history", "SELECT id FROM {history} WHERE client_id = '7'")(lambda s: V.of_key(s.history, "client_id", "7", "validated_at").select("id"))
query("r4_append_validation", "SELECT id, nullif(trim(client_id), '') AS client_id, nullif(trim(CASE WHEN product_code = '0' THEN ' ' ELSE product_code END), '') AS product_code FROM {history}")(
    lambda s: V.append_validation(s.history.withColumn("product_code", F.when(F.col("product_code") == "0", " ").otherwise(F.col("product_code"))).select("id", "client_id", "product_code")))
_RESULT = "SELECT event_id AS row_id, 'DOC' || CAST(user_id AS STRING) || '.pdf' AS document, 'item ' || CAST(event_id % 37 AS STRING) || ' purchase' AS description, 'item ' || CAST(event_id % 36 AS STRING) || ' purchase' AS description_2, 'old' AS product_code FROM {events} WHERE event_type = 'error'"
_RS = "SELECT document, description, arg_max(correct_code, id) AS c FROM {review_queue} WHERE status = 'resolvido' GROUP BY 1, 2"
query("j15_apply_corrections", f"SELECT r.row_id, coalesce(a.c, b.c, 'old') AS product_code FROM ({_RESULT}) r LEFT JOIN ({_RS}) a ON r.document = a.document AND r.description = a.description LEFT JOIN ({_RS}) b ON r.document = b.document AND r.description_2 = b.description")(
    lambda s: V.apply_corrections(s.sql(_RESULT), s.review_queue).select("row_id", "product_code"))
query("r2_regenerate", f"SELECT coalesce(a.c, b.c, 'old') AS product_code, count(*) AS n FROM ({_RESULT}) r LEFT JOIN ({_RS}) a ON r.document = a.document AND r.description = a.description LEFT JOIN ({_RS}) b ON r.document = b.document AND r.description_2 = b.description GROUP BY 1")(
    lambda s: V.apply_corrections(s.sql(_RESULT), s.review_queue).groupBy("product_code").agg(F.count("*").alias("n")))
_RQ = "SELECT id, document, description, item_no, suggested_code, score, match_type, status, created_at, CAST(NULL AS STRING) AS alert, resolved_at FROM {review_queue}"
_ALERTS = "SELECT 'A' || CAST(r_regionkey AS STRING) AS alert_code, 'confirmar ' || r_name AS alert FROM {region}"
_RES = f"SELECT n.*, CASE WHEN row_ord % 3 = 0 THEN 0.5 ELSE 0.9 END AS graded, 'A' || CAST(row_ord % 40 AS STRING) AS client_code FROM ({_NEW}) n"
query("r1_refresh_review", f"""WITH q AS ({_RQ}), a AS ({_RES}), n AS (SELECT document, description, CAST(row_ord AS HUGEINT) AS o, alert FROM a WHERE graded < 0.75 UNION ALL SELECT document, description, CAST(row_ord AS HUGEINT) + 4611686018427387904, b.alert FROM a JOIN ({_ALERTS}) b ON a.client_code = b.alert_code),
  k AS (SELECT document, description, arg_max(alert, o) FILTER (coalesce(alert, '') <> '') AS alert FROM n GROUP BY 1, 2), p AS (SELECT document, description, min(id) AS id FROM q WHERE status = 'pendente' GROUP BY 1, 2),
  u AS (SELECT q.document, q.description, q.status, q.resolved_at, CASE WHEN p.id IS NOT NULL THEN k.alert END AS alert FROM q LEFT JOIN p USING (document, description, id) LEFT JOIN k USING (document, description)
        UNION ALL SELECT k.document, k.description, 'pendente', NULL, k.alert FROM k ANTI JOIN p USING (document, description))
  SELECT status, alert, count(*) AS n FROM u WHERE NOT (status = 'pendente' AND document IN (SELECT document FROM a) AND (document, description) NOT IN (SELECT (document, description) FROM k)) AND NOT coalesce(status = 'resolvido' AND resolved_at < {NOW} - INTERVAL 180 DAY, false) GROUP BY 1, 2""")(
    lambda s: V.refresh_review(s.sql(_RQ), s.sql(_RES).withColumn("score", F.col("graded")).withColumn("manual_review", F.lit(False)), s.sql(_NEW), now(), s.sql(_ALERTS)).groupBy("status", "alert").agg(F.count("*").alias("n")))
_PROC = "SELECT o_orderkey AS process_id, 'aguardando_retorno' AS state, CAST(NULL AS DOUBLE) AS return_value FROM {orders}"
query("u16_attach_return", "SELECT o_orderkey AS process_id, CASE WHEN v IS NOT NULL THEN 'retorno_comparado' ELSE 'aguardando_retorno' END AS state, round(v, 2) AS return_value FROM {orders} LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS v FROM {lineitem} GROUP BY 1) ON o_orderkey = l_orderkey")(
    lambda s: V.attach_return(s.sql(_PROC), s.lineitem.groupBy(F.col("l_orderkey").alias("process_id")).agg(F.sum("l_quantity").alias("value")), now()).select("process_id", "state", F.round("return_value", 2).alias("return_value")))
_FA = "SELECT c_name AS name, 'x' AS error FROM {customer} WHERE c_acctbal < 0"
_FB = "SELECT c_name AS name, 'y' AS error FROM {customer} WHERE c_acctbal < 1000"
query("u12_failed_documents", "SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN 'x' ELSE 'y' END AS error, CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS origin FROM {customer} WHERE c_acctbal < 1000")(lambda s: V.failed_documents(s.sql(_FA), s.sql(_FB)))
query("f16_visible_documents", "SELECT c_name AS name FROM {customer} WHERE c_acctbal >= 1000 OR c_acctbal IS NULL")(lambda s: V.visible_documents(s.customer.select(F.col("c_name").alias("name")), s.sql(_FB)))
query("j23_document_status", "SELECT name, CASE WHEN r THEN 'processando' WHEN o THEN 'concluido' WHEN d THEN 'movido_sem_planilha' ELSE 'aguardando' END AS status FROM (SELECT c_name AS name, c_acctbal > 9000 AS r, c_acctbal > 6000 AS o, c_acctbal > 3000 AS d FROM {customer})")(
    lambda s: (lambda c: V.document_status(c, c.filter("c_acctbal > 3000"), c.filter("c_acctbal > 6000"), c.filter("c_acctbal > 9000")))(s.customer.select(F.col("c_name").alias("name"), "c_acctbal")))
query("w15_search_catalogue", """SELECT query, product_code, rank FROM (SELECT query, product_code, row_number() OVER (PARTITION BY query ORDER BY row_ord) AS rank FROM (SELECT DISTINCT p_name AS query FROM {part}) q JOIN (SELECT CAST(p_partkey AS STRING) AS product_code, p_name AS description, p_partkey AS row_ord FROM {part}) c ON contains(upper(c.product_code || ' ' || c.description), upper(q.query))) WHERE rank <= 10""")(
    lambda s: V.search_catalogue(s.part.select(F.col("p_name").alias("query")).distinct(), s.part.select(F.col("p_partkey").cast("string").alias("product_code"), F.col("p_name").alias("description"), F.col("p_partkey").alias("row_ord"))).select("query", "product_code", "rank"))
_J = "SELECT event_id, '{\"confianca\": ' || CAST(CAST(json_k AS DOUBLE) / 100 AS STRING) || ', \"total\": ' || CAST(json_k AS STRING) || '}' AS raw_json, CASE WHEN event_type = 'view' THEN '' ELSE CAST(event_id AS STRING) END AS number FROM (SELECT *, event_id % 101 AS json_k FROM {events})"
query("v1_trusted_numbers", "SELECT event_id, event_id % 101 / 100 AS confidence FROM {events} WHERE event_id % 101 >= 90 AND event_type <> 'view'")(lambda s: V.trusted_numbers(s.sql(_J)).select("event_id", "confidence"))
query("v2_process_stats", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS items FROM {events}")(lambda s: V.process_stats(s.events.select("event_id", F.replace("props", F.lit('"k"'), F.lit('"total"')).alias("stats"))).select("event_id", "items"))
query("v3_age_days", f"SELECT event_id, round(epoch({NOW} - ts) / 86400, 5) AS age, 6.0 AS hours FROM {{events}}")(
    lambda s: s.events.select("event_id", F.round(V.age_days(F.col("ts"), now()), 5).alias("age"), V.hours_between(F.col("ts"), F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("hours")))
_REP = "SELECT o_orderkey, CAST(o_custkey AS STRING) || ' Itens extraídos, ' || CAST(o_custkey % 50 AS STRING) || ' matches' || CASE WHEN o_orderstatus = 'P' THEN ' 7 pendentes' ELSE '' END AS txt, o_custkey, o_orderstatus FROM {orders}"
query("v4_report_metrics", f"SELECT o_orderkey, o_custkey AS items, o_custkey % 50 AS matches, CASE WHEN o_orderstatus = 'P' THEN 7 ELSE o_custkey - o_custkey % 50 END AS pending FROM ({_REP})")(
    lambda s: s.sql(_REP).select("o_orderkey", V.report_metrics(F.col("txt")).alias("m")).select("o_orderkey", "m.*"))
_PG = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Erro ao ler' WHEN 1 THEN 'gerando planilha' WHEN 2 THEN 'comparando' ELSE 'x' END AS text, o_orderstatus = 'O' AS running, o_orderstatus = 'F' AS has_sheet, o_custkey % 2 = 0 AS moved, o_orderkey % 4 AS k FROM {orders}"
query("v5_progress", f"SELECT o_orderkey, CASE WHEN k = 0 THEN 'erro' WHEN running AND k = 1 THEN 'planilha' WHEN running AND k = 2 THEN 'match' WHEN running THEN 'extracao' WHEN has_sheet THEN 'concluido' WHEN moved THEN 'movido_sem_planilha' ELSE 'aguardando' END AS stage FROM ({_PG})")(
    lambda s: V.progress(s.sql(_PG)).select("o_orderkey", "stage"))
query("v6_used_correction", "SELECT l_orderkey AS doc_id, bool_or(l_tax = 0.08) AS used FROM {lineitem} GROUP BY 1")(
    lambda s: V.used_correction(s.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_tax") == 0.08, "MATCH_CORRECAO_APRENDIDA").alias("match_type"))))
