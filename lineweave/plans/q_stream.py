"""Queries over message intake; the streaming ones read the events table as a file stream and run to completion."""
import uuid

from pyspark.sql import functions as F

from ..functions import rules as R
from ..streaming import intake as M
from .q_sources import folder
from .registry import query

_MSG = f"""SELECT 'm' || CAST(event_id % 9000 AS STRING) AS msg_id, ts AS received_at, 'buyer@cli' || CAST(user_id % 12 AS STRING) || '.example' AS sender, CASE WHEN user_id % 4 = 0 THEN 'alt@x.example' ELSE '' END AS reply_to,
  CASE event_id % 6 WHEN 0 THEN 'RE: pedido de compra' WHEN 1 THEN 'Ordem de Compra' WHEN 2 THEN 'Cotação' WHEN 3 THEN 'Pedido de compra e proposta' ELSE 'ola' END AS subject,
  CASE WHEN user_id % 3 = 0 THEN 'Para {R.SUPPLIER} ' ELSE 'texto ' END || event_type AS body, event_id % 6 AS k, user_id % 3 = 0 AS ours, user_id, event_id, event_type FROM {{events}}"""
_CLS = "CASE WHEN event_type = 'error' THEN 'sem_anexo' WHEN event_type = 'click' THEN 'anexo_sem_pdf' WHEN k = 0 THEN 'resposta_ou_encaminhamento' WHEN NOT ours THEN 'nao_identificado' WHEN k = 1 THEN 'palavras_chave_oc' WHEN k = 2 THEN 'palavras_chave_cotacao' WHEN k = 3 THEN 'ambiguo_oc_e_cotacao' ELSE 'sem_tipo_definido' END"
_CLASSED = f"SELECT *, CASE reason WHEN 'sem_anexo' THEN 'ignorar' WHEN 'palavras_chave_oc' THEN 'oc' WHEN 'palavras_chave_cotacao' THEN 'cotacao' ELSE 'revisar' END AS message_class, CASE user_id % 12 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 0 END AS client_score FROM (SELECT *, {_CLS} AS reason FROM ({_MSG}))"
CLIENTS = [{"id": "one", "domains": ["cli1.example"], "layout": "MRV"}, {"id": "two", "domains": ["cli2.example"], "words": ["nothing"]}, {"id": "mrv", "tax_ids": ["999"]}]


def with_attachments(df):
    pdf = F.struct(F.concat(F.lit("pedido"), F.col("user_id").cast("string"), F.lit(".pdf")).alias("name"), F.lit(".pdf").alias("extension"))
    xls = F.struct(F.lit("lista.xlsx").alias("name"), F.lit(".xlsx").alias("extension"))
    none = F.array().cast("array<struct<name:string,extension:string>>")
    return df.withColumn("attachments", F.when(F.col("event_type") == "error", none).when(F.col("event_type") == "click", F.array(xls)).otherwise(F.array(xls, pdf)))


def messages(s):
    return with_attachments(s.sql(_MSG))


def routed(df):
    return M.route_message(M.identify_sender(M.classify_message(df), CLIENTS, [{"id": "sys", "markers": ["no-such-system"]}]))


_ROUTE = f"SELECT *, CASE WHEN client_score >= 3 AND reason = 'nao_identificado' THEN 'oc' WHEN client_score < 2 AND message_class IN ('oc', 'cotacao') THEN 'revisar' ELSE message_class END AS route FROM ({_CLASSED})"
query("t2_classify_message", f"SELECT message_class, reason, count(*) AS n FROM ({_CLASSED}) GROUP BY 1, 2")(lambda s: M.classify_message(messages(s)).groupBy("message_class", "reason").agg(F.count("*").alias("n")))
query("j13_identify_sender", f"SELECT CASE user_id % 12 WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'desconhecido' END AS client_id, client_score, count(*) AS n FROM ({_CLASSED}) GROUP BY 1, 2")(
    lambda s: M.identify_sender(messages(s), CLIENTS).groupBy("client_id", "client_score").agg(F.count("*").alias("n")))
query("t3_route_message", f"SELECT route, count(*) AS n FROM ({_ROUTE}) GROUP BY 1")(lambda s: routed(messages(s)).groupBy("route").agg(F.count("*").alias("n")))
query("t5_attachments", f"SELECT count(*) AS n, count(DISTINCT file_name) AS names FROM (SELECT 'EMAIL_pedido' || user_id || '_' || row_number() OVER (PARTITION BY user_id) AS file_name FROM ({_MSG}) WHERE event_type NOT IN ('error', 'click'))")(
    lambda s: M.attachments(messages(s)).agg(F.count("*").alias("n"), F.countDistinct("file_name").alias("names")))
query("t6_reply_plan", f"SELECT msg_id, CASE WHEN user_id % 4 = 0 THEN 'alt@x.example' ELSE sender END AS reply_address FROM ({_MSG})")(lambda s: M.reply_plan(M.identify_sender(messages(s), CLIENTS)))
query("t7_next_documents", "SELECT c_name AS name, c_custkey AS mtime FROM {customer} WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0")(
    lambda s: M.next_documents(s.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("mtime"), F.lit(".pdf").alias("extension"), F.when(F.col("c_mktsegment") == "BUILDING", "COTACAO").otherwise("OC").alias("kind"), "c_acctbal"),
                               s.customer.filter("c_acctbal <= 0").select(F.col("c_name").alias("name"))).select("name", "mtime"))


def event_stream(s):
    """The events file as a stream, shaped like messages."""
    schema = s.events.schema
    raw = s.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(s.dir)
    raw = raw.withColumn("received_at", F.col("ts").cast("timestamp"))
    m = raw.select(F.concat(F.lit("m"), (F.col("event_id") % 9000).cast("string")).alias("msg_id"), "received_at", F.concat(F.lit("buyer@cli"), (F.col("user_id") % 12).cast("string"), F.lit(".example")).alias("sender"),
                   F.lit("").alias("reply_to"), F.when(F.col("event_id") % 6 == 1, "Ordem de Compra").when(F.col("event_id") % 6 == 2, "Cotação").otherwise("ola").alias("subject"),
                   F.concat(F.when(F.col("user_id") % 3 == 0, f"Para {R.SUPPLIER} ").otherwise("texto "), F.col("event_type")).alias("body"), "user_id", "event_id", "event_type")
    return with_attachments(m)


def table_of(stream, s, name):
    """The stream run to its end into a table, read back."""
    M.keep_state_on_disk(s.spark)
    path = f"{folder(s)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.option("checkpointLocation", path + "-state").trigger(availableNow=True).outputMode("append").format("parquet").start(path)
    q.awaitTermination()
    return s.spark.read.schema(stream.schema).parquet(path)


def whole_messages(s):
    """Each message once; ``whole`` says that it is a given message in all its parts."""
    got = table_of(M.dedup_messages(event_stream(s)), s, "messages")
    given = s.events.select("event_id", F.concat(F.lit("buyer@cli"), (F.col("user_id") % 12).cast("string"), F.lit(".example")).alias("want_sender"), "event_type")
    return got.join(given.withColumnRenamed("event_type", "want_type"), "event_id", "left").select("msg_id", ((F.col("sender") == F.col("want_sender")) & F.col("body").endswith(F.col("want_type"))).alias("whole"))


_STREAMED = """SELECT msg_id, event_type, CASE WHEN reason = 'sem_anexo' THEN 'ignorar' WHEN reason = 'nao_identificado' AND known THEN 'oc' WHEN reason IN ('palavras_chave_oc', 'palavras_chave_cotacao') AND known THEN 'order' ELSE 'revisar' END AS route FROM (
  SELECT 'm' || CAST(event_id % 9000 AS VARCHAR) AS msg_id, event_type, user_id % 12 IN (1, 2) AS known, CASE WHEN event_type = 'error' THEN 'sem_anexo' WHEN event_type = 'click' THEN 'anexo_sem_pdf' WHEN user_id % 3 <> 0 THEN 'nao_identificado'
         WHEN event_id % 6 = 1 THEN 'palavras_chave_oc' WHEN event_id % 6 = 2 THEN 'palavras_chave_cotacao' ELSE 'sem_tipo_definido' END AS reason FROM {events})"""
query("t1_dedup_messages", "SELECT DISTINCT 'm' || CAST(event_id % 9000 AS VARCHAR) AS msg_id, true AS whole FROM {events}")(whole_messages)
query("t1_not_labelled", "SELECT event_id FROM {events} WHERE event_type <> 'view'")(
    lambda s: M.not_labelled(s.events.withColumn("labels", F.array(F.lit("INBOX"), F.concat(F.lit("Gamma/"), F.col("event_type")))), "gamma/view").select("event_id"))
query("t4_message_review", f"SELECT 'revisao' AS kind, msg_id, 1 AS n FROM ({_STREAMED}) WHERE route = 'revisar' GROUP BY msg_id UNION ALL SELECT 'erro', msg_id, count(*) FROM ({_STREAMED}) WHERE event_type = 'error' GROUP BY msg_id")(
    lambda s: table_of(M.message_review(routed(event_stream(s)).withColumn("error", F.when(F.col("event_type") == "error", "sem anexo"))), s, "review").groupBy("kind", "msg_id").agg(F.count(F.lit(1)).alias("n")))
query("t4_remove_from_review", "SELECT event_id FROM {events} WHERE event_type = 'error' OR NOT (event_id % 10 = 7 OR event_type = 'click')")(
    lambda s: M.remove_from_review(
        s.events.select("event_id", F.col("event_id").cast("string").alias("msg_id"), F.when(F.col("event_type") == "error", "erro").otherwise("revisao").alias("kind"), F.col("event_type").alias("route_reason")),
        s.events.filter("event_id % 10 = 7").select(F.col("event_id").cast("string").alias("msg_id"), F.lit("x").alias("reason")).unionByName(s.events.filter("event_type = 'click'").select(F.lit(None).cast("string").alias("msg_id"), F.col("event_type").alias("reason")).distinct()))
    .select("event_id"))
