"""Message intake (T1-T7, J13): stateless rules, stream-static joins and exactly-once de-duplication."""
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

# What marks an order, a quotation, a reply, and the supplier in a message.
ORDER_WORDS = ["ordem de compra", "order", "pedido de compra", "fornecimento", " oc ", "oc:", "oc nº", "oc n°", "pedido nº", "pedido n°"]
QUOTE_WORDS = ["cotação", "cotacao", "cotar", "solicitação de preço", "solicitacao de preco", "proposta", "orçamento", "orcamento", "price", "quote", "rfq",
               "solicito preço", "solicito preco"]
REPLY_PREFIXES = ["re:", "res:", "рес:", "fwd:", "fw:", "enc:", "encaminhado:", "respondido:"]
SUPPLIER_TERMS = [R.SUPPLIER.lower(), "00.145.602"]
NO_REPLY_CLIENTS = ["mrv"]


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark):
    """Streams started from here keep their keyed state in RocksDB: ids of years stay out of the executors' heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def dedup_messages(messages, prefix=None):
    """Whole messages, each id once, however late it comes and however old the first one is.

    The ids are keyed state without a horizon; a micro-batch looks up its own ids and no others, so its cost doesn't grow
    with the ids seen before.  Of messages with one id in the same micro-batch any one passes.  ``prefix`` leaves out
    messages that carry one of our labels.  A retried micro-batch repeats its decisions from the state of the one before.
    """
    return (not_labelled(messages, prefix) if prefix else messages).dropDuplicates(["msg_id"])


def not_labelled(df, prefix):
    """Messages that already carry one of our labels were handled before."""
    return df.filter(~F.exists("labels", lambda x: F.lower(x).startswith(prefix)))


def _any(c, words):
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def classify_message(df):
    """Class and reason of a message."""
    subject, body = T.text(F.col("subject")), T.text(F.col("body"))
    low = F.lower(F.concat(subject, F.lit(" "), body))
    names = F.array_join(F.transform("attachments", lambda a: F.lower(a["name"])), "\n")
    pdf = F.exists("attachments", lambda a: a["extension"] == ".pdf")
    reply = reduce(lambda a, b: a | b, [F.ltrim(F.lower(subject)).startswith(p) for p in REPLY_PREFIXES])
    ours = _any(low, SUPPLIER_TERMS) | _any(names, SUPPLIER_TERMS)
    order, quote = _any(low, ORDER_WORDS), _any(low, QUOTE_WORDS)
    reason = (F.when(F.size("attachments") <= 0, "sem_anexo").when(~pdf, "anexo_sem_pdf").when(reply, "resposta_ou_encaminhamento")
              .when(~ours, "nao_identificado").when(order & ~quote, "palavras_chave_oc").when(quote & ~order, "palavras_chave_cotacao")
              .when(order & quote, "ambiguo_oc_e_cotacao").otherwise("sem_tipo_definido"))
    df = df.withColumn("reason", reason)
    return df.withColumn("message_class", F.when(F.col("reason") == "sem_anexo", "ignorar").when(F.col("reason") == "palavras_chave_oc", "oc")
                         .when(F.col("reason") == "palavras_chave_cotacao", "cotacao").otherwise("revisar"))


def identify_sender(df, clients, systems=(), minimum=2):
    """Provider markers win outright; otherwise the best additive score 3/3/2/1, first in the list on ties.

    ``clients`` and ``systems`` are registers of a few dozen entries, kept as
    plain data, so the scores are one expression per message and no join.
    """
    low = F.lower(F.concat_ws(" ", "sender", "subject", "body"))
    plain = F.translate(low, "./-", "")
    names = F.array_join(F.transform("attachments", lambda a: F.lower(a["name"])), " ")
    sender = F.lower("sender")

    def hit(c, values, points):
        return F.when(_any(c, [v.lower() for v in values]), points).otherwise(0) if values else F.lit(0)

    scored = [F.struct((hit(sender, c.get("domains"), 3) + hit(plain, c.get("tax_ids"), 3) + hit(low, c.get("words"), 2) + hit(names, c.get("markers"), 1)).alias("score"),
                       F.lit(-i).alias("k"), F.lit(c["id"]).alias("id"), F.lit(c.get("layout")).cast("string").alias("layout"))
              for i, c in enumerate(clients) if c.get("active", True)]
    best = F.array_max(F.array(*scored))
    system = F.coalesce(*[F.when(_any(low, [m.lower() for m in x["markers"]]), F.lit(x["id"])) for x in systems], F.lit(None).cast("string"))
    df = df.withColumn("_best", best).withColumn("_system", system)
    known = F.col("_system").isNotNull() | (F.col("_best.score") >= minimum)
    return df.withColumn("identified", known).withColumn("client_id", F.coalesce("_system", F.when(F.col("_best.score") >= minimum, F.col("_best.id")), F.lit("desconhecido"))) \
        .withColumn("client_score", F.when(F.col("_system").isNotNull(), 5).otherwise(F.col("_best.score"))).drop("_best", "_system")


def route_message(df):
    """A known client lifts an unidentified order; an unknown one sends it to review."""
    lift = F.col("identified") & (F.col("client_score") >= 3) & (F.col("reason") == "nao_identificado") & (F.col("message_class") == "revisar")
    drop = ~F.col("identified") & F.col("message_class").isin("oc", "cotacao")
    return df.withColumn("route", F.when(lift, "oc").when(drop, "revisar").otherwise(F.col("message_class"))) \
        .withColumn("route_reason", F.when(lift, F.concat(F.lit("cliente_conhecido_promovido ("), F.col("client_id"), F.lit(")"))).when(drop, "cliente_nao_identificado").otherwise(F.col("reason")))


def message_review(messages):
    """T4: rows for the review list: each message id to review once (kind ``revisao``), and every processing error (``erro``).

    ``messages`` may have a column ``error``; other columns of the message come along.
    """
    if "error" not in messages.columns:
        messages = messages.withColumn("error", F.lit(None).cast("string"))
    review = messages.filter("route = 'revisar'").withColumn("kind", F.lit("revisao")).dropDuplicates(["msg_id"])
    errors = messages.filter("error IS NOT NULL").withColumn("kind", F.lit("erro")).withColumn("route_reason", F.col("error"))
    return review.unionByName(errors).drop("error")


def remove_from_review(entries, removals):
    """T4: the list without the reviews named by ``msg_id`` or by ``reason`` in a row of ``removals``; errors stay."""
    ids = removals.filter("msg_id IS NOT NULL").select("msg_id").distinct()
    reasons = removals.filter("msg_id IS NULL AND reason IS NOT NULL").select(F.col("reason").alias("route_reason")).distinct()
    left = entries.filter("kind = 'revisao'").join(ids, "msg_id", "left_anti").join(reasons, "route_reason", "left_anti")
    return left.select(*entries.columns).unionByName(entries.filter("kind <> 'revisao'"))


def attachments(df):
    """T5: one row per PDF, prefixed, and numbered where a name repeats."""
    a = df.select("msg_id", "received_at", F.posexplode("attachments").alias("pos", "a")).filter("a.extension = '.pdf'") \
        .withColumn("name", F.when(F.col("a.name").startswith("EMAIL_"), F.col("a.name")).otherwise(F.concat(F.lit("EMAIL_"), F.col("a.name"))))
    n = F.row_number().over(W.partitionBy("name").orderBy("received_at", "msg_id", "pos"))
    return a.withColumn("_n", n).withColumn("file_name", F.when(F.col("_n") == 1, F.col("name")).otherwise(
        F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), F.col("_n").cast("string"), F.lit(".pdf")))).select("msg_id", "pos", "file_name")


def reply_plan(df):
    """Intended replies; nothing is sent."""
    return df.filter(~F.lower("client_id").isin(NO_REPLY_CLIENTS)).select("msg_id", F.coalesce(F.nullif(F.trim("reply_to"), F.lit("")), "sender").alias("reply_address"))


def next_documents(docs, done):
    """Open order documents, oldest first."""
    return docs.filter("extension in ('.pdf') and kind <> 'COTACAO'").join(done.select("name").distinct(), "name", "left_anti").orderBy("mtime", "name")
