"""Review queue, learning, register of companies, and their metrics (U, R, A11-A23, W8-W17, V, J15, J23)."""
import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores as D
from ..functions import text as T
from ..session import cut_lineage
from .common import contained, exact_quantile, first_per_key, last_per_key, ranked
from .similarity import near_pairs


def micros(c):
    """Microseconds since the epoch of either timestamp type (the session runs in UTC)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


#: Columns that a new suggestion always replaces, and those that stay unless the new one says something.
SUGGESTED = ("item_no", "suggested_code", "suggested_description", "score", "match_type", "ai_confidence", "ai_reason")
WHEN_GIVEN = ("alert", "composition")


def upsert_review(queue, new, now=None):
    """A pending row of the same document and wording is refreshed, others are added; alert and composition only when given.

    Several new rows of one wording count in the order of ``row_ord``: the last suggestion holds, and the last alert and
    composition that say something.  Columns that ``new`` lacks stay as they are.  ``now`` is the creation time of added
    rows (by default the time of the call) and part of their id, so a wording that comes again after its row was resolved,
    or after retention has removed that, gets an id of its own.
    """
    keys = ["document", "description"]
    now = F.lit(dt.datetime.now(dt.timezone.utc)) if now is None else now
    always, given = [c for c in SUGGESTED if c in new.columns], [c for c in WHEN_GIVEN if c in new.columns]
    said = lambda c: F.max_by(F.col(c), F.when(F.coalesce(c, F.lit("")) != "", F.col("row_ord"))).alias("n_" + c)
    n = new.groupBy(*keys).agg(F.max_by(F.struct(*always), "row_ord").alias("_t"), *[said(c) for c in given])
    n = n.select(*keys, *[F.col(f"_t.{c}").alias("n_" + c) for c in always], *["n_" + c for c in given], F.lit(True).alias("_new"))
    for c in [*always, *given]:
        if c not in queue.columns:
            queue = queue.withColumn(c, F.lit(None).cast(new.schema[c].dataType))
    pend = first_per_key(queue.filter("status = 'pendente'").select(*keys, "id"), keys, "id").withColumn("_hit", F.lit(True))
    j = queue.join(pend, [*keys, "id"], "left").join(n, keys, "left").withColumn("_u", F.coalesce("_hit", F.lit(False)) & F.coalesce("_new", F.lit(False)))

    def column(c):
        if c in always:
            return F.when(F.col("_u"), F.col("n_" + c)).otherwise(F.col(c)).alias(c)
        if c in given:
            return F.when(F.col("_u"), F.coalesce("n_" + c, c)).otherwise(F.col(c)).alias(c)
        return F.col(c)
    kept = j.select(*[column(c) for c in queue.columns])
    had = queue.groupBy(*keys).agg(F.count(F.lit(1)).alias("_had"))
    at = now.cast("timestamp")
    fresh = n.join(pend.select(*keys), keys, "left_anti").join(had, keys, "left").select(
        F.xxhash64(*keys, F.lit("review"), F.unix_micros(at), F.coalesce("_had", F.lit(0))).alias("id"), *keys, *[F.col("n_" + c).alias(c) for c in [*always, *given]],
        F.lit("pendente").alias("status"), at.alias("created_at"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def prune_pending(queue, kept, documents):
    """Pending rows of the processed documents that were not generated this time go."""
    stale = queue.filter("status = 'pendente'").join(documents.select("document").distinct(), "document", "left_semi") \
        .join(kept.select("document", "description").distinct(), ["document", "description"], "left_anti").select("id", "status").distinct()
    return queue.join(stale, ["id", "status"], "left_anti").select(*queue.columns)


def retain(queue, now, days=180):
    """U3."""
    return queue.filter(~F.coalesce((F.col("status") == "resolvido") & (F.col("resolved_at") < now - F.make_dt_interval(F.lit(days))), F.lit(False)))


def apply_decisions(queue, decisions, now):
    """U4: resolve or discard by id."""
    d = decisions.select("id", F.col("decision").alias("_d"), F.col("correct_code").alias("_c"), F.col("user").alias("_u"))
    j = queue.join(d, "id", "left")
    return j.withColumn("status", F.coalesce("_d", "status")).withColumn("correct_code", F.when(F.col("_d") == "resolvido", F.col("_c")).otherwise(F.col("correct_code"))) \
        .withColumn("corrected_by", F.col("_u")).withColumn("resolved_at", F.when(F.col("_d").isNotNull(), now).otherwise(F.col("resolved_at"))).drop("_d", "_c", "_u")


def upsert_corrections(corrections, new):
    """Latest product per wording, upper and lower case alike."""
    both = corrections.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = last_per_key(both.withColumn("_k", F.lower("description")), "_k", ["_new", "row_ord"])
    first = both.groupBy(F.lower("description").alias("_k")).agg(F.min_by("description", F.struct("_new", "row_ord")).alias("description"))
    return latest.drop("description").join(first, "_k").select("description", "product_code", "row_ord")


def merge_fill(old, new, keys, columns):
    """Only empty fields are filled; confidence rises, never falls."""
    n = new.select(*keys, *[F.col(c).alias("n_" + c) for c in [*columns, "confidence"]])
    j = old.join(n, keys, "left")
    for c in columns:
        j = j.withColumn(c, F.coalesce(F.nullif(c, F.lit("")), F.nullif("n_" + c, F.lit("")), c))
    return j.withColumn("confidence", F.greatest("confidence", F.coalesce("n_confidence", "confidence"))).drop(*["n_" + c for c in [*columns, "confidence"]])


def resolve_company(rows, companies):
    """Tax-number root first, then the company name key."""
    c = companies.withColumn("_root", F.substring("tax_id", 1, 8)).withColumn("_key", T.company_key(F.col("name")))
    by_root = c.filter("length(tax_id) >= 8").groupBy("_root").agg(F.min("id").alias("root_id"))
    by_name = c.filter("_key <> ''").groupBy("_key").agg(F.min("id").alias("name_id"))
    r = rows.withColumn("_d", T.digits(F.col("tax_id"))).withColumn("_root", F.when(F.length("_d") >= 8, F.substring("_d", 1, 8))).withColumn("_key", F.nullif(T.company_key(F.col("name")), F.lit("")))
    return r.join(by_root, "_root", "left").join(by_name, "_key", "left").withColumn("company_id", F.coalesce("root_id", "name_id")).drop("_d", "_root", "_key", "root_id", "name_id")


def register_documents(headers, companies):
    """Company, site, contact and document of each header; new ones get a key from their natural key."""
    h = resolve_company(headers, companies)
    h = h.withColumn("company_id", F.coalesce("company_id", F.xxhash64(T.company_key(F.col("name")))))
    site = F.coalesce(F.nullif("site_code", F.lit("")), T.company_key(F.col("site_name")))
    return h.withColumn("site_id", F.xxhash64("company_id", site)).withColumn("contact_id", F.xxhash64("company_id", F.lower(F.trim("email")))) \
        .withColumn("document_id", F.xxhash64("doc_number", "doc_system")).withColumn("status", F.when(F.col("confidence") < 0.60, "revisao").otherwise("processado"))


def site_key(df):
    """U8: site by company and code, else by company and name."""
    return df.groupBy("company_id", F.coalesce(F.nullif("site_code", F.lit("")), T.company_key(F.col("site_name"))).alias("site_key")).agg(
        F.count("*").alias("documents"), F.max(F.nullif("city", F.lit(""))).alias("city"))


def review_metrics(queue, now):
    """One row; the median interpolates exactly (a few counting jobs run when this is called)."""
    hours = (micros("resolved_at") - micros("created_at")) / 3.6e9
    done = F.col("status") == "resolvido"
    median = exact_quantile(queue.filter(done).select((micros("resolved_at") - micros("created_at")).alias("v")), "v")
    m = queue.agg(F.count_if(F.col("status") == "pendente").alias("pending"), F.min(F.when(F.col("status") == "pendente", F.col("created_at"))).alias("_old"),
                  F.count_if(done).alias("resolved"), F.count_if(F.col("status") == "descartado").alias("discarded"),
                  F.count_if(done & (F.col("resolved_at") >= now - F.make_dt_interval(F.lit(30)))).alias("resolved_30_days"),
                  F.avg(F.when(done, hours)).alias("_mean"), F.lit(None if median is None else median / 3.6e9).cast("double").alias("_median"), F.countDistinct(F.when(done, F.col("document"))).alias("corrected_documents"))
    decided = F.col("resolved") + F.col("discarded")
    return m.select("pending", F.rint((micros(now) - micros("_old")) / 8.64e10).cast("long").alias("oldest_days"), "resolved", "discarded", "resolved_30_days",
                    F.when(decided > 0, F.rint(F.col("resolved") * 100 / decided).cast("long")).alias("correction_rate"),
                    T.hours_text(F.col("_mean")).alias("mean_time"), T.hours_text(F.col("_median")).alias("median_time"), "corrected_documents")


def top_corrected(queue, k=5):
    """A top-k report."""
    g = queue.groupBy("document").agg(F.count_if(F.col("status") == "resolvido").alias("corrections"), F.count_if(F.col("status") == "descartado").alias("discarded"), F.count_if(F.col("status") == "pendente").alias("pending"))
    return g.filter("corrections > 0").orderBy(F.desc("corrections"), F.desc("pending"), "document").limit(k)


def ops_metrics(docs, today):
    """Today, last seven days and all, by client and by format in one pass."""
    g = docs.groupingSets([["client"], ["layout"], []], "client", "layout")
    return g.agg(F.grouping_id().alias("level"), F.count("*").alias("documents"), F.count_if(F.col("day") == today).alias("today"), F.count_if(F.col("day") >= F.date_sub(today, 7)).alias("last_7_days"),
                 F.round(F.avg("match_rate"), 4).alias("mean_match_rate"))


def shadow_stats(log):
    """A14."""
    return log.agg(F.count("*").alias("total"), F.count_if("agree").alias("agree"), F.count_if(~F.col("agree")).alias("differ"),
                   F.round(F.count_if("agree") * 100 / F.count("*"), 1).alias("pct"))


def promote_rules(history, minimum=2):
    """Wording and product confirmed often enough by hand; the latest promotion of a key counts."""
    g = history.filter(F.col("final_type").isin("CORRECAO_MANUAL", "MANUAL")).groupBy("description", "product_code").agg(
        F.count("*").alias("confirmations"), F.max(F.struct("validated_at", "id")).alias("_last")).filter(F.col("confirmations") >= minimum)
    return g.withColumn("rule_key", T.rule_key(F.col("description"))).groupBy("rule_key").agg(
        F.max_by(F.struct("product_code", "confirmations", "description"), F.struct("_last", "product_code")).alias("_r")).select("rule_key", "_r.*")


def learning_stats(history, rules):
    """A15."""
    a = history.agg(F.count_if(F.col("final_type") == "CORRECAO_MANUAL").alias("corrections"), F.countDistinct("client_id").alias("clients"))
    return a.withColumn("_j", F.lit(1)).join(rules.agg(F.count("*").alias("rules")).withColumn("_j", F.lit(1)), "_j").drop("_j")


def crm_stats(companies, sites, documents):
    """One row of counts from three tables."""
    parts = [companies.select(F.lit("companies").alias("t")), sites.select(F.lit("sites").alias("t")),
             documents.select(F.when(F.col("status") == "revisao", "pending_documents").otherwise("documents").alias("t"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    n = lambda *v: F.count_if(F.col("t").isin(*v))
    return u.agg(n("companies").alias("companies"), n("sites").alias("sites"), n("documents", "pending_documents").alias("documents"), n("pending_documents").alias("pending_documents"))


def update_match_counts(docs, items):
    """A22."""
    g = items.groupBy("doc_id").agg(F.count("*").alias("total_items"), F.count_if("matched").alias("matched_items"))
    return docs.join(g, "doc_id", "left")


def latest(df, k, *order):
    """Newest first, limited: a top-k report."""
    return df.orderBy(*order).limit(k)


def page(df, order, number, size=100):
    """One page of a sorted list; a number past the end gives the last page.

    The sort is a range-partitioned one and the page bounds come from partition
    counts, so no global window puts the table in one task.
    """
    total = df.count()
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def last_touched(artefacts):
    """W17."""
    return artefacts.groupBy("doc_id").agg(F.max("mtime").alias("last_touched"))


def suggest_history(items, history, floor=0.82, k=5):
    """Similar validated wordings, own client first, the others only when it has none."""
    h = history.withColumn("h_text", F.upper(F.trim("description"))).filter("h_text <> ''")
    q = items.withColumn("q_text", F.upper(F.trim("description")))
    pairs = near_pairs(q.select(F.col("q_text").alias("a")), h.select(F.col("h_text").alias("b")), floor)
    pairs = cut_lineage(pairs.withColumn("history_score", D.sequence_ratio(F.col("a"), F.col("b"))).filter(F.col("history_score") >= floor)
                        .withColumn("history_score", F.round("history_score", 4)).select("a", "b", "history_score"))
    # a wording's rows come in one order, so its first k per client, or of all, hold every row that can be among the first k
    newest = [F.desc("validated_at"), "h_id"]
    h = h.select(F.col("h_text").alias("b"), F.col("client_id").alias("h_client"), F.col("product_code").alias("h_code"), F.col("id").alias("h_id"), "validated_at")
    mine, all_ = (ranked(h, ["b", *by], newest, "_n").filter(F.col("_n") <= k).drop("_n") for by in (["h_client"], []))
    asked = q.select(F.col("q_text").alias("a"), F.col("client_id").alias("a_client")).distinct()

    def first(found, by):
        return ranked(found, by, [F.desc("history_score"), *newest], "_n").filter(F.col("_n") <= k).drop("_n", "b")
    own = cut_lineage(first(asked.join(pairs, "a").join(mine.withColumn("a_client", F.col("h_client")), ["b", "a_client"]), ["a", "a_client"]))
    rest = asked.join(own.select("a", "a_client").distinct(), ["a", "a_client"], "left_anti")
    other = rest.join(first(pairs.join(all_, "b"), ["a"]), "a")
    found = own.withColumn("_own", F.lit(True)).unionByName(other.withColumn("_own", F.lit(False)))
    j = q.select("item_id", "client_id", "q_text").join(found, (F.col("q_text") == F.col("a")) & F.col("client_id").eqNullSafe(F.col("a_client")))
    j = j.withColumn("_any", F.max("_own").over(W.partitionBy("item_id"))).filter(F.col("_own") | ~F.col("_any")) \
        .withColumn("origin", F.when(F.col("_own"), "CLIENTE").otherwise("GLOBAL"))
    w = W.partitionBy("item_id").orderBy("origin", F.desc("history_score"), F.desc("validated_at"), "h_id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "origin", "history_score", "h_code", "h_id")


def lookup_rule(items, rules, floor=0.88):
    """Exact key, else the most similar key at or above the floor."""
    i = items.select("description").distinct().withColumn("rule_key", T.rule_key(F.col("description")))
    r = rules.select("rule_key", F.col("product_code").alias("rule_code"))
    exact = i.join(r, "rule_key").select("description", "rule_code", F.lit(1.0).alias("score"))
    rest = i.join(r, "rule_key", "left_anti")
    p = near_pairs(rest.select(F.col("rule_key").alias("a")), r.select(F.col("rule_key").alias("b")), floor) \
        .withColumn("score", D.sequence_ratio(F.col("a"), F.col("b"))).filter(F.col("score") >= floor)
    best = p.join(r, F.col("b") == F.col("rule_key")).groupBy("a").agg(F.min_by(F.struct("rule_code", "score"), F.struct((-F.col("score")).alias("s"), "b")).alias("_b"))
    return exact.unionByName(rest.join(best, F.col("a") == F.col("rule_key")).select("description", "_b.rule_code", "_b.score"))


def append_validation(df):
    """Blanks become null before the append."""
    return df.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def of_key(df, column, value, order):
    """Rows of one document or client, newest first."""
    return df.filter(F.col(column) == value).orderBy(F.desc(order))


def apply_corrections(result, resolved):
    """Resolved products by exact wording within the document, second wording for rows still unmatched."""
    r = last_per_key(resolved.filter("status = 'resolvido'").select("document", "description", "correct_code", "id"), ["document", "description"], "id") \
        .select("document", F.col("description").alias("_d"), F.col("correct_code").alias("_c"))
    a = result.join(r.withColumnRenamed("_c", "_c1"), (result["document"] == r["document"]) & (result["description"] == F.col("_d")), "left").drop(r["document"]).drop("_d")
    r2 = r.select(F.col("document").alias("_doc"), F.col("_d").alias("_d2"), F.col("_c").alias("_c2"))
    b = a.join(r2, (F.col("document") == F.col("_doc")) & (F.col("description_2") == F.col("_d2")), "left").drop("_doc", "_d2")
    return b.withColumn("corrected_code", F.coalesce("_c1", "_c2")).withColumn("product_code", F.coalesce("corrected_code", "product_code")).drop("_c1", "_c2")


def refresh_review(queue, results, documents, now, alerts=None):
    """Lines that need review go in (Q6), then those with an equivalence alert (Q7), stale pending rows and old resolved ones out.

    ``alerts`` (alert_code, alert) meets the lines by client code; an alerted line is in the queue even if its match is good.
    """
    from .quantity import equivalence_alert, needs_review
    new = needs_review(results)
    if alerts is not None:
        lines = equivalence_alert(results.drop("alert"), alerts)
        last = F.lit(1 << 62).cast("decimal(38,0)")
        new = new.withColumn("row_ord", F.col("row_ord").cast("decimal(38,0)")).unionByName(lines.withColumn("row_ord", F.col("row_ord") + last), allowMissingColumns=True)
    return retain(prune_pending(upsert_review(queue, new, now), new, documents), now)


def attach_return(processes, returns, now):
    """U16."""
    r = returns.select("process_id", F.col("value").alias("_v"))
    return processes.join(r, "process_id", "left").withColumn("state", F.when(F.col("_v").isNotNull(), "retorno_comparado").otherwise(F.col("state"))) \
        .withColumn("return_value", F.coalesce("_v", "return_value")).withColumn("returned_at", F.when(F.col("_v").isNotNull(), now)).drop("_v")


def failed_documents(a, b):
    """Union of two origins, the first origin of a name counts."""
    return first_per_key(a.withColumn("origin", F.lit(1)).unionByName(b.withColumn("origin", F.lit(2))), "name", "origin")


def visible_documents(docs, removed):
    """F16."""
    return docs.join(removed.select("name").distinct(), "name", "left_anti")


def document_status(inputs, processed, outputs, running):
    """State of each name from the four sets it appears in."""
    tag = lambda d, c: d.select("name", F.lit(c).alias("c")).distinct()
    u = tag(inputs, "in").unionByName(tag(processed, "done")).unionByName(tag(outputs, "out")).unionByName(tag(running, "run"))
    has = lambda c: F.max(F.col("c") == c)
    g = u.groupBy("name").agg(has("in").alias("i"), has("done").alias("d"), has("out").alias("o"), has("run").alias("r"))
    return g.select("name", F.when(F.col("r"), "processando").when(F.col("o"), "concluido").when(F.col("d"), "movido_sem_planilha").otherwise("aguardando").alias("status"))


def search_catalogue(queries, cat, k=10):
    """Products whose description or code contains the query of two or more characters; the queries run as one automaton."""
    q = queries.select("query", F.upper(F.trim("query")).alias("needle")).filter("length(needle) >= 2").distinct()
    body = F.upper(F.concat_ws(" \n ", "product_code", "description"))
    hits = contained(cat, "row_ord", body, q, F.col("needle")).join(q, "needle").join(cat.select("row_ord", "product_code", "description"), "row_ord")
    d = first_per_key(hits.select("query", "product_code", "description", "row_ord"), ["query", "product_code"], "row_ord")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("row_ord"))).filter(F.col("rank") <= k)


# ---- scalars from JSON, text and dates ----

def trusted_numbers(docs, floor=0.9):
    """V1."""
    c = F.get_json_object("raw_json", "$.confianca").try_cast("double")
    return docs.withColumn("confidence", c).filter((F.col("confidence") >= floor) & (T.text(F.col("number")) != ""))


def process_stats(df):
    """V2."""
    return df.withColumn("items", F.coalesce(F.get_json_object("stats", "$.total").try_cast("long"), F.lit(0)))


def age_days(ts, now):
    """V3."""
    return (micros(now) - micros(ts)) / 8.64e10


def hours_between(a, b):
    return (micros(b) - micros(a)) / 3.6e9


def report_metrics(c):
    """V4: counters read from a report; pending is derived when it is not stated."""
    low = F.lower(T.text(c))
    return T.let(low, lambda low: F.struct(
        pick_in(low, r"(\d+)\s*itens?\s*(?:lidos|extra[ií]dos|extraidos|identificados)", r"(\d+)\s*iten[s]?\b").alias("items"),
        pick_in(low, r"(\d+)\s*matches?\s*(?:encontrados|confirmados)?", r"(\d+)\s*match\b", r"(\d+)\s*correspond[eê]ncias?\s*(?:encontradas|confirmadas)?").alias("matches"),
        F.coalesce(pick_in(low, r"(\d+)\s*pendentes?\b", r"(\d+)\s*itens?\s*pendentes?\b"),
                   F.greatest(pick_in(low, r"(\d+)\s*itens?\s*(?:lidos|extra[ií]dos|extraidos|identificados)", r"(\d+)\s*iten[s]?\b")
                              - pick_in(low, r"(\d+)\s*matches?\s*(?:encontrados|confirmados)?", r"(\d+)\s*match\b", r"(\d+)\s*correspond[eê]ncias?\s*(?:encontradas|confirmadas)?"), F.lit(0))).alias("pending")))


def pick_in(low, *patterns):
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")).try_cast("int") for p in patterns])


def progress(df):
    """V5: stage of a document from its report text and flags."""
    t = F.lower(T.text(F.col("text")))
    err = t.rlike(r"traceback|\[web\] processo finalizado com erro|erro ao|exception|falha ao|encerrado por timeout|timeout")
    sheet = t.rlike("planilha|excel|xlsx")
    match = t.rlike("match|comparando|descri|correspond|similaridade|c[óo]digo")
    return df.withColumn("stage", F.when(err, "erro").when(F.col("running") & sheet, "planilha").when(F.col("running") & match, "match").when(F.col("running"), "extracao")
                         .when(F.col("has_sheet"), "concluido").when(F.col("moved"), "movido_sem_planilha").otherwise("aguardando"))


def used_correction(items):
    """V6."""
    return items.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("match_type") == "MATCH_CORRECAO_APRENDIDA", F.lit(False))).alias("used"))
