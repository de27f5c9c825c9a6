"""Operators on small fixtures, against stated values or brute force."""
import datetime as dt
import decimal

from pyspark.sql import functions as F

from lineweave.functions import rules as R
from lineweave.operators import catalogue as C
from lineweave.operators import clienttable as X
from lineweave.operators import linkage as L
from lineweave.operators import pricing as Pr
from lineweave.operators import quantity as Q
from lineweave.operators import review as V
from lineweave.operators.common import soft_filter, soft_rank
from lineweave.operators.similarity import near_pairs


def test_quantity_rule(spark):
    rows = [(12.0, None, "M", 6.0, "CONVERTIDO_METRO_PARA_BARRA_CEIL", 2.0), (432.0, None, "M", 0.134, "TUBO_COMPRIMENTO_NAO_E_BARRA_REVISAR", 432.0), (72.0, None, "BR", 6.0, "BARRA_DIRETA_OC_BAR", 72.0),
            (5.0, None, "UN", 6.0, "BARRA_DIRETA_OC_UN", 5.0), (12.0, "M", "BR", 6.0, "CONVERTIDO_METRO_PARA_BARRA_CEIL", 2.0), (72.0, "NaN", "BR", 6.0, "BARRA_DIRETA_OC_BAR", 72.0),
            (72.0, None, "GALAO", 6.0, "UNIDADE_OC_NAO_MAPEADA(GALAO)", 72.0), (10.0, None, "CX", 6.0, "TUBO_UNIDADE_CAIXA_REVISAR", 10.0)]
    df = spark.createDataFrame(rows, "qty double, unit_a string, unit_b string, bar_length_m double, want string, want_qty double").withColumn("is_tube", F.lit(True))
    for r in Q.adjust_quantity(df, units=("unit_a", "unit_b")).collect():
        assert (r.quantity_kind, r.adjusted_qty) == (r.want, r.want_qty)


def test_order_against_quote(spark):
    o = spark.createDataFrame([("d", "1", "A", 1.0, "10.00", 1), ("d", "0029", "B", 1.0, "10.00", 2), ("d", "331", "C", 1.0, "10.00", 3), ("d", "1232", "D", 1.0, "1.412", 4)], "doc_id string, product_code string, description string, qty double, price string, row_ord long")
    q = spark.createDataFrame([("d", "1", "A", 1.0, "11.0", 1), ("d", "29", "B", 1.0, "10.0", 2), ("d", "331", "C", 1.0, "9.0", 3), ("d", "777", "E", 1.0, "3.0", 4)], "doc_id string, product_code string, description string, qty double, price string, row_ord long")
    got = {r.code: (r.status, None if r.discount is None else float(r.discount), None if r.final_price is None else float(r.final_price)) for r in Pr.compare_order_quote(o, q).collect()}
    assert got == {"1": ("OK", 9.09091, 10.0), "29": ("ABAIXO", 0.0, 10.0), "331": ("ABAIXO", 0.0, 9.0), "1232": ("SEM_ORC", None, None), "777": ("SEM_OC", None, None)}


def test_return_of_a_process(spark):
    p = spark.createDataFrame([("p", 1, "331", "ADAPTADOR SOLD CURTO 25MM X 3/4", "", 484.0, "UN", 0.652, 315.57), ("p", 2, "", "TUBO PVC SOLDAVEL 75MM", "", 4.0, "BR", 33.6163, 134.47), ("p", 3, "9", "RALO", "", 1.0, "UN", 5.0, 5.0)],
                              "process_id string, row_ord long, product_code string, description string, table_description string, qty double, unit string, table_price double, table_total double")
    r = spark.createDataFrame([("p", 1, "0331", "ADAPTADOR SOLD CURTO 25MM X 3/4", 484.0, 0.58), ("p", 2, "29", "TUBO SOLDAVEL PVC 75MM", 4.0, 180.0), ("p", 3, "5", "CAIXA SIFONADA", 1.0, 2.0)], "process_id string, row_ord long, product_code string, description string, qty double, price double")
    rows = {x.description: x for x in Pr.compare_return(p, r).collect()}
    a, t = rows["ADAPTADOR SOLD CURTO 25MM X 3/4"], rows["TUBO PVC SOLDAVEL 75MM"]
    assert (a.discount_pct, a.return_total, a.status) == (11.04, 280.72, "OK")
    assert round(t.table_price, 3) == 201.698 and t.via == Pr.VIA_TEXT
    assert rows["RALO"].status == "SEM" and rows["CAIXA SIFONADA"].via == Pr.VIA_RETURN


def test_greedy_choice_takes_each_return_once(spark):
    import pandas as pd
    df = pd.DataFrame([("p", 1, 7, 0.9), ("p", 1, 8, 0.8), ("p", 2, 7, 0.95), ("p", 2, 8, 0.6), ("q", 1, 7, 0.5)], columns=["process_id", "row_ord", "r_ord", "score"])
    halves = [df.iloc[:3], df.iloc[3:]]
    out = pd.concat(list(Pr.greedy_stream(halves)))
    assert out[["process_id", "row_ord", "r_ord"]].values.tolist() == [["p", 1, 7], ["p", 2, 8], ["q", 1, 7]]


def test_parallel_rounds_choose_like_the_serial_order(spark):
    import random
    rng = random.Random(3)
    rows = list({(p, i, r): (p, i, r, rng.choice([0.5, 0.6, 0.75, 0.9])) for p in ("p", "q") for i in range(40) for r in rng.sample(range(50), rng.randrange(0, 12))}.values())
    rows += [("hot", i, r, 0.8) for i in range(12) for r in range(9)]
    want = []
    for p in ("p", "q", "hot"):
        taken = set()
        for i in range(40):
            free = [(-s, r) for q, j, r, s in rows if (q, j) == (p, i) and r not in taken]
            if free:
                s, r = min(free)
                taken.add(r)
                want.append((p, i, r, -s))
    df = spark.createDataFrame(rows, "process_id string, row_ord long, r_ord long, score double")
    for serial in (10 ** 6, 30):
        assert sorted(map(tuple, Pr.choose_in_order(df, serial).collect())) == sorted(want)


def test_quantiles_by_radix_selection(spark):
    import statistics
    from lineweave.operators.common import exact_quantile
    for values in ([5], [-3, 9], [7, 7, -2 ** 40, 2 ** 50, 0, None], list(range(-50, 51)), [2 ** 62, -2 ** 62, 1, 2]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        assert exact_quantile(df, "v") == statistics.median(v for v in values if v is not None)
    assert exact_quantile(spark.createDataFrame([], "v long"), "v") is None


def test_soft_rank_equals_the_filter_chain(spark):
    df = spark.range(400).select((F.col("id") % 13).alias("item"), "id", *[(F.pmod(F.hash("id", F.lit(k)), F.lit(3)) == 0).alias(f"t{k}") for k in range(5)])
    chain = df
    for k in range(5):
        chain = soft_filter(chain, "item", F.col(f"t{k}"))
    ranked = df.withColumn("r", soft_rank([F.col(f"t{k}") for k in range(5)]))
    best = ranked.groupBy("item").agg(F.max("r").alias("m"))
    assert {r.id for r in chain.collect()} == {r.id for r in ranked.join(best, "item").filter("r = m").collect()}


def test_near_pairs_loses_no_pair(spark):
    import random
    from lineweave.functions.scores import lcs_lengths
    rnd = random.Random(3)
    base = ["".join(rnd.choice("ABCDE ") for _ in range(rnd.randint(4, 40))).strip() or "A" for _ in range(60)]
    other = [b[:i % 5] + "X" + b[i % 5:] for i, b in enumerate(base)] + base[:10]
    a, b = spark.createDataFrame([(x,) for x in base], "a string"), spark.createDataFrame([(x,) for x in other], "b string")
    want = set()
    for x in set(base):
        for y in set(other):
            if 2 * lcs_lengths([x], [y])[0] / (len(x) + len(y)) >= 0.82:
                want.add((x, y))
    assert {(r.a, r.b) for r in near_pairs(a, b, 0.82).collect()} == want


def catalogue(spark):
    rows = [(1, "24", "TUBO PVC SOLDAVEL - 6M - 25MM", "BR", 25.0, 6.0), (2, "500", "LUVA PVC SOLDAVEL 25MM", "PC", 25.0, 0.134), (3, "294", "PLUG ROSCAVEL 3/4", "PC", None, None),
            (4, "677", "PASTA LUBRIFICANTE 1 KG", "PC", None, None), (5, "1288", "QUADRO DISTR 36D/27N SEM BARRAMENTO", "PC", None, None), (6, "30", "JOELHO 90 PVC SOLDAVEL 25MM", "PC", 25.0, None),
            (7, "31", "JOELHO 45 PVC SOLDAVEL 25MM", "PC", 25.0, None), (8, "32", "JOELHO 90 PVC SOLDAVEL 32MM", "PC", 32.0, None), (9, "40", "TE PVC SOLDAVEL 50MM", "PC", 50.0, None),
            (10, "41", "BUCHA SOLDAVEL CURTA 50X25MM", "PC", None, None)]
    raw = spark.createDataFrame(rows, "row_ord long, product_code string, description string, sale_unit string, diameter_mm double, bar_length_m double") \
        .withColumn("diameter_final_mm", F.lit(None).cast("double")).withColumn("family", F.lit(None).cast("string")).withColumn("line", F.lit(None).cast("string"))
    return L.candidate_side(C.catalogue_features(C.build_catalogue(raw)))


def test_description_match(spark):
    texts = spark.createDataFrame([("JOE 90 SOLD 25MM",), ("joelho 45 soldável 25 mm",), ("TUBO SOLD 25MM 6M",), ("TE SOLD 50X25MM",), ("JOELHO ESGOTO 100MM",)], "description string")
    cat, items = catalogue(spark), L.item_features(texts)
    got = {r.description: (r.matched, r.product_code) for r in L.match_description(items, cat).collect()}
    assert got["JOE 90 SOLD 25MM"] == (True, "30") and got["joelho 45 soldável 25 mm"] == (True, "31") and got["TUBO SOLD 25MM 6M"] == (True, "24")
    assert "JOELHO ESGOTO 100MM" not in got and "TE SOLD 50X25MM" not in got
    comp = {r.description: r.composition for r in L.suggest_composition(items, cat).collect()}
    assert comp["TE SOLD 50X25MM"] == "40 TE PVC SOLDAVEL 50MM + 41 BUCHA SOLDAVEL CURTA 50X25MM"


def test_catalogue_rules(spark):
    texts = spark.createDataFrame([("PLUG PVC SOLD 3/4",), ("Pasta lubrificante",), ("PASTA LUBRIFICANTE 250 G",), ("QUADRO DISTRIBUICAO 36 DIN",), ("LUVA",)], "description string")
    got = {r.description: (r.product_code, r.blocks_fallback) for r in L.match_rules(texts, catalogue(spark)).collect()}
    assert got == {"PLUG PVC SOLD 3/4": ("294", False), "Pasta lubrificante": ("677", False), "PASTA LUBRIFICANTE 250 G": (None, True), "QUADRO DISTRIBUICAO 36 DIN": ("1288", False)}


def test_price_factor(spark):
    r = spark.createDataFrame([("a", x) for x in (0.90, 0.905, 0.91, 1.5, 2.0)] + [("b", 0.5), ("b", 3.0)], "doc_id string, ratio double")
    assert {x.doc_id: x.factor for x in X.price_factor(r).collect()} == {"a": 0.905}


def test_review_metrics(spark):
    d = dt.datetime
    q = spark.createDataFrame([(1, "A.pdf", "resolvido", d(2026, 10, 1, 8), d(2026, 10, 1, 10)), (2, "B.pdf", "resolvido", d(2026, 10, 2, 8), d(2026, 10, 2, 14))], "id long, document string, status string, created_at timestamp, resolved_at timestamp")
    r = V.review_metrics(q, F.lit(d(2026, 10, 3))).first()
    assert (r.mean_time, r.median_time, r.correction_rate, r.corrected_documents) == ("4 h", "4 h", 100, 2)


def test_validation_reasons(spark):
    df = spark.createDataFrame([(True, "MATCH_DESCRICAO", "1", 2.0, None, None), (False, "", None, None, -1.0, False)], "matched boolean, match_type string, product_code string, final_qty double, discount_pct double, discount_valid boolean")
    got = [r.validation_reason for r in Q.validate(df).collect()]
    assert got == ["OK", f"SEM_MATCH | TIPO_MATCH_NAO_APROVADO:VAZIO | SEM_CODIGO_{R.SUPPLIER} | SEM_QUANTIDADE_FINAL | DESCONTO_NEGATIVO | DESCONTO_INVALIDO"]


def test_resolved_wording_that_comes_again_gets_its_own_row(spark):
    now = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    schema = "id long, document string, description string, item_no string, suggested_code string, score double, match_type string, status string, created_at timestamp, alert string, correct_code string, corrected_by string, resolved_at timestamp"
    new = spark.createDataFrame([("d", "w", "1", "7", 0.5, "M", "", 1)], "document string, description string, item_no string, suggested_code string, score double, match_type string, alert string, row_ord long")
    first = V.upsert_review(spark.createDataFrame([], schema), new, now)
    decision = first.select("id", F.lit("resolvido").alias("decision"), F.lit("9").alias("correct_code"), F.lit("u").alias("user"))
    again = V.upsert_review(V.apply_decisions(first, decision, now), new, now)
    rows = again.collect()
    assert len(rows) == 2 and len({r.id for r in rows}) == 2 and all(r.created_at is not None for r in rows)
    kept = V.prune_pending(again, new.filter("false"), new).collect()
    assert [r.status for r in kept] == ["resolvido"]


def test_short_queries_and_identifiers_are_found(spark):
    cat = spark.createDataFrame([("1", "TE PVC", 1), ("2", "LUVA", 2)], "product_code string, description string, row_ord long")
    q = spark.createDataFrame([("te",), ("PVC",), ("x",), ("luva",)], "query string")
    assert {(r.query, r.product_code) for r in V.search_catalogue(q, cat).collect()} == {("te", "1"), ("PVC", "1"), ("luva", "2")}
    docs = spark.createDataFrame([("a", "pedido da ABC sa"), ("b", "nada")], "doc_id string, text string")
    ids = spark.createDataFrame([("abc", "term", "ABC"), ("long", "term", "PEDIDO DE")], "client string, kind string, value string")
    assert [(r.doc_id, r.client) for r in X.identify_client(docs, ids).collect()] == [("a", "abc")]


def test_latin_file_keeps_its_letters(spark, tmp_path):
    from lineweave.sources.readers import read_csv_robust
    for encoding in ("latin-1", "utf-8"):
        (tmp_path / encoding).write_bytes("nome;x\nCONEXÃO;1\n".encode(encoding))
        assert read_csv_robust(spark, str(tmp_path / encoding)).first().nome == "CONEXÃO"


def test_ids_stay_apart_after_retention(spark):
    at = lambda d: F.expr(f"TIMESTAMP '2024-{d} 00:00:00'")
    schema = "id long, document string, description string, item_no string, suggested_code string, score double, match_type string, status string, created_at timestamp, alert string, correct_code string, corrected_by string, resolved_at timestamp"
    new = spark.createDataFrame([("d", "w", "1", "7", 0.5, "M", "", 1)], "document string, description string, item_no string, suggested_code string, score double, match_type string, alert string, row_ord long")
    resolve = lambda q, now: V.apply_decisions(q, q.filter("status = 'pendente'").select("id", F.lit("resolvido").alias("decision"), F.lit("9").alias("correct_code"), F.lit("u").alias("user")), now)
    q = resolve(V.upsert_review(spark.createDataFrame([], schema), new, at("01-01")), at("01-02"))
    q = resolve(V.upsert_review(q, new, at("06-01")), at("06-02"))
    q = V.upsert_review(V.retain(q, at("09-01"), 180), new, at("09-01"))
    rows = q.collect()
    assert sorted(r.status for r in rows) == ["pendente", "resolvido"] and len({r.id for r in rows}) == 2


def test_review_rows_keep_alert_and_composition(spark):
    now = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    queue = spark.createDataFrame([(1, "d", "w", "pendente", "5", "old alert", "tee + bush")], "id long, document string, description string, status string, suggested_code string, alert string, composition string")
    new = spark.createDataFrame([("d", "w", "7", "PIPE", "", "", "alta", 1), ("d", "v", "8", "CAP", "look", "a + b", None, 2), ("d", "v", "9", "CAP2", "", "", "baixa", 3)],
                                "document string, description string, suggested_code string, suggested_description string, alert string, composition string, ai_confidence string, row_ord long")
    rows = {r.description: r for r in V.upsert_review(queue, new, now).collect()}
    assert (rows["w"].id, rows["w"].suggested_code, rows["w"].suggested_description, rows["w"].alert, rows["w"].composition, rows["w"].ai_confidence) == (1, "7", "PIPE", "old alert", "tee + bush", "alta")
    assert (rows["v"].suggested_code, rows["v"].alert, rows["v"].composition, rows["v"].ai_confidence) == ("9", "look", "a + b", "baixa")


def test_alerted_lines_join_the_queue(spark):
    now = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    queue = spark.createDataFrame([], "id long, document string, description string, status string, suggested_code string, score double, match_type string, alert string, created_at timestamp, resolved_at timestamp")
    results = spark.createDataFrame([("d", "good", "3", 0.9, "M", False, "01116962", 1), ("d", "poor", "4", 0.2, "M", False, "77", 2), ("d", "fine", "5", 0.95, "M", False, "78", 3)],
                                    "document string, description string, suggested_code string, score double, match_type string, manual_review boolean, client_code string, row_ord long")
    alerts = spark.createDataFrame([("1116962", "ask which one")], "alert_code string, alert string")
    rows = {r.description: r.alert for r in V.refresh_review(queue, results, results.select("document"), now, alerts).collect()}
    assert rows == {"good": "ask which one", "poor": None}


def test_late_and_old_messages_come_out_whole_and_once(spark, tmp_path):
    from lineweave.streaming.intake import dedup_messages, keep_state_on_disk
    keep_state_on_disk(spark)
    schema = "msg_id string, received_at timestamp, body string, labels array<string>"
    batches = [[("a", 12, "first", [])], [("b", 14, "x", []), ("l", 1, "labelled", ["Ours/done"])], [("late", 7, "y", [])], [("a", 15, "again", []), ("c", 3, "z", [])]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(m, dt.datetime(2024, 1, 1, h) + dt.timedelta(days=400 * (i == 3)), b, x) for m, h, b, x in rows], schema)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = dedup_messages(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ours/")
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    got = spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()
    assert sorted((r.msg_id, r.body) for r in got) == [("a", "first"), ("b", "x"), ("c", "z"), ("late", "y")]


def test_copies_of_a_product_are_scored_once(spark):
    one = catalogue(spark)
    copies = one.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("row_ord", F.col("row_ord") + 100 * F.col("i")) \
        .withColumn("product_code", F.concat("product_code", F.lit("-"), F.col("i").cast("string"))).drop("i")
    classes = L.product_classes(copies, 3)
    assert classes.count() == one.count() and {(r.n, len(r.members)) for r in classes.collect()} == {(5, 3)}
    items = L.item_features(spark.createDataFrame([("JOE 90 SOLD 25MM",), ("TUBO SOLD 25MM 6M",)], "description string"))
    pp = L.profile_pairs(items, copies).filter("structural").drop("structural")
    whole = L.score_pairs(items.join(pp, "profile").join(copies, "c_profile"))
    pairs = L.scored_classes(items, classes, ["description"])
    assert pairs.agg(F.sum("n")).first()[0] == whole.count() and pairs.count() * 5 == whole.count()
    columns = ["description", "product_code", "row_ord", "score", "second", "n_candidates", "sole"]
    want = {tuple(r) for r in L.best_candidate(whole, ["description"]).select(*columns).collect()}
    assert {tuple(r) for r in L.best_class(pairs, items, classes, ["description"]).select(*columns).collect()} == want
    want = {tuple(r) for r in L.top_candidates(whole, ["description"]).collect()}
    assert {tuple(r) for r in L.top_candidates(L.each_member(pairs).join(classes.select("c_class", "c_description"), "c_class"), ["description"]).collect()} == want


def test_price_table_is_judged_once_a_class(spark):
    from lineweave.operators import cascade as K
    columns = "client string, validity string, product_code string, client_code string, description string, unit string, price decimal(18,6), row_ord long"
    names = ["JOELHO 90 PVC SOLDAVEL 25MM", "JOELHO 45 PVC SOLDAVEL 25MM", "TE PVC SOLDAVEL 50MM", "BUCHA DE REDUCAO SOLDAVEL 50X25MM"]
    rows = [("x", "1 SEM - 2026", str(100 * i + j), "", d, "UN", decimal.Decimal(j + 1), 100 * i + j) for i in range(9) for j, d in enumerate(names)]
    table = spark.createDataFrame(rows, columns)
    raw = table.select("row_ord", "product_code", "description", F.lit("PC").alias("sale_unit"), F.lit(None).cast("double").alias("diameter_mm"), F.lit(None).cast("double").alias("bar_length_m"),
                       F.lit(None).cast("double").alias("diameter_final_mm"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("line"))
    side = K.table_side(table, C.build_catalogue(raw))
    assert {(r.n, len(r.members)) for r in side.collect()} == {(9, X.MEMBERS)}
    items = L.item_features(spark.createDataFrame([("k", "x", "JOELHO 90 SOLD 25MM"), ("m", "x", "TE SOLD 50MM")], "item_key string, client string, description string"))
    pairs = X.restricted_pairs(items, side)
    assert {(r.item_key, r.c_description): r.n for r in pairs.collect()} == {("k", names[0]): 9, ("k", names[1]): 9, ("m", names[2]): 9}
    judged = X.judged_pairs(pairs)
    assert judged.count() == 3 * X.MEMBERS
    got = {r.item_key: r.product_code for r in X.first_without_conflict(judged).collect()}
    assert got == {"k": "0", "m": "2"}


def test_retries_by_class_are_those_by_product(spark):
    import random
    rnd = random.Random(3)
    rows, place = [], 0
    for item in range(60):
        for _ in range(rnd.randint(1, 6)):
            n = rnd.choice([1, 1, 2, 6])
            members = sorted(rnd.sample(range(1000), n)) if rnd.random() < 0.9 else [place + 2000]
            rows.append((f"i{item}", f"d{place}", decimal.Decimal(place), rnd.choice([-1, 3, 3, 5]), rnd.random() < 0.7, rnd.choice([0.3, 0.42, 0.6, 0.6, 0.9, None]), rnd.random() < 0.4,
                         [(m, f"p{m}") for m in members], 0.35, 0.5, rnd.random() < 0.1))
            place += 1
    kind = "item_key string, c_description string, table_price decimal(18,6), pool_rank int, structural boolean, score double, conflict boolean, members array<struct<row_ord:long,product_code:string>>, floor_sole double, floor double, is_board boolean"
    classes = spark.createDataFrame(rows, kind)
    by_product = classes.withColumn("_m", F.explode("members")).withColumn("members", F.array("_m")).drop("_m")
    want = {}
    for item in {r[0] for r in rows}:
        pool = [dict(zip(classes.columns, r), row=m[0]) for r in rows if r[0] == item for m in r[7]]
        for _ in range(4):
            top = max((x["pool_rank"] for x in pool), default=None)
            good = [x for x in pool if x["pool_rank"] == top and top >= 0 and x["structural"]] or pool
            if not good:
                break
            good.sort(key=lambda x: (x["score"] is None, -(x["score"] or 0), x["row"]))
            b, second = good[0], good[1]["score"] if len(good) > 1 else None
            if b["score"] is None or b["score"] < (b["floor_sole"] if len(good) == 1 else b["floor"]):
                break
            if not b["conflict"]:
                want[item] = (b["row"], b["score"], second is not None and b["score"] - second < 0.02 or b["is_board"])
                break
            pool = [x for x in pool if x["row"] != b["row"]]
    assert len(want) > 20
    for pairs in (classes, by_product):
        found = X.first_without_conflict(pairs)
        assert {r.item_key: (r.row_ord, r.score, r.review) for r in found.collect()} == want
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1  # dealt by item once for all attempts


def test_classes_are_judged_in_one_row(spark):
    items = L.item_features(spark.createDataFrame([("k", "x", "TE SOLD 50MM")], "item_key string, client string, description string"))
    columns = "client string, validity string, product_code string, client_code string, description string, unit string, price decimal(18,6), row_ord long"
    table = spark.createDataFrame([("x", "1 SEM - 2026", str(i), "", "TE PVC SOLDAVEL 50MM", "UN", decimal.Decimal(2), i) for i in range(9)], columns)
    raw = table.select("row_ord", "product_code", "description", F.lit("PC").alias("sale_unit"), *[F.lit(None).cast(t).alias(c) for c, t in (("diameter_mm", "double"), ("bar_length_m", "double"), ("diameter_final_mm", "double"), ("family", "string"), ("line", "string"))])
    from lineweave.operators import cascade as K
    r = X.judged_classes(X.restricted_pairs(items, K.table_side(table, C.build_catalogue(raw)))).collect()
    assert [[m.row_ord for m in x.members] for x in r] == [list(range(X.MEMBERS))]


def test_texts_that_ask_the_same_are_judged_once(spark):
    from lineweave.operators import cascade as K
    columns = "client string, validity string, product_code string, client_code string, description string, unit string, price decimal(18,6), row_ord long"
    names = ["JOELHO 90 PVC SOLDAVEL 25MM", "JOELHO 45 PVC SOLDAVEL 25MM", "TE PVC SOLDAVEL 50MM", "BUCHA DE REDUCAO SOLDAVEL 50X25MM", "TUBO PVC ESGOTO 100MM", "QUADRO DISTR 12D/12N SEM BARRAMENTO"]
    table = spark.createDataFrame([(c, "1 SEM - 2026", f"{i}{j}", "", d, "UN", decimal.Decimal(j + 1), 100 * i + j) for c in "xy" for i in range(2) for j, d in enumerate(names)], columns)
    raw = table.filter("client = 'x'").select("row_ord", "product_code", "description", F.lit("PC").alias("sale_unit"), *[F.lit(None).cast(t).alias(c) for c, t in (("diameter_mm", "double"), ("bar_length_m", "double"), ("diameter_final_mm", "double"), ("family", "string"), ("line", "string"))])
    side = K.table_side(table, C.build_catalogue(raw))
    wordings = [f"{a}{d}{b}" for d in [*names, "TE SOLD 25MM", "JOE 90 25", "LUVA"] for a, b in (("", ""), ("FVM - ", " - NBR 5648"))]
    items = L.item_features(spark.createDataFrame([(f"{c}{i}", c, d) for c in "xyz" for i, d in enumerate(wordings)], "item_key string, client string, description string"))
    plain = X.restricted_pairs(items, side)
    apart = X.judged_classes(plain)  # verdicts pair by pair
    by = lambda d: sorted((tuple(str(r[c]) for c in sorted(apart.columns)) for r in d.collect()))
    assert by(X.judged_classes(X.restricted_pairs(items, side, judge=True))) == by(apart) and apart.count() > 10
    found, judged, won = X.judged_wordings(items, side)
    assert found.count() == items.count() and judged.select("item_key").distinct().count() < apart.select("item_key").distinct().count()
    assert by(X.of_items(found, judged)) == by(apart)
    assert sorted(map(str, X.of_items(found, won).select(*won.columns).collect())) == sorted(map(str, X.first_without_conflict(apart).collect()))


def test_best_of_three_texts_in_one_call(spark):
    from lineweave.functions import scores as D
    rows = [("TE 25 SOLD", "TE SOLD 25", "SOLD TE 25", "TE"), ("TE 25", "", None, ""), ("", "", "", ""), (None, "TE", "TE", None), ("LUVA 50", "LUVA 50", "LUVA 50", "BUCHA 50 LUVA")]
    df = spark.createDataFrame(rows, "a string, x string, y string, z string")
    w = lambda c: D.sort_words(F.col(c))
    skips = [("x", F.col("x") == ""), ("y", F.col("y").isin("") | (F.col("y") == F.col("x"))), ("z", F.col("z") == "")]
    one = D.best_blended_ratio(F.col("a"), w("a"), [(F.col(c), w(c), s) for c, s in skips])
    apart = F.greatest(*[F.when(s, 0.0).otherwise(D.blended_ratio(F.col("a"), F.col(c))) for c, s in skips])
    got = df.select(one.alias("one"), apart.alias("apart")).collect()
    assert [r.one for r in got] == [r.apart for r in got]


def test_pairs_that_come_again_are_compared_once(monkeypatch):
    from lineweave.functions import scores as D
    import numpy as np
    import pyarrow as pa
    seen = []
    count = np.bitwise_count
    monkeypatch.setattr(D.np, "bitwise_count", lambda x: (seen.append(len(x)), count(x))[1])
    a, b = ["JOELHO 25", "TE 50", None, ""] * 500, ["JOELHO 25 MM", "TE 20", "TE", None] * 500
    assert D._ratio(pa.array(a), pa.array(b)).tolist() == [2 * 9 / 21, 2 * 4 / 10, 0.0, 1.0] * 500 and seen == [2]


def test_vector_search_asks_ids_divisible_by_50_of_all_rows(spark, tmp_path):
    from lineweave.plans.catalog import QUERIES
    spark.createDataFrame([(i, "hot bolt" if i % 2 else "blue ring", f"Brand#{i}", "SMALL", i % 50, 900.0 + i) for i in range(110)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, [1.0, float(i % 50 == 0), float(i) / 110]) for i in range(110)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query_id: r.row_ord for r in QUERIES["m9_match_vector"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 50, 100} and all(i in range(110) for i in got.values())


def test_closest_is_the_best_near_pair(spark):
    import random
    from lineweave.operators.similarity import closest
    rnd = random.Random(5)
    base = ["".join(rnd.choice("ABCD ") for _ in range(rnd.randint(4, 40))).strip() or "A" for _ in range(80)]
    other = sorted({b[:i % 5] + "X" + b[i % 5:] for i, b in enumerate(base)} | {b[:-1] + "Z" for b in base} | {b[1:] + "Y" for b in base})
    a, b = spark.createDataFrame([(x,) for x in base], "a string"), spark.createDataFrame([(x, -i) for i, x in enumerate(other)], "b string, place long")
    want = {}
    for r in near_pairs(a, b, 0.6).join(b, "b").collect():
        want[r.a] = max(want.get(r.a, (0, 0, "")), (r.ratio, -r.place, r.b))
    assert {r.a: (r.ratio, -r.place, r.b) for r in closest(a, b, 0.6).collect()} == want


def test_history_of_a_wording_is_cut_before_lines_meet_it(spark):
    rows = [(i, None if i % 11 == 0 else str(i % 3), f"ITEM {i % 4} NBR 5648", str(i % 7), None if i % 13 == 0 else dt.datetime(2026, 1, 1 + i % 9)) for i in range(300)]
    history = spark.createDataFrame(rows, "id long, client_id string, description string, product_code string, validated_at timestamp")
    asked = [(i, None if i % 5 == 0 else str(i % 6), f"item {i % 4} nbr 564") for i in range(40)]
    got = {}
    for r in V.suggest_history(spark.createDataFrame(asked, "item_id long, client_id string, description string"), history).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.origin, r.history_score, r.h_id))
    from difflib import SequenceMatcher
    for item, client, text in asked:
        found = [(i, c, round(SequenceMatcher(None, text.upper(), d).ratio(), 4), t) for i, c, d, _, t in rows if SequenceMatcher(None, text.upper(), d).ratio() >= 0.82]
        own = [x for x in found if client is not None and x[1] == client]
        best = sorted(own or found, key=lambda x: (-x[2], x[3] is None, -(x[3] or dt.datetime(1, 1, 1)).toordinal(), x[0]))[:5]
        assert sorted(got[item]) == [(n + 1, "CLIENTE" if own else "GLOBAL", s, i) for n, (i, _, s, _) in enumerate(best)]


def test_subsequence_lengths_by_table(spark):
    import random
    from lineweave.functions.scores import lcs_lengths
    rnd = random.Random(9)
    a, b = ([None, "", "x" * 70, "é\U0001F600a"] + ["".join(rnd.choice("ABCé 1") for _ in range(rnd.randrange(70))) for _ in range(200)] for _ in range(2))
    b[3] = "a\U0001F600é"

    def slow(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            row = _next(row, c, y)
        return row[-1]

    def _next(row, c, y):
        out = [0]
        for j, d in enumerate(y):
            out.append(row[j] + 1 if c == d else max(out[j], row[j + 1]))
        return out
    assert list(lcs_lengths(a, b)) == [slow(x or "", y or "") for x, y in zip(a, b)]


def test_nearest_vectors_hold_few_products_at_a_time():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from lineweave.operators import linkage as L
    rng = np.random.default_rng(3)
    side = lambda n: list(rng.integers(-4, 5, (n, 8)).astype(np.float32))
    products = pd.DataFrame({"row_ord": np.arange(30_000), "product_code": [str(i) for i in range(30_000)], "embedding": side(30_000)})
    queries = pd.DataFrame({"query_id": np.arange(600), "embedding": side(600)})
    tracemalloc.start()
    got = L.nearest(queries, products, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    sims = np.stack(queries["embedding"]).astype(float) @ np.stack(products["embedding"]).astype(float).T
    want = np.argsort(-sims, axis=1, kind="stable")[:, :3]  # ties by catalogue order
    assert got.sort_values(["query_id", "cosine", "row_ord"], ascending=[True, False, True])["row_ord"].tolist() == want.ravel().tolist()
