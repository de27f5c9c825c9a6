"""Personal data by candidate gradient boosting, in DataFrame functions and Spark ML only.

Base patterns with their checks give the base spans.  High-recall generators propose further, overlapping spans (numbers
in any grouping, long keys, written-out addresses); boosted trees score them by format and context.  They learn from a
bounded sample of documents: a proposal is positive where it is a base span or a cue that the features don't see says so (a
word that announces a key or a phone, a known last label of an address), and negative where it cuts a base span, is too
short, or its cue says otherwise; a proposal that touches no base span and has no cue is no example.  A threshold per
generator, calibrated on all documents of the half that the trees haven't seen, is the least score whose proposals are
right in ``precision`` of the cases; proposals above it that touch no base span are added.
"""
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .shared import shared_table, table

MARK, STAND_IN = "﷐", "﷑"
SAMPLE = 40_000  # documents that the trees and thresholds are fitted on, at most
PRECISION, LEAST = 0.98, 20
# The contract's patterns; possessive, and begun only where a run begins, so that long runs take linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "number": r"[0-9]", "secret": r"[A-Za-z0-9_+/-]{20}", "contact": r"(?i)\W(?:at|@)\W"}
WIDE = {
    "number": r"\+?(?:\([0-9]{2,4}\)[\x20.-]?)?[0-9](?:[\x20().-]{0,2}[0-9])++",
    "secret": r"(?:\G|(?<![A-Za-z0-9_+/-]))[A-Za-z0-9_+/-]{20,}+={0,2}",
    "contact": r"(?i)[a-z0-9._%+-]{2,64}+\x20?(?:\(at\)|\[at\]|@|\x20at\x20)\x20?[a-z0-9-]{2,63}+\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{2,10}",
}
KINDS = [*BASE, *WIDE]
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
ANNOUNCED = r"(?i)(?:token|secret|passw(?:or)?d|api.?key|key|auth)[\W_]{0,5}$"
PHONED = r"(?i)(?:tel(?:e(?:fone?|phone))?|phone|fone|call|mobile|handy|cell?|whatsapp|fax|telefon|t[ée]l[ée]phone|appel(?:ez|er)?|anruf|llam[ae]r?)[\W_]{0,4}$"
COUNTED = r"(?i)(?:order|invoice|ref(?:erence)?|isbn|price|page|version|pedido|art(?:ikel)?|item|total|build|ticket|[#$€£])[\W_]{0,4}(?:n[ro°º]?[\W_]{0,3})?$"
LAST_LABELS = r"(?i)\W(?:com|org|net|edu|gov|int|info|io|dev|app|biz|de|fr|es|uk|eu|br|us|example|test|invalid)$"
SPAN = "array<struct<start:int,end:int,kind:string,value:string,before:string,after:string>>"


def found(text, kind, pattern):
    """Leftmost non-overlapping matches of ``pattern`` in ``text`` (without MARK), as spans in code points.

    The matches are marked, the text is split at the marks, and lengths of the pieces give the places.
    """
    def spans(p):
        ends = F.aggregate(F.transform(p, lambda x: F.length(x)), F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        return let(ends, lambda e: F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: F.struct(
            F.get(e, i).alias("start"), F.get(e, i + 1).alias("end"), F.lit(kind).alias("kind"), F.get(p, i).alias("value"),
            F.right(F.get(p, i - 1), F.lit(16)).alias("before"), F.left(F.get(p, i + 1), F.lit(4)).alias("after"))))
    none = F.lit(None).cast(SPAN)
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    hits = F.when(text.rlike(NEEDS[kind]), let(pieces, lambda p: F.when(F.size(p) >= 3, spans(p)).otherwise(none))).otherwise(none)
    return F.coalesce(hits, F.array().cast(SPAN))


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits):
    at = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(at, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _passes(span):
    digits = _digits(span["value"])
    return (F.when(span["kind"] == "ip", span["value"].rlike(OCTETS))
            .when(span["kind"] == "card", let(digits, lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)))
            .when(span["kind"] == "phone", F.length(digits).between(9, 15)).otherwise(True))


def _order(spans):
    """By start, then kind as listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.lit(KINDS), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))


def proposals(docs: DataFrame) -> DataFrame:
    """(doc_id, base, wide): base spans that pass their checks, and what the generators propose; one row per given row."""
    clean = F.translate(F.coalesce("text", F.lit("")), MARK, STAND_IN).alias("t")
    d = docs.select("doc_id", clean)
    base = F.concat(*[F.filter(found(F.col("t"), k, p), _passes) for k, p in BASE.items()])
    wide = F.concat(*[found(F.col("t"), k, p) for k, p in WIDE.items()])
    d = d.select("doc_id", base.alias("base"), wide.alias("wide"), F.xxhash64("t").alias("content"))
    return d


def _place(text):
    return (F.when(text == "", 0).when(text.rlike(r"^[A-Za-z]$"), 1).when(text.rlike(r"^[0-9]$"), 2).when(text.rlike(r"^\s$"), 3)
            .when(text.rlike("^[\"'`]$"), 4).when(text.rlike(r"^[.,;:]$"), 5).when(text.rlike(r"^[=@/+_-]$"), 6).otherwise(7))


FEATURES = ["kind", "length", "digits", "letters", "upper", "marks", "groups", "first_group", "last_group", "hex", "plus", "before", "after", "cue", "brackets", "spaces", "written"]


def described(c: DataFrame) -> DataFrame:
    """Format and context features of proposals ``s``."""
    v, b = F.col("s.value"), F.col("s.before")
    groups = F.array_remove(F.split(v, r"[^A-Za-z0-9]+"), "")
    values = [F.array_position(F.lit(KINDS), F.col("s.kind")), F.length(v), F.regexp_count(v, F.lit("[0-9]")), F.regexp_count(v, F.lit("[A-Za-z]")), F.regexp_count(v, F.lit("[A-Z]")),
              F.regexp_count(v, F.lit("[^A-Za-z0-9]")), F.size(groups), F.length(F.try_element_at(groups, F.lit(1))), F.length(F.try_element_at(groups, F.lit(-1))), v.rlike("^[0-9a-f]+$"),
              v.startswith("+"), _place(F.right(b, F.lit(1))), _place(F.left("s.after", F.lit(1))), b.rlike(r"[=:]\s?[\"']?$"), v.rlike(r"[\[(]"), F.regexp_count(v, F.lit(" ")),
              v.rlike(r"(?i)\W(?:at|dot)\W")]
    return c.withColumns({f"f_{n}": F.coalesce(x.cast("double"), F.lit(0.0)) for n, x in zip(FEATURES, values)})


def fitted(proposed: DataFrame, sample=SAMPLE, precision=PRECISION):
    """(trees, {kind: threshold}); None without examples of both labels.

    The trees see the half by content of a sample of about ``sample`` documents; thresholds come from the whole other half.
    """
    n = proposed.count()
    share = F.pmod(F.xxhash64("content", F.lit(7)), F.lit(1_000_000)) < int(1e6 * min(1.0, sample / max(n, 1)))
    s = F.col("s")
    touched = F.exists("base", lambda x: (x["start"] < s["end"]) & (x["end"] > s["start"]))
    same = F.exists("base", lambda x: (x["start"] == s["start"]) & (x["end"] == s["end"]))
    kind, before, value = F.col("s.kind"), F.col("s.before"), F.col("s.value")
    digits = F.length(_digits(value))
    announced = before.rlike(ANNOUNCED) & value.rlike("[0-9]")
    number = F.when(same, True).when(touched | (digits < 9) | (digits > 19), False).when(before.rlike(PHONED) & (digits <= 15), True).when(before.rlike(COUNTED), False)
    contact = F.when(same, True).when(touched, False).otherwise(value.rlike(LAST_LABELS))
    label = F.when(kind == "secret", announced).when(kind == "number", number).otherwise(contact)
    picked = proposed.filter(F.size("wide") > 0).select("content", "base", share.alias("sampled"), F.pmod("content", F.lit(2)).alias("half"), F.explode("wide").alias("s"))
    seen = described(picked.filter("half = 1 OR sampled").withColumn("label", label.cast("double")).filter("label IS NOT NULL"))
    columns = [f"f_{n}" for n in FEATURES]
    rows = shared_table(seen.select(*columns, "label", "half"), "proposals")
    if rows.filter("half = 0").select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    trees = GBTClassifier(maxIter=8, maxDepth=4, maxBins=32, seed=11, checkpointInterval=-1).fit(vectors.filter("half = 0").select("features", "label"))
    scored = shared_table(trees.transform(vectors.filter("half = 1")).select(F.col("f_kind"), "label", vector_to_array("probability")[1].alias("score")), "calibration")
    # the least score above which the proposals of a kind are right often enough; equal scores count together
    tied = scored.groupBy("f_kind", "score").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("f_kind").orderBy(F.desc("score"))
    tied = tied.withColumns({"right": F.sum("right").over(down), "n": F.sum("n").over(down)})
    chosen = tied.filter((F.col("n") >= LEAST) & (F.col("right") >= precision * F.col("n"))).groupBy("f_kind").agg(F.min("score").alias("score"))
    return trees, {r.f_kind: r.score for r in chosen.collect()}  # one row per generator


def detect(docs: DataFrame, sample=SAMPLE, precision=PRECISION) -> DataFrame:
    """``docs`` (doc_id, text) with the contract's counts, ``base_sha256``, ``spans`` and the spans as an array ``found``.

    One row per given row; a null or empty text has no spans.  Without proposals of both labels only base spans are found.
    """
    proposed = shared_table(proposals(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    model = fitted(proposed, sample, precision)
    added = None
    if model and model[1]:
        trees, least = model
        c = proposed.select("row", "base", F.explode("wide").alias("s"))
        free = ~F.exists("base", lambda x: (x["start"] < F.col("s.end")) & (x["end"] > F.col("s.start")))
        c = described(c.filter(free).select("row", "s"))
        c = trees.transform(VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features").transform(c))
        enough = F.lit(False)
        for kind, score in least.items():
            enough = enough | ((F.col("f_kind") == kind) & (vector_to_array("probability")[1] >= score))
        added = c.filter(enough).groupBy("row").agg(F.collect_list(F.struct("s.start", "s.end", "s.kind")).alias("added"))
    short = "array<struct<start:int,end:int,kind:string>>"
    out = proposed.select("row", "doc_id", F.transform("base", lambda x: F.struct(x["start"], x["end"], x["kind"])).cast(short).alias("base"))
    out = out.join(added, "row", "left") if added is not None else out.withColumn("added", F.lit(None).cast(short))
    everything = F.concat("base", F.coalesce("added", F.array().cast(short)))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(F.concat_ws(",", _order(F.col("base"))), 256).alias("base_sha256"), F.concat_ws(",", _order(everything)).alias("spans"), everything.alias("found"))


def redact(text, spans):
    """``text`` with every span, or run of overlapping spans, replaced by its kind in brackets."""
    ordered = F.sort_array(spans)
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    def put(a, s):
        gap = F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        shown = F.when(s["start"] >= a["at"], F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], shown).alias("out"))
    return F.aggregate(ordered, empty, put, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))


def op10_pii(spark, sf_dir):
    return detect(table(spark, sf_dir, "documents")).drop("found")
