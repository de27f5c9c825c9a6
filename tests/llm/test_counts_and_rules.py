"""Quality rules, mixing, URL filters, token counts."""
import collections
import math
import random
import re

import public_tokenizers
import pytest

from lineweave.llm import mixing, quality, tokencounts, urlfilter
from pyspark.sql import functions as F

from .cases import docs_of, odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(1)
    rows = odd_rows() + [(100 + i, " ".join(rng.choice("ab #|") for _ in range(rng.randrange(60)))) for i in range(60)] + [(200, "x y\nx y\n\n \nx y")]
    got = quality.judge(docs_of(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    want = sorted((str(i), *base_counts(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed) for r in got)


def test_quality_cutoffs_keep_the_bound(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        rows.append((i, " ".join(f"w{rng.randrange(9999)}" + ("$$$" if bad or i % 300 == 1 else "") for _ in range(20)), "s", None if i % 2 else "en"))
        labels.append((i, None if i == 3 else 0 if bad else 1, 0))
    got = {r.doc_id: r.kept for r in quality.judge(docs_of(spark, rows), spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int"), alpha=0.2).collect()}
    assert not any(got[i] for i in range(0, 1500, 5))
    good = [i for i in range(1500) if i % 5 and i != 3]
    assert sum(not got[i] for i in good) / len(good) <= 0.05
    few = quality.judge(docs_of(spark, rows[:50]), spark.createDataFrame(labels[:50], "doc_id long, quality int, toxic int"))
    assert few.filter("NOT kept").count() == 0  # too few labels for a certificate
    assert quality.judge(docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    kept = quality.good_documents(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), alpha=0.2)
    assert kept.columns == docs_of(spark, []).columns and kept.count() == sum(got.values())


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 400, 0.01), (20, 4000, 0.01), (900, 100000, 0.01)])
def test_binomial_bound_is_exact(spark, k, n, p):
    got = spark.range(1).select(quality.binomial_cdf(F.lit(k), F.lit(n), p)).first()[0]
    want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-6)


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(0, 40)), rng.choice(["a", "a", "a", "b", None, "ü"])) for i in range(6000)] + [(1, None, "empty"), (2, "x y", "a"), (2, "x y", "a"), (None, "z", None)]
    df = docs_of(spark, rows)
    old = mixing.LEAF
    mixing.LEAF = 16  # several levels of the tree
    try:
        got, again = (mixing.mix(d).toPandas() for d in (df, df.repartition(7)))
    finally:
        mixing.LEAF = old
    key = ["doc_id", "source", "size", "copies"]
    assert len(got) == len(rows) and got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    assert (got.taken == got.copies * got["size"]).all() and (got.copies <= 3).all()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, target, total = set(order), {}, sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left.remove(s)
    target |= {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
    for s, g in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert g.target.iloc[0] == pytest.approx(target[s]) and abs(g.taken.sum() - target[s]) <= g["size"].max()
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_pivotal_rounding_is_unbiased():
    rng = random.Random(4)
    total = [0.0] * 6
    for _ in range(4000):
        items = [(0, s, p, rng.random()) for s, p in ((10, .3), (20, .5), (5, .9), (40, .2), (7, .6), (30, .75))]
        for i, p, done in mixing.meet(items):
            total[i] += p
    assert all(abs(t / 4000 - x[2]) < 0.04 for t, x in zip(total, items))


def test_url_filters(spark):
    urls = ["http://a.example.com/en/7x?q", "HTTPS://A.Example.COM/en/6", "x://example.net/de/8", "x://notexample.net/de/8", "x://com/en/", "x://spam-farm.org/", None, "no scheme", "://", "a://b://c.org/es/",
            "http://org/es/1#f", "http://h/click/track", "http://cheap-pills.example.com/en/7", "x://example.com/en/7\nz"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])]
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("mine")).withColumn("rule", F.lit(1))).collect()}
    for i, u in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if any(re.search(e, f"{host} {path}") for _, _, e, _ in urlfilter.PATTERN_RULES) else "allow")
        assert got[(i, host)] == (path, rule, verdict), u
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    alphabet = ["a", "B", "'s", " ", "\n", "é", "e\u0301", "\u0301", "<|endoftext|>", "<|", ".", "Σ", "\u3000", "1", "日本", "\x1c", "\x85", "🙂", "<", "\u0338"]
    texts = [t for _, t in odd_rows()] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(900))) for _ in range(60)] + ["x" * 1000]
    tokenizer = tokencounts.Counter(path).tokenizer
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = tokencounts.count_tokens(docs_of(spark, list(enumerate(texts))), path, chunk=120, overlap=16, limit=10).collect()
    assert {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in got} == {i: (n, len((t or "").encode()), n > 10) for i, (n, t) in enumerate(zip(want, texts))}
    assert tokencounts.count_tokens(docs_of(spark, []), path).count() == 0


def test_tracker_rule_blocks_its_path(spark):
    urls = {"http://h/click/track": "block", "http://h/a/click/track/b": "block", "https://h.gov/click/track?x=1": "block", "http://h/click/tracks": "allow", "http://click/track": "allow", "http://h/x?u=/click/track": "allow"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.pattern) for r in urlfilter.judge_urls(pages).collect()}
    assert [got[i] for i in range(len(urls))] == [(v, "tracker" if v == "block" else None) for v in urls.values()]


def test_host_rules_of_the_contract(spark):
    urls = {"x://com/en/1": ("com/en/", "block"), "x://example.com/en/7": ("example.com/en/7", "allow"), "x://example.com/en/8": ("com/en/", "block"),
            "x://net/de/1": ("net/de/", "allow"), "x://spam-farm.a.net/de/": ("net/de/", "allow"), "x://example.net/de/7": ("net/de/", "allow"),
            "x://a.example.net/de/8": ("example.net/de/8", "block"), "x://b.org/es/": ("org/es/", "block")}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages).collect()} == dict(enumerate(urls.values()))
