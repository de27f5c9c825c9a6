"""Decontamination, language-model scores, personal data."""
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from lineweave.llm import decontam, lmscore, pii
from pyspark.sql import functions as F

from .cases import docs_of, odd_rows, words

LABELS = "doc_id long, quality int, toxic int"


def test_decontamination(spark):
    rng = random.Random(13)
    items = [(i, words(rng, 40, 3000)) for i in range(12)] + [(50, None), (51, "")]
    rows = odd_rows()
    truth = set()
    for i in range(60):
        body = [words(rng, rng.randrange(0, 90), 3000), words(rng, 60, 3000)]
        if i % 3 == 0:
            item = items[i % 12]
            leak = item[1].upper().split()
            if i % 2:
                for j in rng.sample(range(30), 5):  # a paraphrase: five words differ
                    leak[j] = "other"
            body.insert(1, ", ".join(leak))
            truth.add((100 + i, item[0]))
        rows.append((100 + i, " ".join(body)))
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs_of(spark, rows), bench).collect()}
    assert len(truth - got) <= 0.1 * len(truth) and got <= truth
    blocks = {(r.doc_id, r.item_id) for r in decontam.leaks(docs_of(spark, rows), bench, block=4).collect()}
    assert blocks == got
    assert decontam.leaks(docs_of(spark, []), bench).count() == 0
    assert decontam.leaks(docs_of(spark, rows[-3:]), bench.limit(0)).count() == 0


def test_retrieval_recall_against_all_pairs(spark):
    rng = random.Random(14)
    items = [(i, words(rng, 40, 3000)) for i in range(10)]
    rows = [(i, words(rng, 50, 3000) + " " + items[i % 10][1] + " " + words(rng, 50, 3000)) for i in range(40)]
    docs = docs_of(spark, rows)
    n, idf = decontam.document_frequencies(docs.select("text"))
    axes = decontam.latent_axes(decontam.sample_passages(docs.select("text"), idf, 64, 1.0)) * idf[:, None]
    block = decontam.Items([i for i, _ in items], [t for _, t in items], [None] * 10, axes)
    near, every = ({(r.doc_id, r.item_id) for r in decontam.retrieve(docs, block, axes, exhaustive=e).collect()} for e in (False, True))
    assert n == 40 and len(near & every) >= 0.9 * len(every) and len(every) == 40


def test_passages_in_long_documents_are_summed_where_they_stand(spark):
    rng = random.Random(44)
    items = [(i, " ".join(f"item{i}x{j}" for j in range(20 + 4 * i))) for i in range(8)]
    rows, truth = [], set()
    for d in range(12):  # one passage among thousands of words that no item holds
        before = rng.randrange(0, 900)
        rows += [(d, words(rng, before, 3000) + " " + items[d % 8][1] + " " + words(rng, rng.randrange(0, 900), 3000)), (100 + d, words(rng, 500, 3000))]
        truth.add((d, items[d % 8][0], before))
    docs = docs_of(spark, rows)
    n, idf = decontam.document_frequencies(docs.select("text"))
    seen = [len({w for w in t.split()}) for _, t in rows]
    assert n == 24 and max(seen) > 300 and (idf >= 0).all()
    axes = decontam.latent_axes(decontam.sample_passages(docs.select("text"), idf, 64, 1.0)) * idf[:, None]
    got = decontam.retrieve(docs, decontam.Items([i for i, _ in items], [t for _, t in items], [None] * 8, axes), axes).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {t[:2] for t in truth}
    assert all(abs(r.start_word - at) <= 60 for r in got for d, _, at in truth if d == r.doc_id)


def test_paraphrases_of_every_length_are_found(spark):
    rng = random.Random(22)
    items = [(n, words(rng, n, 3000)) for n in range(15, 61)] + [(99, "so so so so so so so so so so w1x w2x w3x w4x w5x w6x")]
    rows, truth = [(9999, words(rng, 40, 3000) + " so so so so so so so so so so so " + words(rng, 40, 3000))], {(9999, 99)}
    for n, text in items[:-1]:
        for keep in (0.62, 0.7, 0.8):
            leak = text.split()
            last = max(1, n // 4)  # the words that stand for the answer stay
            for j in rng.sample(range(n - last), n - math.ceil(keep * n)):
                leak[j] = f"w{rng.randrange(3000)}x"
            doc = n * 100 + int(100 * keep)
            rows.append((doc, " ".join([words(rng, rng.randrange(60, 80), 3000), *leak, words(rng, 60, 3000)])))
            truth.add((doc, n))
    bench = spark.createDataFrame([(*r, "so" if r[0] == 99 else None) for r in items], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs_of(spark, rows), bench).collect()}
    assert (9999, 99) in got and len(truth & got) >= 0.9 * len(truth) and got <= truth


def test_randomised_svd_finds_the_axes(spark):
    rng = np.random.default_rng(15)
    mix = rng.standard_normal((200, 3)) @ rng.standard_normal((3, 30))
    rows = [([*range(30)], [float(v) for v in r]) for r in mix]
    axes = decontam.latent_axes(spark.createDataFrame(rows, "features array<long>, weights array<double>"), rank=3)[:30].astype(float)
    q = np.linalg.qr(axes)[0]
    assert np.abs(mix - mix @ q @ q.T).max() < 1e-3 * np.abs(mix).max()


def test_axes_are_fitted_on_every_passage(spark, monkeypatch):
    rng = random.Random(51)
    texts = [words(rng, rng.randrange(1, 200), 400) for _ in range(300)] + [None, ""]
    docs = docs_of(spark, list(enumerate(texts)))
    _, passages, idf = decontam._counts(docs)
    rows = decontam.sample_passages(docs, idf, decontam.PASSAGE).collect()
    assert passages == len(rows) == sum(-(-len((t or "").split()) // decontam.PASSAGE) for t in texts)
    with pytest.raises(ValueError):
        decontam.sample_passages(docs, idf, decontam.PASSAGE, 0.5)
    a = np.zeros((len(rows), decontam.FEATURES))
    for k, r in enumerate(rows):
        a[k, r.features] = r.weights
    assert np.allclose((a * a).sum(1), 1, atol=1e-4)
    want = np.triu(a.T @ a)
    for triangle in (decontam.gram(decontam.sample_passages(docs.repartition(3), idf, decontam.PASSAGE)), decontam.gram(docs.select("text").repartition(3), idf)):
        got = np.zeros((decontam.FEATURES, decontam.FEATURES))
        for r in triangle.collect():
            got[r.feature, r.feature:] = np.frombuffer(bytes(r.row), np.float32)
        assert np.allclose(got, want, atol=1e-4)
    # leaks fits on all texts, whatever their number: no passage is drawn
    seen = []
    fit = decontam.latent_axes
    monkeypatch.setattr(decontam, "latent_axes", lambda t, **k: (seen.append(sorted(str(r.text) for r in t.collect())), fit(t, **k))[1])
    bench = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    decontam.leaks(docs, bench)
    assert seen == [sorted(map(str, [*texts, texts[0]]))]


def test_common_subsequence():
    rng = random.Random(16)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
            row = new
        assert decontam.common_subsequence(a, b) == row[-1]


def test_scores_against_plain_counts(spark):
    rng = random.Random(17)
    rows = odd_rows() + [(100 + i, " ".join(rng.choice(["red", "green", "blue"] if i % 2 else ["one", "two", "red"]) for _ in range(30)) + f" rare{i}") for i in range(40)]
    labels = [(100 + i, 1 if i % 2 else 0, 0) for i in range(30)] + [(101, 1, 0), (103, 1, 1), (105, None, 0)]
    own, classes = 6, 4
    got = {(r.doc_id, r.n_words): r for r in lmscore.score(docs_of(spark, rows), spark.createDataFrame(labels, LABELS), own, classes).collect()}
    good = {i for i, *_ in labels} - {i for i, q, t in labels if q != 1 or t != 0}
    from lineweave.llm.shared import batch_bytes, words_of
    import pyarrow as pa
    hashed = [words_of(*batch_bytes(pa.array([t], pa.string())), folded=True)[3] for _, t in rows]
    counts = collections.Counter(int(np.int64(np.uint64(x).view(np.int64))) for h in hashed for x in h)
    top = sorted(sorted(counts, key=lambda x: (-counts[x], x))[:own], key=lambda x: x % 2 ** 64)
    size = own + classes

    def entry(x):
        s = int(np.uint64(x).view(np.int64))
        return top.index(s) if s in top else own + int(x) % classes
    seqs = [[entry(x) for x in h] for h in hashed]
    table = {True: np.zeros((size + 1, size)), False: np.zeros((size + 1, size))}
    for (i, _), s in zip(rows, seqs):
        for a, b in zip([size, *s], s):
            table[False][a, b] += 1
            if i in good:
                table[True][a, b] += 1
    table[False] *= table[True].sum() / table[False].sum()

    def loss(t, a, b):
        one = t.sum(0)
        return -math.log((t[a, b] + lmscore.PRIOR * (one[b] + 1) / (one.sum() + size)) / (t[a].sum() + lmscore.PRIOR))
    for (i, _), s in zip(rows, seqs):
        r = got[(i, len(s))]
        if s:
            want = [np.mean([loss(table[k], a, b) for a, b in zip([size, *s], s)]) for k in (True, False)]
            assert (r.loss_target, r.loss_background, r.score) == pytest.approx((*want, want[0] - want[1]), abs=1e-4)
        else:
            assert r.score is None
    assert len(lmscore.score(docs_of(spark, rows), spark.createDataFrame([], LABELS)).collect()) == len(rows)
    assert lmscore.score(docs_of(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_held_out_documents_are_told_apart(spark):
    rng = random.Random(18)
    rows = [(i, " ".join(rng.choices(["red", "green", "blue", "sky"] if i % 2 else ["mud", "oil", "red", "rust"], k=40))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], LABELS)
    got = {r.doc_id: r.score for r in lmscore.score(docs_of(spark, rows), labels).collect()}
    assert max(got[i] for i in range(101, 200, 2)) < min(got[i] for i in range(100, 200, 2))


@pytest.mark.parametrize("hot_words, hot_pairs", [(lmscore.HOT_WORDS, lmscore.HOT_PAIRS), (5, 3), (1, 0)])
def test_scores_over_the_whole_vocabulary(spark, monkeypatch, hot_words, hot_pairs):
    for name, value in (("HOT_WORDS", hot_words), ("HOT_PAIRS", hot_pairs), ("BUCKET", 2000)):
        monkeypatch.setattr(lmscore, name, value)
    rng = random.Random(21)
    rows = [(i, "a b a b the " + words(rng, 30, 4000) + " the end") for i in range(150)] + [(200, "a a a"), (201, "only"), (202, ""), (203, None)]
    labels = [(i, i % 2, 0) for i in range(100)]
    got = {r.doc_id: r for r in lmscore.score(docs_of(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    pairs, histories, singles = ({k: collections.Counter() for k in (True, False)} for _ in range(3))
    texts = {i: (t or "").split() for i, t in rows}
    for i, s in texts.items():
        for k in {False, i < 100 and i % 2 == 1}:
            singles[k].update(s)
            pairs[k].update(zip(["", *s], s))
            histories[k].update(["", *s][:-1] if s else [])
    size, scale = len(singles[False]), singles[True].total() / singles[False].total()
    assert size > 1024  # more words than 768 and 256 classes

    def loss(k, a, b):
        f = 1 if k else scale
        below = singles[k].total() * f + size
        return -math.log((pairs[k][a, b] * f + lmscore.PRIOR * (singles[k][b] * f + 1) / below) / (histories[k][a] * f + lmscore.PRIOR))
    for i, s in texts.items():
        assert got[i].n_words == len(s)
        if s:
            want = [np.mean([loss(k, a, b) for a, b in zip(["", *s], s)]) for k in (True, False)]
            assert (got[i].loss_target, got[i].loss_background, got[i].score) == pytest.approx((*want, want[0] - want[1]), abs=1e-6)
        else:
            assert got[i].score is None


FIXED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(FIXED.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def personal_rows():
    rng = random.Random(19)
    pieces = ["1", "4111 1111 1111 1111", "+", "(", ")", "@", ".", "a", "b", "-", " ", "_", "%", pii.MARK, "é", "🙂", "256", "0", "1.2.3.4", "x@y.zz", "+1 (988) 555-2485", "\n", "$1", "\\"]
    return odd_rows() + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for i in range(600)] + [(5000, "9" * 20000 + "a" * 20000 + "@" + "1." * 20000), (5001, "b.c" * 9000 + "@x" + ".y" * 9000)]


def test_personal_data_base_spans(spark):
    rows = personal_rows()
    got = pii.detect(docs_of(spark, rows)).collect()
    want = sorted((str(i), hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest(), *[sum(s.startswith(k) for s in base_spans(t)) for k in FIXED]) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    for r in got:
        assert set(filter(None, r.spans.split(","))) >= {f"{s.kind}:{s.start}:{s.end}" for s in r.found if s.kind in FIXED}
    assert pii.detect(docs_of(spark, [])).count() == 0


def test_boosted_trees_add_keys(spark):
    rng = random.Random(20)
    rows = []
    for i in range(400):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        cue = "token = " if i % 2 else "note: "
        rows.append((i, f"{words(rng, 8)} {cue}\"{key}\" {words(rng, 6)}" if i % 4 < 2 else words(rng, 9) + " " + "".join(rng.choice("abcdefghij") for _ in range(25)) + " 17 4.5"))
    got = {r.doc_id: r.spans for r in pii.detect(docs_of(spark, rows)).collect()}
    plain = [i for i in range(400) if i % 4 >= 2]
    assert sum("secret" in got[i] for i in plain) == 0


def test_boosted_trees_add_numbers_and_written_addresses(spark):
    rng = random.Random(23)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(1200):
        cue = rng.choice(["call", "tel", "fone:", "write to", "see"])
        kind = i % 6
        said = {0: f"{cue} +{digits(2)} {digits(5)} {digits(4)}", 1: f"tel {rng.choice('123456789')}{digits(10)}", 2: f"{cue} john{i} (at) example dot com", 3: f"order no {digits(4)}-{digits(8)}", 4: f"look at home. the {digits(4)}", 5: f"mail x{i}@y{i}.org"}[kind]
        rows.append((i, f"{words(rng, 8)} {said} {words(rng, 6)}"))
    got = {r.doc_id: r.spans for r in pii.detect(docs_of(spark, rows)).collect()}
    share = lambda kind, word: sum(word in got[i] for i in range(kind, 1200, 6)) / 200
    assert share(1, "number:") >= 0.9 and share(2, "contact:") >= 0.9
    assert share(3, "number:") <= 0.1 and share(4, "contact:") <= 0.1 and share(4, "number:") == 0


def test_redaction(spark):
    rows = [("mail x@y.zz, ip 1.2.3.4!", [(5, 11, "email"), (16, 23, "ip")]), ("abcdef", [(1, 4, "card"), (2, 5, "phone")]), ("none", [])]
    df = spark.createDataFrame(rows, "t string, s array<struct<start:int,end:int,kind:string>>")
    assert [r[0] for r in df.select(pii.redact(F.col("t"), F.col("s"))).collect()] == ["mail [email], ip [ip]!", "a[card]f", "none"]
