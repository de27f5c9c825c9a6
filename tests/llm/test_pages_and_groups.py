"""Main text of pages (11), centroid clustering (12) and the filter audit (13) against brute force and held-out pages."""
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from lineweave.llm.centroids import cluster, dictionaries, encode, integers
from lineweave.llm.filteraudit import audit
from lineweave.llm.htmltext import Blocks, extract, is_article, labelled_table, described, page_blocks, trained

from .cases import docs_of, odd_rows, words

LONG = " ".join(f"word{i}" for i in range(60))
#: (page, its main text): layouts that the labelled table doesn't hold.
HELD_OUT = [
    ("<html><body><nav><a href=/>Home</a> <a href=/x>Products and more</a></nav><article><h1>A &lt;title&gt;</h1><p>First&nbsp;\n\t part<br>of it.<p>Ok.</p>"
     f"<p>{LONG}</p><div class='ad-box'>Buy now while it lasts dear reader.</div><p>Last &amp; least</p></article><footer>&copy; 2020 all rights</footer></body></html>",
     ["A <title>", "First part of it.", "Ok.", LONG, "Last & least"]),
    (f"<body><header><h1>The Daily</h1></header><div id=cookieNotice><p>We use cookies to give you {LONG}</p></div><main><h2>Head</h2><p>{LONG}</p><p>Short one.</p>"
     f"<section class='comments'><h3>Comments</h3><p>I say {LONG}</p><form><label>Name</label><input></form></section></main><aside><p>Most read {LONG}</p></aside></body>",
     ["Head", LONG, "Short one."]),
    (f"<body><table><tr><td><a href=a>One</a><br><a href=b>Two</a></td><td><h1>Old page title</h1><p>{LONG}</p><p>{LONG} again</p></td></tr></table></body>", ["Old page title", LONG, f"{LONG} again"]),
    (f"<body><div class='menu'><ul><li><a href=1>a b c</a><li><a href=2>d e</a></ul></div><div class='post-content'><p>{LONG}</p><ul><li>first point here<li>second point</ul></div>"
     f"<div class='reply-list'><article class='comment'><p>Me too {LONG}</p></article></div>", [LONG, "first point here", "second point"]),
    (f"<script>if (a < b) document.write('<p>no</p>')</script><style>p {{}}</style><article><p>{LONG}</p><script>x('</p>')</script><noscript>enable it</noscript><p>Tail", [LONG, "Tail"]),
]


def tag_free(page):
    return re.sub(r"<[^>]*>", "", page)


def test_trees_find_held_out_articles(spark):
    pages = spark.createDataFrame([(i, f"u{i}", p, 9, "x") for i, (p, _) in enumerate(HELD_OUT)], "page_id long, url string, html string, n_chars int, text string")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    for i, (_, want) in enumerate(HELD_OUT):
        assert got[i]["text"] == "\n\n".join(want)
        assert got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == f"u{i}"


def test_tree_is_trained_on_the_table_and_holds_out(spark):
    table = labelled_table(spark)
    names = sorted(r["page"] for r in table.select("page").distinct().collect())
    right = n = 0
    for out in names[::3]:  # trained without a page kind, judged on it
        tree = trained(table.filter(table.page != out))
        rows = [tuple(r)[2:] for r in table.filter(table.page == out).orderBy("block").collect()]
        right += sum(is_article(tree, f) == bool(b[5]) for f, b in zip(described([b[:5] for b in rows]), rows))
        n += len(rows)
    assert right / n >= 0.8


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p"), (3, "u", "plain text without any tag"), (3, "u", "plain text without any tag"), (4, "u", "<article><p>cut &am"),
            (5, "u", "<article><p>cut &amp"), (6, "u", "<!-- <p>never</p>"), (7, "u", "<article><p title='x>y'>ok &#233;&eacute;</p></article>"), (8, "u", "<div>" * 20000 + "deep"),
            (9, "u", "<article>" + "<p>some words of a long page</p>" * 30000 + "</article>"), (10, "u", "</p></div><article><a href=x>" + "<p>q w e r t y</p>" * 3)]
    got = [(r["page_id"], r["text"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[1] == by[2] == by[6] == "" and by[None] == ""
    assert by[4] == "cut &am" and by[5] == "cut &" and by[7] == "ok éé"
    assert by[9] == "\n\n".join(["some words of a long page"] * 30000)
    assert extract(spark.createDataFrame([], "page_id string, url string, html string")).count() == 0


def test_blocks_of_a_page_can_be_looked_at(spark):
    pages = spark.createDataFrame([("p", HELD_OUT[0][0])], "page_id string, html string")
    rows = page_blocks(pages).collect()
    assert [r["text"] for r in rows] == [b[0] for b in Blocks(HELD_OUT[0][0]).found]
    assert max(r["link_share"] for r in rows) == 1.0


# ---- centroids ---------------------------------------------------------------------------------------------------

def lloyd(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for c, vs in groups.items():
            cents[c] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    total = sum(d for *_, d in out)
    return sorted(((str(i), c, d, sum(e for _, b, e in out if b == c), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in out))


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, label int, cluster int, distance double")


@pytest.mark.parametrize("seed", [1, 2])
def test_centroids_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 5 - 2, 0.4) for _ in range(64)]) for i in range(90)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(7, rows[8][1]), (None, rows[9][1]), (None, [0.0] * 64)]
    rows += [(301, None), (302, []), (303, [1.0] * 63), (304, [None] + [1.0] * 63), (305, [float("nan")] * 64), (306, [float("inf")] * 64), (307, [-0.0] * 64), (308, [1e4] * 64)]
    got = sorted((str(r[0]), *r[1:]) for r in map(tuple, cluster(vectors_of(spark, rows).repartition(5)).collect()))
    assert got == lloyd(rows)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, cluster(vectors_of(spark, rows)).collect())) == lloyd(rows)
    assert cluster(vectors_of(spark, [(1, None)])).count() == 0
    with pytest.raises(Exception, match="beyond"):
        cluster(vectors_of(spark, [(1, [1e9] * 64)])).collect()


def test_dictionaries_are_lossless_and_shared(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(-300, 300, (2000, 64))
    m[500:] = m[rng.integers(0, 20, 1500)]  # copies
    blocks = dictionaries(m)
    assert sorted(i for s, e, *_ in blocks for i in range(s, e)) == list(range(64))
    assert all((values[codes] == m[:, s:e]).all() and len(np.unique(values, axis=0)) == len(values) for s, e, values, codes in blocks)
    assert max(e - s for s, e, *_ in blocks) > 1 and sum(len(values) * (e - s) for s, e, values, _ in blocks) < m.size / 2
    df = vectors_of(spark, [(i, [float(x) / 1024 for x in v]) for i, v in enumerate(m[:40].tolist())])
    row = encode(integers(df).coalesce(1)).first()
    assert row["n"] == 40 and len(row["ids"]) == 40


# ---- filter audit ------------------------------------------------------------------------------------------------

def brute_audit(rows, labels):
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        docs.append((source or "", {f for f, x in fails.items() if x}, any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and x == 1 for j, _, x in labels if j is not None)))
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            mine = list(left)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["a", "b"])) for i, t in [(r[0], r[1]) for r in odd_rows(rng)]]
    rows += [(50 + i, words(rng, rng.choice([20, 55, 90]), rng.choice([60, 4000])) + rng.choice(["", " #", " ABCDEFGHIJ" * 9]), rng.choice(["a", "b", None, ""])) for i in range(60)]
    rows += [(200 + i, rows[20][1], "b") for i in range(40)] + [(12, rows[20][1], None), (None, rows[20][1], "a"), (999, None, "z")]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows[::2]] + [(50, 1, 1), (50, 0, 0), (None, 1, 1), (777, 1, 0)]
    got = audit(docs_of(spark, rows).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got.collect()} == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert audit(docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
