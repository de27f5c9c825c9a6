"""Shared inputs of the corpus operators' tests."""
import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, base string, h long, row long, rep long"


def docs_of(spark, rows):
    """``rows``: (doc_id, text[, source[, lang]]); further columns have the names that operators use inside."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", 1, 2, 3.0, "b", 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, DOC)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def odd_rows(rng=None):
    """Null and empty texts, null ids, ties, rows alike, and a very long text."""
    rng = rng or random.Random(5)
    same = words(rng, 60)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, same), (6, same), (7, same), (7, same), (None, words(rng, 30)), (None, None), (8, words(rng, 20000, 9000)),
            (9, "é́ 🙂 " * 30), (10, "a" * 5000), (11, words(rng, 80) + "\n" + same)]
