"""Token counts by overlap resynchronisation.

A long text is encoded in overlapping chunks with offsets.  Two neighbouring encodings are spliced at a boundary that
both have and that is proven stable: the place of an ASCII white-space character, which the tokenizer's word split never
joins to either side (it drops white space, and neither normal forms nor special strings reach over one), where both
encodings go on with the same tokens up to the end of the shorter one's next word.  Where the overlap holds no such
boundary, it is widened, at worst to the whole text.  A text of one chunk has nothing to splice; its words are looked up
in a bounded memo of what the library gave for them.
"""
import functools
import os
import re

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

CHUNK, OVERLAP, MEMO = 65536, 512, 1_000_000
WHITE = re.compile(r"[ \t-\r]+")
#: White space to Python's split, but part of a word to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPECIAL = "<|"


class Counter:
    """Counts of one worker; ``vocabulary`` is a tokenizers file."""

    def __init__(self, vocabulary, chunk=CHUNK, overlap=OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.chunk, self.overlap, self.memo = Tokenizer.from_file(vocabulary), chunk, overlap, {"": 0}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    @staticmethod
    @functools.cache
    def of(vocabulary, chunk, overlap):
        """The worker's own, so that its memo serves all its tasks."""
        return Counter(vocabulary, chunk, overlap)

    def encode(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def learn(self, words):
        """Counts of new words, from one encoding of them all, told apart by offsets."""
        plain = [w for w in words if SPECIAL not in w]
        for w in words:
            if SPECIAL in w:
                self.memo[w] = len(self.encode(w).ids)
        for at in range(0, len(plain), 512):
            part = plain[at:at + 512]
            e = self.encode("\n".join(part))
            i, end, counts, offsets = 0, len(part[0]), [0] * len(part), e.offsets
            for start, _ in offsets:
                while start >= end:
                    i += 1
                    end += len(part[i]) + 1
                counts[i] += 1
            self.memo.update(zip(part, counts))

    def short(self, texts):
        pieces = [WHITE.split(t) if SEPARATORS.search(t) else t.split() for t in texts]
        new = {w for p in pieces for w in p} - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:
            self.memo = {"": 0}
            new = {w for p in pieces for w in p} - {""}
        self.learn(list(new))
        get = self.memo.__getitem__
        return [sum(map(get, p)) for p in pieces]

    def long(self, text):
        """Tokens of ``text``, from chunks that overlap."""
        n, total, done = len(text), 0, 0
        start, end = 0, min(len(text), self.chunk)
        left = self.encode(text[:end])
        while end < n:
            overlap, cut = self.overlap, None
            while cut is None and overlap < end - start:
                begin = end - overlap
                upto = min(n, max(begin + self.chunk, end + overlap))
                right = self.encode(text[begin:upto])
                cut = self.splice(text, start, left, end, begin, right)
                overlap *= 4
            if cut is None:  # no stable boundary in the whole left chunk: a longer one replaces it
                end = min(n, start + 2 * (end - start))
                left = self.encode(text[start:end])
                continue
            total += sum(1 for s, _ in left.offsets if done <= start + s < cut)
            done, start, end, left = cut, begin, upto, right
        return total + sum(1 for s, _ in left.offsets if start + s >= done)

    def splice(self, text, start, left, end, begin, right):
        """A white-space boundary that both encodings share, with the same tokens of the next word; None if there is none."""
        spaces = [m.end() for m in WHITE.finditer(text, begin, end)]
        heads_l = {start + s: i for i, (s, _) in enumerate(left.offsets)}
        heads_r = {begin + s: i for i, (s, _) in enumerate(right.offsets)}
        for a, b in zip(spaces, spaces[1:]):
            if a in heads_l and a in heads_r and b in heads_l and b in heads_r:
                if left.ids[heads_l[a]:heads_l[b]] == right.ids[heads_r[a]:heads_r[b]]:
                    return a
        return None

    def counts(self, texts):
        out = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, c in zip(short, self.short([texts[i] for i in short])):
            out[i] = c
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.long(t)
        return out


def count_tokens(docs: DataFrame, vocabulary=None, chunk=CHUNK, overlap=OVERLAP, limit=2048) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_bytes, n_tokens, over_limit); a null text is empty, each row has its own result.

    ``vocabulary``: path of a tokenizers file that every executor has, the library's word vocabulary by default.
    """
    path = vocabulary

    def run(batches):
        import pandas as pd
        import public_tokenizers as P
        counter = Counter.of(path or P.path("word_bpe_49k.json"), chunk, overlap)
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                yield pd.DataFrame({"doc_id": part.doc_id, "n_bytes": part.n_bytes, "n_tokens": counter.counts(part.text.tolist())})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInPandas(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
