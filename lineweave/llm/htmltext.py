"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat run of text blocks, cut at block-level tags.  A block is described by its words and the share of
them inside links, the same of the blocks before and after it, and what its containers call themselves.  A decision tree,
trained on the small labelled table ``LABELLED``, tells which blocks belong to the article; their texts are joined in page
order.  Everything about a page stays within its row, so there is no shuffle.
"""
import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title noscript template textarea select button svg math iframe object noframes noembed canvas audio video".split())
#: An element of these kinds that is left open ends where the next of its kind starts.
RESTARTS = set("p li dt dd tr td th option".split())
TAG = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
REST = re.compile(r"""(?:[^>"']+|"[^"]*"|'[^']*')*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w-])""")
PAGE = set("html body article main".split())
ASIDE_TAGS = set("nav aside footer form menu dialog fieldset".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())
#: Words of class and id names of what isn't the article, and of what is.
ASIDE_NAMES = re.compile(r"(?<![a-z])(?:ads?|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banners?|cookies?|cookiebar|consent|gdpr|notices?|popups?|modal|overlay|newsletter|subscri\w*|signup|"
                         r"login|nav|navbar|topnav|sidenav|navigation|menus?|navmenu|breadcrumbs?|sidebars?|widgets?|footer|masthead|toolbar|social|shar(?:e|ing)|related|recommend\w*|"
                         r"trending|popular|comments?|commentlist|disqus|respond|repl(?:y|ies)|search|pagination|pager|taglist|hidden|copyright|legal|disclaimer|skip)(?![a-z])")
MAIN_NAMES = re.compile(r"(?<![a-z])(?:article|content|post|entry|story|main|maincontent|articlebody|postbody|body)(?![a-z])")

FEATURES = ["words", "link_share", "words_before", "link_share_before", "words_after", "link_share_after", "aside", "place", "heading"]


class Blocks:
    """Text blocks of one page: (text, words, linked words, aside, main, heading).

    ``aside``: some container is a menu, form, advert, comment list or the like.  ``main``: the innermost container that
    says so is the article's (2 by its tag or role, 1 by its name, else 0).  A page cut off anywhere ends there; a tag cut
    off is dropped, a character reference cut off is read as browsers do.
    """

    def __init__(self, page):
        self.found, self.pieces = [], []
        self.open = [("", 0, 0)]  # (tag, aside, main)
        self.count = {}
        self.links = 0  # depth at which the link around here was opened, else 0
        self.unclosed = set()
        at, n = 0, len(page)
        while at < n:
            m = TAG.search(page, at)
            if not m:
                self._text(page[at:])
                break
            self._text(page[at:m.start()])
            at = self._tag(page, m)
        self._flush()

    def _text(self, text):
        if text:
            self.pieces.append((text, self.links > 0))

    def _tag(self, page, m):
        """Handle the tag at ``m``; where the text goes on."""
        start, tag = m.group(0), m.group(2)
        if tag is None:
            ends = {"<!--": "-->", "<![CDATA[": "]]>"}.get(start, ">")
            at = page.find(ends, m.end())
            if start == "<![CDATA[":
                self._text(page[m.end():at if at >= 0 else len(page)])
            return at + len(ends) if at >= 0 else len(page)
        tag = tag.lower()
        rest = REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1
        if not end:
            return len(page)
        if m.group(1):
            self._close(tag)
            return end
        inside = page[m.end():end - 1]
        if tag in RAW and not inside.endswith("/"):
            close = None if tag in self.unclosed else re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(page, end)
            if tag not in INLINE:
                self._flush()
            if close:
                return (page.find(">", close.end()) + 1) or len(page)
            self.unclosed.add(tag)
            return len(page) if tag in ("script", "style", "title", "textarea") else end
        self._start(tag, inside)
        return end

    def _start(self, tag, inside):
        if tag == "a":
            self.links = len(self.open)  # links don't nest
        elif tag == "br":
            self.pieces.append((" ", False))
        if tag in INLINE or "-" in tag:
            return
        self._flush()
        if tag in VOID:
            return
        if self.open[-1][0] == tag and tag in RESTARTS or self.open[-1][0] == "p":
            self._pop()
        self.open.append((tag, *self._hints(tag, inside)))
        self.count[tag] = self.count.get(tag, 0) + 1

    def _hints(self, tag, inside):
        _, aside, main = self.open[-1]
        names, role = "", ""
        hidden = False
        if inside:
            for a in ATTRIBUTE.finditer(inside):
                key = (a.group(1) or a.group(5)).lower()
                value = a.group(2) or a.group(3) or a.group(4) or ""
                if key in ("class", "id"):
                    names += " " + re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).replace("_", "-").lower()
                elif key == "role":
                    role = value.strip().lower()
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = True
        own = tag in ("article", "main") or role in ("article", "main")
        if tag in ASIDE_TAGS or role in ASIDE_ROLES or hidden or tag == "header" and not main:
            aside = 1
        elif names and tag not in ("html", "body") and ASIDE_NAMES.search(names) and not (own and not re.search(r"comment|repl|related|promo|(?<![a-z])ads?(?![a-z])", names)):
            aside = 1
        if own:
            main = 2
        elif main < 2 and names and tag not in PAGE and MAIN_NAMES.search(names):
            main = 1
        return aside, main

    def _pop(self):
        tag = self.open.pop()[0]
        self.count[tag] -= 1
        if len(self.open) < self.links:
            self.links = 0  # a link left open ends with its block

    def _close(self, tag):
        if tag == "a":
            self.links = 0
        if tag in INLINE or "-" in tag:
            return
        self._flush()
        if self.count.get(tag):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def _flush(self):
        if self.pieces:
            words = linked = 0
            for text, link in self.pieces if any(x[1] for x in self.pieces) else ():
                n = len(text.split())
                linked += n if link else 0
            text = " ".join(html.unescape("".join(x[0] for x in self.pieces)).split())
            self.pieces = []
            if text:
                words = text.count(" ") + 1
                tag, aside, main = self.open[-1]
                self.found.append((text, words, min(linked, words), aside, main, int(tag in ("h1", "h2", "h3", "h4", "h5", "h6"))))


def described(blocks):
    """``FEATURES`` of each block, from (words, linked words, aside, main, heading).

    ``place``: 0 where the page names no article, 2 inside the article, 1 outside of the one it names.
    """
    named = max((b[3] for b in blocks if not b[2]), default=0)
    rows = []
    for i, (words, linked, aside, main, heading) in enumerate(blocks):
        before = blocks[i - 1] if i else (0, 0)
        after = blocks[i + 1] if i + 1 < len(blocks) else (0, 0)
        place = 0 if not named else 2 if main >= named else 1
        rows.append((float(words), linked / words, float(before[0]), before[1] / max(before[0], 1), float(after[0]), after[1] / max(after[0], 1), float(aside), float(place), float(heading)))
    return rows


#: Pages as block rows (words, linked words, aside, main, heading, is article).  By kind: news, blog, old table layout, forum,
#: shop, manual, teaser page, short note; with and without names that say what a container is.
LABELLED = {
    "news": [(1, 1, 1, 0, 0, 0), (1, 1, 1, 0, 0, 0), (2, 2, 1, 0, 0, 0), (9, 0, 1, 0, 0, 0), (8, 0, 0, 2, 1, 1), (4, 0, 0, 2, 0, 1), (62, 1, 0, 2, 0, 1), (12, 0, 1, 2, 0, 0), (48, 3, 0, 2, 0, 1),
             (1, 0, 0, 2, 0, 1), (75, 0, 0, 2, 0, 1), (5, 5, 1, 2, 0, 0), (31, 0, 1, 2, 0, 0), (22, 0, 1, 2, 0, 0), (7, 2, 1, 0, 0, 0)],
    "news, long notice": [(38, 4, 0, 0, 0, 0), (3, 3, 1, 0, 0, 0), (3, 3, 0, 0, 0, 0), (6, 0, 0, 2, 1, 1), (90, 2, 0, 2, 0, 1), (1, 0, 0, 2, 0, 1), (2, 0, 0, 2, 0, 1), (44, 0, 0, 2, 0, 1),
                          (25, 0, 0, 0, 0, 0), (14, 3, 0, 0, 0, 0)],
    "article, notices around": [(30, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (16, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (6, 0, 0, 2, 1, 1), (70, 2, 0, 2, 0, 1), (3, 0, 0, 2, 0, 1), (45, 0, 0, 0, 0, 0), (20, 0, 0, 0, 0, 0),
                                (12, 0, 0, 0, 0, 0), (5, 5, 0, 0, 0, 0)],
    "article, texts beside": [(8, 0, 0, 0, 1, 0), (90, 1, 0, 0, 0, 0), (41, 0, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (5, 0, 0, 2, 1, 1), (18, 0, 0, 2, 0, 1), (64, 0, 0, 2, 0, 1), (27, 0, 0, 0, 0, 0), (60, 0, 0, 0, 0, 0)],
    "blog": [(2, 2, 1, 0, 0, 0), (5, 0, 0, 1, 1, 1), (120, 4, 0, 1, 0, 1), (6, 0, 0, 1, 1, 1), (80, 0, 0, 1, 0, 1), (3, 0, 0, 1, 0, 1), (40, 0, 0, 1, 0, 1), (4, 4, 0, 1, 0, 0), (33, 0, 1, 1, 0, 0),
             (4, 0, 1, 1, 1, 0), (11, 11, 0, 0, 0, 0), (9, 0, 0, 0, 0, 0)],
    "old table layout": [(1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (5, 0, 0, 0, 1, 1), (95, 2, 0, 0, 0, 1), (60, 0, 0, 0, 0, 1), (9, 0, 0, 0, 0, 1), (70, 5, 0, 0, 0, 1),
                         (4, 4, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (6, 1, 0, 0, 0, 0)],
    "plain": [(2, 2, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (4, 0, 0, 0, 1, 1), (30, 0, 0, 0, 0, 1), (22, 0, 0, 0, 0, 1), (12, 0, 0, 0, 0, 1), (35, 0, 0, 0, 0, 1), (3, 3, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0)],
    "cut page": [(2, 2, 1, 0, 0, 0), (4, 0, 0, 2, 1, 1), (52, 1, 0, 2, 0, 1), (2, 0, 0, 2, 0, 1)],
    "cut short": [(1, 1, 1, 0, 0, 0), (7, 0, 1, 0, 0, 0), (3, 0, 0, 2, 0, 1)],
    "cut at once": [(2, 0, 0, 2, 1, 1)],
    "unnamed portal": [(4, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (7, 0, 0, 0, 1, 1), (85, 2, 0, 0, 0, 1), (6, 0, 0, 0, 0, 1), (72, 1, 0, 0, 0, 1), (2, 0, 0, 0, 0, 0),
                       (5, 5, 0, 0, 0, 0), (6, 6, 0, 0, 0, 0), (11, 0, 0, 0, 0, 0)],
    "unnamed diary": [(3, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (5, 0, 0, 0, 1, 1), (44, 0, 0, 0, 0, 1), (39, 2, 0, 0, 0, 1), (10, 0, 0, 0, 0, 1), (51, 0, 0, 0, 0, 1), (3, 3, 0, 0, 0, 0), (8, 0, 0, 0, 0, 0),
                      (4, 4, 0, 0, 0, 0)],
    "unnamed company": [(2, 0, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (4, 0, 0, 0, 1, 1), (33, 0, 0, 0, 0, 1), (47, 1, 0, 0, 0, 1), (4, 4, 0, 0, 0, 0), (9, 0, 0, 0, 0, 0)],
    "bare text": [(40, 0, 0, 0, 0, 1), (55, 3, 0, 0, 0, 1), (80, 0, 0, 0, 0, 1)],
    "bare page": [(1, 1, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (6, 0, 0, 0, 1, 1), (28, 1, 0, 0, 0, 1), (7, 0, 0, 0, 0, 1), (90, 0, 0, 0, 0, 1), (64, 2, 0, 0, 0, 1)],
    "forum": [(3, 3, 1, 0, 0, 0), (7, 0, 0, 2, 1, 1), (66, 0, 0, 2, 0, 1), (18, 1, 0, 2, 0, 1), (41, 0, 1, 2, 0, 0), (55, 2, 1, 2, 0, 0), (2, 2, 1, 2, 0, 0), (28, 0, 1, 0, 0, 0), (6, 6, 0, 0, 0, 0)],
    "shop": [(2, 2, 1, 0, 0, 0), (4, 0, 0, 1, 1, 1), (45, 0, 0, 1, 0, 1), (8, 0, 0, 1, 0, 1), (2, 0, 0, 1, 0, 1), (5, 5, 0, 1, 0, 0), (6, 6, 0, 1, 0, 0), (19, 0, 1, 1, 0, 0), (12, 0, 0, 0, 0, 0)],
    "manual": [(2, 2, 1, 0, 0, 0), (3, 3, 1, 0, 0, 0), (3, 0, 0, 2, 1, 1), (15, 0, 0, 2, 0, 1), (4, 0, 0, 2, 0, 1), (7, 7, 0, 2, 0, 0), (5, 1, 0, 2, 0, 1), (6, 0, 0, 2, 0, 1), (20, 12, 0, 2, 0, 1),
               (2, 0, 0, 2, 1, 1), (11, 0, 0, 2, 0, 1), (3, 3, 0, 2, 0, 0), (10, 0, 1, 0, 0, 0)],
    "short note": [(1, 1, 1, 0, 0, 0), (3, 0, 0, 2, 1, 1), (2, 0, 0, 2, 0, 1), (6, 0, 1, 0, 0, 0)],
    "long comments": [(1, 1, 1, 0, 0, 0), (6, 0, 0, 2, 1, 1), (25, 0, 0, 2, 0, 1), (70, 0, 1, 2, 0, 0), (110, 1, 1, 2, 0, 0), (95, 0, 1, 0, 0, 0), (88, 0, 1, 0, 0, 0), (40, 0, 1, 0, 0, 0)],
    "teasers": [(1, 1, 0, 0, 0, 0), (9, 9, 0, 0, 1, 0), (8, 8, 0, 0, 0, 0), (7, 7, 0, 0, 1, 0), (10, 10, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (8, 1, 0, 0, 0, 0)],
}
LABELLED_SCHEMA = "page string, block int, words int, linked int, aside int, main int, heading int, article int"


def labelled_table(spark) -> DataFrame:
    return spark.createDataFrame([(page, i, *row) for page, rows in LABELLED.items() for i, row in enumerate(rows)], LABELLED_SCHEMA)


def trained(labelled: DataFrame, depth=6):
    """A decision tree as nested (feature, threshold, low, high), leaves as booleans, from a table like ``LABELLED``.

    The table is small by its nature (hand-labelled blocks); it is read to the driver for the neighbours' features.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors
    spark = labelled.sparkSession
    pages = {}
    for r in labelled.orderBy("page", "block").collect():
        pages.setdefault(r["page"], []).append((r["words"], r["linked"], r["aside"], r["main"], r["heading"], r["article"]))
    rows = [(Vectors.dense(x), float(b[5])) for blocks in pages.values() for x, b in zip(described([b[:5] for b in blocks]), blocks)]
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=2, maxBins=64, seed=3, cacheNodeIds=False).fit(spark.createDataFrame(rows, ["features", "label"]).coalesce(1))

    def walk(node):
        if node.numDescendants() == 0:
            return node.prediction() == 1.0
        return node.split().featureIndex(), node.split().threshold(), walk(node.leftChild()), walk(node.rightChild())
    return walk(model._java_obj.rootNode())


def is_article(tree, features):
    while not isinstance(tree, bool):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def page_blocks(pages: DataFrame) -> DataFrame:
    """One row per text block of ``pages`` (page_id, html): its text and what it is described by, to label or to look at."""
    def run(batches):
        import pandas as pd
        for batch in batches:
            rows = []
            for page_id, page in zip(batch["page_id"], batch["html"]):
                found = Blocks(page or "").found
                rows += [(page_id, i, *b, *f) for i, (b, f) in enumerate(zip(found, described([b[1:] for b in found])))]
            yield pd.DataFrame(rows, columns=["page_id", "block", "text", "n_words", "n_linked", "is_aside", "main", "is_heading", *FEATURES])
    kind = pages.schema["page_id"].dataType.simpleString()
    features = ", ".join(f"{f} double" for f in FEATURES)
    return pages.select("page_id", "html").mapInPandas(run, f"page_id {kind}, block int, text string, n_words int, n_linked int, is_aside int, main int, is_heading int, {features}")


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, text, n_chars, n_blocks, n_kept).

    One row per given row, repeated and null ones too; a null or empty html, or one without an article block, has an empty
    text.  White space of any kind inside a block becomes one space, and ``br`` counts as white space.  ``tree``: see
    ``trained``; by default the one of ``LABELLED``.
    """
    import pyarrow as pa
    if tree is None:
        tree = trained(labelled_table(pages.sparkSession))

    def run(batches):
        for batch in batches:
            texts, blocks, kept = [], [], []
            for page in batch.column(2):
                found = Blocks(page.as_py() or "").found
                mine = [b[0] for b, f in zip(found, described([b[1:] for b in found])) if is_article(tree, f)]
                texts.append("\n\n".join(mine))
                blocks.append(len(found))
                kept.append(len(mine))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(blocks, pa.int32()), pa.array(kept, pa.int32())], ["page_id", "url", "text", "n_blocks", "n_kept"])
    d = pages.select("page_id", "url", "html")
    kinds = [d.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return (d.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_blocks int, n_kept int")
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept"))


def op11_main_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).drop("n_blocks", "n_kept")


#: The given pages mark their article by its tag; other layouts are left to the tests.
OP11_SQL = r"""
WITH p AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x: replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g'),
             '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS blocks FROM p),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda x: trim(regexp_replace(x, '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""
