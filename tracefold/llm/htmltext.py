"""Main text of web pages by a site style tree.

The element trees of all pages of a host are merged: elements whose chains of
tags and classes are equal are one node of the host's style tree.  A node knows
how many distinct main texts show it, how its presentation (sequence of child
elements) and its content (text below it) are spread over them.  Importance is
the entropy of both to the base of their number, content weighing CONTENT:
what is the same on every page has none.  Branches of low importance are
removed from the pages that show their repeated content, after those that their
own names mark as menus, headers, footers, sidebars, notices, adverts, forms,
comments or code.  Nothing inside article or main goes by repetition.

Pages are read twice and never shuffled: the first pass yields a few hashes per
element chain, which are aggregated; the second removes the contents found to be
repeated on the page's host.  A main text counts once however many copies and
near copies (other menu, advert or date) show it.
"""

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize

CONTENT = 0.9            # weight of content against presentation
LEAST_IMPORTANCE = 0.2
LEAST_PAGES = 8          # distinct main texts from which repetition tells
MAIN_SHARE = 0.75        # the longest blocks that hold this share tell main texts apart

MARK = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
SPACE = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROPPED = set("head script style noscript template nav footer aside form button select textarea input iframe "
              "svg canvas object dialog menu title xmp noembed noframes datalist option label audio video map".split())
BLOCKS = set("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = set("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: Words in class, id or role that mark a branch beside the article.
MARKED = set("ad ads adbox advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments "
             "consent contentinfo complementary cookie cookies dialog disclaimer disqus footer form gdpr login masthead "
             "menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
             "promotion recommended related replies respond search share sharing sidebar signup skip social sponsor "
             "sponsored subscribe toolbar topbar widget".split())
#: Words that beside a marking one leave its meaning; a name of other words counts only outside articles.
NEUTRAL = set("area article bar block bottom box button buttons container content cta group inner item items link links list "
              "news outer page panel post posts row section site slot text top unit wrap wrapper".split())
PARAGRAPH_ENDS = {"article", "section", "div", "td", "th", "li", "main", "body", "table", "blockquote"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts))) >> 1


def _marked(tag: str, attributes: dict, inside: bool) -> bool:
    """Hidden, or named as something beside the article.

    Inside an article a name must consist of marking and neutral words: "share-buttons"
    goes, "share-price" is what the article is about.
    """
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" \
            or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    for name in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        words = {w.lower() for w in NAME.findall(name)}
        if words & MARKED and (not inside or words <= MARKED | NEUTRAL):
            return True
    return False


class Page:
    """One reading of a page: its kept blocks and, per element chain, content and presentation.

    Every character is looked at a bounded number of times, however tags nest or break off.
    """

    def __init__(self, html: str | None):
        self.stack: list[tuple] = []             # (tag, dropped, in article, node, prose, block or dropped element)
        self.places: dict[str, list[int]] = {}   # where in the stack a tag is open
        self.nodes: list[tuple] = [(-1, 0, False)]   # (parent, chain, may go by repetition) of block elements
        self.digests: list[int] = [0]            # of the texts below a node, as they close
        self.blocks: list[tuple] = []            # (in article, text, node, prose)
        self.branches: set[int] = set()          # chains outside articles, which repetition may remove
        self.buffer: list[str] = []
        self.inside = False
        self.content: dict[int, int] = {}
        self.style: dict[int, int] = {}
        self.missing: dict[str, int] = {}        # no such character from here on
        self._read(html or "")

    def _flush(self):
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                node, prose = self.stack[-1][3:5] if self.stack else (0, False)
                self.blocks.append((self.inside, text, node, prose))
            self.buffer.clear()

    def _text(self, raw: str):
        if not raw or self.stack and self.stack[-1][1]:
            return
        text = unescape(raw) if "&" in raw else raw
        self.buffer.append(text)
        squeezed = "".join(text.split())
        if squeezed:
            node = self.stack[-1][3] if self.stack else 0
            self.digests[node] = _hash(self.digests[node], squeezed)

    def _open(self, tag: str, attributes: dict):
        _, dropped, inside, node, prose, _ = self.stack[-1] if self.stack else ("", False, False, 0, False, False)
        if tag in BLOCKS:
            self._flush()
        if tag in ("article", "main") or attributes.get("role") == "main":
            inside = 2 if tag == "article" else inside or 1
        if tag in BLOCKS and not dropped:
            above = self.nodes[node][1]
            names = re.sub(r"\d+", "#", " ".join(sorted(attributes.get("class", "").split())))
            chain = _hash(above, tag, names)
            self.style[above] = _hash(self.style.get(above, 0), tag, names)
            may_go = not inside and tag not in ("html", "body")
            if may_go:
                self.branches.add(chain)
            self.nodes.append((node, chain, may_go))
            self.digests.append(0)
            node = len(self.nodes) - 1
        dropped = dropped or tag in DROPPED or tag == "header" and not inside or _marked(tag, attributes, bool(inside))
        if dropped and tag not in BLOCKS and tag in DROPPED:
            self._flush()
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, dropped, inside, node, prose or tag in PROSE, tag in BLOCKS or tag in DROPPED))
        self.inside = inside

    def _pop(self, at: int):
        if any(s[5] for s in self.stack[at:]):
            self._flush()
        while len(self.stack) > at:
            tag, _, _, node, _, _ = self.stack.pop()
            self.places[tag].pop()
            above = self.stack[-1][3] if self.stack else 0
            if node != above:                    # a block element ends: its texts belong to the one around it, too
                _, chain, _ = self.nodes[node]
                if self.digests[node]:
                    self.content[chain] = _hash(self.content.get(chain, 0), self.digests[node])
                    self.digests[above] = _hash(self.digests[above], self.digests[node])
        self.inside = self.stack[-1][2] if self.stack else False

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, tags, barriers=()):
        at = self._last(tags)
        if at >= 0 and at > self._last(barriers):
            self._pop(at)

    def _find(self, html: str, what: str, at: int) -> int:
        """Place of ``what``, or -1; that there is none is found once."""
        if at >= self.missing.get(what, len(html) + 1):
            return -1
        found = html.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def _attributes(self, html: str, at: int) -> tuple[dict, int]:
        """Attributes from ``at`` and the place behind the tag's end, -1 if it has none.

        A quote that never closes is an ordinary character.
        """
        out = {}
        while True:
            at = SPACE.match(html, at).end()
            if at >= len(html):
                return out, -1
            if html[at] == ">":
                return out, at + 1
            name = ATTRIBUTE.match(html, at)
            at, value = name.end(), ""
            equals = EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at:at + 1]
                end = self._find(html, quote, at + 1) if quote in ('"', "'") and quote else -1
                if end >= 0:
                    value, at = html[at + 1:end], end + 1
                else:
                    bare = BARE.match(html, at)
                    value, at = bare[0], bare.end()
            out.setdefault(name[0].lower(), unescape(value) if "&" in value else value)

    def _read(self, html: str):
        at = begin = 0
        while (m := MARK.search(html, at)) is not None:
            self._text(html[begin:m.start()])
            if m[2] is None:                     # a comment, or what browsers take for one
                end = self._find(html, "-->", m.start() + 2) if m[0] == "<!--" else self._find(html, ">", m.end())
                at = begin = len(html) if end < 0 else end + (3 if m[0] == "<!--" else 1)
                continue
            tag = m[2].lower()
            attributes, at = self._attributes(html, m.end())
            if at < 0:                           # a tag that never ends
                at = begin = len(html)
                break
            begin = at
            if m[1]:
                self._close((tag,))
                continue
            if tag in BLOCKS and tag not in ("body", "html"):
                self._close(("p",), PARAGRAPH_ENDS)
            if tag in CLOSES:
                self._close(CLOSES[tag], BARRIERS[tag])
            if tag in VOID:
                if tag in BLOCKS:
                    self._flush()
                elif tag == "br" and not (self.stack and self.stack[-1][1]):
                    self.buffer.append(" ")
                continue
            if tag in RAW:                       # not markup up to its end tag
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                close = self._find(html, ">", end.end()) if end else -1
                at = begin = close + 1 if close >= 0 else len(html)
                continue
            self._open(tag, attributes)
        self._text(html[begin:])
        self._flush()
        self._pop(0)

    def _best(self) -> list[tuple]:
        """Blocks of the articles, or of main, unless the page's prose stands beside them; without any, all."""
        best = max((b[0] for b in self.blocks), default=False)
        chosen = [b for b in self.blocks if not best or b[0] == best]
        beside = sum(len(b[1]) for b in self.blocks if best and b[0] != best and b[3])
        return self.blocks if beside > sum(len(b[1]) for b in chosen) else chosen

    def text(self, repeated=frozenset()) -> str:
        """The page's text without the branches whose (chain, content) is repeated."""
        gone = [False] * len(self.nodes)
        if repeated:
            noise = {c for c in self.branches if (c, self.content.get(c, 0)) in repeated}
            for i, (parent, chain, may_go) in enumerate(self.nodes):     # parents come first
                gone[i] = parent >= 0 and gone[parent] or may_go and chain in noise
        return "\n".join(t for inside, t, node, _ in self._best() if inside or not gone[node])

    def main_text(self) -> int:
        """Hash of the longest blocks of the articles, of main, or of paragraphs and headings."""
        best = self._best()
        if best and not best[0][0]:
            best = [b for b in best if b[3]] or best
        texts = sorted({b[1] for b in best}, key=lambda t: (-len(t), t))
        left, longest = MAIN_SHARE * sum(map(len, texts)), []
        for t in texts:
            if left <= 0:
                break
            longest.append(t)
            left -= len(t)
        return _hash(*longest)


_CHAINS = "host string, chain long, content long, style long, page long"


def _chains(batches):
    for batch in batches:
        rows = []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html")):
            page, host = Page(html.as_py()), host_of(url)
            key = page.main_text() if page.branches else 0
            rows += [(host, c, page.content.get(c, 0), page.style.get(c, 0), key) for c in page.branches]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(5)],
            ["host", "chain", "content", "style", "page"])


def repeated_contents(pages: DataFrame) -> DataFrame:
    """(host, chain, content) of chains of low importance: contents that LEAST_PAGES main texts or more show."""
    chains = pages.select("url", "html").mapInArrow(_chains, _CHAINS)
    # a main text counts once; then partial sums per value keep hot hosts flat
    chains = materialize(chains.groupBy("host", "chain", "page").agg(
        F.min("content").alias("content"), F.min("style").alias("style")), "chains")

    def counts(by: str) -> DataFrame:
        return chains.groupBy("host", "chain", by).agg(F.count("*").alias("c"))

    def entropy(by: str) -> DataFrame:
        return counts(by).groupBy("host", "chain").agg(
            F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("s")).select(
            "host", "chain", "pages",
            F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages"))
            .otherwise(1.0).alias(f"{by}_entropy"))
    unimportant = (entropy("content").join(entropy("style").drop("pages"), ["host", "chain"])
                   .filter((F.col("pages") >= LEAST_PAGES) & (
                       CONTENT * F.col("content_entropy") + (1 - CONTENT) * F.col("style_entropy") < LEAST_IMPORTANCE)))
    return (counts("content").filter(F.col("c") >= LEAST_PAGES)
            .join(unimportant, ["host", "chain"]).select("host", "chain", "content"))


def _extract(batches):
    for batch in batches:
        texts = [Page(h.as_py()).text({(n["chain"], n["content"]) for n in noise or ()})
                 for h, noise in zip(batch.column("html"), batch.column("noise").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: main text of every row of pages.

    pages: page_id, url, html; further columns are ignored.  Blocks are those of
    article elements, else of main, else of the body; all of the body, if paragraphs and
    headings beside the articles hold more than these do.  Broken markup is read as
    browsers read it, in linear time; a tag that never ends drops the rest.  Character references are
    decoded, white space inside a block becomes one space, blocks are joined by
    a line break in page order; line break elements are white space.  Null and empty
    html gives an empty text.  Pages without a host in their url share the
    host "".  Repeated rows give repeated rows.  Without repeated contents of
    unimportant chains (few pages, no repetition) only marked branches go.
    """
    noise = repeated_contents(pages).groupBy("host").agg(F.collect_list(F.struct("chain", "content")).alias("noise"))
    noise = materialize(noise, "noise")     # read back, its size is known when the join is planned
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return (pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
            .join(noise, "host", "left").select("page_id", "url", "html", "noise")
            .mapInArrow(_extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long"))


PAGES_SQL = r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
lined AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(replace(a, chr(10), ' '), '</?(b|br)>', ' ', 'g'),
    '</?(h1|p)>', chr(10), 'g'), chr(10)) AS lines FROM article),
plain AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(lines, lambda x: trim(regexp_replace(
    replace(regexp_replace(x, '&quot;', '"', 'g'), '&amp;', chr(1)), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t
  FROM lined)
SELECT page_id, url, replace(regexp_replace(t, '&amp', '&', 'g'), chr(1), '&') AS text,
       CAST(len(replace(regexp_replace(t, '&amp', '&', 'g'), chr(1), '&')) AS BIGINT) AS n_chars FROM plain"""
