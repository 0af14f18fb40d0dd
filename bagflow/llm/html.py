"""Operator 1: main text of web pages, with site template removal.

Every element's whole subtree, its tags and its text, is hashed as it stands on the page, the hashes are counted by host in Spark,
and subtrees found on many pages of a host are deleted as template, the outermost first. What is no template but not the article by
its tag, role or class (a menu, header, advert, comments and so on) is deleted as well, on any page."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagflow.llm.common import discard, lean, own, prepared, stored, table

#: A subtree is template where so many pages, and such a share of the pages, of one host have it.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: Template hashes that may be sent to every task (8 bytes each); more are joined to their pages instead.
SENT_HASHES = 200_000

# Elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video".split())
BLOCK = frozenset(
    "html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table caption colgroup thead tbody tfoot tr td th ul".split()
)
#: What a start tag ends, as far up as the nearest of the second set.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
    "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tr td th", "table"), "body": ("head", "html"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
ENDS_P = BLOCK - frozenset("html body head option optgroup caption colgroup thead tbody tfoot tr td th".split())
P_SCOPE = frozenset("td th table body html button".split())
DROP_TAGS = frozenset("nav footer aside form head button select dialog menu search".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "alert alerts announcement nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments respond reply replies disqus discussion related recommended pagination pager searchbox toolbar skip".split()
)
#: An article of this kind is a reader's comment.
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus discussion".split())
#: Beside a word of the above, these may stand in a name such as "comment-list" or "site-footer"; "notice-board" is another thing.
BESIDE = frozenset(
    "area bar bars block body bottom box btn button buttons center col column container content desktop entry fixed form global google group header heading holder icon icons inner item items label left link links list main mobile module outer page panel post posts primary region right row section secondary site slot small sticky sub text thread title top unit user wrap wrapper zone".split()
)
#: A class that says how a page is laid out, such as "with-sidebar", stands on what holds the article.
LAYOUT = frozenset("has with no without layout page".split())
#: Page or site headers; inside an article a header holds its title.
DROP_OUTSIDE = frozenset("header topbar".split())
NEVER = frozenset("html body main article".split())
#: Inside an article these hold prose; a passage that many pages share is text, not template.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption summary".split())
FORMATTING = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOST = re.compile(r"://([^/?#]*)")
PARTS = re.compile(r"[-_]+")
SIZE = re.compile(r"\d+(?:x\d+)?\Z")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")


def host_of(url: str | None) -> str:
    found = HOST.search(url or "")
    return found[1].lower() if found else ""


def named(value: str, words: frozenset) -> bool:
    """Whether one of a class or id attribute's names is made of these words."""
    for one in value.split():
        # "leftSidebar" is left-sidebar and "ad2" another ad
        parts = {x if SIZE.match(x) else x.rstrip("0123456789") for x in PARTS.split(CAMEL.sub(r"\1-\2", one).lower())} - {""}
        if not parts & LAYOUT and (rest := parts - words) != parts and all(x in BESIDE or x in DROP_WORDS or x in DROP_OUTSIDE or SIZE.match(x) for x in rest):
            return True
    return False


def dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER and tag != "article":
        return False
    if tag in DROP_TAGS or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    names = COMMENT_WORDS if tag == "article" else DROP_WORDS if in_article else DROP_WORDS | DROP_OUTSIDE
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        given = values[0] or values[1] or values[2]
        value = given.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "role" and value.strip() in DROP_ROLES:
            return True
        if name in ("class", "id") and named(given, names):
            return True
    return False


def blocks_of(pieces: list[str | None]) -> list[str]:
    """Blocks between the breaks (None): references decoded, white space turned into one space."""
    out, held = [], []
    for piece in [*pieces, None]:
        if piece is not None:
            held.append(piece)
        elif held:
            text = "".join(held)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append(text)
            held = []
    return out


class Page:
    """A page's elements in the order of the source.

    events: text as a string, None for a break, the number of an element where it begins and its complement where it ends."""

    def __init__(self, html: str):
        self.events: list[str | int | None] = []
        self.tags: list[str] = []
        self.attributes: list[str] = []
        self.ends: list[int] = []
        self.begins: list[int] = []
        self.read(html)

    def read(self, html: str) -> None:
        events, stack = self.events, []

        def close(n: int) -> None:
            while len(stack) > n:
                node = stack.pop()
                self.ends[node] = len(events)
                events.append(~node)

        def close_upto(tags: frozenset, scope: frozenset) -> None:
            for i in range(len(stack) - 1, -1, -1):
                tag = self.tags[stack[i]]
                if tag in tags:
                    close(i)
                    return
                if tag in scope:
                    return

        at, size = 0, len(html)
        while at < size:
            found = TOKEN.search(html, at)
            if (upto := found.start() if found else size) > at:
                events.append(html[at:upto])
            if not found:
                break
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag = tag.lower()
            if found[1] or found[4]:
                for i in range(len(stack) - 1, -1, -1):
                    open_tag = self.tags[stack[i]]
                    if open_tag == tag:
                        close(i)
                        break
                    if tag in FORMATTING and open_tag in BLOCK:
                        break
                else:
                    if tag in BLOCK:
                        events.append(None)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else size
                continue
            if tag in ENDS_P:
                close_upto(frozenset(("p",)), P_SCOPE)
            if tag in CLOSES:
                close_upto(*CLOSES[tag])
            if tag in VOID:
                events.append(None if tag in BLOCK else " " if tag in ("br", "wbr") else "")
                continue
            node = len(self.tags)
            self.tags.append(tag)
            self.attributes.append((found[3] if found[2] else found[6]) or "")
            self.begins.append(len(events))
            self.ends.append(-1)
            stack.append(node)
            events.append(node)
        close(0)

    def codes(self, host: str) -> dict[int, int]:
        """A hash of the host and of the whole subtree for every element that could be template and holds text.

        Subtrees are compared by their tags and their text without regard to white space and attributes."""
        said, filled, in_article, inside = [], [0], [], 0
        for event in self.events:
            words = 0
            if isinstance(event, str):
                text = " ".join(event.split())
                said.append(text)
                words = bool(text)
            elif event is None:
                said.append("<>")
            elif event >= 0:
                in_article.append(inside > 0)
                inside += self.tags[event] == "article"
                said.append("<" + self.tags[event])
            else:
                inside -= self.tags[~event] == "article"
                said.append(">")
            filled.append(filled[-1] + words)
        out = {}
        for node, tag in enumerate(self.tags):
            if tag not in BLOCK or tag in NEVER or in_article[node] and tag in PROSE:
                continue
            a, b = self.begins[node], self.ends[node]
            if filled[b] > filled[a]:
                whole = "\0".join([host, *said[a:b]]).encode("utf-8", "surrogatepass")
                out[node] = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True)
        return out

    def text(self, template: set[int]) -> str:
        """The main text without the elements in `template`: that of the articles; without one, of main; else of all."""
        kept: list[list[str | None]] = [[], [], []]  # outside, in main, in an article
        region, regions = 0, []
        skip = -1  # the element that is being left out
        for event in self.events:
            if isinstance(event, str) or event is None:
                if skip < 0:
                    kept[region].append(event)
                continue
            if event < 0:
                if skip >= 0:
                    if skip == ~event:
                        skip = -1
                    continue
                if self.tags[~event] in BLOCK:
                    kept[region].append(None)
                region = regions.pop()
                continue
            if skip >= 0:
                continue
            tag, attributes = self.tags[event], self.attributes[event]
            if event in template or dropped(tag, attributes, region == 2):
                skip = event
                kept[region].append(None if tag in BLOCK else "")
                continue
            if tag in BLOCK:
                kept[region].append(None)
            regions.append(region)
            region = 2 if tag == "article" else max(region, 1) if tag == "main" or 'role="main"' in attributes else region
        for pieces in reversed(kept):
            if blocks := blocks_of(pieces):
                return " ".join(blocks)
        return ""


def read_page(html: str, host: str, template: Callable[[int], bool] | None) -> tuple[str, list[int]]:
    """The main text, and the hashes of the subtrees that could be template; those that `template` knows are left out."""
    page = Page(html)
    codes = page.codes(host)
    return page.text({node for node, code in codes.items() if template(code)} if template else set()), list(codes.values())


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, hosts, codes = [], [], []
        for key, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            host = host_of(url)
            keys.append(key)
            hosts.append(host)
            codes.append(sorted(set(Page(html or "").codes(host).values())))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(codes, pa.list_(pa.int64()))], ["row_key", "host", "codes"])


def _extractor(sent: np.ndarray | None) -> Callable:
    """Texts of (page_id, url, html, codes); with sent, the template hashes are those, else each row's codes."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = frozenset(sent.tolist()) if sent is not None else frozenset()
        for batch in batches:
            texts = []
            codes = batch.column(3).to_pylist() if sent is None else [None] * batch.num_rows
            for url, html, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), codes, strict=True):
                known = everywhere if sent is not None else frozenset(mine or ())
                page = Page(html or "")
                gone = {node for node, code in page.codes(host_of(url)).items() if code in known} if known else set()
                texts.append(page.text(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return extract


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", sent_hashes: int = SENT_HASHES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Two passes over the pages. The first gives every page's distinct subtree hashes; they are counted by (host, hash), the
    host being inside the hash, with partial counts before the shuffle, so a host with a third of all pages is spread over its
    hashes. The template hashes go to the second pass if there are at most sent_hashes of them, else they are joined to
    their pages; the texts are the same either way.

    Null html: empty text. Null url: the host is empty. Repeated rows are counted and returned as they come; an empty table
    gives no rows. Further columns are ignored."""
    spark = prepared(pages.sparkSession)
    base = own(pages, page_id=F.col(key).cast("long"), url=url, html=html)
    keyed = base.withColumn("row_key", F.xxhash64("page_id", "url", "html"))
    seen = keyed.select("row_key", "url", "html").mapInArrow(lean(_hashes), "row_key bigint, host string, codes array<bigint>")
    each = seen.select("row_key", "host", F.explode("codes").alias("code"))
    # the host's size is wanted beside its hashes: a row of its own with no hash
    sizes = own(base, host=F.coalesce(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lit(""))).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = each.groupBy("host", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    template = counts.join(sizes, "host").where(F.col("n") >= MIN_SHARE * F.col("pages")).select("code").distinct()
    template = stored(template)
    schema = "page_id bigint, url string, text string, n_chars bigint"
    if template.count() <= sent_hashes:
        sent = np.array([r[0] for r in template.collect()], np.int64)
        discard(template)
        return base.mapInArrow(lean(_extractor(sent)), schema)
    mine = each.join(template, "code").groupBy("row_key").agg(F.collect_set("code").alias("codes"))
    return keyed.join(mine, "row_key", "left").select("page_id", "url", "html", "codes").mapInArrow(lean(_extractor(None)), schema)


def op1_html(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
