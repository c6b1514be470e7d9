"""Page parsing: a small per-row tokenizer helper and the JVM-native fast form.

The per-row helper walks the tag stream of Python's ``html.parser`` keeping a
stack of open elements, and records *direct* text nodes of the selected tags
plus every ``a[href]``.  It is used inside ``mapInPandas`` jobs only.

Recovery rules for broken markup: void elements never open; a start tag of a
block or heading element (or another ``p``) closes an open ``p`` and every
element opened after it; an end tag closes the nearest matching open element
and everything above it, and is ignored when nothing matches.  Text directly
inside an element is one node until a tag or comment interrupts it.
"""
from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: elements that never hold children
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: start tags that implicitly close an open <p>
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section "
    "table ul".split())
# fixed values: selected tags, in the order their text is concatenated
SELECTED = ("title", "p", "h1", "h2", "h3", "h4", "h5", "h6")


class _Collector(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.nodes: dict[str, list[str]] = {t: [] for t in SELECTED}
        self.hrefs: list[str] = []
        self._buf: list[str] = []

    def _flush(self):
        if self._buf:
            text = "".join(self._buf)
            self._buf = []
            if self.stack and self.stack[-1] in self.nodes:
                self.nodes[self.stack[-1]].append(text)

    def _close_to(self, tag: str) -> bool:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] == tag:
                del self.stack[i:]
                return True
        return False

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag == "a":
            for k, v in attrs:
                if k == "href":
                    self.hrefs.append(v if v is not None else "")
                    break
        if tag in CLOSES_P and "p" in self.stack:
            self._close_to("p")
        if tag not in VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1] == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        self._flush()
        self._close_to(tag)

    def handle_comment(self, data):
        self._flush()

    def handle_data(self, data):
        self._buf.append(data)

    def close(self):
        super().close()
        self._flush()


def parse_html(html: str) -> tuple[dict[str, list[str]], list[str]]:
    """Direct text nodes per selected tag (document order) and all hrefs."""
    c = _Collector()
    c.feed(html)
    c.close()
    return c.nodes, c.hrefs


def page_text_from_nodes(nodes: dict[str, list[str]]) -> str:
    """Selected nodes in selector order, stripped, empties dropped, space-joined."""
    parts = (t.strip() for tag in SELECTED for t in nodes[tag])
    return " ".join(p for p in parts if p)


# ----------------------------------------------------------------- native form
# fixed values: character references decoded by the native form, as regex
# patterns (the named ones are HTML5 legacy names, valid without ';'), &amp last
NATIVE_ENTITIES = [("&quot;?", '"'), ("&#39;", "'"), ("&lt;?", "<"), ("&gt;?", ">"),
                   ("&nbsp;?", "\u00a0"), ("&copy;?", "\u00a9"), ("&middot;?", "\u00b7"),
                   ("&amp;?", "&")]
RAW_BLOCKS = "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"


def strip_raw_blocks(html: Column) -> Column:
    return F.regexp_replace(html, RAW_BLOCKS, "")


def decode_entities(c: Column) -> Column:
    """Decode the references of ``NATIVE_ENTITIES`` once each, left to right
    (``&amp;lt;`` -> ``&lt;``), with or without the closing ``;``."""
    for pattern, ch in NATIVE_ENTITIES:
        c = F.regexp_replace(c, pattern, ch)
    return c


def native_nodes(clean_html: Column, tag: str) -> Column:
    """Text right after each ``<tag>`` start, up to the next tag (flat markup)."""
    return F.transform(
        F.regexp_extract_all(clean_html, F.lit(f"<{tag}(?:\\s[^>]*)?>([^<]*)"), 1),
        decode_entities)


def native_hrefs(clean_html: Column) -> Column:
    return F.regexp_extract_all(clean_html, F.lit('<a\\s[^>]*href="([^"]*)"'), 1)
