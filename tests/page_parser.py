"""A page read by the standard library's parser, tag by tag, to hold the library's expressions against."""

from html.parser import HTMLParser

from quarterdeck import fixed_values as V
from quarterdeck.functions.html import CHILDLESS

# --- element names (fixed values) ------------------------------------------
BLOCKS = {"p", "h2", "h3"}
REMOVED = {"script", "style", "aside", "figure", "img"}
NOT_TEXT = {"script", "style", "template", "rt", "rp"}


class _Page(HTMLParser):
    """Hands each text node to every open block element of the body around it."""

    def __init__(self, is_body):
        super().__init__()
        self.is_body = is_body
        self.open = []            # (tag, its block or None)
        self.pending = []
        self.visible = []
        self.blocks = None        # a list from the moment the body is found
        self.body_depth = None    # set while the body is open
        self.removed_depth = None

    def _end_text(self):
        text, self.pending = "".join(self.pending), []
        if not text or any(tag in NOT_TEXT for tag, _ in self.open):
            return
        self.visible.append(text)
        text = text.strip()
        if text and self.removed_depth is None:
            for _, block in self.open:
                if block is not None:
                    block.append(text)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._end_text()

    def handle_decl(self, decl):
        self._end_text()

    def handle_pi(self, data):
        self._end_text()

    def handle_starttag(self, tag, attrs):
        self._end_text()
        block = None
        if self.body_depth is not None and self.removed_depth is None:
            if tag in REMOVED and tag not in CHILDLESS:
                self.removed_depth = len(self.open)
            elif tag in BLOCKS:
                block = []
                self.blocks.append(block)
        if self.blocks is None and self.is_body(dict(attrs)):
            self.blocks = []
            self.body_depth = len(self.open)
        self.open.append((tag, block))
        if tag in CHILDLESS:
            self._cut(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in CHILDLESS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_text()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self._cut(depth)
                return

    def _cut(self, depth):
        del self.open[depth:]
        if self.removed_depth is not None and self.removed_depth >= depth:
            self.removed_depth = None
        if self.body_depth is not None and self.body_depth >= depth:
            self.body_depth = None

    def read(self, html):
        self.feed(html)
        self.close()
        self._end_text()
        return self


def _has_id(attrs):
    return attrs.get("id") == V.TRANSCRIPT_ID


def _has_class(attrs):
    return V.TRANSCRIPT_CLASS in (attrs.get("class") or "")


def read_page(html):
    """(body text or None, visible text) of one page."""
    page = _Page(_has_id).read(html)
    if page.blocks is None:
        page = _Page(_has_class).read(html)
    paragraphs = [text for text in map("".join, page.blocks or []) if text]
    return "\n\n".join(paragraphs) or None, "".join(page.visible)
