"""Main text of an HTML page, by a pass over its tags."""
from __future__ import annotations

from html.parser import HTMLParser

# Parts of a page that hold no article text, and containers in the order of preference.
PAGE_NOISE = ("script", "style", "nav", "header", "footer", "aside")
CONTAINER_CLASSES = ("article-content", "article-body", "story-body", "content-body", "entry-content")
#: Elements that end an open paragraph, as in HTML.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def container_ranks(tag: str, attributes: dict[str, str]) -> list[int]:
    """Which of the preferred containers the element is; smaller is better, body comes last."""
    classes = attributes.get("class", "")
    tests = [tag == "article", *[c in classes for c in CONTAINER_CLASSES], attributes.get("itemprop") == "articleBody", tag == "main",
             attributes.get("role") == "main", "content" in classes.split(), attributes.get("id") == "content", tag == "body"]
    return [k for k, ok in enumerate(tests) if ok]


class MainText(HTMLParser):
    """Collects paragraphs with the containers they stand in.

    The container is the first element of the best kind that the page has.  A paragraph ends at its
    closing tag, where another block opens, or with the element it stands in.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.noise = 0
        self.first: dict[int, int] = {}  # kind -> depth at which its first element is open, or -1 once closed
        self.paragraphs: list[tuple[set[int], list[str]]] = []
        self.reading: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.handle_endtag("p")
        if tag in VOID:
            return
        self.open.append(tag)
        if tag in PAGE_NOISE:
            self.noise += 1
        if self.noise:
            return
        for kind in container_ranks(tag, {k: v or "" for k, v in attrs}):
            self.first.setdefault(kind, len(self.open))
        if tag == "p":
            self.reading = []
            self.paragraphs.append(({k for k, depth in self.first.items() if depth > 0}, self.reading))

    def handle_startendtag(self, tag, attrs):
        if tag == "p":
            self.handle_endtag("p")

    def handle_endtag(self, tag):
        if tag not in self.open or tag == "p" and not self.within_reach("p"):
            return
        while True:
            depth, last = len(self.open), self.open.pop()
            if last in PAGE_NOISE:
                self.noise -= 1
            if last == "p":
                self.reading = None
            for kind, at in self.first.items():
                if at == depth:
                    self.first[kind] = -1
            if last == tag:
                return

    def within_reach(self, tag: str) -> bool:
        """A paragraph is only closed from inside its own noise-free or noisy part."""
        for name in reversed(self.open):
            if name == tag:
                return True
            if name in PAGE_NOISE:
                return False
        return False

    def handle_data(self, data):
        if self.reading is not None and not self.noise:
            self.reading.append(data)


def main_text(html: str | None, minimum: int = 100) -> str | None:
    """Paragraphs of the main container, blanks collapsed; None unless longer than `minimum`."""
    if html is None:
        return None
    page = MainText()
    page.feed(html)
    page.close()
    best = min(page.first, default=None)
    texts = (" ".join("".join(parts).split()) for inside, parts in page.paragraphs if best is None or best in inside)
    text = " ".join(t for t in texts if t)
    return text if len(text) > minimum else None
