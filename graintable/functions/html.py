"""HTML to Markdown with the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .slices import sliced

BLOCKS = {"p", "div", "section", "article", "header", "footer", "nav", "table", "tr", "ul", "ol", "blockquote", "main", "aside", "form", "figure", "pre"}
SILENT = {"script", "style", "template", "noscript"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0
        self.lists: list[list] = []  # kind and last number
        self.links: list[str | None] = []

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag in MARKS:
            self.out.append(MARKS[tag])
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.out.append("[" if self.links[-1] else "")
        elif tag in BLOCKS:
            self.out.append("\n\n")
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n\n")
        elif tag in MARKS:
            self.out.append(MARKS[tag])
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str | None:
    """Markdown of an HTML text: # headings, links, lists, bold, italics and breaks. Scripts and styles are left out; plain text stays."""
    if html is None:
        return None
    writer = _Writer()
    writer.feed(html)
    writer.close()
    text = re.sub(r"[ \t]+\n(?!\n)", lambda m: "  \n" if m[0].startswith("  ") else "\n", "".join(writer.out))
    text = re.sub(r"\n[ \t]+(?=[^\s*\d])", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n\s+\n", "\n\n", text)).strip()


html_to_markdown = sliced(to_markdown, "string")
