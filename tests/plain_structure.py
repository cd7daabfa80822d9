"""Sections and structural chunks of HTML and Markdown by plain loops, to hold the library's against."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from typing import NamedTuple

from lodestar.functions.text import BOILERPLATE, NOISE_TAGS

#: Elements that begin a line.
BLOCK_TAGS = {
    "address", "article", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "h4", "h5", "h6", "hr", "li",
    "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
FLOOR, CEILING = 120, 450
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Section(NamedTuple):
    level: int
    title: str
    body: str


class Piece(NamedTuple):
    path: tuple[str, ...]
    text: str


def count_tokens(text: str) -> int:
    """Words and single signs; a stand-in for a model's own counter, which may be passed instead."""
    return len(re.findall(r"\w+|[^\w\s]", text))


class _Walker(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.noise, self.heading, self.buffer = 0, 0, []
        self.sections: list[list] = [[0, "", []]]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in NOISE_TAGS:
            self.noise += 1
        elif tag in ("h1", "h2", "h3"):
            self.heading, self.buffer = int(tag[1]), []
        elif tag in BLOCK_TAGS:
            self.sections[-1][2].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in NOISE_TAGS:
            self.noise = max(0, self.noise - 1)
        elif tag in ("h1", "h2", "h3") and self.heading:
            self.sections.append([self.heading, " ".join("".join(self.buffer).split()), []])
            self.heading = 0
        elif tag in BLOCK_TAGS and tag not in _VOID:
            self.sections[-1][2].append("\n")

    def handle_data(self, data: str) -> None:
        if not self.noise:
            (self.buffer if self.heading else self.sections[-1][2]).append(data)


def _tidy(text: str, phrases: tuple[str, ...]) -> str:
    """Lines of over two words or with a sentence's end that are no boilerplate."""
    kept = []
    for line in (" ".join(x.split()) for x in text.split("\n")):
        low = line.lower()
        noise = low.startswith("*") or any(p in low for p in (*phrases, "=" * 8, "<a href", "<center", 'class="'))
        if not noise and (line.count(" ") > 1 or line.endswith((".", "!", "?", ":"))):
            kept.append(line)
    return "\n".join(kept)


def html_sections(html: str, phrases: tuple[str, ...] = BOILERPLATE) -> list[Section]:
    """Sections that h1 to h3 open, from the page's main part: main, else article, else body, else all."""
    parts = (re.search(rf"(?is)<({tag})\b[^>]*>(.*?)</\1\s*>", html) for tag in ("main", "article", "body"))
    walker = _Walker()
    walker.feed(next((m.group(2) for m in parts if m), html))
    walker.close()
    found = [Section(level, title, _tidy("".join(body), phrases)) for level, title, body in walker.sections]
    return [s for s in found if s.title or s.body]


def markdown_sections(text: str) -> list[Section]:
    """Levels 1 to 3, in either heading style, open sections; deeper ones are body without their signs; nothing inside a
    fence is a heading."""
    sections: list[list] = [[0, "", []]]
    fenced, ruler, lines = False, False, text.split("\n")
    for i, line in enumerate(lines):
        fence = re.match(r"\s*(```|~~~)", line)
        fenced ^= bool(fence)
        heading = None if fenced or fence else re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
        under = None if fenced or fence or heading or i + 1 == len(lines) else re.match(r"(=+|-{3,})\s*$", lines[i + 1])
        if ruler:  # the line under a title
            ruler = False
        elif heading and len(heading.group(1)) <= 3:
            sections.append([len(heading.group(1)), heading.group(2), []])
        elif under and line.strip():
            sections.append([1 if lines[i + 1].startswith("=") else 2, line.strip(), []])
            ruler = True
        else:
            sections[-1][2].append(heading.group(2) if heading else line)
    found = [Section(level, title, "\n".join(body).strip()) for level, title, body in sections]
    return [s for s in found if s.title or s.body]


def with_paths(name: str, sections: list[Section]) -> list[Piece]:
    """Breadcrumbs, the document's name always first, of the sections that have a body."""
    stack: list[tuple[int, str]] = []
    out = []
    for s in sections:
        if s.title:
            stack = [(level, title) for level, title in stack if level < s.level] + [(s.level, s.title)]
        if s.body.strip():
            out.append(Piece((name, *(t for _, t in stack)), s.body.strip()))
    return out


def _common(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def merge(pieces: list[Piece], count: Callable[[str], int], floor: int = FLOOR, ceiling: int = CEILING) -> list[Piece]:
    """Neighbours together until the floor is reached; not beyond the ceiling, nor over a change of parent once half the
    floor is there. A section below the last one, or beside it, changes no parent. The merged path is the common one;
    titles that it loses stay in the text."""
    out: list[Piece] = []
    held: list[Piece] = []

    def flush() -> None:
        path = held[0].path
        for p in held[1:]:
            path = path[: _common(path, p.path)]
        lines = [x for p in held for x in (" / ".join(p.path[len(path) :]) if len(held) > 1 else "", p.text) if x]
        out.append(Piece(path, "\n".join(lines)))
        held.clear()

    for piece in pieces:
        if held:
            size = count("\n".join(p.text for p in held))
            moved = _common(held[-1].path, piece.path) < len(held[-1].path) - 1
            if size >= floor or size + count(piece.text) > ceiling or (moved and size >= floor // 2):
                flush()
        held.append(piece)
    if held:
        flush()
    return out


def split(text: str, count: Callable[[str], int], ceiling: int = CEILING) -> list[str]:
    """Paragraphs filled up to the ceiling, each part beginning with the last paragraph of the one before where both fit.
    A paragraph that is too long is cut at lines, and a line at words. No part is over the ceiling."""
    units: list[str] = []
    for paragraph in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if count(paragraph) <= ceiling:
            units += [paragraph] if paragraph else []
            continue
        for line in paragraph.split("\n"):
            words: list[str] = []
            for word in line.split():
                if words and count(" ".join([*words, word])) > ceiling:
                    units.append(" ".join(words))
                    words = []
                words.append(word)
            units += [" ".join(words)] if words else []
    parts: list[list[str]] = []
    for unit in units:
        if parts and count("\n\n".join([*parts[-1], unit])) <= ceiling:
            parts[-1].append(unit)
        elif parts and count("\n\n".join([parts[-1][-1], unit])) <= ceiling:
            parts.append([parts[-1][-1], unit])
        else:
            parts.append([unit])
    return ["\n\n".join(p) for p in parts]


def structural_chunks(name: str, sections: list[Section], count: Callable[[str], int] = count_tokens, ceiling: int = CEILING) -> list[Piece]:
    """Merged and split pieces; the ceiling holds for the breadcrumb and the text together."""
    out = []
    for piece in merge(with_paths(name, sections), count, ceiling=ceiling):
        room = max(1, ceiling - count(" > ".join(piece.path)) - 2)
        out += [Piece(piece.path, part) for part in split(piece.text, count, room)]
    return out
