"""Pages as sequences of leaf blocks, and what a labeller may know of each."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the HTML syntax.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe".split())
#: Of these, the content is no markup, so that without an end tag it reaches to the end of the page.
CODE = frozenset({"script", "style"})
#: What these hold flows with the text around them, whatever its tags.
FOREIGN = frozenset({"svg", "math"})
#: Leaves of formulas.
SYMBOLS = frozenset("mi mn mo ms mtext annotation".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img input ins kbd label mark meter object output q rp rt ruby s samp select small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "p": frozenset({"p"}), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
#: A paragraph ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
#: Elements that an implied end doesn't reach beyond.
SCOPE = frozenset("ul ol dl table div article section main aside nav header footer form body blockquote".split())

#: Comments, declarations and tags. A tag with a quote that nothing closes ends at the first ``>``.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
#: Ends of raw elements; a template may hold others.
ENDS = {tag: re.compile(rf"<(/{'?' if tag == 'template' else ''}){tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

PATH_BUCKETS = WORD_BUCKETS = 1 << 12
NUMBERS = 14


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]
    linked: int
    links: int


@dataclass
class Open:
    tag: str
    names: tuple[str, ...] = field(default=())
    inline: bool = False
    foreign: bool = False


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag with the words of its class, id and role."""
    found = [tag]
    if "=" in attributes:
        for m in NAMED.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            found += [f"{m[1].lower()}:{w}" for w in PARTS.findall(CAMEL.sub(" ", value).lower())]
    return tuple(found)


def raw_end(page: str, tag: str, at: int) -> int | None:
    """Where a raw element ends whose content begins at ``at``; None if it has no end tag."""
    depth, last = 1, None
    for m in ENDS[tag].finditer(page, at):
        depth += -1 if m[1] else 1
        if m[1]:
            last = m.end()
            if not depth:
                break
    if last is None:
        return None
    close = page.find(">", last)
    return close + 1 if close >= 0 else len(page)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: runs of text that no block element interrupts, with references decoded and white space folded.

    Markup may be broken: end tags without a beginning are passed over, elements left open end with what holds them.
    Scripts, styles, frames and templates have no text, and what looks like markup in them is none; a script or
    style without an end tag reaches to the end of the page, as in browsers, while such a frame, noscript or
    template is passed over and what follows is kept. The text of formulas, drawings, canvases and objects counts,
    and doesn't part the block that holds it.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[Open] = []
    pieces: list[str] = []
    anchor = linked = links = 0
    at, unended = 0, set()

    def flush() -> None:
        nonlocal linked, links
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(text, tuple(o.names for o in stack if not o.inline), linked, links))
        pieces.clear()
        linked = links = 0

    while m := TOKEN.search(page, at):
        start, end = m.span()
        if start > at:
            piece = html.unescape(page[at:start])
            pieces.append(piece)
            if anchor:
                linked += len(piece.strip())
        at = end
        if m[2] is None:
            continue
        tag = m[2].lower()
        within = bool(stack) and stack[-1].foreign
        inline = tag in INLINE or tag in FOREIGN or (within and tag not in ENDS_P and tag not in CLOSES and tag not in SCOPE)
        if m[1]:
            if not inline:
                flush()
            elif tag == "a" and anchor:
                anchor -= 1
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    if not inline:
                        anchor = 0
                    del stack[i:]
                    break
                if inline and not stack[i].inline:
                    break
            if within and tag not in SYMBOLS and not tag.startswith("m"):
                pieces.append(" ")
            continue
        if tag in RAW:
            pieces.append(" ")
            if not m[3].rstrip().endswith("/") and tag not in unended:
                # what is inside is no markup; only the end tag counts
                closed = raw_end(page, tag, end)
                if closed is not None:
                    at = closed
                elif tag in CODE:
                    at = len(page)
                else:
                    unended.add(tag)
            continue
        if inline:
            if tag in ("br", "svg", "object", "canvas") or tag in SYMBOLS or (within and not tag.startswith("m")):
                pieces.append(" ")
            elif tag == "a":
                anchor += 1
                links += 1
        else:
            flush()
            anchor = 0
            while stack and stack[-1].foreign:
                stack.pop()
            ends = CLOSES.get(tag, frozenset({"p"}) if tag in ENDS_P else frozenset())
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in ends:
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE:
                        break
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(Open(tag, names_of(tag, m[3]), inline, inline and (within or tag in FOREIGN)))
        elif tag in VOID and not inline:
            flush()
    pieces.append(html.unescape(page[at:]))
    flush()
    return out


def path_ids(path: tuple[tuple[str, ...], ...]) -> list[int]:
    """Buckets of a tag path: the names of each element, of its last three with their height, and the path of tags."""
    found = {zlib.crc32(n.encode()) % PATH_BUCKETS for names in path for n in names}
    for height, names in enumerate(reversed(path[-3:])):
        found.update(zlib.crc32(f"{height}/{n}".encode()) % PATH_BUCKETS for n in names)
    found.add(zlib.crc32(">".join(names[0] for names in path[-4:]).encode()) % PATH_BUCKETS)
    return sorted(found)


def word_ids(text: str) -> list[int]:
    return [zlib.crc32(w) % WORD_BUCKETS for w in text.lower().encode().split()]


def numbers(block: Block, i: int, n: int, seen: int, total: int) -> list[float]:
    """What the words don't tell: length, links, punctuation, place in the page."""
    text = block.text
    size = len(text)
    tags = [names[0] for names in block.path]
    last = tags[-1] if tags else ""
    return [
        np.log1p(size) / 7, np.log1p(text.count(" ") + 1) / 5, min(1.0, block.linked / size), min(1.0, block.links / 5), sum(map(text.count, ".!?")) / (1 + size / 60), text.count(",") / (1 + size / 60),
        float(text[-1] in ".!?\"'»”"), i / max(1, n - 1), seen / max(1, total), len(tags) / 12, float(last in ("h1", "h2", "h3", "h4", "h5", "h6")), float(last in ("li", "dd", "dt")), float(last == "p"), float("©" in text or "copyright" in text.lower()),
    ]


def describe(page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """Path buckets, word buckets and numbers of each block."""
    total, seen, values, known = sum(len(b.text) for b in page), 0, [], {}
    for i, b in enumerate(page):
        values.append(numbers(b, i, len(page), seen, total))
        seen += len(b.text)
    paths = [known[b.path] if b.path in known else known.setdefault(b.path, path_ids(b.path)) for b in page]
    return paths, [word_ids(b.text) for b in page], np.array(values, dtype=np.float32).reshape(len(page), NUMBERS)
