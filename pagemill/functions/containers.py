"""Markdown with containers: quotes that hold lists that hold code, line by line.

A fold over the lines of one text keeps a stack of open containers and one open leaf.
Each line first goes through the containers that it continues, then opens new ones, and
what is left of it goes to a leaf. A line that continues only a paragraph, though not
its containers, still belongs to it (a lazy line). Every line is looked at once per
container it stands in, of which there are ``MOST_OPEN`` at most; deeper marks are text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MOST_OPEN = 64
TAB = 4

# --- Fixed values: line shapes of the Markdown block kinds --------------------
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-*+]|(\d{1,9})[.)])(?:( +)(?=\S)| *$)")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
RULE = re.compile(r" {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$")
UNDERLINE = re.compile(r" {0,3}(=+|-+) *$")
DELIMITER = re.compile(r" {0,3}\|? *:?-+:? *(?:\| *:?-+:? *)*\|? *$")
DEFINITION = re.compile(r" {0,3}\[([^\[\]]+)\]: *(?:<[^<>]*>|\S+)(?: +(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))? *$")
REFERENCE = re.compile(r"\[([^\[\]]+)\](?:\[([^\[\]]*)\])?(?!\()")
# ------------------------------------------------------------------------------


@dataclass
class Container:
    indent: int = 0  # of what stands inside an item; 0 for a quote
    ordered: bool | None = None  # None for a quote
    told: bool = False  # whether an item has had its first text

    @property
    def is_quote(self) -> bool:
        return self.ordered is None


@dataclass
class Leaf:
    kind: str  # paragraph, code, table, or fence while it is open
    path: list[Container]
    lines: list[str] = field(default_factory=list)
    fence: str = ""
    language: str = ""
    indent: int = 0


@dataclass
class Block:
    block_type: str
    text: str
    level: int | None = None
    language: str | None = None
    ordered: bool | None = None
    quotes: int = 0
    path: str = ""


class Reader:
    """The fold: :meth:`line` for every line, then :meth:`end`."""

    def __init__(self) -> None:
        self.open: list[Container] = []
        self.leaf: Leaf | None = None
        self.blocks: list[Block] = []
        self.names: set[str] = set()

    def line(self, line: str) -> None:
        rest, matched = line, 0
        for container in self.open:
            after = self._continued(container, rest)
            if after is None:
                break
            rest, matched = after, matched + 1
        inside = matched == len(self.open)
        leaf = self.leaf
        if leaf is not None and leaf.kind == "fence" and inside:
            self._fenced(leaf, rest)
            return
        opened = self._opened(rest, matched, leaf if inside else None)
        if opened is not None:
            rest, leaf = opened, None
            inside = True
        elif not inside and leaf is not None and leaf.kind == "paragraph" and rest.strip() and not self._starts(rest):
            leaf.lines.append(rest)
            return
        elif not inside:
            self._close(matched)
            leaf = None
        self._to_leaf(rest, leaf)

    def end(self) -> list[Block]:
        self._close(0)
        return [b for b in self.blocks if b.block_type in ("code", "table", "heading") or b.text.strip()]

    def _continued(self, container: Container, line: str) -> str | None:
        """What is left of a line inside a container, None if it doesn't continue it."""
        if container.is_quote:
            mark = QUOTE.match(line)
            return line[mark.end() :] if mark else None
        if not line.strip():
            return line
        return line[container.indent :] if len(line) - len(line.lstrip(" ")) >= container.indent else None

    def _opened(self, rest: str, matched: int, leaf: Leaf | None) -> str | None:
        """What is left of a line after the containers that it opens, None if it opens none."""
        opened = False
        while len(self.open) < MOST_OPEN or matched < len(self.open):
            paragraph = leaf is not None and leaf.kind == "paragraph"
            quote = QUOTE.match(rest)
            item = None if quote or RULE.match(rest) else ITEM.match(rest)
            if item and paragraph and (not item[4] or item[3] not in (None, "1")):
                item = None  # only an item with text, and the first of a numbered list, ends a paragraph
            if not quote and not item:
                break
            self._close(matched)
            if quote:
                self.open.append(Container())
                rest = rest[quote.end() :]
            else:
                blanks = item[4] or " "
                extra = len(blanks) if len(blanks) <= 4 else 1
                indent = len(item[1]) + len(item[2]) + extra
                self.open.append(Container(indent, item[3] is not None))
                rest = rest[indent:]
            matched, leaf, opened = len(self.open), None, True
        return rest if opened else None

    def _starts(self, line: str) -> bool:
        return bool(HEADING.match(line) or FENCE.match(line) or RULE.match(line))

    def _to_leaf(self, line: str, leaf: Leaf | None) -> None:
        if not line.strip():
            if leaf is not None and leaf.kind == "code":
                leaf.lines.append(line[TAB:])
            else:
                self._finish()
            return
        if leaf is not None and leaf.kind == "paragraph":
            under = UNDERLINE.match(line)
            if under:
                self._told("heading", leaf, level=1 if under[1][0] == "=" else 2)
                self.leaf = None
                return
            if len(leaf.lines) == 1 and "|" in leaf.lines[0] and DELIMITER.match(line) and _cells(leaf.lines[0]) == _cells(line):
                leaf.kind = "table"
                leaf.lines.append(line)
                return
        if leaf is not None and leaf.kind == "table" and not self._starts(line) and "|" in line:
            leaf.lines.append(line)
            return
        heading, fence = HEADING.match(line), FENCE.match(line)
        if heading:
            self._finish()
            self.blocks.append(self._block("heading", (heading[2] or "").strip(), self.open, level=len(heading[1])))
        elif fence and not (fence[1][0] == "`" and "`" in fence[2]):
            self._finish()
            indent = len(line) - len(line.lstrip(" "))
            self.leaf = Leaf("fence", list(self.open), fence=fence[1], language=fence[2].strip(), indent=indent)
        elif RULE.match(line):
            self._finish()
        elif line.startswith(" " * TAB) and (leaf is None or leaf.kind == "code"):
            if leaf is None:
                self._finish()
                self.leaf = leaf = Leaf("code", list(self.open))
            leaf.lines.append(line[TAB:])
        else:
            if leaf is None or leaf.kind != "paragraph":
                self._finish()
                self.leaf = Leaf("paragraph", list(self.open))
            self.leaf.lines.append(line)

    def _fenced(self, leaf: Leaf, line: str) -> None:
        bare = line.strip(" ")
        if len(bare) >= len(leaf.fence) and not bare.strip(leaf.fence[0]) and len(line) - len(line.lstrip(" ")) < TAB:
            self._finish()
        else:
            blanks = len(line) - len(line.lstrip(" "))
            leaf.lines.append(line[min(blanks, leaf.indent) :])

    def _close(self, matched: int) -> None:
        """End the leaf, and the containers after the first ``matched``."""
        self._finish()
        del self.open[matched:]

    def _finish(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf.kind == "fence":
            self.blocks.append(self._block("code", "\n".join(leaf.lines), leaf.path, language=leaf.language or "unknown"))
        elif leaf.kind == "code":
            self.blocks.append(self._block("code", "\n".join(leaf.lines).rstrip(" \n"), leaf.path, language="unknown"))
        elif leaf.kind == "table":
            self.blocks.append(self._block("table", "\n".join(leaf.lines), leaf.path))
        else:
            self._told("paragraph", leaf)

    def _told(self, kind: str, leaf: Leaf, level: int | None = None) -> None:
        """A paragraph without the definitions that it begins with; an item's first one is the item's text."""
        lines = leaf.lines
        while lines and (definition := DEFINITION.match(lines[0])):
            self.names.add(_name(definition[1]))
            lines = lines[1:]
        if not lines:
            return
        item = leaf.path[-1] if leaf.path and not leaf.path[-1].is_quote else None
        block = self._block(kind, "\n".join(lines), leaf.path, level=level)
        if kind == "paragraph" and item is not None and not item.told:
            block.block_type, block.ordered = "list_item", item.ordered
            block.level = sum(not c.is_quote for c in leaf.path)
        if item is not None:
            item.told = True
        self.blocks.append(block)

    def _block(self, kind: str, text: str, path: list[Container], **more: object) -> Block:
        signs = "".join("q" if c.is_quote else "o" if c.ordered else "u" for c in path)
        return Block(kind, text, quotes=signs.count("q"), path=signs, **more)


def _cells(line: str) -> int:
    return len(re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|")))


def _name(label: str) -> str:
    return " ".join(label.split()).casefold()


def parse(text: str) -> list[Block]:
    """Blocks of a text in document order; what refers to a definition reads as an inline link."""
    reader = Reader()
    for line in re.split(r"\r\n?|\n", text):
        lead = line[: len(line) - len(line.lstrip(" \t"))]
        reader.line(lead.expandtabs(TAB) + line[len(lead) :] if "\t" in lead else line)
    blocks = reader.end()
    if reader.names:
        for block in blocks:
            if block.block_type != "code" and "[" in block.text:
                block.text = REFERENCE.sub(lambda m: f"[{m[1]}](#)" if _name(m[2] or m[1]) in reader.names else m[0], block.text)
    return blocks
