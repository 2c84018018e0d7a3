"""Zip containers, opened with care."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

#: What no honest document packs.
MEMBER_BYTES, MEMBER_RATIO, TOTAL_BYTES = 10 << 20, 200, 400 << 20
#: What declares an entity, and bytes of a member that are searched at once.
ENTITY, PIECE = b"<!ENTITY", 1 << 16


class Unreadable(ValueError):
    """A file that can't be read, with the reason."""


class Archive:
    """A zip file that is refused where it unpacks to too much."""

    def __init__(self, content: bytes):
        try:
            self._zip = zipfile.ZipFile(io.BytesIO(content))
            infos = self._zip.infolist()
        except Exception as e:
            raise Unreadable(f"not a zip file: {e}") from e
        if sum(i.file_size for i in infos) > TOTAL_BYTES:
            raise Unreadable("unpacks to too much")
        if any(i.file_size > MEMBER_BYTES and i.file_size > MEMBER_RATIO * max(1, i.compress_size) for i in infos):
            raise Unreadable("a member unpacks to too much")
        self.names = [i.filename for i in infos]

    def bytes(self, name: str) -> bytes:
        return self._zip.read(name)

    def text(self, name: str) -> str:
        return self.bytes(name).decode("utf-8", "ignore")

    def matching(self, pattern: str) -> list[str]:
        """Members whose name matches, by the numbers in it."""
        found = [n for n in self.names if re.fullmatch(pattern, n)]
        return sorted(found, key=lambda n: ([int(x) for x in re.findall(r"\d+", n)], n))

    def xml(self, name: str) -> ElementTree.Element | None:
        """The tree of a member; None where it is missing. Names lose their namespaces; entity declarations are refused."""
        if name not in self.names:
            return None
        return tree(self.bytes(name))

    def _events(self, name: str) -> Iterator[tuple[str, ElementTree.Element, list]]:
        """(start or end, element, the elements around it) as a member is unpacked. Names lose their namespaces; document type declarations are refused."""
        if name not in self.names:
            return
        with self._zip.open(name) as member:
            if b"<!DOCTYPE" in member.peek(4096)[:4096]:
                raise Unreadable("declares a document type")
            around: list[ElementTree.Element] = []
            try:
                for event, node in ElementTree.iterparse(member, ("start", "end")):
                    if event == "start":
                        node.tag = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
                        node.attrib = {k.rpartition("}")[2]: v for k, v in node.attrib.items()}
                        yield event, node, around
                        around.append(node)
                    else:
                        around.pop()
                        yield event, node, around
            except ElementTree.ParseError as e:
                raise Unreadable(f"malformed XML: {e}") from e

    def refuse_declared(self, name: str) -> None:
        """Refuse a member as a tree of it would be, read in pieces."""
        with self._zip.open(name) as member:
            piece = member.read(PIECE)
            if _declares_type(piece):
                raise Unreadable("declares entities")
            end = b""
            while piece:
                if ENTITY in end + piece:
                    raise Unreadable("declares entities")
                end, piece = piece[1 - len(ENTITY) :], member.read(PIECE)

    def elements(self, name: str, tag: str, beside: tuple[str, ...] = ()) -> Iterator[ElementTree.Element]:
        """The elements of one tag, one at a time; each is let go when the next is asked for. Those of the tags ``beside`` it come as they end, and stay."""
        for event, node, around in self._events(name):
            if event == "end" and node.tag == tag:
                yield node
                if around:
                    around[-1].clear()
            elif event == "end" and node.tag in beside:
                yield node

    def attribute_of(self, name: str, tag: str, attribute: str) -> list[str]:
        """An attribute of every element of one tag; what is inside them is let go."""
        found = []
        for event, node, around in self._events(name):
            if event == "start" and node.tag == tag:
                found.append(node.get(attribute) or "")
            elif event == "end" and any(x.tag == tag for x in around):
                around[-1].clear()
        return found

    def sheet_rows(self, name: str, number: int) -> Iterator[ElementTree.Element]:
        """The rows of the table of that number, from 0."""
        at = -1
        for event, node, around in self._events(name):
            if event == "start":
                at += node.tag == "table"
            elif node.tag == "table-row":
                if at == number:
                    yield node
                around[-1].clear()


def _declares_type(raw: bytes) -> bool:
    """Whether a part's beginning declares a document type with rules of its own."""
    return b"<!DOCTYPE" in raw[:2048] and b"[" in raw[:4096].partition(b"<!DOCTYPE")[2].partition(b">")[0]


def tree(raw: bytes) -> ElementTree.Element:
    if ENTITY in raw or _declares_type(raw):
        raise Unreadable("declares entities")
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise Unreadable(f"malformed XML: {e}") from e
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
        node.attrib = {k.rpartition("}")[2]: v for k, v in node.attrib.items()}
    return root


def all_text(node: ElementTree.Element | None, glue: str = "") -> str:
    return glue.join(node.itertext()) if node is not None else ""
