"""Files to pages of text. XML-based formats are read as trees, not as strings."""

from __future__ import annotations

import email
import email.policy
import json
import posixpath
import re
from collections.abc import Callable
from xml.etree.ElementTree import Element

from tarn.sources.archive import Archive, Unreadable, all_text, tree
from tarn.sources.html import reading_text, tidy
from tarn.sources.sheets import Workbook, decode, delimited_rows

Pages = list[tuple[int, str]]


def parse_text(content: bytes, name: str = "") -> Pages:
    """Pages by form feed, else by ``[page N]`` lines, else one."""
    text = decode(content)
    if "\f" in text:
        return [(i, tidy(t)) for i, t in enumerate(text.split("\f"), 1)]
    marked = re.split(r"(?im)^\s*\[page\s+(\d+)\]\s*$", text)
    return [(int(n), tidy(t)) for n, t in zip(marked[1::2], marked[2::2], strict=True)] or [(1, tidy(text))]


def _single(text: str) -> str:
    """The text with single blanks, indents included, and one empty line at most in a row."""
    lines = re.sub(r"[ \t\xa0]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def _page_number(given, place: int) -> int:
    """The number that a page says it has; its place where it says none, or nothing that is a number."""
    try:
        return int(given) if given is not None else place
    except (TypeError, ValueError):
        return place


def parse_json(content: bytes, name: str = "") -> Pages:
    try:
        data = json.loads(content.decode("utf-8", "ignore"))
    except ValueError as e:
        raise Unreadable(f"invalid JSON: {e}") from e
    if isinstance(data, dict) and isinstance(data.get("pages"), list):
        pages = [p if isinstance(p, dict) else {"text": p} for p in data["pages"]]
        return [(_page_number(p.get("page"), i), _single(str(p.get("text", "")))) for i, p in enumerate(pages, 1)]
    return [(1, _single(json.dumps(data, ensure_ascii=False, indent=2)))]


def parse_csv(content: bytes, name: str = "") -> Pages:
    rows = (f"baris {i}: " + " | ".join(c.strip() for c in r) for i, r in enumerate(delimited_rows(content), 1) if any(c.strip() for c in r))
    return [(1, tidy("\n".join(rows)))]


def parse_xml(content: bytes, name: str = "") -> Pages:
    text = re.sub(r"(?s)<!--.*?-->|<\?.*?\?>|<[^>]+>", " ", decode(content))
    import html

    return [(1, tidy(html.unescape(text)))]


def parse_html(content: bytes, name: str = "") -> Pages:
    raw = decode(content)
    text, found = reading_text(raw), re.search(r"(?is)<title[^>]*>(.*?)</title>", raw)
    title = reading_text(found.group(1))[:120] if found else ""
    title = title or name
    return [(1, text if not title or text.lower().startswith(title.lower()[:40]) else f"{title}\n{text}")]


def _word_text(root: Element) -> str:
    """A Word part: a line per paragraph, a line per table row with its cells parted by bars."""
    lines: list[str] = []

    def inline(node: Element) -> str:
        out = []
        for x in node.iter():
            if x.tag == "t":
                out.append(x.text or "")
            elif x.tag in ("tab", "ptab"):
                out.append("\t")
            elif x.tag == "br":
                out.append("\n")
        return "".join(out)

    def walk(node: Element) -> None:
        for x in node:
            if x.tag == "p":
                lines.append(inline(x))
            elif x.tag == "tr":
                cells = [" ".join(inline(p).strip() for p in c.iter("p")).strip() for c in x if c.tag == "tc"]
                lines.append(re.sub(r"( \| )*\s*$", "", " | ".join(cells)))
            else:
                walk(x)

    walk(root)
    return tidy("\n".join(lines))


WORD_PARTS = [("header", "Header"), ("footer", "Footer"), ("footnotes", "Catatan kaki"), ("endnotes", "Catatan akhir"), ("comments", "Komentar")]
PROPERTIES = ["title", "subject", "creator", "description", "keywords", "lastModifiedBy"]


def parse_docx(content: bytes, name: str = "") -> Pages:
    a = Archive(content)
    body = a.xml("word/document.xml")
    if body is None:
        raise Unreadable("no document part")
    parts = [_word_text(body)]
    for stem, label in WORD_PARTS:
        for member in a.matching(rf"word/{stem}\d*\.xml"):
            if text := _word_text(a.xml(member)):
                number = re.sub(r"\D", "", posixpath.basename(member))
                parts.append(f"[{label}{number}]\n{text}")
    if (core := a.xml("docProps/core.xml")) is not None:
        values = [(x.tag, all_text(x).strip()) for x in core]
        if lines := [f"{tag}: {v}" for wanted in PROPERTIES for tag, v in values if tag == wanted and v]:
            parts.append("[Properti dokumen]\n" + "\n".join(lines))
    return [(i, p) for i, p in enumerate([p for p in parts if p], 1)]


def _drawing_text(root: Element) -> str:
    return tidy("\n".join("".join(all_text(t) for t in p.iter("t")) for p in root.iter("p")))


def parse_pptx(content: bytes, name: str = "") -> Pages:
    a = Archive(content)
    notes = {re.sub(r"\D", "", posixpath.basename(n)): n for n in a.matching(r"ppt/notesSlides/notesSlide\d+\.xml")}
    pages = []
    for i, member in enumerate(a.matching(r"ppt/slides/slide\d+\.xml"), 1):
        text = _drawing_text(a.xml(member))
        note = notes.get(re.sub(r"\D", "", posixpath.basename(member)))
        if note and (spoken := _drawing_text(a.xml(note))):
            text += f"\n\nCatatan pembicara: {spoken}"
        pages.append((i, text))
    fixed = []
    for kind, label in (("slideMaster", "Master slide"), ("slideLayout", "Tata letak slide")):
        for member in a.matching(rf"ppt/{kind}s/{kind}\d+\.xml"):
            if text := _drawing_text(a.xml(member)):
                fixed.append(f"[{label} {posixpath.basename(member)[:-4]}] {text}")
    return pages + ([(len(pages) + 1, "\n".join(fixed))] if fixed else [])


def parse_xlsx(content: bytes, name: str = "") -> Pages:
    book, pages = Workbook.open(content), []
    for number, (title, path) in enumerate(book.sheets, 1):
        lines = [title] if title else []
        edges: dict[str, list[str]] = {"oddHeader": [], "oddFooter": []}
        for row, cells in book.rows(path, edges):
            if cells:
                lines.append(f"baris {row}: " + " | ".join(f"{_letters(c)}={tidy(v)}" for c, v in sorted(cells.items())))
        lines += _sheet_extras(book.archive, path, edges)
        pages.append((number, "\n".join(lines)))
    return pages


def _letters(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet_extras(a: Archive, path: str, edges: dict[str, list[str]]) -> list[str]:
    """What a sheet prints at its edges, its comments, and the text of its drawings."""
    out = []
    a.refuse_declared(path)
    for edge, printed in edges.items():
        for x in printed:
            if text := re.sub(r"&[LCRPNDTAFG]|&\"[^\"]*\"|&\d+", " ", x).strip():
                out.append(f"{'Header' if 'Header' in edge else 'Footer'} cetak: {' '.join(text.split())}")
    folder, base = posixpath.split(path)
    rels = a.xml(f"{folder}/_rels/{base}.rels")
    for r in rels.iter("Relationship") if rels is not None else []:
        target = r.get("Target", "")
        member = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
        label = {"comments": "Komentar sel", "drawing": "Teks pada gambar/objek"}.get(re.sub(r"\d*\.xml$", "", posixpath.basename(member)).lower())
        if label and (part := a.xml(member)) is not None:
            if texts := [t for t in (tidy(all_text(x)) for x in part.iter("t")) if t]:
                out.append(f"{label}: " + " / ".join(texts))
    return out


def parse_odf(content: bytes, name: str = "") -> Pages:
    a = Archive(content)
    root = a.xml("content.xml")
    if root is None:
        raise Unreadable("no content part")
    lines: list[str] = []

    def walk(node: Element) -> None:
        for x in node:
            if x.tag == "table-row":
                cells = [" ".join(all_text(p) for p in c.iter("p")).strip() or c.get("date-value") or c.get("value") or "" for c in x if c.tag == "table-cell"]
                lines.append(" | ".join(c for c in cells if c))
            elif x.tag in ("p", "h"):
                lines.append(all_text(x))
            else:
                walk(x)

    walk(root)
    parts = [tidy("\n".join(lines))]
    if (styles := a.xml("styles.xml")) is not None:
        parts += [f"[{label}] {text}" for tag, label in (("header", "Header"), ("footer", "Footer")) for x in styles.iter(tag) if (text := tidy(all_text(x, " ")))]
    if (meta := a.xml("meta.xml")) is not None:
        found = [f"{x.tag}: {all_text(x).strip()}" for x in meta.iter() if x.tag in ("title", "subject", "creator", "description", "keyword", "generator") and all_text(x).strip()]
        parts += ["[Properti dokumen] " + "; ".join(found)] if found else []
    return [(i, p) for i, p in enumerate([p for p in parts if p], 1)]


def parse_epub(content: bytes, name: str = "") -> Pages:
    a = Archive(content)
    container = a.xml("META-INF/container.xml")
    opf = next((x.get("full-path") for x in container.iter("rootfile")), None) if container is not None else None
    chapters: list[str] = []
    if opf and (root := a.xml(opf)) is not None:
        items = {x.get("id"): x for x in root.iter("item")}
        for ref in root.iter("itemref"):
            item = items.get(ref.get("idref"))
            if item is None or "nav" in (item.get("properties") or "").split():
                continue
            path = posixpath.normpath(posixpath.join(posixpath.dirname(opf), item.get("href", "")))
            if path in a.names and posixpath.basename(path).lower() not in ("nav.xhtml", "toc.xhtml", "toc.ncx"):
                chapters.append(path)
    chapters = chapters or sorted(n for n in a.names if n.lower().endswith((".xhtml", ".html", ".htm")))
    return [(i, reading_text(a.text(c))) for i, c in enumerate(chapters, 1)]


#: RTF control words that stand for text, and groups that hold none.
RTF_TEXT = {
    "par": "\n", "line": "\n", "sect": "\n", "row": "\n", "cell": " | ", "tab": "\t", "page": "\f", "emdash": "—", "endash": "–", "emspace": " ",
    "enspace": " ", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”",
}
RTF_SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "themedata", "datastore"}
_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.S)


def parse_rtf(content: bytes, name: str = "") -> Pages:
    """One pass with a stack of groups; silent groups, and those marked ``*``, give no text."""
    out: list[str] = []
    silent, stack, skip = False, [], 0
    for code, word, number, sign, brace, text in _RTF.findall(content.decode("latin-1")):
        if brace == "{":
            stack.append(silent)
        elif brace:
            silent = stack.pop() if stack else False
        elif word and word.lower() in RTF_SILENT or sign == "*":
            silent = True
        elif silent:
            continue
        elif code:
            if skip:
                skip -= 1
            else:
                out.append(bytes([int(code, 16)]).decode("cp1252", "ignore"))
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip = 1
        elif word:
            low = word.lower()
            glued = next((k for k in sorted(RTF_TEXT, key=len, reverse=True) if word.startswith(k) and word[len(k) :][:1].isupper()), None)
            if low in RTF_TEXT and not number:
                out.append(RTF_TEXT[low])
            elif glued and not number:  # text that follows a control word without a blank
                out.append(RTF_TEXT[glued] + word[len(glued) :])
        elif sign:
            out.append({"~": " ", "_": "-"}.get(sign, sign if sign in "{}\\" else ""))
        elif text:
            out.append(text[1:] if skip and text.startswith("?") else text)
            skip = 0
    # characters beyond the first plane are written as two units
    return [(1, tidy("".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")))]


def parse_eml(content: bytes, name: str = "") -> Pages:
    message = email.message_from_bytes(content, policy=email.policy.default)
    lines = [f"{h}: {message[h]}" for h in ("From", "To", "Cc", "Date", "Subject") if message[h]]
    bodies, attached = [], []
    for part in message.walk():
        if part.get_filename():
            attached.append(part.get_filename())
        elif part.get_content_type() in ("text/plain", "text/html"):
            try:
                body = part.get_content()
            except (LookupError, ValueError):
                continue
            body = reading_text(body) if part.get_content_subtype() == "html" else tidy(body)
            bodies += [body] if body else []
    tail = ["Lampiran: " + ", ".join(attached)] if attached else []
    return [(1, tidy("\n\n".join([*lines, *bodies, *tail])))]


def _provider(content: bytes, name: str = "") -> Pages:
    raise Unreadable("needs a provider for this format")


def _legacy(kind: str) -> Callable[[bytes, str], Pages]:
    def run(content: bytes, name: str = "") -> Pages:
        from tarn.sources import legacy

        return getattr(legacy, kind)(content)

    return run


PARSERS: dict[str, Callable[[bytes, str], Pages]] = {
    "text": parse_text, "json": parse_json, "csv": parse_csv, "xml": parse_xml, "html": parse_html, "docx": parse_docx, "pptx": parse_pptx,
    "xlsx": parse_xlsx, "odf": parse_odf, "epub": parse_epub, "rtf": parse_rtf, "eml": parse_eml, "pdf": _provider, "image_ocr": _provider,
    "doc_binary": _legacy("doc_pages"), "xls_binary": _legacy("xls_pages"), "ppt_binary": _legacy("ppt_pages"),
}


def parse(name: str, content: bytes, mime: str = "") -> tuple[str, Pages]:
    """(parser, pages that are not blank), or Unreadable."""
    from tarn.sources.formats import parser_for

    parser = parser_for(name, content, mime)
    if not parser:
        raise Unreadable("unknown format")
    pages = [(n, t) for n, t in PARSERS[parser](content, name) if t.strip()]
    if not pages:
        raise Unreadable("no readable text")
    return parser, pages


__all__ = ["PARSERS", "Unreadable", "parse", "tree"]
