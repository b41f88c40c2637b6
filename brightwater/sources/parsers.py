"""Text from document bytes: small helpers that run inside Spark tasks, standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

# Fixed values that results depend on.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "utf-16", "utf-16le", "utf-16be")
STRING_ENCODINGS = ("utf-8", "gb18030", "utf-16le", "latin-1")
TEXT_TYPES = ("txt", "md", "markdown", "csv", "tsv", "json", "jsonl", "log", "yaml", "yml", "ini", "xml")
BINARY_TYPES = ("doc", "docx", "xls", "xlsx", "pdf", "ofd", "wps", "pws", "png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PRINTABLE = re.compile(rb"[ -~]{4,}")


class ParseError(ValueError):
    """A document from which no text can be had."""


def decode_text(data: bytes, encoding: str | None = None) -> str:
    """By the given encoding, strictly; else by the first of ``ENCODINGS`` that fits, else UTF-8 with replacement marks."""
    if encoding:
        try:
            return data.decode(encoding)
        except (UnicodeDecodeError, LookupError) as e:
            raise ParseError(f"the file is not {encoding}") from e
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


def local_text(data: bytes) -> str:
    """UTF-8, what isn't left out."""
    return data.decode("utf-8", errors="ignore")


def xml_text(data: bytes) -> str:
    """The text of every element in document order, one per line; empty for bad XML."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return ""
    return "\n".join(t for e in root.iter() if (t := (e.text or "").strip()))


def binary_strings(data: bytes) -> str:
    """The longest of four lenient decodings and the runs of printable ASCII."""
    found = [data.decode(name, errors="ignore") for name in STRING_ENCODINGS]
    found.append("\n".join(m.decode("ascii") for m in _PRINTABLE.findall(data)))
    return max(found, key=len)


def archive_xml(data: bytes) -> str:
    """OFD: the text of all XML parts of a zip archive, in order of the archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return "\n".join(t for n in z.namelist() if n.lower().endswith(".xml") and (t := xml_text(z.read(n))))
    except zipfile.BadZipFile:
        return ""


def table_cells(table) -> list[list[dict]]:
    """Rows of {text, row_span, col_span} of a Word table; cells merged downwards count in the span of the cell they continue."""
    rows, open_cells = [], {}
    for tr in table.iterfind(f"{_W}tr"):
        row, column, seen = [], 0, {}
        for tc in tr.iterfind(f"{_W}tc"):
            properties = tc.find(f"{_W}tcPr")
            span = merge = None
            if properties is not None:
                span, merge = properties.find(f"{_W}gridSpan"), properties.find(f"{_W}vMerge")
            width = max(1, int(span.get(f"{_W}val", "1"))) if span is not None else 1
            state = None if merge is None else (merge.get(f"{_W}val") or "continue").lower()
            if state == "continue":
                above = open_cells.get(column)
                if above is not None:
                    above["row_span"] += 1
                    seen[column] = above
            else:
                cell = {"text": "".join((t.text or "").strip() for t in tc.iter(f"{_W}t")), "row_span": 1, "col_span": width}
                row.append(cell)
                if state == "restart":
                    seen[column] = cell
            column += width
        open_cells = seen
        if row:
            rows.append(row)
    return rows


def spanned_markdown(rows: list[list[dict]]) -> str:
    """A pipe table; spans show as [RxC] and take empty cells to their right."""
    lines = []
    for row in rows:
        cells = []
        for c in row:
            text = c["text"].replace("|", "\\|")
            if c["row_span"] > 1 or c["col_span"] > 1:
                text = f"{text} [R{c['row_span']}xC{c['col_span']}]".strip()
            cells += [text, *[""] * (c["col_span"] - 1)]
        lines.append(cells)
    width = max(map(len, lines), default=0)
    if not width:
        return ""
    shown = ["| " + " | ".join(x + [""] * (width - len(x))) + " |" for x in lines]
    return "\n".join([shown[0], "|" + "|".join([" --- "] * width) + "|", *shown[1:]])


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in document order, then tables of headers and footers; equal tables once, under numbered headings."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    blocks, seen = [], []

    def add_table(table) -> None:
        text = spanned_markdown(table_cells(table))
        if text and text not in seen:
            seen.append(text)
            blocks.append(f"### 表格 {len(seen)}\n{text}")

    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            text = "".join(t.text or "" for t in block.iter(f"{_W}t")).strip()
            if text:
                blocks.append(text)
        elif block.tag == f"{_W}tbl":
            add_table(block)
    for name in sorted(n for n in archive.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n)):
        for table in ElementTree.fromstring(archive.read(name)).iter(f"{_W}tbl"):
            add_table(table)
    return "\n\n".join(blocks)


def xlsx_text(data: bytes) -> str:
    """Each sheet under its name as a pipe table."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet")]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{m}si")]
    out = []
    for i, name in enumerate(names, 1):
        part = f"xl/worksheets/sheet{i}.xml"
        if part not in z.namelist():
            continue
        rows = []
        for row in ElementTree.fromstring(z.read(part)).iter(f"{m}row"):
            cells = []
            for c in row.iter(f"{m}c"):
                value = c.find(f"{m}v")
                text = "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else "" if value is None else value.text or ""
                cells.append(strings[int(text)] if c.get("t") == "s" and text else text)
            if any(x.strip() for x in cells):
                rows.append([{"text": x.strip(), "row_span": 1, "col_span": 1} for x in cells])
        if rows:
            out.append(f"## {name}\n{spanned_markdown(rows)}")
    return "\n\n".join(out)


#: An ampersand, and the rest of a character reference if it is a whole one.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


class _Html(HTMLParser):
    skipped = {"script", "style", "noscript", "template", "head"}
    blocks = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "ul", "ol", "table", "nav", "header", "footer"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.skipped
        if tag in self.blocks:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.skipped and self.hidden:
            self.hidden -= 1
        if tag in self.blocks:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(data: bytes | str, cut_references: bool = True) -> str:
    """What a page shows, a line per block. Without ``cut_references``, a character reference that lacks its semicolon stays as it is written."""
    text = data if isinstance(data, str) else decode_text(data)
    reader = _Html()
    reader.feed(text if cut_references else _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", text))
    reader.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(reader.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def no_text(data: bytes) -> str:
    """Pictures and other formats whose engines are not bundled: a caller registers its own."""
    return ""


#: Parser by file type; callers may pass a table of their own (PDF layout, OCR and converters need engines that are not bundled).
PARSERS: dict[str, Callable[[bytes], str]] = {
    **{t: local_text for t in TEXT_TYPES}, "docx": docx_text, "xlsx": xlsx_text, "xls": binary_strings, "ofd": archive_xml, "html": html_text, "htm": html_text,
    "doc": lambda d: docx_text(d) or binary_strings(d), "wps": binary_strings, "pws": lambda d: archive_xml(d) or binary_strings(d), "pdf": no_text,
    **{t: no_text for t in ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp")},
}


def file_type(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""


def local_file_text(name: str, data: bytes, parsers=PARSERS) -> str:
    return parsers.get(file_type(name), binary_strings)(data)


def uploaded_text(name: str, data: bytes, encoding: str | None = None, parsers=PARSERS) -> str:
    """A given encoding or a text type decodes; other types are parsed; unknown types that give nothing decode as text. Empty files raise."""
    if not data:
        raise ParseError("the file is empty")
    kind = file_type(name)
    if encoding or kind in TEXT_TYPES:
        text = decode_text(data, encoding)
    else:
        text = parsers[kind](data) if kind in parsers else ""
        if not text.strip() and kind not in BINARY_TYPES:
            text = decode_text(data)
    if not text.strip():
        raise ParseError("no text can be had from the file")
    return text
