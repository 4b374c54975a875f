"""File formats: a file's chunks of text, and the file with other chunks in their places."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from pathlib import PurePosixPath

Change = Callable[[str], str]


def change_text(raw: bytes, change: Change) -> bytes:
    return change(raw.decode("utf-8", "replace")).encode()


class _TextNodes(HTMLParser):
    """Re-emits a page with its text nodes changed; all other markup stands as it was.

    even: start tags are written in one way, names small and values in double quotes, an empty element as a pair of tags.
    """

    def __init__(self, change: Change, even: bool = False):
        super().__init__(convert_charrefs=False)
        self.change, self.even, self.out = change, even, []

    def handle_starttag(self, tag, attrs):
        said = [tag, *(name if value is None else f'{name}="{value}"' for name, value in attrs)]
        self.out.append(f"<{' '.join(said)}>" if self.even else self.get_starttag_text())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.even:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        self.out.append(self.change(data))

    def handle_comment(self, data):
        self.out.append(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.out.append(f"<!{decl}>")

    def handle_pi(self, data):
        self.out.append(f"<?{data}>")

    def unknown_decl(self, data):
        self.out.append(f"<![{data}]>")

    def handle_entityref(self, name):
        self.out.append(f"&{name};")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")


def change_html_text(page: str, change: Change, even: bool = False) -> str:
    parser = _TextNodes(change, even)
    parser.feed(page)
    parser.close()
    return "".join(parser.out)


def change_html(raw: bytes, change: Change) -> bytes:
    return change_html_text(raw.decode("utf-8", "replace"), change).encode()


def change_csv(raw: bytes, change: Change) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out).writerows([change(c) for c in row] for row in csv.reader(io.StringIO(raw.decode("utf-8", "replace"), newline="")))
    return out.getvalue().encode()


def _parse(xml: bytes) -> tuple[ET.Element, dict[str, str]]:
    spaces = dict(x for _, x in ET.iterparse(io.BytesIO(xml), events=["start-ns"]))
    for prefix, uri in spaces.items():
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    return ET.fromstring(xml), spaces


def _write(root: ET.Element, spaces: dict[str, str]) -> bytes:
    out = ET.tostring(root, encoding="UTF-8", xml_declaration=True).decode()
    head = re.search(r"<[A-Za-z][^>]*?(?=/?>)", out)
    lost = "".join(f' xmlns{":" + p if p else ""}="{u}"' for p, u in spaces.items() if f'xmlns{":" + p if p else ""}="' not in head[0])
    return (out[: head.end()] + lost + out[head.end() :]).encode()


def _rezipped(raw: bytes, changed: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            new.writestr(item, changed.get(item.filename, old.read(item.filename)))
    return out.getvalue()


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
_BREAKS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}


def _paragraph(p: ET.Element, change: Change) -> None:
    """The runs' joined text changed: all of it goes into the first run, the others keep none."""
    runs = p.findall(W + "r")
    text = "".join(e.text or "" if e.tag == W + "t" else _BREAKS.get(e.tag, "") for r in runs for e in r)
    if not text.strip() or (new := change(text)) == text:
        return
    for r in runs:
        for e in [e for e in r if e.tag == W + "t" or e.tag in _BREAKS]:
            r.remove(e)
    ET.SubElement(runs[0], W + "t", {_SPACE: "preserve"}).text = new


def _table(table: ET.Element, change: Change) -> None:
    for row in table.findall(W + "tr"):
        for cell in row.findall(W + "tc"):
            for p in cell.findall(W + "p"):
                _paragraph(p, change)
            for inner in cell.findall(W + "tbl"):
                _table(inner, change)


def _story(root: ET.Element, change: Change) -> None:
    for p in root.findall(W + "p"):
        _paragraph(p, change)
    for t in root.findall(W + "tbl"):
        _table(t, change)


def change_docx(raw: bytes, change: Change) -> bytes:
    """Paragraphs of the body, then its tables, then headers and footers with theirs."""
    changed = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        parts = sorted(n for n in z.namelist() if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n))
        for name in ["word/document.xml", *parts]:
            root, spaces = _parse(z.read(name))
            _story(root.find(W + "body") if name == "word/document.xml" else root, change)
            changed[name] = _write(root, spaces)
    return _rezipped(raw, changed)


S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def change_xlsx(raw: bytes, change: Change) -> bytes:
    """Text cells in the order of sheets, rows and cells; numbers and formulas stay."""
    changed, done = {}, set()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        strings, spaces = _parse(z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else (None, {})
        items = strings.findall(S + "si") if strings is not None else []

        def swap(item: ET.Element) -> None:
            text = "".join(t.text or "" for t in item.iter(S + "t"))
            if text and (new := change(text)) != text:
                for child in list(item):
                    item.remove(child)
                ET.SubElement(item, S + "t", {_SPACE: "preserve"}).text = new

        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
            root, own = _parse(z.read(name))
            for cell in root.iter(S + "c"):
                value = cell.find(S + "v")
                if cell.get("t") == "s" and value is not None and int(value.text) not in done:
                    done.add(int(value.text))
                    swap(items[int(value.text)])
                elif cell.get("t") == "inlineStr" and cell.find(S + "is") is not None:
                    swap(cell.find(S + "is"))
            changed[name] = _write(root, own)
        if strings is not None:
            changed["xl/sharedStrings.xml"] = _write(strings, spaces)
    return _rezipped(raw, changed)


def change_pdf(raw: bytes, change: Change) -> bytes:
    """The pages' text as Markdown sections. Needs pdfplumber."""
    try:
        import pdfplumber
    except ImportError:
        raise RuntimeError("reading PDF needs pdfplumber") from None
    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        return page_sections([p.extract_text() or "" for p in pdf.pages], change).encode()


def page_sections(pages: list[str], change: Change) -> str:
    return "\n\n---\n\n".join(f"## Страница {i}\n\n{change(t)}" for i, t in enumerate(pages, 1))


MASKED = {".txt": change_text, ".md": change_text, ".html": change_html, ".htm": change_html, ".csv": change_csv, ".docx": change_docx, ".xlsx": change_xlsx, ".pdf": change_pdf}
#: Restoring runs over a page's whole text, markup too.
RESTORED = {k: v for k, v in MASKED.items() if k != ".pdf"} | {".html": change_text, ".htm": change_text}


def handler(path: str, table: dict[str, Callable[[bytes, Change], bytes]]) -> Callable[[bytes, Change], bytes]:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".xls":
        raise ValueError("format .xls is not supported: save it as .xlsx")
    if suffix not in table:
        raise ValueError(f"format {suffix} is not supported")
    return table[suffix]


def masked_name(path: str) -> str:
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}_anon{'.md' if p.suffix.lower() == '.pdf' else p.suffix}"))


def restored_name(path: str) -> str:
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem.removesuffix('_anon')}_restored{p.suffix}"))
