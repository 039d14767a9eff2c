"""Document containers to Markdown: Word, PowerPoint, OpenDocument, EPUB, RTF and text-based PDF.

Pure functions of bytes, run in Arrow batches over binaryFile rows. A file that can't be read gives an error struct in its row,
never a failed task; ceilings bound what is inflated.
"""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import strip
from quillspark.operators.rows import flat_map
from quillspark.sources.errors import TextError

MAX_FILE = 100 << 20
MAX_INFLATED = 64 << 20
SNIFFED = 8000
#: Style names of headings and titles as word processors store them (fixed values).
HEADINGS = frozenset("heading überschrift berschrift uberschrift titre titolo título ttulo titulo encabezado kop rubrik overskrift otsikko nagłówek nagwek".split())
TITLES = frozenset("title titel titre titolo título ttulo titulo otsikko".split())

_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍﻿"))


def clean_inline(s: str) -> str:
    return re.sub(r"[ \t\n\r\v\f\xa0\u2007\u202f]+", " ", s.translate(_INVISIBLE)).strip(" ")


class Markdown:
    """Blocks of a document; list items and table rows of one run stand on lines of one block."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, str]] = []

    def _add(self, kind: str, s: str) -> None:
        if kind in ("item", "row") and self.blocks and self.blocks[-1][0] == kind:
            self.blocks[-1] = (kind, self.blocks[-1][1] + "\n" + s)
        else:
            self.blocks.append((kind, s))

    def heading(self, level: int, s: str) -> None:
        if s := clean_inline(s):
            self._add("heading", "#" * min(6, max(1, level)) + " " + s)

    def para(self, s: str) -> None:
        if s := clean_inline(s):
            self._add("para", s)

    def item(self, depth: int, s: str, ordered: bool = False) -> None:
        if s := clean_inline(s):
            self._add("item", "  " * max(0, depth) + ("1. " if ordered else "- ") + s)

    def row(self, cells: list[str]) -> None:
        cells = [clean_inline(c) for c in cells]
        if any(cells):
            self._add("row", "| " + " | ".join(cells) + " |")

    def text(self) -> str:
        return "\n\n".join(s for _, s in self.blocks) + "\n" if self.blocks else ""


class Zip:
    """Parts of a zip, under one budget of inflated bytes."""

    def __init__(self, data: bytes):
        try:
            self.z = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise TextError("invalid_args", f"not a readable zip: {e}") from None
        self.names = set(self.z.namelist())
        self.left = MAX_INFLATED

    def read(self, name: str) -> bytes:
        if name not in self.names:
            raise TextError("invalid_args", f"the container has no {name}")
        with self.z.open(name) as f:
            out = f.read(self.left + 1)
        self.left -= len(out)
        if self.left < 0:
            raise TextError("invalid_args", "the container inflates beyond the ceiling")
        return out

    def xml(self, name: str) -> ET.Element:
        return parse(self.read(name))


def parse(data: bytes) -> ET.Element:
    if re.search(rb"<!ENTITY", data[:4096]):
        raise TextError("invalid_args", "entity declarations aren't read")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise TextError("invalid_args", f"damaged XML: {e}") from None


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def attr(e: ET.Element, key: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == key), default)


def _title(z: Zip, part: str = "docProps/core.xml") -> str:
    if part in z.names:
        for e in z.xml(part).iter():
            if name(e) == "title":
                return clean_inline("".join(e.itertext()))
    return ""


# --- Word -----------------------------------------------------------------------------------------
def heading_level(style: str) -> int:
    s = re.sub(r"[\s_-]+", "", style.lower())
    m = re.fullmatch(r"(.*?)(\d*)", s)
    base, digits = m.groups()
    if not digits:
        return int(base in TITLES)
    return int(digits) if base in HEADINGS else 0


def _runs(e: ET.Element) -> Iterator[str]:
    for c in e:
        n = name(c)
        if n in ("del", "moveFrom", "instrText", "delText", "pPr", "rPr", "footnoteReference", "endnoteReference", "commentReference", "AlternateContent"):
            if n == "AlternateContent":
                for x in c:
                    if name(x) == "Fallback":
                        yield from _runs(x)
            continue
        if n == "t":
            yield c.text or ""
        elif n == "tab":
            yield " "
        elif n in ("br", "cr"):
            yield "\n"
        elif n == "noBreakHyphen":
            yield "-"
        elif n in ("tbl",):
            continue
        else:
            yield from _runs(c)


def _word_body(e: ET.Element, md: Markdown) -> None:
    for c in e:
        n = name(c)
        if n == "p":
            style, listed, depth = "", False, 0
            for p in c:
                if name(p) == "pPr":
                    for q in p.iter():
                        if name(q) == "pStyle":
                            style = attr(q, "val")
                        elif name(q) == "numPr":
                            listed = True
                        elif name(q) == "ilvl":
                            depth = int(attr(q, "val", "0") or 0)
            text = "".join(_runs(c))
            level = heading_level(style)
            if level:
                md.heading(level, text)
            elif listed:
                md.item(depth, text)
            else:
                md.para(text)
        elif n == "tbl":
            for row in c:
                if name(row) == "tr":
                    md.row([" ".join("".join(_runs(p)) for p in cell.iter() if name(p) == "p") for cell in row if name(cell) == "tc"])
        elif n not in ("sectPr", "del", "moveFrom"):
            _word_body(c, md)


def docx(data: bytes) -> tuple[str, str, int | None]:
    z, md = Zip(data), Markdown()
    _word_body(z.xml("word/document.xml"), md)
    return md.text(), _title(z), None


# --- PowerPoint -----------------------------------------------------------------------------------
def _slide(e: ET.Element, md: Markdown) -> None:
    titled = False
    for shape in e.iter():
        if name(shape) == "tbl":
            for row in shape:
                if name(row) == "tr":
                    md.row([" ".join("".join(t.text or "" for t in p.iter() if name(t) == "t") for p in cell.iter() if name(p) == "p") for cell in row if name(cell) == "tc"])
        if name(shape) != "sp":
            continue
        kind = next((attr(p, "type") for p in shape.iter() if name(p) == "ph"), None)
        if kind in ("sldNum", "dt", "ftr", "hdr"):
            continue
        for p in shape.iter():
            if name(p) != "p":
                continue
            text = "".join("\n" if name(t) == "br" else t.text or "" for t in p.iter() if name(t) in ("t", "br"))
            depth = next((int(attr(q, "lvl", "0") or 0) for q in p if name(q) == "pPr"), 0)
            bullet = not any(name(q) == "buNone" for q in p.iter())
            if kind in ("title", "ctrTitle") and not titled:
                md.heading(1, text)
                titled = bool(clean_inline(text)) or titled
            elif kind in ("body", "obj", "subTitle") or kind == "" and bullet:
                md.item(depth, text) if kind != "subTitle" else md.para(text)
            else:
                md.para(text)


def pptx(data: bytes) -> tuple[str, str, int | None]:
    z, md = Zip(data), Markdown()
    slides = [(int(m.group(1)) if m.group(1) else 1 << 30, n) for n in z.names if (m := re.fullmatch(r"ppt/slides/slide(\d*)\.xml", n))]
    if not slides:
        raise TextError("invalid_args", "the container has no slides")
    for _, n in sorted(slides):
        _slide(z.xml(n), md)
    return md.text(), _title(z), len(slides)


# --- OpenDocument ---------------------------------------------------------------------------------
MAX_REPEAT = 1024


def _odf_text(e: ET.Element) -> str:
    out = [e.text or ""]
    for c in e:
        n = name(c)
        if n in ("note", "annotation", "annotation-end", "tracked-changes"):
            pass
        elif n == "s":
            out.append(" " * min(MAX_REPEAT, int(attr(c, "c", "1") or 1)))
        elif n in ("tab", "line-break"):
            out.append(" ")
        else:
            out.append(_odf_text(c))
        out.append(c.tail or "")
    return "".join(out)


def _odf_rows(e: ET.Element) -> Iterator[list[str]]:
    for c in e:
        if name(c) == "table-row":
            cells: list[str] = []
            blank = 0
            for cell in c:
                if name(cell) in ("table-cell", "covered-table-cell"):
                    s = " ".join(_odf_text(p) for p in cell.iter() if name(p) == "p")
                    n = min(MAX_REPEAT, int(attr(cell, "number-columns-repeated", "1") or 1))
                    if not s.strip():
                        blank += n
                        continue
                    cells += [""] * min(blank, MAX_REPEAT - len(cells))
                    cells += [s] * min(n, MAX_REPEAT - len(cells))
                    blank = 0
            if cells:
                for _ in range(min(MAX_REPEAT, int(attr(c, "number-rows-repeated", "1") or 1))):
                    yield cells
        elif name(c) in ("table-header-rows", "table-rows", "table-row-group"):
            yield from _odf_rows(c)


def _odf_body(e: ET.Element, md: Markdown, depth: int = -1) -> None:
    for c in e:
        n = name(c)
        if n == "h":
            md.heading(int(attr(c, "outline-level", "1") or 1), _odf_text(c))
        elif n == "p":
            md.item(depth, _odf_text(c)) if depth >= 0 else md.para(_odf_text(c))
        elif n == "list":
            _odf_body(c, md, depth + 1)
        elif n == "table":
            if attr(e, "_sheet"):
                md.heading(2, attr(c, "name"))
            for row in _odf_rows(c):
                md.row(row)
        elif n not in ("tracked-changes", "note", "annotation", "forms", "sequence-decls"):
            _odf_body(c, md, depth)


def odf(data: bytes, sheet: bool) -> tuple[str, str, int | None]:
    if data[:2] == b"PK":
        z = Zip(data)
        root = z.xml("content.xml")
        title = _title(z, "meta.xml")
    else:
        root = parse(data[:MAX_INFLATED])
        title = next((clean_inline("".join(e.itertext())) for e in root.iter() if name(e) == "title"), "")
    md, pages = Markdown(), 0
    for body in root.iter():
        if name(body) == ("spreadsheet" if sheet else "text") and body.tag.startswith("{urn:oasis:names:tc:opendocument:xmlns:office"):
            if sheet:
                body.set("_sheet", "1")
                pages = sum(name(c) == "table" for c in body)
            _odf_body(body, md)
    return md.text(), title, pages or None


# --- EPUB -----------------------------------------------------------------------------------------
def epub(data: bytes) -> tuple[str, str, int | None]:
    z = Zip(data)
    package = next((attr(e, "full-path") for e in z.xml("META-INF/container.xml").iter() if name(e) == "rootfile"), "")
    root = z.xml(package)
    items, spine, title = {}, [], ""
    for e in root.iter():
        n = name(e)
        if n == "item":
            items[attr(e, "id")] = (attr(e, "href"), attr(e, "media-type"), attr(e, "properties"))
        elif n == "itemref" and attr(e, "linear", "yes") != "no":
            spine.append(attr(e, "idref"))
        elif n == "title" and not title:
            title = clean_inline("".join(e.itertext()))
    base, out = posixpath.dirname(package), []
    for k in spine:
        href, kind, props = items.get(k, ("", "", ""))
        part = posixpath.normpath(posixpath.join(base, href.split("#")[0]))
        if "html" in kind and "nav" not in props.split() and part in z.names:
            md = Markdown()
            page = re.sub(r"(?is)<(script|style|head|nav)\b.*?</\1\s*>|<!--.*?-->", " ", z.read(part).decode("utf-8", "replace"))
            for m in re.finditer(r"(?is)<(h[1-6]|li|p|td|th|blockquote|pre)\b[^>]*>(.*?)(?=</\1\s*>|<(?:h[1-6]|li|p|td|th|ul|ol)\b)", page):
                s = strip.decode_entities(re.sub(r"<[^>]*>", "", m.group(2)))
                t = m.group(1).lower()
                md.heading(int(t[1]), s) if t[0] == "h" else md.item(0, s) if t == "li" else md.para(s)
            out.append(md.text().rstrip("\n"))
    return "\n\n".join(x for x in out if x) + "\n" if any(out) else "", title, len(out) or None


# --- RTF ------------------------------------------------------------------------------------------
#: Destinations without text, and characters by control word (fixed values).
RTF_SKIP = frozenset("fonttbl colortbl stylesheet listtable listoverridetable rsidtbl generator pict object header headerl headerr headerf footer footerl footerr footerf footnote annotation fldinst themedata colorschememapping datastore latentstyles xmlnstbl mmathPr filetbl revtbl listtext pntext bkmkstart bkmkend shpinst nonshppict".split())
RTF_CHARS = {"tab": " ", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "~": "\xa0", "_": "-"}
_RTF = re.compile(rb"\\(?P<word>[a-z]+)(?P<param>-?\d+)? ?|\\'(?P<byte>[0-9a-fA-F]{2})|\\(?P<sign>[^a-z])|(?P<brace>[{}])|[\r\n]+|(?P<text>[^\\{}\r\n]+)", re.I)


class _Rtf:
    """Reads tokens one by one; what a control word does stands in the table WORDS."""

    def __init__(self) -> None:
        self.md, self.title = Markdown(), ""
        self.text, self.cells = "", []  # type: str, list[str]
        self.where, self.fallback = "body", 1  # destination, and how many characters stand in for one in Unicode
        self.groups: list[tuple[str, int]] = []
        self.outline = -1
        self.passed = 0  # characters still to be passed over, being the fallback of one read already
        self.binary = 0  # bytes to be passed over
        self.units: list[int] = []  # a first half of a surrogate pair
        self.optional = False

    def put(self, s: str) -> None:
        if self.passed:
            s, self.passed = s[self.passed:], max(0, self.passed - len(s))
        if self.where == "body":
            self.text += s
        elif self.where == "title":
            self.title += s

    def paragraph(self, *_: object) -> None:
        s, self.text = clean_inline(self.text), ""
        bullet = re.match(r"[•·▪◦‣–-]\s+(.*)", s)
        if bullet:
            self.md.item(0, bullet.group(1))
        elif self.outline >= 0:
            self.md.heading(self.outline + 1, s)
        else:
            self.md.para(s)

    def fresh(self, *_: object) -> None:
        self.paragraph()
        self.outline = -1

    def begin_row(self, *_: object) -> None:
        self.paragraph()
        self.cells = []

    def cell(self, *_: object) -> None:
        self.cells.append(self.text)
        self.text = ""

    def row(self, *_: object) -> None:
        self.md.row(self.cells)
        self.cells = []

    def level(self, n: int | None) -> None:
        self.outline = n if n is not None and 0 <= n <= 8 else -1

    def width(self, n: int | None) -> None:
        self.fallback = n if n is not None and n >= 0 else self.fallback

    def go(self, where: str, only_in: str | None = None) -> None:
        if only_in is None or self.where == only_in:
            self.where = where

    def unicode(self, n: int | None) -> None:
        if n is None:
            return
        self.units.append(n % 65536)
        if 0xD800 <= self.units[-1] < 0xDC00 and len(self.units) == 1:
            self.passed = self.fallback
            return
        unit = b"".join(x.to_bytes(2, "little") for x in self.units)
        self.units = []
        self.put(unit.decode("utf-16-le", "replace"))
        self.passed = self.fallback

    WORDS = {
        **dict.fromkeys(("par", "line", "sect", "page", "column"), paragraph), **dict.fromkeys(("pard", "sectd"), fresh), **dict.fromkeys(("cell", "nestcell"), cell), **dict.fromkeys(("row", "nestrow"), row),
        "trowd": begin_row, "outlinelevel": level, "uc": width, "u": unicode, "info": lambda self, n: self.go("info"), "title": lambda self, n: self.go("title", "info"),
    }

    def word(self, w: str, n: int | None) -> None:
        if w in RTF_SKIP or self.optional and w != "shppict":
            self.where = "skip"
        elif w == "bin":
            self.binary = n or 0
        elif self.where != "skip":
            if w in RTF_CHARS:
                self.put(RTF_CHARS[w])
            elif w in self.WORDS:
                self.WORDS[w](self, n)
        self.optional = False

    def sign(self, c: str) -> None:
        self.optional = c == "*"
        if c in "\r\n":
            self.paragraph()
        elif c in "\\{}":
            self.put(c)
        elif c in RTF_CHARS:
            self.put(RTF_CHARS[c])

    def read(self, data: bytes) -> None:
        at = 0
        while m := _RTF.search(data, at):
            at = m.end()
            if m["word"]:
                self.word(m["word"].decode(), int(m["param"]) if m["param"] else None)
                at, self.binary = at + self.binary, 0
            elif m["brace"] == b"{":
                self.groups.append((self.where, self.fallback))
            elif m["brace"]:
                if self.groups:
                    self.where, self.fallback = self.groups.pop()
                if not self.groups:
                    break
            elif m["sign"]:
                self.sign(m["sign"].decode("latin-1"))
            elif m["byte"]:
                self.put(bytes.fromhex(m["byte"].decode()).decode("cp1252", "replace"))
            elif m["text"]:
                self.put(m["text"].decode("cp1252", "replace"))
        self.paragraph()


def rtf(data: bytes) -> tuple[str, str, int | None]:
    if not data.lstrip().startswith(b"{\\rtf"):
        raise TextError("invalid_args", "not an RTF file")
    r = _Rtf()
    r.read(data)
    return r.md.text(), clean_inline(r.title), None


# --- PDF ------------------------------------------------------------------------------------------
_PDF_TEXT = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|/[^\s/<>\[\]()]+|[A-Za-z'\"*]+")


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        h = re.sub(rb"\s", b"", raw[1:-1])
        b = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    else:
        esc = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
        b = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else esc.get(m[1], m[1]), raw[1:-1], flags=re.S)
    if b[:2] == b"\xfe\xff":
        return b[2:].decode("utf-16-be", "replace")
    return b.decode("cp1252", "replace")


def pdf_glyphs(data: bytes) -> Iterator[tuple[int, float, float, float, str]]:
    """(page, x, y, size, text) of the shown strings of every content stream with simple fonts."""
    page, left = 0, MAX_INFLATED
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n", data, re.S):
        end = data.find(b"endstream", m.end())
        body = data[m.end():end if end >= 0 else len(data)]
        if b"/FlateDecode" in m.group(1):
            try:
                body = zlib.decompressobj().decompress(body, left)
            except zlib.error:
                continue
        left -= len(body)
        if left <= 0:
            raise TextError("invalid_args", "the file inflates beyond the ceiling")
        if b"BT" not in body or not re.search(rb"T[jJ]|'", body):
            continue
        page += 1
        x = y = lx = ly = 0.0
        size, lead = 12.0, 0.0
        args: list = []
        for t in _PDF_TEXT.finditer(body):
            s = t.group()
            if s[:1] in b"(<":
                args.append(_pdf_string(s))
            elif re.fullmatch(rb"-?\d*\.?\d+", s):
                args.append(float(s))
            elif s[:1] in b"/[]":
                args.append(s)
            else:
                nums = [a for a in args if isinstance(a, float)]
                if s == b"Tf" and nums:
                    size = nums[-1]
                elif s == b"TL" and nums:
                    lead = nums[-1]
                elif s in (b"Td", b"TD") and len(nums) >= 2:
                    lx, ly = lx + nums[-2], ly + nums[-1]
                    x, y = lx, ly
                    lead = -nums[-1] if s == b"TD" else lead
                elif s == b"Tm" and len(nums) >= 6:
                    lx, ly = nums[-2], nums[-1]
                    x, y = lx, ly
                    size = abs(nums[-3]) * (size if abs(nums[-3]) <= 1.5 else 1) if abs(nums[-3]) <= 1.5 else abs(nums[-3])
                elif s in (b"T*", b"'"):
                    ly -= lead or size * 1.2
                    x, y = lx, ly
                elif s == b"BT":
                    x = y = lx = ly = 0.0
                if s in (b"Tj", b"TJ", b"'", b'"'):
                    out = ""
                    for a in args:
                        out += a if isinstance(a, str) else " " if isinstance(a, float) and a < -180 and out else ""
                    if out.strip():
                        yield page, x, y, size, out
                        x += 0.5 * size * len(out)
                args = []


def pdf(data: bytes) -> tuple[str, str, int | None]:
    if b"%PDF" not in data[:1024]:
        raise TextError("invalid_args", "not a PDF file")
    if b"/Encrypt" in data:
        raise TextError("invalid_args", "the file is encrypted")
    lines: list[list] = []  # page, y, size, text
    for p, x, y, size, s in pdf_glyphs(data):
        last = lines[-1] if lines else None
        if last and last[0] == p and abs(last[1] - y) <= 0.3 * size:
            last[3] += (" " if x - last[4] > 0.18 * size and not last[3].endswith(" ") else "") + s
            last[4] = x + 0.5 * size * len(s)
        else:
            lines.append([p, y, size, s, x + 0.5 * size * len(s)])
    pages = max((x[0] for x in lines), default=0)
    by: dict[int, list] = defaultdict(list)
    for x in lines:
        by[x[0]].append(x)
    fold = lambda s: re.sub(r"\d+", "#", clean_inline(s).lower())
    seen = Counter(k for ls in by.values() for k in {fold(x[3]) for x in [*ls[:2], *ls[-2:]]})
    least = max(3, -(-6 * pages // 10))
    furniture = {k for k, n in seen.items() if n >= least}
    lines = [x for ls in by.values() for i, x in enumerate(ls) if not ((i < 2 or i >= len(ls) - 2) and fold(x[3]) in furniture)]
    if not lines:
        return "", "", pages or None
    weight: Counter = Counter()
    for x in lines:
        weight[round(x[2], 1)] += len(x[3])
    body = max(weight, key=lambda k: (weight[k], -k))
    ranks = {s: i + 1 for i, s in enumerate(sorted((s for s in weight if s >= 1.25 * body), reverse=True))}
    gaps = sorted(r for a, b in zip(lines, lines[1:]) if a[0] == b[0] and 0 < (r := (a[1] - b[1]) / max(b[2], 1)) < 4)
    leading = gaps[len(gaps) // 2] if gaps else 1.2
    md, run, last = Markdown(), [], None

    def flush() -> None:
        if not run:
            return
        size = round(run[0][2], 1)
        text = run[0][3]
        for x in run[1:]:
            s = x[3].lstrip()
            first = re.match(r"\w+", s)
            if re.search(r"[^\W\d]-\s*$", text) and s[:1].islower() and not (first and first.group() in ("und", "oder", "bzw", "and", "or", "et", "y")):
                text = text.rstrip()[:-1] + s
            else:
                text += " " + s
        if size in ranks:
            md.heading(ranks[size], text)
        elif m := re.match(r"\s*(?:[•▪◦‣·–-]|(\d{1,3})[.)])\s+(.*)", text, re.S):
            md.item(0, m.group(2), bool(m.group(1)))
        else:
            md.para(text)
        run.clear()

    for x in lines:
        if last is not None:
            gap = (last[1] - x[1]) / max(x[2], 1) if last[0] == x[0] else 0
            if abs(last[2] - x[2]) > 0.6 or gap > 1.35 * leading or gap < 0 or re.match(r"\s*[•▪◦‣]\s", x[3]) or last[0] != x[0] and last[3].rstrip()[-1:] in ".!?:":
                flush()
        run.append(x)
        last = x
    flush()
    title = re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", data)
    return md.text(), clean_inline(_pdf_string(title.group(1))) if title else "", pages or None


DECODERS: dict[str, tuple[tuple[str, ...], Callable[[bytes], tuple[str, str, int | None]]]] = {
    "docx": ((".docx", ".docm"), docx), "epub": ((".epub",), epub), "ods": ((".ods", ".fods"), lambda d: odf(d, True)),
    "odt": ((".odt", ".fodt"), lambda d: odf(d, False)), "pdf": ((".pdf",), pdf), "pptx": ((".pptx", ".pptm"), pptx), "rtf": ((".rtf",), rtf),
}


def detect_format(path: str, data: bytes) -> str:
    """Format by the name's ending, then by content; text otherwise."""
    low = path.lower()
    for k, (ends, _) in DECODERS.items():
        if low.endswith(ends):
            return k
    head = data[:8192]
    if head.lstrip().startswith(b"{\\rtf"):
        return "rtf"
    if b"%PDF" in head[:1024]:
        return "pdf"
    if head[:2] == b"PK":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except zipfile.BadZipFile:
            return "text"
        if "word/document.xml" in names:
            return "docx"
        if any(n.startswith("ppt/slides/") for n in names):
            return "pptx"
        if "META-INF/container.xml" in names:
            return "epub"
        if "content.xml" in names and "mimetype" in names:
            kind = zipfile.ZipFile(io.BytesIO(data)).read("mimetype")[:128]
            return "ods" if b"spreadsheet" in kind else "odt"
    if m := re.search(rb"office:mimetype=[\"']([^\"']*)", head):
        return "ods" if b"spreadsheet" in m.group(1) else "odt"
    return "text"


def is_binary(data: bytes) -> bool:
    """A zero byte or broken UTF-8 near the start; a character cut at the end is forgiven."""
    head = data[:SNIFFED]
    if b"\0" in head:
        return True
    for cut in range(4 if len(data) > SNIFFED else 1):
        try:
            head[:len(head) - cut].decode("utf-8")
            return False
        except UnicodeDecodeError:
            continue
    return True


def decode(path: str, data: bytes | None, want: str = "auto") -> tuple[str, str, str, int | None]:
    """(markdown, title, format, pages)."""
    data = data or b""
    kind = detect_format(path, data) if want == "auto" else want
    if kind == "text":
        if is_binary(data):
            raise TextError("invalid_args", f"{path} is binary")
        return data.decode("utf-8", "replace").removeprefix("﻿"), "", "text", None
    if kind not in DECODERS:
        raise TextError("invalid_args", f"unknown format {kind}")
    if len(data) > MAX_FILE:
        raise TextError("invalid_args", f"{path} is over the file ceiling")
    text, title, pages = DECODERS[kind][1](data)
    if not text.strip():
        raise TextError("empty_input", f"{path} holds no text")
    return text, title, kind, pages


def extract(files: DataFrame, want: str = "auto") -> DataFrame:
    """binaryFile rows (path, content) to markdown, title, format, pages and an error struct."""

    def make() -> Callable[..., list[tuple]]:
        def rows(path, content):  # noqa: ANN001, ANN202
            try:
                return [(path, *decode(path, bytes(content) if content is not None else None, want), None)]
            except TextError as e:
                return [(path, None, None, None, None, dict(zip(("code", "message", "retriable"), e.struct())))]
            except Exception as e:  # noqa: BLE001  a damaged file must not fail the task
                return [(path, None, None, None, None, {"code": "invalid_args", "message": f"{type(e).__name__}: {e}"[:300], "retriable": False})]

        return rows

    small = F.when(F.length("content") <= MAX_FILE, F.col("content"))
    return flat_map(files, ["path", small], make, "path string, markdown string, title string, format string, pages int, error struct<code:string,message:string,retriable:boolean>")


def read_files(spark: SparkSession, path: str | list[str], want: str = "auto") -> DataFrame:
    return extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"), want)
