"""Opening Office packages (zip + XML) inside tasks.

The helpers here only unzip and flatten XML into item rows. What the items mean (which sheet a
drawing belongs to, who wrote a comment, how a locator reads, what counts as empty) is decided by
column expressions in :mod:`linetrawl.sources.office`.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from linetrawl.functions.batches import SLICE_BYTES

# XML namespaces.
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
XDR = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
SS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TC = "{http://schemas.microsoft.com/office/spreadsheetml/2018/threadedcomments}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
# Built-in number formats that show dates or times.
DATE_FORMAT_IDS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)

ITEM_TYPE = "struct<ord:int,ref:string,name:string,who:string,parent:string,text:string>"
LINK_TYPE = "struct<sheet:string,base:string,target:string,type:string>"
PART_SCHEMA = (
    "path string, part_ord int, part string, kind string, sheet string, row int, "
    f"items array<{ITEM_TYPE}>, links array<{LINK_TYPE}>, people map<string,string>, "
    "authors array<string>, error string"
)
_TEXT = pa.string()
_ARROW = pa.schema([
    ("path", _TEXT), ("part_ord", pa.int32()), ("part", _TEXT), ("kind", _TEXT), ("sheet", _TEXT),
    ("row", pa.int32()),
    ("items", pa.list_(pa.struct([("ord", pa.int32())] + [(n, _TEXT) for n in ("ref", "name", "who", "parent", "text")]))),
    ("links", pa.list_(pa.struct([(n, _TEXT) for n in ("sheet", "base", "target", "type")]))),
    ("people", pa.map_(_TEXT, _TEXT)), ("authors", pa.list_(_TEXT)), ("error", _TEXT),
])
_BATCH_ROWS = 2000


def weight(row: dict) -> int:
    """About the bytes of a part row as Python objects; rows are handed on at ``_BATCH_ROWS`` or ``SLICE_BYTES`` of them."""
    items, fixed = row.get("items") or (), len(row.get("links") or ()) + len(row.get("people") or ())
    return 256 * (1 + len(items) + fixed) + sum(len(i.get("text") or "") for i in items)


def unpack(files: DataFrame, reader, whole: bool = False) -> DataFrame:
    """Part rows of ``(path, content)``; ``reader(zip)`` yields dicts of part columns.

    A container that cannot be opened or read becomes one row with ``error`` and the task goes on;
    with ``whole`` such a file gives nothing else.
    """
    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                path = path.as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        found = list(reader(z)) if whole else reader(z)
                        for n, row in enumerate(found):
                            rows.append({"part_ord": n, **row, "path": path})
                            held += weight(row)
                            if len(rows) >= _BATCH_ROWS or held >= SLICE_BYTES:
                                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                                rows, held = [], 0
                except Exception as e:  # any malformed container is data, not a task failure
                    rows.append({"path": path, "part_ord": -1, "kind": "error", "error": f"extract_error: {e}"})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, PART_SCHEMA)


def _xml(z, name):
    """Parsed part, or None if it is missing or malformed."""
    try:
        return ET.fromstring(z.read(name))
    except (KeyError, ET.ParseError):
        return None


def _rels(z, part):
    """(id, type, target) of a part's relationships, found whatever the case of the entry name."""
    folder, _, leaf = part.rpartition("/")
    wanted = f"{folder}/_rels/{leaf}.rels".lower().lstrip("/")
    for entry in z.namelist():
        if entry.lower() == wanted:
            root = _xml(z, entry)
            if root is not None:
                return [(r.get("Id", ""), r.get("Type", ""), r.get("Target", "")) for r in root.iter(PKG + "Relationship")]
    return []


def _drawing_text(elem):
    return "\n".join(t.text for t in elem.iter(A + "t") if t.text)


# ------------------------------------------------------------------------------------- workbooks
def read_workbook(z):
    """Rows of kind sheet, row, shape, graphic, chart, smartart, comment and thread."""
    actual = {n.lower(): n for n in z.namelist()}
    sheets, part_ord = _sheets(z), 0
    links = [
        {"sheet": name, "base": part, "target": target, "type": kind}
        for name, part in sheets for _, kind, target in _rels(z, part)
    ]
    try:
        strings, dates, epoch = _strings(z, actual), _date_styles(z, actual), _epoch(z)
        for name, part in sheets:
            if part not in actual:
                continue
            yield {"part_ord": part_ord, "part": part, "kind": "sheet", "sheet": name, "row": 0}
            with z.open(actual[part]) as stream:
                for row, items in _sheet_rows(stream, strings, dates, epoch):
                    yield {"part_ord": part_ord, "part": part, "kind": "row", "sheet": name, "row": row, "items": items}
            part_ord += 1
    except Exception:  # damaged cells must not hide the other parts
        part_ord += 1

    names = people(z, actual)
    for entry in z.namelist():
        if not entry.lower().endswith(".xml"):
            continue
        for kind, items, authors in _object_items(z, entry):
            yield {"part_ord": part_ord, "part": entry, "kind": kind, "row": 0, "items": items, "links": links,
                   "people": list(names.items()), "authors": authors}
            part_ord += 1


def people(z, actual):
    """Display names of a workbook's persons by id."""
    return {
        p.get("id"): p.get("displayName", "")
        for low, entry in actual.items() if low.startswith("xl/persons/") and low.endswith(".xml")
        for root in [_xml(z, entry)] if root is not None
        for p in root.iter(TC + "person") if p.get("id")
    }


def _sheets(z):
    book = _xml(z, "xl/workbook.xml")
    if book is None:
        return []
    targets = {rid: t for rid, _, t in _rels(z, "xl/workbook.xml")}
    out = []
    for s in book.iterfind(f"{SS}sheets/{SS}sheet"):
        target = targets.get(s.get(REL_ID, ""), "")
        if s.get("name") and target:
            out.append((s.get("name"), (target.lstrip("/") if target[0] == "/" else "xl/" + target).lower()))
    return out


def _rich_text(si):
    """Plain runs of a string item, without phonetic guides."""
    runs = [si] + si.findall(SS + "r")
    return "".join(t.text or "" for run in runs for t in run.findall(SS + "t"))


def _strings(z, actual):
    if "xl/sharedstrings.xml" not in actual:
        return []
    out = []
    with z.open(actual["xl/sharedstrings.xml"]) as stream:
        for _, el in ET.iterparse(stream):
            if el.tag == SS + "si":
                out.append(_rich_text(el))
                el.clear()
    return out


def _date_styles(z, actual):
    """Style index -> 'date' or 'span' for cells whose number format shows a point or length of time."""
    root = _xml(z, actual.get("xl/styles.xml", ""))
    if root is None:
        return {}
    custom = {int(f.get("numFmtId", -1)): f.get("formatCode", "") for f in root.iter(SS + "numFmt")}
    out = {}
    for i, xf in enumerate(root.iterfind(f"{SS}cellXfs/{SS}xf")):
        fid = int(xf.get("numFmtId", 0))
        code = custom.get(fid, "[h]:mm:ss" if fid == 46 else "d" if fid in DATE_FORMAT_IDS else "")
        if re.search(r"\[(h+|m+|s+)\]", code, re.I):
            out[i] = "span"
        elif re.search(r"[dmhys]", re.sub(r'\[[^\]]*\]|"[^"]*"|\\.|_.|general', "", code.split(";")[0], flags=re.I), re.I):
            out[i] = "date"
    return out


def _epoch(z):
    book = _xml(z, "xl/workbook.xml")
    props = book.find(SS + "workbookPr") if book is not None else None
    is_1904 = props is not None and props.get("date1904") in ("1", "true")
    return dt.datetime(1904, 1, 1) if is_1904 else dt.datetime(1899, 12, 30)


def _moment(number, how, epoch):
    days, part = divmod(number, 1)
    rest = dt.timedelta(milliseconds=round(part * 86_400_000))
    if how == "span":
        return str(dt.timedelta(days=days) + rest)
    if 0 <= number < 1 and rest.days == 0:
        return str((dt.datetime.min + rest).time())
    if 0 < days < 60 and epoch.year == 1899:
        days += 1
    return str(epoch + dt.timedelta(days=days) + rest)


def _cell_text(cell, strings, dates, epoch):
    kind, raw = cell.get("t", "n"), cell.findtext(SS + "v")
    if kind == "inlineStr":
        inline = cell.find(SS + "is")
        return None if inline is None else _rich_text(inline)
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return str(raw.strip() not in ("0", "false"))
    if kind != "n":
        return raw
    number = float(raw) if re.search(r"[.eE]", raw) else int(raw)
    how = dates.get(int(cell.get("s", 0)))
    return _moment(number, how, epoch) if how else str(number)


def _sheet_rows(stream, strings, dates, epoch):
    at = 0
    for _, row in ET.iterparse(stream):
        if row.tag != SS + "row":
            continue
        at = int(row.get("r", at + 1))
        col, items = 0, []
        for cell in row.findall(SS + "c"):
            ref = cell.get("r")
            col = _column_number(ref) if ref else col + 1
            items.append({"ord": col, "ref": ref or f"{_letters(col)}{at}", "text": _cell_text(cell, strings, dates, epoch)})
        row.clear()
        yield at, items


def _column_number(ref):
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n


def _letters(col):
    first, last = divmod(col - 1, 26)
    return (_letters(first) if first else "") + chr(65 + last)


def object_kind(entry):
    """What objects an entry holds: drawing, chart, smartart, thread or comment; None if it is another part."""
    low = entry.lower()
    kinds = {
        "xl/drawings/drawing": "drawing", "xl/charts/chart": "chart", "xl/diagrams/": "smartart",
        "xl/threadedcomments/threadedcomment": "thread", "xl/comments": "comment",
    }
    return next((k for prefix, k in kinds.items() if low.startswith(prefix) and low.endswith(".xml")), None)


def _object_items(z, entry):
    """(kind, items, authors) of one drawing, chart, diagram or comments part."""
    kind = object_kind(entry)
    root = _xml(z, entry) if kind else None
    if root is None:
        return
    if kind == "drawing":
        for sub, tag, wrapper in (("shape", "sp", "nvSpPr"), ("graphic", "graphicFrame", "nvGraphicFramePr")):
            yield sub, [
                {"ord": i, "name": props.get("name") if props is not None else None, "text": _drawing_text(el)}
                for i, el in enumerate(root.iter(XDR + tag))
                for props in [el.find(f"{XDR}{wrapper}/{XDR}cNvPr")]
            ], None
    elif kind in ("chart", "smartart"):
        yield kind, [{"ord": 0, "text": _drawing_text(root)}], None
    elif kind == "thread":
        yield kind, [
            {"ord": i, "ref": c.get("ref"), "who": c.get("personId"), "parent": c.get("parentId"),
             "text": c.findtext(TC + "text")}
            for i, c in enumerate(root.iter(TC + "threadedComment"))
        ], None
    else:
        yield kind, [
            {"ord": i, "ref": c.get("ref"), "who": c.get("authorId"),
             "text": "".join(t.text or "" for t in c.iter(SS + "t"))}
            for i, c in enumerate(root.iterfind(f"{SS}commentList/{SS}comment"))
        ], [a.text or "" for a in root.iterfind(f"{SS}authors/{SS}author")]


# --------------------------------------------------------------------------- documents and slides
def _paragraphs(root, para, run_text, skip=()):
    """Text of the paragraphs below ``root`` in order, leaving out the ``skip`` subtrees."""
    def text_of(el):
        if el.tag in skip:
            return ""
        own = (el.text or "") if el.tag == run_text else {"tab": "\t", "br": "\x0b", "cr": "\x0b"}.get(el.tag.rpartition("}")[2], "")
        return own + "".join(map(text_of, el))

    def walk(el):
        for child in el:
            if child.tag in skip:
                continue
            if child.tag == para:
                yield "".join(map(text_of, child))
            else:
                yield from walk(child)

    return list(walk(root))


def read_document(z):
    """Rows of kind body, header, footer, textbox and note-like comment of a word document."""
    root = ET.fromstring(z.read("word/document.xml"))
    hidden = (W + "txbxContent", W + "pPrChange", W + "tabs", MC + "Fallback", W + "del")
    para = lambda el: "\r".join(_paragraphs(el, W + "p", W + "t", hidden))
    yield {"part": "word/document.xml", "kind": "body", "items": [{"ord": 0, "text": para(root.find(W + "body"))}]}

    parts = {rid: "word/" + target for rid, _, target in _rels(z, "word/document.xml")}
    inherited = {}
    for number, section in enumerate(root.iter(W + "sectPr"), 1):
        for ref in section:
            if ref.tag in (W + "headerReference", W + "footerReference"):
                inherited[ref.tag[len(W):-len("Reference")], ref.get(W + "type")] = parts.get(ref.get(REL_ID))
        for kind in ("header", "footer"):
            found = [(t, p) for (k, t), p in sorted(inherited.items()) if k == kind]
            texts = [para(el) for _, p in found for el in [_xml(z, p or "")] if el is not None]
            yield {"part": kind, "kind": kind, "row": number, "items": [{"ord": i, "text": t} for i, t in enumerate(texts)]}

    boxes = []
    for anchor in [*root.iter(WP + "anchor"), *root.iter(WP + "inline")]:
        props = anchor.find(WP + "docPr")
        for box in anchor.iter(W + "txbxContent"):
            boxes.append({"ord": len(boxes), "name": props.get("name") if props is not None else None, "text": para(box)})
    yield {"part": "word/document.xml", "kind": "textbox", "items": boxes}

    notes = _xml(z, "word/comments.xml")
    if notes is not None:
        yield {"part": "word/comments.xml", "kind": "note", "items": [
            {"ord": i, "who": c.get(W + "author"), "text": para(c)} for i, c in enumerate(notes.iter(W + "comment"), 1)
        ]}


def read_slides(z):
    """Rows of kind slide and notes of a presentation, one per slide."""
    show = ET.fromstring(z.read("ppt/presentation.xml"))
    targets = {rid: "ppt/" + t for rid, _, t in _rels(z, "ppt/presentation.xml")}
    first = int(show.get("firstSlideNum", 1))

    def shapes(part):
        root = _xml(z, part)
        tree = root.find(f"{P}cSld/{P}spTree") if root is not None else None
        for i, sp in enumerate(tree.findall(P + "sp") if tree is not None else ()):
            props, body = sp.find(f"{P}nvSpPr/{P}cNvPr"), sp.find(P + "txBody")
            if body is not None:
                yield {"ord": i, "name": props.get("name") if props is not None else None,
                       "text": "\r".join(_paragraphs(body, A + "p", A + "t"))}

    for number, slide in enumerate(show.iterfind(f"{P}sldIdLst/{P}sldId"), first):
        part = targets.get(slide.get(REL_ID), "")
        yield {"part": part, "kind": "slide", "row": number, "items": list(shapes(part))}
        for _, kind, target in _rels(z, part):
            if kind.endswith("/notesSlide"):
                yield {"part": target, "kind": "notes", "row": number,
                       "items": list(shapes("ppt/" + target.removeprefix("../")))}
