"""Office packages written from the given tables, one per conversation or document, inside tasks."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linetrawl.functions.batches import SLICE_BYTES
from linetrawl.plans import fixtures as fx
from linetrawl.sources.office import REL_COMMENTS, REL_DRAWING, REL_THREADS
from linetrawl.sources.packages import A, P, PKG, REL_ID, SS, TC, W, WP, XDR

R = REL_ID[1:-3]
REL_SHEET = R + "/worksheet"


def _ns(**prefixes):
    return " ".join(f'xmlns{":" + k if k != "x" else ""}="{v.strip("{}")}"' for k, v in prefixes.items())


def _rels(*entries):
    rows = "".join(f'<Relationship Id="{i}" Type="{t}" Target="{target}"/>' for i, t, target in entries)
    return f"<Relationships {_ns(x=PKG)}>{rows}</Relationships>"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def _paras(text, tag, run):
    return "".join(f"<{tag}>{run.format(escape(line))}</{tag}>" for line in text.split("\n"))


def _workbook(row) -> bytes:
    roles = sorted({t["role"] for t in row["turns"]})
    parts, strings = {}, []
    parts["xl/workbook.xml"] = f"<workbook {_ns(x=SS, r='{' + R + '}')}><sheets>" + "".join(
        f"<sheet name={quoteattr(role)} sheetId=\"{i}\" r:id=\"rId{i}\"/>" for i, role in enumerate(roles, 1)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = _rels(*[(f"rId{i}", REL_SHEET, f"worksheets/sheet{i}.xml") for i in range(1, len(roles) + 1)])
    for i, role in enumerate(roles, 1):
        mine = [t for t in row["turns"] if t["role"] == role]
        cells, notes, threads, shapes = "", "", "", ""
        for t in mine:
            r, text = t["turn"] + 1, t["text"]
            if t["turn"] % 2:
                body = f'<c r="B{r}" t="inlineStr"><is><r><t>{escape(text[:9])}</t></r><r><t>{escape(text[9:])}</t></r></is></c>'
            else:
                strings.append(text)
                body = f'<c r="B{r}" t="s"><v>{len(strings) - 1}</v></c>'
            cells += (f'<row r="{r}"><c r="A{r}"><v>{t["turn"]}</v></c>{body}<c r="C{r}" t="b"><v>{int(t["turn"] % 3 == 0)}</v></c>'
                      f'<c r="D{r}" s="0"/></row>')
            notes += (f'<comment ref="B{r}" authorId="0"><text><r><t>{escape(text[:5])}</t></r><r><t>{escape(text[5:])}</t></r></text></comment>')
            parent = ' parentId="{0}"' if t["turn"] else ""
            threads += f'<threadedComment ref="C{r}" personId="{{{role}}}" id="{{{r}}}"{parent}><text>{escape(text)}</text></threadedComment>'
            name = "" if t["turn"] % 4 == 3 else f' name="box {t["turn"]}"'
            lines = "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in text.split("\n"))
            shapes += f'<xdr:sp><xdr:nvSpPr><xdr:cNvPr id="{r}"{name}/></xdr:nvSpPr><xdr:txBody>{lines}</xdr:txBody></xdr:sp>'
        frame = (f'<xdr:graphicFrame><xdr:nvGraphicFramePr><xdr:cNvPr id="1" name="frame"/></xdr:nvGraphicFramePr>'
                 f'<a:graphic><a:t>figure of {escape(role)}</a:t></a:graphic></xdr:graphicFrame>')
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {_ns(x=SS)}><sheetData>{cells}</sheetData></worksheet>"
        parts[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = _rels(
            ("a", REL_DRAWING, f"../drawings/drawing{i}.xml"), ("b", REL_COMMENTS, f"../comments{i}.xml"),
            ("c", REL_THREADS, f"../threadedComments/threadedComment{i}.xml"))
        parts[f"xl/drawings/drawing{i}.xml"] = f"<xdr:wsDr {_ns(xdr=XDR, a=A)}>{shapes}{frame}</xdr:wsDr>"
        parts[f"xl/comments{i}.xml"] = (f"<comments {_ns(x=SS)}><authors><author>{escape(role)}</author></authors>"
                                        f"<commentList>{notes}</commentList></comments>")
        parts[f"xl/threadedComments/threadedComment{i}.xml"] = f"<ThreadedComments {_ns(x=TC)}>{threads}</ThreadedComments>"
    parts["xl/sharedStrings.xml"] = f"<sst {_ns(x=SS)}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>"
    parts["xl/persons/person.xml"] = f'<personList {_ns(x=TC)}><person id="{{user}}" displayName="User Name"/></personList>'
    parts["xl/charts/chart1.xml"] = f'<c:chart xmlns:c="urn:c" {_ns(a=A)}><a:t>chart {row["key"]}</a:t><a:t>axis</a:t></c:chart>'
    parts["xl/diagrams/data1.xml"] = f'<d:data xmlns:d="urn:d" {_ns(a=A)}><a:t>node {row["key"]}</a:t></d:data>'
    return _zip(parts)


def _document(row) -> bytes:
    run = "<w:r><w:t>{}</w:t></w:r>"
    body = _paras(row["text"], "w:p", run)
    box = f'<w:p><w:r><w:drawing><wp:anchor><wp:docPr id="1" name="box"/><w:txbxContent>{_paras(row["lang"], "w:p", run)}</w:txbxContent></wp:anchor></w:drawing></w:r></w:p>'
    section = '<w:sectPr><w:headerReference w:type="default" r:id="h"/><w:footerReference w:type="default" r:id="f"/></w:sectPr>'
    names = _ns(w=W, wp=WP, r="{" + R + "}")
    return _zip({
        "word/document.xml": f"<w:document {names}><w:body>{body}{box}{section}</w:body></w:document>",
        "word/_rels/document.xml.rels": _rels(("h", R + "/header", "header1.xml"), ("f", R + "/footer", "footer1.xml")),
        "word/header1.xml": f"<w:hdr {names}>{_paras('head ' + row['source'], 'w:p', run)}</w:hdr>",
        "word/footer1.xml": f"<w:ftr {names}>{_paras('foot ' + row['lang'], 'w:p', run)}</w:ftr>",
        "word/comments.xml": f'<w:comments {names}><w:comment w:author={quoteattr(row["source"])}>{_paras("note " + row["lang"], "w:p", run)}</w:comment></w:comments>',
    })


def _slides(row) -> bytes:
    names = _ns(p=P, a=A, r="{" + R + "}")
    parts, order, links = {}, "", []
    for n, t in enumerate(row["turns"], 1):
        def shape(name, text):
            return (f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/></p:nvSpPr><p:txBody>'
                    f'{_paras(text, "a:p", "<a:r><a:t>{}</a:t></a:r>")}</p:txBody></p:sp>')
        order += f'<p:sldId id="{n}" r:id="s{n}"/>'
        links.append((f"s{n}", R + "/slide", f"slides/slide{n}.xml"))
        parts[f"ppt/slides/slide{n}.xml"] = f'<p:sld {names}><p:cSld><p:spTree>{shape("", t["text"])}{shape("Role", t["role"])}</p:spTree></p:cSld></p:sld>'
        parts[f"ppt/slides/_rels/slide{n}.xml.rels"] = _rels(("n", R + "/notesSlide", f"../notesSlides/notesSlide{n}.xml"))
        parts[f"ppt/notesSlides/notesSlide{n}.xml"] = f'<p:notes {names}><p:cSld><p:spTree>{shape("N", "said by " + t["role"])}</p:spTree></p:cSld></p:notes>'
    parts["ppt/presentation.xml"] = f"<p:presentation {names}><p:sldIdLst>{order}</p:sldIdLst></p:presentation>"
    parts["ppt/_rels/presentation.xml.rels"] = _rels(*links)
    return _zip(parts)


def _lines_in_cells(row) -> bytes:
    """A workbook with a line of the text in each row."""
    cells = "".join(f'<row r="{n}"><c r="A{n}" t="inlineStr"><is><t>{escape(line)}</t></is></c></row>' for n, line in enumerate(row["text"].split("\n"), 1) if line)
    return _zip({
        "xl/workbook.xml": f"<workbook {_ns(x=SS, r='{' + R + '}')}><sheets><sheet name=\"Lines\" sheetId=\"1\" r:id=\"rId1\"/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _rels(("rId1", REL_SHEET, "worksheets/sheet1.xml")),
        "xl/worksheets/sheet1.xml": f"<worksheet {_ns(x=SS)}><sheetData>{cells}</sheetData></worksheet>",
    })


def _lines_in_paragraphs(row) -> bytes:
    body = _paras(row["text"], "w:p", "<w:r><w:t>{}</w:t></w:r>")
    return _zip({"word/document.xml": f"<w:document {_ns(w=W)}><w:body>{body}</w:body></w:document>"})


def scan_v(spark, sf_dir):
    """``content_v`` with real packages where the extension says so; every fifth one is damaged, being plain text."""
    files = fx.documents(spark, sf_dir)
    package = (F.col("path").endswith(".xlsx") | F.col("path").endswith(".docx")) & (F.col("file_ord") % 5 != 0)
    build = lambda row: (_lines_in_cells if row["path"].endswith(".xlsx") else _lines_in_paragraphs)(row)
    packed = _write(files.filter(package).select("path", F.coalesce("text", F.lit("")).alias("text")), build)
    return fx.as_content(files.filter(~package)).select("path", "content").unionByName(packed)


def _write(rows: DataFrame, build) -> DataFrame:
    def run(batches):
        for batch in batches:
            paths, packages, held = [], [], 0
            for i in range(batch.num_rows):  # a row at a time, handed on before many packages are held
                row = batch.slice(i, 1).to_pylist()[0]
                paths.append(row["path"])
                packages.append(build(row))
                held += len(packages[-1])
                if held >= SLICE_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(packages, pa.binary())], names=["path", "content"])
                    paths, packages, held = [], [], 0
    return rows.mapInArrow(run, "path string, content binary")


def _conversations(spark, sf_dir, ext):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return fx.spread(fx.table(spark, sf_dir, "conversations"), "conv_id").groupBy("conv_id").agg(turns.alias("turns")).select(
        F.concat(F.lit("/office/conv"), "conv_id", F.lit(ext)).alias("path"), F.col("conv_id").alias("key"), "turns")


def books_v(spark, sf_dir):
    return _write(_conversations(spark, sf_dir, ".xlsx"), _workbook)


def slides_v(spark, sf_dir):
    return _write(_conversations(spark, sf_dir, ".pptx"), _slides)


def letters_v(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select(
        F.concat(F.lit("/office/doc"), "file_ord", F.lit(".docx")).alias("path"), "text", "lang", "source")
    return _write(docs, _document)
