"""Word packages as tables: paragraphs, images, styles, media, counts.

A package is one binary value; one pass over its document part yields rows, in a Python
worker since no built-in reads XML by ancestry.  A package that cannot be read becomes a row
with an error and never fails its task.
"""

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import ship

# --- fixed values: namespaces of the format ---
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
V = "{urn:schemas-microsoft-com:vml}"
ASVG = "{http://schemas.microsoft.com/office/drawing/2016/SVG/main}"
MATH_MARK = ""

PARAGRAPHS = "ms_id string, idx int, text string, style string, in_table boolean, bold_share double, has_drawing boolean, error string"
IMAGES = "ms_id string, img_ord int, para_index int, rid string, filename string, svg_filename string, width_emu long, height_emu long, anchored boolean, alt_text string, in_table boolean"

# --- fixed values: tags that are counted in the document part ---
COUNTED = {
    "pictures": r"<pic:pic[\s>]|<v:imagedata[\s>]", "svg_originals": r"<asvg:svgBlip", "formulas": r"<m:oMath[\s>]", "display_formulas": r"<m:oMathPara[\s>]", "tables": r"<w:tbl[\s>]",
    "drawings": r"<w:drawing[\s>]", "pict": r"<w:pict[\s>]", "ole_objects": r"<o:OLEObject", "mathtype_objects": r'ProgID="(?:Equation|MathType)', "paragraphs": r"<w:p[\s>]",
    "footnote_refs": r"<w:footnoteReference", "citation_fields": r"ADDIN (?:ZOTERO_ITEM|CSL_CITATION|EN\.CITE)",
}


def packages(spark: SparkSession, folder: str, glob: str = "*.docx") -> DataFrame:
    """A-19: path and content of every package below a folder; editors' lock files are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return found.where(~F.substring_index("path", "/", -1).startswith("~$")).select(F.col("path").alias("ms_id"), "content")


def _part(z: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        return z.read(name)
    except KeyError:
        return None


def relationships(z: zipfile.ZipFile) -> dict[str, str]:
    """A-05: relationship id to media file."""
    data = _part(z, "word/_rels/document.xml.rels")
    rels = ET.fromstring(data) if data else []
    return {e.get("Id", ""): e.get("Target", "").split("media/", 1)[1] for e in rels if "media/" in e.get("Target", "")}


def style_names(z: zipfile.ZipFile) -> dict[str, str]:
    """A-06: style id to name."""
    data = _part(z, "word/styles.xml")
    if not data:
        return {}
    return {s.get(W + "styleId", ""): (s.find(W + "name").get(W + "val", "") if s.find(W + "name") is not None else "") for s in ET.fromstring(data).iter(W + "style")}


class Scan:
    """A-01 to A-04: one descent; what stands in a paragraph inside a paragraph belongs to the inner one."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.rels, self.styles = relationships(z), style_names(z)
            self.media = sorted(n.split("media/", 1)[1] for n in z.namelist() if n.startswith("word/media/"))
            root = ET.fromstring(z.read("word/document.xml"))
        self.paragraphs: list[dict] = []
        self.images: list[dict] = []
        body = root.find(W + "body")
        if body is not None:
            self._descend(body, None, False, None, None)

    def _descend(self, node, paragraph: dict | None, in_table: bool, frame, run: dict | None) -> None:
        for child in node:
            tag = child.tag
            inner, table, around, here = paragraph, in_table or tag == W + "tbl", frame, run
            if tag == W + "p":
                style = child.find(f"{W}pPr/{W}pStyle")
                sid = style.get(W + "val", "") if style is not None else ""
                inner = {"idx": len(self.paragraphs), "text": [], "style": self.styles.get(sid, sid), "in_table": in_table, "runs": 0, "bold": 0, "drawing": False}
                self.paragraphs.append(inner)
                around = here = None
            elif tag == W + "r" and paragraph is not None:
                bold = child.find(f"{W}rPr/{W}b")
                here = {"bold": bold is not None and bold.get(W + "val") not in ("0", "false"), "counted": False}
            elif tag in (WP + "inline", WP + "anchor"):
                around = child
            if paragraph is not None:
                if tag == W + "t":
                    paragraph["text"].append(child.text or "")
                    if run is not None and not run["counted"]:
                        run["counted"] = True
                        paragraph["runs"] += 1
                        paragraph["bold"] += run["bold"]
                elif tag == W + "tab" and run is not None:
                    paragraph["text"].append("\t")
                elif tag in (W + "br", W + "cr"):
                    paragraph["text"].append(" ")
                elif tag == M + "oMath":
                    paragraph["text"].append(MATH_MARK)
                elif tag in (W + "drawing", W + "pict"):
                    paragraph["drawing"] = True
                elif tag == A + "blip":
                    self._picture(child, paragraph, frame)
                elif tag == V + "imagedata" and child.get(R + "id", "") in self.rels:
                    self._image(child.get(R + "id"), paragraph, alt=child.get(V + "title") or child.get("title") or "")
            self._descend(child, inner, table, around, here)

    def _picture(self, blip, paragraph: dict, frame) -> None:
        rid = blip.get(R + "embed") or blip.get(R + "link") or ""
        if rid not in self.rels:
            return
        extent = frame.find(WP + "extent") if frame is not None else None
        about = frame.find(WP + "docPr") if frame is not None else None
        size = lambda k: int(extent.get(k) or 0) if extent is not None else 0
        svg = next((self.rels[x] for b in blip.iter(ASVG + "svgBlip") if (x := b.get(R + "embed") or b.get(R + "link") or "") in self.rels), "")
        self._image(rid, paragraph, svg, size("cx"), size("cy"), frame is not None and frame.tag == WP + "anchor", (about.get("descr") or "") if about is not None else "")

    def _image(self, rid: str, paragraph: dict, svg: str = "", width: int = 0, height: int = 0, anchored: bool = False, alt: str = "") -> None:
        self.images.append({"img_ord": len(self.images), "para_index": paragraph["idx"], "rid": rid, "filename": self.rels[rid], "svg_filename": svg, "width_emu": width, "height_emu": height, "anchored": anchored, "alt_text": alt, "in_table": paragraph["in_table"]})


def _scan_all(packages_: DataFrame, rows_of, schema: str) -> DataFrame:
    ship(packages_.sparkSession)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [row for ms_id, content in zip(batch["ms_id"], batch["content"]) for row in rows_of(ms_id, content)]
            yield pd.DataFrame(rows, columns=names)

    return packages_.select("ms_id", "content").mapInPandas(run, schema)


def _paragraph_rows(ms_id, content):
    try:
        for p in Scan(bytes(content)).paragraphs:
            yield (ms_id, p["idx"], "".join(p["text"]), p["style"], p["in_table"], p["bold"] / p["runs"] if p["runs"] else 0.0, p["drawing"], None)
    except Exception as e:  # a damaged package is a row that says so
        yield (ms_id, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])


def _image_rows(ms_id, content):
    try:
        for i in Scan(bytes(content)).images:
            yield (ms_id, *i.values())
    except Exception:  # reported by the paragraphs of the same package
        return


def paragraphs(packages_: DataFrame) -> DataFrame:
    """A-01 to A-04, A-06: every paragraph in reading order; a package that cannot be read has one row with an error."""
    return _scan_all(packages_, _paragraph_rows, PARAGRAPHS)


def images(packages_: DataFrame) -> DataFrame:
    """A-01, A-05: every use of an image in reading order, with its file and placed size."""
    return _scan_all(packages_, _image_rows, IMAGES)


def _media_rows(ms_id, content):
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
            for name in sorted(z.namelist()):
                if name.startswith("word/media/"):
                    yield (ms_id, name.split("media/", 1)[1], z.read(name))
    except Exception:
        return


def media(packages_: DataFrame) -> DataFrame:
    """A-08: ms_id, filename, data of every media file, used or not."""
    return _scan_all(packages_, _media_rows, "ms_id string, filename string, data binary")


def orphans(media_: DataFrame, images_: DataFrame) -> DataFrame:
    """A-07: media that no image uses."""
    used = images_.select("ms_id", "filename").union(images_.where("svg_filename <> ''").select("ms_id", F.col("svg_filename").alias("filename"))).distinct()
    return media_.join(used, ["ms_id", "filename"], "left_anti")


def _part_rows(ms_id, content):
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
            for name in sorted(z.namelist()):
                if name.endswith((".xml", ".rels")):
                    yield (ms_id, name, z.read(name).decode("utf-8", "ignore"))
    except Exception:
        return


def parts(packages_: DataFrame) -> DataFrame:
    """ms_id, name, xml of every XML part."""
    return _scan_all(packages_, _part_rows, "ms_id string, name string, xml string")


def source_counts(parts_: DataFrame) -> DataFrame:
    """A-11, N-14: what the document part holds, counted by its tags alone, apart from any parser."""
    xml = parts_.where("name = 'word/document.xml'")
    return xml.select("ms_id", *[F.regexp_count("xml", F.lit(p)).cast("long").alias(n) for n, p in COUNTED.items()])


def core_title(parts_: DataFrame) -> DataFrame:
    """A-14: ms_id, title of the document's own properties, '' where it has none."""
    found = F.regexp_extract("xml", r"(?s)<dc:title>(.*?)</dc:title>", 1)
    return parts_.where("name = 'docProps/core.xml'").select("ms_id", F.trim(F.regexp_replace(found, r"<[^>]+>", "")).alias("title"))


def templates(parts_: DataFrame) -> DataFrame:
    """A-13, N-13: default font and size, page, columns of each section and line numbers of a template."""
    attribute = lambda tag, name: F.regexp_extract(F.col("xml"), rf'<w:{tag}\b[^>]*\bw:{name}="([^"]*)"', 1)
    document = parts_.where("name = 'word/document.xml'").select(
        "ms_id", F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<w:sectPr\b(.*?)</w:sectPr>"), 1), lambda s: F.coalesce(F.nullif(F.regexp_extract(s, r'<w:cols\b[^>]*\bw:num="(\d+)"', 1), F.lit("")).try_cast("int"), F.lit(1))).alias("columns"),
        (attribute("pgSz", "w").try_cast("int") / 1440 * 25.4).alias("page_width_mm"), (attribute("pgMar", "left").try_cast("int") / 1440 * 25.4).alias("margin_left_mm"), (attribute("pgMar", "right").try_cast("int") / 1440 * 25.4).alias("margin_right_mm"),
        F.contains("xml", F.lit("<w:lnNumType")).alias("line_numbers"),
    )
    styles = parts_.where("name = 'word/styles.xml'").select(
        "ms_id", F.regexp_extract("xml", r'(?s)<w:docDefaults>.*?<w:rFonts\b[^>]*\bw:ascii="([^"]*)"', 1).alias("font"), (F.regexp_extract("xml", r'(?s)<w:docDefaults>.*?<w:sz\s+w:val="(\d+)"', 1).try_cast("int") / 2).alias("size_pt"),
        F.regexp_extract_all("xml", F.lit(r'<w:style\b[^>]*\bw:styleId="([^"]*)"'), 1).alias("style_ids"),
    )
    return document.join(styles, "ms_id", "left")


def image_size(data: Column) -> Column:
    """A-23: struct of format and pixels of PNG, GIF, BMP and JPEG files by their headers; nulls for anything else."""

    def sizes(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(d) for d in values], columns=["format", "width_px", "height_px"]).astype({"format": object, "width_px": "Int32", "height_px": "Int32"})

    return F.pandas_udf(sizes, "format string, width_px int, height_px int")(data)


def measure(data: bytes | None) -> tuple:
    try:
        if data is None:
            return None, None, None
        data = bytes(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("png", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return "bmp", width, abs(height)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(data):
                marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", width, height
                at += 2 + length
    except struct.error:
        pass
    return None, None, None


def package(texts: list[str], styles: list[str] | None = None, title: str = "") -> bytes:
    """The smallest package with these paragraphs: for tests, and for round trips of the scanner."""
    from xml.sax.saxutils import escape

    clean = lambda s: escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", s))
    rows = "".join(f'<w:p>{f"""<w:pPr><w:pStyle w:val="{clean(s)}"/></w:pPr>""" if s else ""}<w:r><w:t xml:space="preserve">{clean(t)}</w:t></w:r></w:p>' for t, s in zip(texts, styles or [""] * len(texts)))
    names = sorted({s for s in styles or [] if s})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{rows}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W[1:-1]}">' + "".join(f'<w:style w:styleId="{clean(n)}"><w:name w:val="{clean(n)}"/></w:style>' for n in names) + "</w:styles>")
        z.writestr("docProps/core.xml", f'<cp xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{clean(title)}</dc:title></cp>')
    return out.getvalue()


def packed(text: Column) -> Column:
    """A package whose paragraphs are the lines of a text."""

    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([package((t or "").split("\n")) for t in texts], dtype=object)

    return F.pandas_udf(pack, "binary")(text)



def without_paragraphs(packages_: DataFrame, removals: DataFrame) -> DataFrame:
    """L-22: packages (ms_id, content) without the paragraphs that ``removals`` (ms_id, idx) names; all other parts byte for byte.

    A table cell keeps one empty paragraph, as the format asks.  Packages with nothing to
    remove are not opened; one that cannot be read stays as it is.
    """
    ship(packages_.sparkSession)
    wanted = removals.groupBy("ms_id").agg(F.collect_set("idx").alias("idx"))

    def rewrite(contents: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([c if g is None else _rewritten(bytes(c), {int(i) for i in g}) for c, g in zip(contents, gone)], dtype=object)

    joined = packages_.join(wanted, "ms_id", "left")
    return joined.select("ms_id", F.when(F.col("idx").isNull(), F.col("content")).otherwise(F.pandas_udf(rewrite, "binary")("content", "idx")).alias("content"))


def _rewritten(content: bytes, gone: set[int]) -> bytes:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            parts_ = {n: z.read(n) for n in z.namelist()}
        data = parts_["word/document.xml"]
        for prefix, uri in (e for _, e in ET.iterparse(io.BytesIO(data), events=["start-ns"])):
            ET.register_namespace(prefix, uri)
        root = ET.fromstring(data)
        above = {child: parent for parent in root.iter() for child in parent}
        for n, paragraph in enumerate(list(root.find(W + "body").iter(W + "p"))):
            if n in gone:
                parent = above[paragraph]
                if parent.tag == W + "tc" and len(parent.findall(W + "p")) == 1:
                    for child in list(paragraph):
                        paragraph.remove(child)
                else:
                    parent.remove(paragraph)
        parts_["word/document.xml"] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    except Exception:  # the caller sees it as it was, and the scan reports it
        return content
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts_.items():
            z.writestr(name, part)
    return out.getvalue()
