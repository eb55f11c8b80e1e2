"""A reader's JSON document trees as tables: blocks with runs, cells, issues.

The tree format is that of the common open document converter: ``{"blocks": [{"t": type, "c": content}]}``.
Its recursion is walked in a Python worker, once a document; what comes out is flat.  A tree
that cannot be read is an issue row and never fails its task.
"""

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import ship

RUN = "kind:string,text:string,bold:boolean,italic:boolean,superscript:boolean,subscript:boolean,smallcaps:boolean,code:boolean,display:boolean,url:string,target_id:string,ref_ids:array<string>"
RUN_FIELDS = [f.split(":")[0] for f in RUN.replace("array<string>", "array").split(",")]
ROWS = f"ms_id string, seq int, record string, kind string, level int, text string, inlines array<struct<{RUN}>>, parent int, item int, row int, col int, rowspan int, colspan int, align string, severity string, code string"
FIELDS = [f.split()[0] for f in ROWS.replace(RUN, "x").split(", ")]
STYLES = {"Strong": "bold", "Emph": "italic", "Superscript": "superscript", "Subscript": "subscript", "SmallCaps": "smallcaps"}
ALIGN = {"AlignLeft": "left", "AlignCenter": "center", "AlignRight": "right"}
QUOTES = {"DoubleQuote": "“”", "SingleQuote": "‘’"}


def runs(nodes: list, style: dict | None = None) -> list[dict]:
    """B-02: flat runs; marks of enclosing nodes are pushed down to them."""
    style, out = style or {}, []

    def add(kind: str, text: str = "", **more) -> None:
        if text or kind != "text":
            out.append({"kind": kind, "text": text, **style, **more})

    for node in nodes:
        kind, content = node.get("t"), node.get("c")
        if kind == "Str":
            add("text", content)
        elif kind == "Space":
            add("text", " ")
        elif kind in ("SoftBreak", "LineBreak"):
            out.append({"kind": "break", "text": ""})
        elif kind in STYLES:
            out += runs(content, {**style, STYLES[kind]: True})
        elif kind in ("Strikeout", "Underline"):
            out += runs(content, style)
        elif kind == "Code":
            add("text", content[1], code=True)
        elif kind == "Math":
            out.append({"kind": "math", "text": content[1], "display": content[0]["t"] == "DisplayMath"})
        elif kind == "Link":
            out.append({"kind": "link", "text": "".join(r["text"] for r in runs(content[1])), "url": content[2][0] if len(content) > 2 else ""})
        elif kind == "Note":
            out.append({"kind": "footnote", "text": ""})
        elif kind == "Cite":
            out.append({"kind": "cite", "text": "".join(r["text"] for r in runs(content[1])), "ref_ids": [c.get("citationId", "") for c in content[0] if isinstance(c, dict)]})
        elif kind == "Span":
            out += runs(content[1], style)
        elif kind == "Quoted":
            first, last = QUOTES.get(content[0]["t"], "‘’")
            add("text", first)
            out += runs(content[1], style)
            add("text", last)
        elif kind == "RawInline":
            add("text", content[1])
        elif kind != "Image" and isinstance(content, list):
            out += runs([x for x in content if isinstance(x, dict)], style)
    return out


def plain(found: list[dict]) -> str:
    """B-04: text of runs, formulas between dollar signs."""
    return "".join(f"${r['text']}$" if r["kind"] == "math" else " " if r["kind"] == "break" else r["text"] for r in found)


def images(node) -> list[str]:
    """B-03: paths of all images below a node."""
    if isinstance(node, dict):
        own = [node["c"][2][0]] if node.get("t") == "Image" else []
        return own + [p for v in node.values() for p in images(v)]
    return [p for v in node for p in images(v)] if isinstance(node, list) else []


class Walk:
    """B-01, B-21: rows of a document: headings and blocks in order, nested ones with their parent, cells, issues."""

    def __init__(self):
        self.rows: list[dict] = []

    def add(self, record: str, kind: str, found: list[dict] | None = None, **more) -> int:
        row = {"seq": len(self.rows), "record": record, "kind": kind, "inlines": found or [], "text": plain(found) if found is not None else more.pop("text", "")}
        self.rows.append(row | more)
        return row["seq"]

    def issue(self, severity: str, code: str, text: str) -> None:
        self.add("issue", "issue", text=text, severity=severity, code=code)

    def blocks(self, nodes: list, **place) -> None:
        for node in nodes:
            kind, content = node.get("t"), node.get("c")
            if kind == "Header":
                self.add("heading", "heading", runs(content[2]), level=content[0], **place)
            elif kind in ("Para", "Plain"):
                self.add("block", "paragraph", runs(content), **place)
            elif kind == "BlockQuote":
                self.issue("info", "blockquote_unwrapped", "An indented paragraph was taken out of its quotation.")
                self.blocks(content, **place)
            elif kind == "Div":
                self.blocks(content[1], **place)
            elif kind in ("BulletList", "OrderedList"):
                parent = self.add("block", "list", text=kind, **place)
                for n, item in enumerate(content if kind == "BulletList" else content[1]):
                    self.blocks(item, parent=parent, item=n)
            elif kind == "DefinitionList":
                for term, definitions in content:
                    self.add("block", "paragraph", runs(term), **place)
                    for d in definitions:
                        self.blocks(d, **place)
            elif kind == "LineBlock":
                for line in content:
                    self.add("block", "paragraph", runs(line), **place)
            elif kind == "CodeBlock":
                self.add("block", "code", text=content[1], **place)
            elif kind == "RawBlock":
                self.add("block", "raw", text=content[1], **place)
            elif kind == "Table":
                self.table(content, place)
            elif kind not in ("HorizontalRule", "Null"):
                self.issue("warning", "unhandled_block", f"Block type {kind!r} is not known; it is kept as it is.")
                self.add("block", "raw", text=json.dumps(node)[:2000], **place)

    def table(self, content: list, place: dict) -> None:
        if len(content) >= 6:  # attributes, caption, columns, head, bodies, foot
            caption = " ".join(plain(runs(b.get("c", []))) for b in content[1][1]).strip()
            head = content[3][1]
            rows = [*head, *(r for body in content[4] or [] for r in [*body[2], *body[3]]), *content[5][1]]
            grid = [[(c[4], c[2], c[3], ALIGN.get(c[1]["t"], "default")) for c in row[1]] for row in rows]
        else:  # caption, alignments, widths, headers, rows
            caption = plain(runs(content[0]))
            head = [content[3]] if any(content[3]) else []
            grid = [[(c, 1, 1, "default") for c in row] for row in [*head, *content[4]]]
        parent = self.add("block", "table_ref", text=caption, level=len(head), **place)
        for r, row in enumerate(grid):
            for c, (inside, rowspan, colspan, align) in enumerate(row):
                cell = self.add("cell", "cell", text="", parent=parent, row=r, col=c, rowspan=rowspan, colspan=colspan, align=align)
                self.blocks(inside, parent=cell)


def walked(ms_id: str, tree: str | None) -> list[tuple]:
    walk = Walk()
    try:
        walk.blocks(json.loads(tree)["blocks"])
    except Exception as e:  # what was read so far stays
        walk.issue("error", "unreadable_tree", f"{type(e).__name__}: {e}"[:200])
    out = []
    for row in walk.rows:
        row["inlines"] = [{f: r.get(f, [] if f == "ref_ids" else "" if f in ("text", "url", "target_id") else False) for f in RUN_FIELDS} for r in row["inlines"]]
        out.append((ms_id, *(row.get(f) for f in FIELDS[1:])))
    return out


def rows(trees: DataFrame) -> DataFrame:
    """All records of documents ``trees`` (ms_id, tree): headings, blocks, cells, issues, in order by ``seq``."""
    ship(trees.sparkSession)

    def run(batches):
        for batch in batches:
            made = pd.DataFrame([r for ms_id, tree in zip(batch["ms_id"], batch["tree"]) for r in walked(ms_id, tree)], columns=FIELDS, dtype=object)
            yield made

    return trees.select("ms_id", "tree").mapInPandas(run, ROWS)


def headings(records: DataFrame) -> DataFrame:
    return records.where("record = 'heading'").select("ms_id", F.col("seq").alias("ord"), "level", F.col("text").alias("title_raw"))


def blocks(records: DataFrame) -> DataFrame:
    """B-19: every block, nested ones with the list or cell they are in."""
    return records.where("record = 'block'").select("ms_id", "seq", "kind", "text", "inlines", "parent", "item")


def cells(records: DataFrame) -> DataFrame:
    """B-21, H-11: ms_id, tab_id, row, col, spans, align and what a cell holds: formulas, text, other blocks."""
    inside = records.where("record = 'block' AND parent IS NOT NULL").groupBy("ms_id", F.col("parent").alias("seq")).agg(
        F.sum(F.size(F.filter("inlines", lambda r: r["kind"] == "math"))).cast("int").alias("n_math"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.array_join(F.transform(F.filter("inlines", lambda r: r["kind"] != "math"), lambda r: F.when(r["kind"] == "break", " ").otherwise(r["text"])), "").alias("t")))), lambda x: x["t"]), " ")).alias("text"),
        F.max(F.element_at(F.concat(F.transform(F.filter("inlines", lambda r: r["kind"] == "math"), lambda r: r["text"]), F.array(F.lit(None).cast("string"))), 1)).alias("latex"),
        F.max(F.col("kind") != "paragraph").alias("has_non_paragraph"),
    )
    own = records.where("record = 'cell'").select("ms_id", "seq", F.concat(F.lit("t"), F.col("parent").cast("string")).alias("tab_id"), "row", "col", "rowspan", "colspan", "align")
    filled = own.join(inside, ["ms_id", "seq"], "left")
    return filled.select("ms_id", "tab_id", "row", "col", "rowspan", "colspan", "align", F.coalesce("n_math", F.lit(0)).alias("n_math"), F.coalesce("text", F.lit("")).alias("text"), "latex", F.coalesce("has_non_paragraph", F.lit(False)).alias("has_non_paragraph"))


def issues(records: DataFrame) -> DataFrame:
    return records.where("record = 'issue'").select("ms_id", "seq", "severity", "code", F.col("text").alias("message"))
