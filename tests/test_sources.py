import io
import json
import math
import struct
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import floats, grams, learn
from scriptorium.sources import docx, files
from scriptorium.streaming import corrections

NS = f'xmlns:w="{docx.W[1:-1]}" xmlns:r="{docx.R[1:-1]}" xmlns:a="{docx.A[1:-1]}" xmlns:wp="{docx.WP[1:-1]}" xmlns:m="{docx.M[1:-1]}" xmlns:v="{docx.V[1:-1]}" xmlns:pic="p" xmlns:asvg="{docx.ASVG[1:-1]}"'
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x02\0\0\0"


def built(body: str, media: dict | None = None, rels: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="T1"><w:name w:val="Title"/></w:style></w:styles>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="d"><dc:title>My  work</dc:title></c>')
        for name, data in (media or {}).items():
            z.writestr(f"word/media/{name}", data)
    return out.getvalue()


BODY = """
<w:p><w:pPr><w:pStyle w:val="T1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>A title</w:t></w:r><w:r><w:tab/><w:t>x</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r><m:oMath><m:r><m:t>q</m:t></m:r></m:oMath></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>outer</w:t><w:drawing><wp:anchor><wp:extent cx="914400" cy="457200"/><wp:docPr descr="alt"/><a:blip r:embed="rId1"><asvg:svgBlip r:embed="rId2"/></a:blip></wp:anchor></w:drawing>
  <w:txbx><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:txbx></w:r></w:p>
<w:p><w:r><w:pict><v:imagedata r:id="rId1"/></w:pict></w:r></w:p>
"""
RELS = '<Relationship Id="rId1" Target="media/a.png"/><Relationship Id="rId2" Target="media/a.svg"/><Relationship Id="rId9" Target="x.xml"/>'


def packages(spark):
    whole = built(BODY, {"a.png": PNG, "a.svg": b"<svg/>", "logo.png": PNG}, RELS)
    return spark.createDataFrame([("one", bytearray(whole)), ("damaged", bytearray(b"no zip")), ("empty", bytearray(built("")))], "ms_id string, content binary")


def test_scan(spark):
    rows = docx.paragraphs(packages(spark)).collect()
    one = [r for r in rows if r.ms_id == "one"]
    assert [(r.idx, r.text.strip(), r.in_table) for r in one] == [(0, "A title\tx", False), (1, "cell" + docx.MATH_MARK, True), (2, "outer", False), (3, "inner", False), (4, "", False)]
    assert one[0].style == "Title" and one[0].bold_share == 0.5 and one[2].has_drawing and not one[3].has_drawing
    damaged = [r for r in rows if r.ms_id == "damaged"]
    assert len(damaged) == 1 and "BadZipFile" in damaged[0].error and not [r for r in rows if r.ms_id == "empty"]


def test_images_and_orphans(spark):
    found = docx.images(packages(spark)).orderBy("img_ord").collect()
    assert [(r.para_index, r.filename, r.svg_filename, r.width_emu, r.anchored, r.alt_text) for r in found] == [(2, "a.png", "a.svg", 914400, True, "alt"), (4, "a.png", "", 0, False, "")]
    media = docx.media(packages(spark))
    assert [r.filename for r in docx.orphans(media, docx.images(packages(spark))).collect()] == ["logo.png"]
    figures = floats.figures_of(docx.images(packages(spark))).orderBy("ord").collect()
    assert [(f.fig_id, f.files, f.placed_width_mm) for f in figures] == [("fig1", ["a.svg"], 25.4), ("fig2", ["a.png"], 0.0)]


def test_counts_and_title(spark):
    parts = docx.parts(packages(spark))
    counts = docx.source_counts(parts).where("ms_id = 'one'").first()
    assert (counts.paragraphs, counts.tables, counts.formulas, counts.pictures, counts.svg_originals) == (5, 1, 1, 1, 1)
    assert docx.core_title(parts).where("ms_id = 'one'").first().title == "My  work"


def test_image_sizes(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 12
    rows = [(bytearray(d),) for d in (PNG, b"GIF89a" + struct.pack("<HH", 7, 9), b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6), jpeg, b"??", b"")] + [(None,)]
    found = spark.createDataFrame(rows, "d binary").select(docx.image_size(F.col("d")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in found] == [("png", 640, 480), ("gif", 7, 9), ("bmp", 5, 6), ("jpeg", 40, 30), (None, None, None), (None, None, None), (None, None, None)]


def test_packages_of_a_folder(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx.package(["x"], ["Heading 1"], "T"))
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    found = docx.packages(spark, str(tmp_path))
    assert found.count() == 1 and docx.paragraphs(found).first().style == "Heading 1"


def test_profiles_of_folders(spark, tmp_path):
    for name, data in {"one/a.json": dict(id="a", journal="A", verified=True, structure=dict(abstract_max_words=200)), "one/_template.json": dict(id="t"), "one/b.json": dict(id="b"), "two/a.json": dict(id="a", journal="A2")}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(data))
    found = {r.profile_id: r for r in files.profiles(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()}
    assert set(found) == {"a", "b"} and found["a"].journal == "A2" and found["a"].abstract_max_words is None and found["b"].dpi_halftone == 300 and found["b"].verified is False


def test_examples_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "examples")
    rows = spark.createDataFrame([("a", True, "methods"), ("a", True, "methods"), ("b", False, "")], files.EXAMPLES)
    assert files.append_examples(rows, path) == 2 and files.append_examples(rows, path) == 0
    with open(tmp_path / "examples" / "bad.json", "w") as out:
        out.write("\nnot json\n")
    assert files.examples(spark, path).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", True, "x"), ("a", True, "x"), ("b", False, "")]
    for n in range(3):
        spark.createDataFrame(rows, files.EXAMPLES).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    corrections.keep(corrections.each_once(corrections.corrections(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, files.examples(spark, str(tmp_path / "out")).collect())) == sorted(set(rows))


def test_learning(spark):
    heads = [f"{w} {x}" for w in ("Introduction", "Methods", "Results", "Conclusion") for x in ("", "and more", "of work", "2")]
    body = [f"This is a longer sentence about {x}, which ends with a point." for x in ("wind", "water", "heat", "light", "sound", "mass", "time", "space", "iron", "salt", "sand", "snow")]
    rows = spark.createDataFrame([(t, True, t.split()[0].lower()) for t in heads] + [(t, False, "") for t in body], files.EXAMPLES)
    model = learn.train(rows, "is_heading", 2.0)
    found = {r.text: r for r in learn.predict(model, spark.createDataFrame([("Discussion of work",), ("This is a sentence about rain, which ends with a point.",), ("",)], "text string"), "true").collect()}
    assert found["Discussion of work"].probability > 0.5 > found["This is a sentence about rain, which ends with a point."].probability
    assert learn.predict(None, rows).where("predicted IS NOT NULL").isEmpty()
    status = learn.status(rows).first()
    assert (status.examples, status.headings, status.role_classes, status.can_train_heading) == (28, 16, 4, False)


def test_markdown_and_results(spark, tmp_path):
    frame = spark.createDataFrame([(1, None)], "a int, b string")
    assert files.markdown(frame) == "| a | b |\n| --- | --- |\n| 1 |  |"
    files.write_results({"x": frame}, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == 1


def test_paragraphs_leave_a_package(spark):
    rows = packages(spark)
    gone = spark.createDataFrame([("one", 0), ("one", 1), ("damaged", 0)], "ms_id string, idx int")
    after = docx.without_paragraphs(rows, gone)
    texts = [r.text.strip() for r in docx.paragraphs(after).where("ms_id = 'one'").orderBy("idx").collect()]
    assert texts == ["", "outer", "inner", ""]
    assert docx.images(after).where("ms_id = 'one'").count() == 2 and docx.media(after).where("ms_id = 'one'").count() == 3
    assert bytes(after.where("ms_id = 'damaged'").first().content) == b"no zip"
    before = bytes(rows.where("ms_id = 'empty'").first().content)
    assert bytes(after.where("ms_id = 'empty'").first().content) == before


def test_models_that_have_enough(spark):
    assert learn.train_all(learn.seeds(spark)) == {"heading": None, "role": None, "finding": None}


def test_examples_of_one_class_are_in_many_tasks(spark, monkeypatch):
    rows = spark.range(400).selectExpr("concat('line ', id) text", "id < 100 is_heading", "'' role")
    seen = {}

    def fit(self, given):
        seen.update(plan=given._jdf.queryExecution().executedPlan().toString(), weights={(r.is_heading, r.weight) for r in given.select("is_heading", "weight").collect()}, tasks=given.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())

    monkeypatch.setattr(learn.Pipeline, "fit", fit)
    learn.train(rows, "is_heading", 2.0)
    assert seen["weights"] == {(True, 2.0), (False, 400 / 600)} and "Window" not in seen["plan"]
    assert len(seen["tasks"]) >= 4 and sum(seen["tasks"]) == 400 and max(seen["tasks"]) <= 200


def test_grams_of_whole_texts(spark, monkeypatch):
    def counts(text):
        words = [f" {w} " for w in text.lower().split()]
        return Counter(w[i : i + n] for w in words for n in (2, 3, 4) for i in range(len(w) - n + 1))

    texts = ["Wind and water", "wind  WIND\twind", "", "a", "\U0001f600\U0001f601 und été", "x" * 50 + " end", "\x00a \x00"]
    found = [counts(t) for t in texts]
    total, documents = sum(found, Counter()), Counter(g for c in found for g in c)
    monkeypatch.setattr(grams, "LETTERS", 20)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    model = grams.Grams(10_000).fit(rows)
    assert len(model.getOrDefault("vocabulary")) == len(total)
    vectors = [r.tfidf for r in model.transform(rows).orderBy("id").collect()]
    for c, v in zip(found, vectors):
        values = {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + documents[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in values.values()))
        assert sorted(v.values) == pytest.approx(sorted(x / norm for x in values.values()))
    few = grams.Grams(5).fit(rows)
    kept = {(int(n), int(d)) for n, d in zip(*grams_counts(rows, few))}
    assert min(n for n, _ in kept) >= sorted(total.values(), reverse=True)[4]


def grams_counts(rows, model):
    tallied = {r.gram: r for r in rows.select(grams.spaced(F.col("text")).alias("text")).mapInArrow(grams._tallied, "gram long, n long, texts long").groupBy("gram").sum("n", "texts").collect()}
    kept = [tallied[g] for g in model.getOrDefault("vocabulary")]
    return [r["sum(n)"] for r in kept], [r["sum(texts)"] for r in kept]


def test_two_classes_train_one_vector(spark):
    rows = spark.createDataFrame([(f"Title {i}", True, "") for i in range(8)] + [(f"a sentence of some length, number {i}.", False, "") for i in range(8)], files.EXAMPLES)
    assert learn.train(rows, "is_heading", 2.0).stages[-1].coefficientMatrix.numRows == 1
