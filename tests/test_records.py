"""Records that are read and observed whole: the same results as row by row, without their moves and parsers."""

import math
import random

from pyspark.sql import functions as F

from secondpass.catalog import geometry, views
from secondpass.functions.scalars import FEATURES
from secondpass.operators import features
from secondpass.sources import payloads

SF = "/root/testdata/sf0.001"
_CELLS = "sample_id string, row_start int, row_end int, column_start int, column_end int, text string, x0 double, y0 double, x1 double, y1 double"
_BOXES = "sample_id string, record_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def test_features_of_whole_records_are_those_of_their_rows(spark, monkeypatch):
    from secondpass.functions import observations

    monkeypatch.setattr(observations, "_PAIRS_AT_ONCE", 7)
    draw = random.Random(11)
    texts = ["", " ", None, "12", "-3%", "A", "a1", "x 7", "é 1", "½", "１", "12_", "(3)", "１９　x", "a-2"]
    cells, boxes = [], []
    for i in range(60):
        name = f"t{i:02d}"
        for _ in range(draw.choice((0, 1, 3, 9))):
            row, column = draw.choice((0, 1, 5, None if i % 9 == 0 else 2)), draw.randrange(70)
            corners = [draw.choice((0.0, 1.5, 2.0, 4.0, None if i % 7 == 0 else 3.0)) for _ in range(4)]
            cells.append((name, row, None if row is None else row + draw.choice((0, 1, 1, 3)), column, column + draw.choice((-1, 1, 2)),
                          draw.choice(texts), *corners))
        for k in range(draw.choice((0, 1, 4, 12))):
            left, low = draw.choice((0.0, 1.0, 2.5)), draw.choice((0.0, 0.5, 6.0))
            sides = (None,) * 4 if draw.random() < 0.1 else (left, low, left + 1, low + 2)
            boxes.append((name, k, "x", *sides, draw.choice((None, 0.25, 0.5, 1 + 1e-7, -2.0, math.nan, 0.95, 0.95))))
    records = spark.createDataFrame([(f"t{i:02d}", float(i % 3), 2.0) for i in range(60)], "sample_id string, image_height double, image_width double")
    c, b = spark.createDataFrame(cells, _CELLS), spark.createDataFrame(boxes, _BOXES)
    rows = {r["sample_id"]: r for r in features.primary_features(records, b, c).collect()}
    whole = features.primary_features(records, b, c, bounded=True).collect()
    assert len(whole) == len(rows) == 60
    for r in whole:
        for name in FEATURES:
            one, other = r[name], rows[r["sample_id"]][name]
            assert (one is None) == (other is None) and (one is None or abs(one - other) < 1e-12), (r["sample_id"], name, one, other)


def test_sheets_hold_the_cells_and_boxes_of_the_views(spark):
    held = views.sheets(spark, SF).select("sample_id", "order_key", F.explode("cells").alias("c")).select("sample_id", "order_key", "c.*")
    cells = views.cells(spark, SF)
    assert held.count() == cells.count() and held.select(*cells.columns).exceptAll(cells).count() == 0
    held = views.sheets(spark, SF).select("sample_id", F.explode("boxes").alias("b")).select("sample_id", "b.*")
    boxes = views.ocr_boxes(spark, SF).select("sample_id", "x0", "y0", "x1", "y1", "confidence")
    assert held.count() == boxes.count() and held.exceptAll(boxes).count() == 0


def test_features_move_lines_once(spark):
    plan = geometry.feature_table(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Generate" not in plan


def test_plain_annotations_need_no_parser_and_others_get_one(monkeypatch):
    box = "<bndbox><xmin>{}</xmin><ymin>1</ymin><xmax>9.5</xmax><ymax>8</ymax></bndbox>"
    size, row = "<size><width>400</width><height>30.5</height></size>", "<object><name>table row</name>" + box.format(0) + "</object>"
    plain = f'<annotation xmlns="urn:x">{size}{row}<group>{row}{row}</group>{row}</annotation>'
    others = [plain.replace(*change) for change in (
        ("400", "0"), ("<xmin>0", "<xmin>9.5"), ("<xmin>0", "<xmin>1e1"), ("table row", "row"), ("<group>", "<group>#"), ("</group>", ""),
        ("</annotation>", ""), (size, ""), (size, size + size), ("<object>", "<object><name>table</name>"), ("</group>", "</group><!-- x -->"),
        ("</group>", "</group><group/>"), ("<xmin>0</xmin>", "<xmin>0</xmin><xmin>0</xmin>"), ("400", "4&#48;0"), ("400", " 400 "), ("400", "NaN"))]
    fast = [payloads.structure_of(payload) for payload in (plain, *others)]
    assert payloads._plain_structure(plain) is not None
    monkeypatch.setattr(payloads, "_plain_structure", lambda payload: None)
    assert fast == [payloads.structure_of(payload) for payload in (plain, *others)]
    assert len(fast[0]["objects"]) == 4 and fast[0]["error"] is None


def test_contents_read_by_type_are_those_read_as_variants(spark):
    record = '{"text":"a é","bbox":[0.0,1.0,2.5,3.0]}'
    kinds = [record, record.replace('"a é"', "5"), record.replace("0.0", "true"), record.replace("0.0", '"0.0"'), record.replace("0.0", "null"),
             record.replace("0.0", "9.0"), record.replace("0.0", '"NaN"'), record.replace("0.0", "0"), record.replace("a é", "\\u0061\\n"),
             record.replace('"text":"a é",', ""), record.replace("{", '{"text":"b",'), record.replace("{", '{"more":1,'), "null", "{}", "[]", "5",
             record.replace("[0.0,1.0,2.5,3.0]", "[0.0]"), record.replace("0.0", "1e400"), record.replace("0.0", "01"), record.replace("3.0", "123456789012345678901.0")]
    texts = ['{"ocr":[' + ",".join(kind) + "]}" for kind in ([], *([k] for k in kinds), *([record, k] for k in kinds))]
    texts += [None, "", "{}", "[]", '{"ocr":null}', '{"ocr":[' + record + "]}}", '{"ocr":{}}', '{"ocr":[' + record + '],"ocr":[]}', ' {"ocr":[' + record + "]}"]
    df = spark.createDataFrame([(f"{i:03d}", text) for i, text in enumerate(texts)], "k string, p string")
    # White space in front keeps a text from being written back as it was; it changes nothing else.
    slow = df.withColumn("p", F.concat(F.lit(" "), F.col("p")))
    found, wanted = (sorted(map(repr, payloads.content_rows(part, ["k"], "p").collect())) for part in (df, slow))
    assert found == wanted
    assert sum("reason='bad record'" in row for row in found) > 10 and sum("reason='invalid JSON'" in row for row in found) > 5


def test_bare_tables_need_no_parser(monkeypatch):
    from secondpass.functions import tables

    def read(markup):
        try:
            return tables.html_cells(markup)
        except tables.TableError as error:
            return str(error)

    row = '<tr><td rowspan=2> x  y</td><td colspan="2">A > b</td></tr><tr><td>é</td><td></td></tr>'
    markups = [f"<table>{part}</table>" for part in (
        row, row + row, "", "<tr></tr>", row.replace("2>", "0>"), row.replace("=2", "=3"), row.replace('"2"', '" 2"'), row.replace("=2", "=2 rowspan=1"),
        row.replace("<td>", '<td class="b c" id=x1>'), row.replace("rowspan=2", 'title=" rowspan=5" rowspan=2'), row.replace("</td></tr>", "</tr>"),
        row.replace("é", "&eacute;"), row.replace("<td>", "<td/>"), row.replace("=2", "=2/"), row.replace("=2", "=٢"), row + " ", row + "x")]
    fast = [read(markup) for markup in markups]
    pages = [tables.top_level_tables(markup) for markup in markups]
    assert tables._BARE.fullmatch(markups[0])
    never = tables.re.compile(r"(?!)")
    monkeypatch.setattr(tables, "_BARE", never)
    monkeypatch.setattr(tables, "_PLAIN", never)
    assert fast == [read(markup) for markup in markups]
    assert pages == [tables.top_level_tables(markup) for markup in markups]
    assert len(fast[0]) == 4 and fast[0][0]["row_end"] == 2
