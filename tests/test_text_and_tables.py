"""Golden edge cases of text functions, table parsing and annotation payloads."""

import pytest
from pyspark.sql import functions as F

from secondpass.functions import grids, tables, text
from secondpass.operators.tables import canonical_cells, cell_failures, parse_tables
from secondpass.sources import payloads, records


@pytest.mark.parametrize("value, tokens", [
    ("1,234.5%", ["1,234.5%"]), ("1 234", ["1234"]), ("−5", ["-5"]), ("A-2", []), ("12x", []),
    ("5%%", []), ("1.2.3", ["1.2", "3"]), ("1996-01-02", ["1996", "01", "02"]), ("no", []), ("_7", []), ("3-4", ["3", "4"]), ("²", ["2"]),
])
def test_numeric_tokens(spark, value, tokens):
    df = spark.createDataFrame([(value,)], "t string")
    row = df.select(text.extract_numeric_tokens(F.col("t")).alias("x"), text.is_numeric_looking(F.col("t")).alias("n")).first()
    assert row["x"] == tokens and row["n"] == bool(tokens)


def test_normalize_text(spark):
    cases = {"a\r\nb\rc": "a b c", " x y\x1c": "x y", "é": "é", "  \t ": "", "plain": "plain"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert df.where(text.normalize_text(F.col("t")) != F.col("want")).count() == 0


def test_labels_errors_and_formats(spark):
    df = spark.createDataFrame([("Table--Row", "bad /tmp/x.png: y", "  <fcel> a"), ("", "", "a|b")], "l string, e string, f string")
    a, b = df.select(text.normalize_label(F.col("l")), text.sanitize_error(F.col("e"), "Oops"), text.native_format(F.col("f"))).collect()
    assert tuple(a) == ("table__row", "bad <path> y", "paddle_table_tokens")
    assert b[1] == "Oops" and b[2] == "markdown"


GOOD = "<table><tr><th rowspan=2>a</th><td>b</td></tr><tr><td>c &amp; d</td></tr></table>"


def test_html_spans():
    cells = tables.html_cells(GOOD)
    assert [(c["row_start"], c["row_end"], c["column_start"], c["text"], c["is_column_header"]) for c in cells] == [
        (0, 2, 0, "a", True), (0, 1, 1, "b", False), (1, 2, 1, "c & d", False)]
    assert len(tables.html_cells("<table><tr><td/><td>x</td></tr></table>")) == 2
    assert tables.html_cells("<table><tr><td colspan=1000000000>x</td></tr></table>")[0]["column_end"] == 10**9


@pytest.mark.parametrize("markup", [
    "<table><tr><td rowspan=3>a</td></tr></table>",
    "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td colspan=1>c</td><td>d</td></tr></table>",
    "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>",
    "<table><tr><td>a<table></table></td></tr></table>",
    "<table><tr><td>a</td></tr></table><table></table>",
    "x<table><tr><td>a</td></tr></table>",
    "<table><tr><td>a</th></tr></table>",
    "<table><tr><td rowspan=0>a</td></tr></table>", "<table><tr><td rowspan=abc>a</td></tr></table>",
    "<table><tr><td>a</td></tr>", "<table></table>", "<table/>",
])
def test_html_refused(markup):
    with pytest.raises(tables.TableError):
        tables.html_cells(markup)


def test_reference_html_is_laxer():
    assert tables.html_cells("<table><tr><td>a</th></tr></table>", strict=False)[0]["text"] == "a"
    with pytest.raises(tables.TableError):
        tables.html_cells("<table><tr><td>a</td></tr></table><table><tr><td>a</td></tr></table>", strict=False)


def test_markdown():
    cells = tables.markdown_cells("|a|b\\|c|\n|--|:-:|\n|d||")
    assert [c["text"] for c in cells] == ["a", "b|c", "d", ""]
    for bad in ("|a|b|", "|a|\n|x|", "|a|b|\n|-|", "```\n|a|\n|-|", "|a|\\\n|-|-|", "|a|\n|-|\n|b|c|"):
        with pytest.raises(tables.TableError):
            tables.markdown_cells(bad)


def test_top_level_tables():
    found = tables.top_level_tables("a<TABLE class=x><tr><td>1&nbsp;</td></tr></TABLE>b<table></table></table>")
    assert found["table_count"] == 2 and found["malformed"] and not found["nested"]
    assert found["blocks"][0] == "<TABLE class=x><tr><td>1&nbsp;</td></tr></table>"


def test_failures_become_rows(spark):
    df = spark.createDataFrame([("a", GOOD), ("b", ""), ("c", None), ("d", "<fcel>x"), ("e", "|a|\n|-|\n<|user|>")], "id string, p string")
    rows = parse_tables(df, ["id"], "p").collect()
    status = {r["id"]: (r["status"], r["format"]) for r in rows}
    assert status == {"a": ("success", "html"), "b": ("parse_failed", None), "c": ("parse_failed", None),
                      "d": ("parse_failed", None), "e": ("success", "markdown")}
    assert sum(r["row_start"] is not None for r in rows) == 4


def test_binary_payloads(spark):
    good = "<table><tr><td>\u00e9\u4e2d</td></tr></table>".encode()
    df = spark.createDataFrame([("a", good), ("b", good[:-25] + b"\xff" + good[-25:]), ("c", b""), ("d", None)], "id string, p binary")
    rows = {r["id"]: (r["status"], r["error"], r["text"]) for r in parse_tables(df, ["id"], "p").collect()}
    assert rows == {"a": ("success", None, "\u00e9\u4e2d"), "b": ("parse_failed", "output: not UTF-8", None),
                    "c": ("parse_failed", "output: empty", None), "d": ("parse_failed", "output: null", None)}


@pytest.mark.parametrize("markup, error", [
    ("<table><tr><tr>", "html: tr opened in place row"), ("</td>", "html: td closed in place before"), ("", "html: no table"),
    ("<table><tr><td>a</td></tr></table></table>", "html: table closed in place after"), ("<table/>", "html: no rows"),
    ("<tr/><table><tr><td>a</td></tr></table>z", "html: text outside the table"),
    ("<table><tr><td colspan=99999999999>a</td></tr></table>", "span: beyond the last column"),
])
def test_html_reasons(markup, error):
    with pytest.raises(tables.TableError, match=error):
        tables.html_cells(markup)


def test_lax_rows_and_ignored_tags():
    lax = tables.html_cells("<tbody><table><thead><tr><td/></tr></thead> x <!--n--></table><tr>", strict=False)
    assert [(c["row_start"], c["text"]) for c in lax] == [(0, "")]
    with pytest.raises(tables.TableError, match="position without a cell"):
        tables.html_cells("<table><tr/><tr><td>a</td></tr></table>", strict=False)
    assert len(tables.html_cells("<table><tr/><tr><td>a</td></tr></table>")) == 1


@pytest.mark.parametrize("markup, count, blocks, nested, malformed", [
    ("", 0, [], False, False), ("<table/>", 1, ["<table/>"], False, False), ("</table><table>", 1, [], False, True),
    ("<table><table/>a&amp;<br></table>", 1, ["<table><table/>a&amp;<br></table>"], True, False),
    ("<table>a</table>b<table><table></table>", 2, ["<table>a</table>"], True, True),
])
def test_top_level_edges(markup, count, blocks, nested, malformed):
    assert tables.top_level_tables(markup) == {"table_count": count, "blocks": blocks, "nested": nested, "malformed": malformed}


def test_structure_fields(spark):
    size = "<s:size xmlns:s='u'><s:width>4<b>9</b></s:width><height> 5 </height></s:size>"
    box = "<bndbox><xmin>0</xmin><ymin>0</ymin><xmax>1</xmax><ymax>1</ymax></bndbox>"
    table = f"<deep><object><name>table</name><part><name>row</name></part>{box}</object></deep>"
    found = payloads.structure_of(f"<a>{table}{size}</a>".encode())
    assert (found["width"], found["height"], len(found["objects"]), found["error"]) == (4.0, 5.0, 1, None)
    reasons = {
        f"<a>{size}{size}</a>": "size: 2 found, one wanted", f"<a>{size}<object>{box}</object></a>": "name: none found, one wanted",
        f"<a>{size}<object><name>table</name>{box}{box}</object></a>": "bndbox: 2 found, one wanted",
        "<a><size><width>x</width><height>1</height></size></a>": "width: not a number",
        "<a><size><width>0</width><height>1</height></size></a>": "size: not positive", "<a>&nope;</a>": "xml: unreadable",
        f"<a>{size}{table.replace('<xmin>0', '<xmin>1')}</a>": "bndbox: no area",
        f"<a>{size}{table.replace('<xmin>0', '<xmin>')}</a>": "bndbox.xmin: not a finite number",
    }
    assert {xml: payloads.structure_of(xml)["error"] for xml in reasons} == reasons
    rows = payloads.structure_rows(spark.createDataFrame([("a", f"<a>{size}{table}</a>"), ("b", None), ("c", f"<a>{size}</a>")], "id string, p string"), ["id"], "p")
    assert sorted((r["id"], r["object_no"], r["reason"]) for r in rows.collect()) == [("a", 0, None), ("b", None, "xml: unreadable")]


def test_counts_of_manifests(spark):
    members = spark.createDataFrame([("d", "1", "i", True), ("d", "2", "i", False), ("f", "2", "i", True)], "cohort string, sample_id string, issuer string, spanning boolean")
    wanted = spark.createDataFrame([("d", 2, None), ("f", 1, 0), ("r", 4, None)], "cohort string, members long, spanning long")
    assert sorted(map(tuple, records.membership_problems(members, wanted).collect()), key=str) == [
        ("duplicate member", None, "2", 2, 1), ("member count", "r", None, 0, 4), ("spanning count", "f", None, 1, 0)]
    assert records.membership_problems(members.limit(0), wanted.limit(0)).count() == 0
    reports = spark.createDataFrame([("a", "x"), ("b", "x")], "report_id string, reporting_entity string")
    assert [tuple(r) for r in records.manifest_problems(reports, 2, 2).collect()] == [("entity count", 1, 2)]


def test_failed_cell_tables_are_named(spark):
    schema = ("sample_id string, row_start int, row_end int, column_start int, column_end int, text string, xa double, ya double, xb double, yb double, "
              "origin string, image_height double, column_header boolean, row_header boolean, row_section boolean")
    box = (0.0, 0.0, 1.0, 1.0, "TOPLEFT", 9.0, None, None, None)
    rows = [("good", 0, 1, 0, 1, None, *box), ("range", 0, 0, 0, 1, "a", *box), ("null", 0, None, 0, 1, "a", *box),
            ("box", 0, 1, 0, 1, "a", 0.0, 0.0, float("nan"), 1.0, "TOPLEFT", 9.0, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in cell_failures(df).collect()} == {("range", "invalid range"), ("null", "invalid range"), ("box", "unusable box")}
    assert [r["sample_id"] for r in canonical_cells(df).collect()] == ["good"]


@pytest.mark.parametrize("body, reason", [
    ("no marker", "no page markers"), ("== PAGE 1 == =\na\n== PAGE 1 == =\n", "page numbers not unique and positive"),
    ("== PAGE 2 == =\na\n== PAGE 1 == =\n", "page numbers not increasing"), ("== PAGE 0 == =\n", "page numbers not unique and positive"),
    ("== PAGE 1 == =\n== PAGE x\n", "malformed page markers"), ("== PAGE 1 =\n", "no page markers"),
])
def test_page_markers_refused(spark, body, reason):
    good, bad = payloads.split_pages(spark.createDataFrame([("r", body)], "id string, t string"), ["id"], "t")
    assert good.count() == 0 and [r["reason"] for r in bad.collect()] == [reason]


def test_page_markers(spark):
    df = spark.createDataFrame([("r", "pre\n==== page 2 ==== ====\r\nx\ny\n  = PAGE 10 = =\nz")], "id string, t string")
    rows = payloads.split_pages(df, ["id"], "t")[0].orderBy("page_number").collect()
    assert [(r["page_number"], r["page_index"], r["text"]) for r in rows] == [(2, 1, "\nx\ny\n"), (10, 9, "\nz")]


def test_structure_and_content_reasons(spark):
    xml = "<a><size><width>1</width><height>2</height></size><object><name>table</name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>1</xmax><ymax>%s</ymax></bndbox></object></a>"
    assert payloads.structure_of(xml % "1.5")["objects"][0]["y1"] == 1.5
    for bad in (xml % "0", xml % "nan", xml % "", "<a/>", "<a", (xml % "1").replace(">table<", ">tables<")):
        assert payloads.structure_of(bad)["error"]
    cases = {'{"ocr":[{"text":"a","bbox":[0,0,1,1.5]}]}': None, '{"ocr":[{"text":1,"bbox":[0,0,1,1]}]}': "bad record",
             '{"ocr":[{"text":"a","bbox":[0,0,true,1]}]}': "bad record", '{"ocr":[{"text":"a","bbox":[0,0,0,1]}]}': "bad record",
             '{"ocr":{}}': "no ocr array", '[]': "no ocr array", '{"ocr":[]} x': "invalid JSON", '{"ocr":[]}': None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    _, bad = payloads.parse_content_json(df, ["p"], "p")
    assert {r["p"]: r["reason"] for r in bad.collect()} == {k: v for k, v in cases.items() if v}


def test_metadata_rejects(spark):
    lines = ['{"id":"a","file_name":"x"}', '{"id":"b"}', "{", "[1]", '{"id":3,"file_name":"x"}', " ", '{"id":"c","file_name":"y"}', '{"id":"c","file_name":"y"}']
    good, bad = records.parse_metadata(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert [r["id"] for r in good.collect()] == ["a"]
    assert sorted(r["reason"] for r in bad.collect()) == sorted(
        ["no image path", "invalid JSON", "not an object", "no sample id", "duplicate sample id", "duplicate sample id"])


def cells(texts):
    return [{"row_start": r, "row_end": r + 1, "column_start": c, "column_end": c + 1, "text": t, "x0": 10.0 * c, "y0": 10.0 * r,
             "x1": 10.0 * c + 9, "y1": 10.0 * r + 9} for r, row in enumerate(texts) for c, t in enumerate(row)]


def test_grid_scores():
    a = cells([["ab", "c"], ["d", "e"], ["f", "g"]])
    same = grids.compare(a, a, ("top", "con", "loc"))
    assert all(same[f"{m}_matched"] == 6 for m in ("top", "con", "loc"))
    b = cells([["ab", "c"], ["f", "g"]])
    forth, back = grids.compare(a, b, ("con",)), grids.compare(b, a, ("con",))
    assert forth["con_matched"] == back["con_matched"] == 4
    assert grids.text_similarity("abcd", "acbd") == 0.75 and grids.text_similarity("", "") == 1.0 and grids.text_similarity("", "x") == 0.0
    assert grids.compare([], a, ("top",))["errors"] == ["top"]


def test_stacked_grids_equal_single_ones():
    import random

    import pyarrow as pa

    from secondpass.functions import grid_stacks, grids
    from secondpass.operators.scoring import METRICS

    draw = random.Random(5)
    words = ["", None, "a", "abc", "acb", "12-34", "é\U0001f600x", "long " * 5, "longer " * 12, "tail " * 60, "tall " * 60, "q" * 9, "pq" * 9]

    def table():
        rows, columns, cells = draw.randint(1, 4), draw.randint(1, 4), []
        for r in range(rows):
            for c in range(columns):
                if draw.random() < 0.9:
                    box = [float(draw.randint(0, 9)) for _ in range(4)] if draw.random() < 0.97 else [None] * 4
                    cells.append(dict(row_start=r, row_end=r + draw.choice((1, 1, 2)), column_start=c, column_end=c + draw.choice((1, 1, 3)),
                                      text=draw.choice(words), x0=box[0], y0=box[1], x1=box[2], y1=box[3]))
        if cells and draw.random() < 0.03:
            cells[0]["row_start"] = draw.choice((None, -1))
        if draw.random() < 0.1:
            for cell in cells:
                cell.update(x0=None, y0=None, x1=None, y1=None)
        return cells

    left, right = [table() for _ in range(600)], [table() for _ in range(600)]
    right[:200] = [[dict(cell) for cell in cells] for cells in left[:200]]
    for cells in right[50:150]:
        for cell in cells:
            cell["text"] = draw.choice((cell["text"], "abc"))
    left[3], right[4], left[5] = None, [], []
    cell = pa.struct([(n, pa.int32()) for n in ("row_start", "row_end", "column_start", "column_end")] + [("text", pa.string())]
                     + [(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")])

    def single(a, b, metrics):
        try:
            return grids.compare(a or [], b or [], metrics)
        except Exception:  # null indices are an error of the batch
            return None

    for metrics in (METRICS, ("con", "top"), ("top",)):
        kind = pa.struct([("reference_size", pa.int64()), ("prediction_size", pa.int64()),
                          *[(f"{m}_matched", pa.float64()) for m in metrics], ("errors", pa.list_(pa.string()))])
        wanted = [single(a, b, metrics) for a, b in zip(left, right)]
        fine = [i for i, row in enumerate(wanted) if row is not None]
        assert len(fine) > 500
        sides = [pa.array([side[i] for i in fine], pa.list_(cell)) for side in (left, right)]
        for low, high in ((0, len(fine)), (10, 13)):
            found = grid_stacks.compare(sides[0][low:high], sides[1][low:high], metrics, kind).to_pylist()
            for row, i in zip(found, fine[low:high]):
                for name, value in wanted[i].items():
                    same = row[name] == value or (isinstance(value, float) and abs(row[name] - value) < 1e-9)
                    assert same, (i, name, row, wanted[i])


def test_plain_markup_is_read_as_the_parser_reads_it():
    import random

    from secondpass.functions import tables as reader

    draw = random.Random(11)
    pieces = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", '<td colspan="2">', '<td rowspan="2" colspan="1">',
              '<td colspan="x">', '<td colspan="0">', '<td colspan="2147483647">', "<p>", "</p>", "text ", " ", "a > b", "\x1c\x0b", "é", "<tr class=\"a b\">",
              "<td colspan=\"3\" colspan=\"2\">", "</td x=\"1\">"]
    odd = ["&amp;", "<br/>", "<!-- c -->", "<TD>", "<", "<td", "<script>", "<td colspan=2>", "</ td>"]

    def outcome(read, *args):
        try:
            return read(*args)
        except reader.TableError as error:
            return str(error)

    plain = 0
    for number in range(4000):
        rows = "".join("<tr>" + "".join(draw.choice(pieces[4:9:4] + ["<td>"]) + draw.choice(("1", " b  c ", "")) + "</td>" for _ in range(3)) + "</tr>" for _ in range(2))
        loose = [draw.choice(pieces) for _ in range(draw.randint(1, 12))]
        if number % 3 == 0:
            loose.insert(draw.randrange(len(loose)), draw.choice(odd))
        markup = f"<table>{rows}</table>" if number % 2 else "".join(loose)
        if reader._PLAIN.fullmatch(markup):
            plain += 1
            for charrefs in (True, False):
                merged = []
                for token in reader._Tokens(markup, charrefs).found:  # neighbouring texts may come in parts
                    if merged and token[0] == merged[-1][0] == "text":
                        merged[-1] = ("text", "", merged[-1][2] + token[2], {})
                    else:
                        merged.append(token)
                assert reader._tokens(markup, charrefs) == merged, markup
        assert not reader._PLAIN.fullmatch(markup + draw.choice(odd))
        spans = [[{"tag": "td", "parts": ["x"], "rowspan": "1", "colspan": draw.choice(("1", "1", "2", "x", "2147483647"))}
                  for _ in range(draw.randint(1, 3))] for _ in range(2)]
        flat = outcome(reader._place_flat, spans)
        spans[0][0]["rowspan"] = " 1"  # the same span, read by the general way
        assert outcome(reader._place, spans) == flat
    assert plain > 2000
