import tracemalloc
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lrforge.schemas import CELLS
from lrforge.sources import cells, html, tables, workbooks
from lrforge.streaming import incremental


def book(path, sheets, shared=None, **parts):
    """An .xlsx file from the XML of its sheets' rows, by name."""
    main, office = workbooks.MAIN, workbooks.OFFICE
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            if rows is not None:
                z.writestr(f"xl/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{shared}</sst>')


def test_workbooks_round_trip(spark, tmp_path):
    rows = [("w1", "first", 0, 1, "Cat A & B"), ("w1", "first", 2, 0, "<f>"), ("w1", "second sheet", 0, 27, " x "), ("w1", "a\"b'<", 1, 1, "q"), ("w2", "only", 5, 3, "1.5"), ("w2", "only", 5, 10, "é日😀")]
    df = spark.createDataFrame([*rows, ("w2", "only", 6, 1, None)], CELLS).repartition(3)
    workbooks.write_workbooks(df, f"file://{tmp_path}")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    got = workbooks.scan_workbooks(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got if r["error"] is None) == sorted(rows)
    assert [(r["scenario_id"], r["sheet"]) for r in got if r["error"]] == [("bad", None)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad.xlsx", "w1.xlsx", "w2.xlsx"]  # no staging left
    workbooks.write_workbooks(df.where("scenario_id = 'w2'").withColumn("value", F.lit("new")), str(tmp_path))
    assert {r["scenario_id"]: r["value"] for r in workbooks.scan_workbooks(spark, f"{tmp_path}/w2.xlsx").collect()} == {"w2": "new"} and (tmp_path / "w1.xlsx").exists()
    workbooks.write_workbooks(df.where("scenario_id = 'w2'"), str(tmp_path), overwrite=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["w2.xlsx"]
    assert workbooks.scan_workbooks(spark, f"{tmp_path}/w2.xlsx").count() == 2


def test_sheets_of_other_writers(spark, tmp_path):
    """Shared strings with runs, references left out, numbers, an empty sheet, texts for no value, and a broken sheet beside good ones."""
    shared = "<si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si>"
    good = '<row r="3"><c t="s"><v>1</v></c><c r="D3"><v>0.5</v></c><c><v>7</v></c></row><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>NA</t></is></c><c t="str"><v>Nat</v></c></row>'
    book(tmp_path / "n.xlsx", {"good": good, "gone": None, "torn": "<row><c><v>1</v></c></row><row", "index": '<row><c t="s"><v>9</v></c></row>', "empty": ""}, shared)
    got = workbooks.scan_workbooks(spark, str(tmp_path)).collect()
    assert sorted((r["sheet"], r["row_idx"], r["col_idx"], r["value"]) for r in got if r["error"] is None) == [("good", 2, 0, "two runs"), ("good", 2, 3, "0.5"), ("good", 2, 4, "7"), ("good", 3, 0, "plain"), ("good", 3, 2, "Nat"), ("torn", 0, 0, "1")]
    assert {r["sheet"]: r["error"].split(":")[0] for r in got if r["error"]} == {"gone": "KeyError", "torn": "ParseError", "index": "ValueError"}
    assert workbooks.scan_workbooks(spark, str(tmp_path)).rdd.getNumPartitions() == 5


def test_headers(spark, tmp_path):
    rows = [("a", "s", 4, 0, "Info"), ("a", "s", 4, 1, "LR"), ("a", "s", 4, 3, "LR"), ("a", "s", 5, 0, "x"), ("a", "s", 5, 1, "1"), ("a", "s", 7, 2, "y"), ("a", "s", 7, 3, "2"), ("a", "only head", 0, 0, "h")]
    workbooks.write_workbooks(spark.createDataFrame(rows, CELLS), str(tmp_path))
    got = sorted((r["row_idx"], r["header"], r["value"]) for r in workbooks.scan_workbooks(spark, str(tmp_path), header=True).collect())
    assert got == [(0, "Info", "x"), (0, "LR", "1"), (2, "LR.1", "2"), (2, "Unnamed: 2", "y")]


def test_failed_writes_leave_nothing(spark, tmp_path):
    """A name that comes twice after it is cut fails the job, after other tasks have written; a task that dies half-way leaves its workbook nowhere."""
    good = [(f"g{i}", "s", r, 0, "v") for i in range(6) for r in range(50)]
    for bad in ([("bad", "n" * 31 + x, 0, 0, "v") for x in "ab"], [("bad", "s", 0, 0, "fails")]):
        df = spark.createDataFrame(good + bad, CELLS)
        value = F.when((F.col("scenario_id") == "bad") & F.col("sheet").eqNullSafe("s"), F.raise_error("killed")).otherwise(F.col("value"))
        with pytest.raises(Exception, match="two sheets|killed"):
            workbooks.write_workbooks(df.repartition(4).withColumn("value", value), str(tmp_path))
        assert not [p for p in tmp_path.rglob("*") if p.is_file()] and not list(tmp_path.glob("_staging*"))


def test_large_sheets_in_bounded_memory(tmp_path):
    """300,000 cells through the writer and reader of a task: neither holds more than a batch."""
    out = workbooks.WorkbookWriter({"path": str(tmp_path)}, False)
    n, width = 300_000, 30

    def batches():
        for start in range(0, n, 10_000):
            at = np.arange(start, start + 10_000)
            columns = [pa.array(["big"] * 10_000), pa.array(["s"] * 10_000), pa.array(at // width, pa.int32()), pa.array(at % width, pa.int32()), pa.array([f"value {i}" for i in at.tolist()])]
            yield pa.RecordBatch.from_arrays(columns, names=["scenario_id", "sheet", "row_idx", "col_idx", "value"])

    tracemalloc.start()
    out.commit([out.write(batches())])
    reader = workbooks.WorkbookReader({"path": str(tmp_path)})
    seen = total = 0
    for part in reader.partitions():
        for batch in reader.read(part):
            seen += batch.num_rows
            total += sum(int(v.split()[1]) for v in batch.column(4).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (seen, total) == (n, n * (n - 1) // 2) and peak < 24 << 20


def flat(pieces):
    return [x for rows, columns, texts in pieces for x in zip(rows.tolist(), columns.tolist(), texts.to_pylist(), strict=True)]


def batch_of(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["scenario_id", "sheet", "row_idx", "col_idx", "value"])


def test_blocks_of_a_sheet_are_written_by_several_tasks(tmp_path):
    """Two tasks' blocks strung together are one sheet: its checksum, sizes and cells are right."""
    n = workbooks.BLOCK_ROWS
    rows = [("b", sheet, r, c, v) for sheet in ("none", "s <1>") for r in (0, 5, n - 1, n, n + 1, 3 * n) for c, v in ((0, f"{r} & <x>"), (1, None), (30, f"é{r}"))]
    rows = [(*r[:4], None if r[1] == "none" else r[4]) for r in rows]
    (tmp_path / "_staging-x").mkdir()
    write, places = workbooks.write_blocks(str(tmp_path), "_staging-x"), []
    for task in (0, 1):
        mine = [r for r in rows if r[2] // n % 2 == task]
        places += [x for b in write(batch_of(mine[i : i + 4]) for i in range(0, len(mine), 4)) for x in b.to_pylist()]
    assert len({p["file"] for p in places}) == 2 and len(places) == 6
    places.sort(key=lambda p: (p["scenario_id"], p["sheet"], p["block"]))
    out = workbooks.BlockWriter({"path": str(tmp_path)}, False)
    out.commit([out.write(iter([pa.RecordBatch.from_pylist(places)]))])
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        assert z.testzip() is None and [name for name, _ in workbooks.sheets_of(z)] == ["none", "s <1>"]
        assert flat(workbooks.cells_of(z, "xl/worksheets/sheet1.xml")) == []
        got = flat(workbooks.cells_of(z, "xl/worksheets/sheet2.xml"))
        assert got == [(r, c, v) for _, s, r, c, v in rows if s != "none" and v is not None]
        assert sum(len(x) for x in workbooks._rows(z, "xl/worksheets/sheet2.xml")) == 6


def test_joined_checksums():
    for a, b in ((b"", b""), (b"a", b""), (b"", b"b"), (b"first" * 999, b"second" * 12345)):
        assert workbooks.joined_crc(workbooks.zlib.crc32(a), workbooks.zlib.crc32(b), len(b)) == workbooks.zlib.crc32(a + b)


@pytest.mark.parametrize("odd", ["plain", "a\rb", "tab\tnew\nline", "]]>", "&#65;", "", " ", "😀 é", "\u2028"])
def test_sheets_read_by_pattern_and_by_parser_agree(tmp_path, odd):
    """One odd text far into a sheet of many pieces; cells are those that the XML parser finds row by row."""
    rows = [("w", "s", 2 * r, c, odd if r == 15_000 and c else f"v{r} & {c}") for r in range(20_000) for c in (0, 28)]
    out = workbooks.WorkbookWriter({"path": str(tmp_path)}, False)
    out.commit([out.write(iter([batch_of(rows)]))])
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z, z.open("xl/worksheets/sheet1.xml") as stream:
        want = [(int(row.get("r")) - 1, workbooks.column_number(c.get("r")), c[0][0].text) for row in workbooks._pulled(stream, "row") for c in row if c[0][0].text]
        got = flat(workbooks.cells_of(z, "xl/worksheets/sheet1.xml"))
        assert got == want and len(got) == 40_000 - (odd == "")
        parts = workbooks._regular(z, "xl/worksheets/sheet1.xml")
        read = sum(len(p[0]) for p in parts)
        assert read < 40_000 if odd == "a\rb" else read == len(got)


def test_irregular_rows_go_to_the_parser(tmp_path):
    """Rows whose cells name other rows, a cell outside a row, a comment, a torn end: as the parser has them, up to the error."""
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'
    start = f'<row r="1">{cell("A1", "a")}</row>'
    for rest, want, error in (
        (f'<row r="2">{cell("B7", "b")}</row>', [(0, 0, "a"), (1, 1, "b")], None),
        (f'<row r="2">{cell("A2", "b")}{cell("B3", "c")}</row>', [(0, 0, "a"), (1, 0, "b"), (1, 1, "c")], None),
        (f'<!-- {cell("A2", "no")} --><row>{cell("C2", "b")}</row>', [(0, 0, "a"), (1, 2, "b")], None),
        (f'<row r="4"><c r="A4"><v>1</v></c></row><row r="5">{cell("A5", "z")}</row><row', [(0, 0, "a"), (3, 0, "1"), (4, 0, "z")], "ParseError"),
        (f'<row r="2">{cell("A2", "bad " + chr(1))}</row>', [(0, 0, "a")], "ParseError"),
    ):
        with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
            z.writestr("s.xml", workbooks.BEGIN.decode() + start + rest + workbooks.END.decode())
        with zipfile.ZipFile(tmp_path / "t.xlsx") as z:
            got, failed = [], None
            try:
                for cells in workbooks.cells_of(z, "s.xml"):
                    got += flat([cells])
            except Exception as e:  # noqa: BLE001
                failed = type(e).__name__
        assert (got, failed) == (want, error)


def test_csv_files_are_numbered_on(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"p{i}.csv").write_text("".join(f"{i}-{j},x\n" for j in range(i * 3 + 1)))
    got = {r["row_idx"]: r["value"] for r in cells.scan_csv(spark, str(tmp_path), 2, "s").where("col_idx = 0").collect()}
    assert got == dict(enumerate(f"{i}-{j}" for i in range(5) for j in range(i * 3 + 1)))


def test_csv_with_header(spark, tmp_path):
    (tmp_path / "m.csv").write_text('scenario_id,label\ns,"a, ""b"" \nnext"\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "m.csv"), "scenario_id string, label string", ["label"]).collect()] == [("s", 'a, "b" \nnext')]
    with pytest.raises(ValueError, match="pair_index"):
        tables.read_csv(spark, str(tmp_path / "m.csv"), "scenario_id string, label string", ["pair_index"])


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"a, ""b"""\n,None\n')
    rows = cells.scan_csv(spark, str(tmp_path / "a.csv"), 2, "s").collect()
    assert sorted((r["row_idx"], r["col_idx"], r["value"]) for r in rows) == [(0, 0, "x"), (0, 1, 'a, "b"')]


def test_empty_csv_keeps_its_header(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([], "a int, b string"), str(tmp_path / "e"))
    assert "a,b" in "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv"))


def test_manifests(spark, tmp_path):
    df = spark.createDataFrame([("s1",), ("s1",), ("s2",)], "scenario_id string")
    row = tables.run_manifest(df, {"f": "abc"}, ["w"]).first()
    assert (row["rows"], row["scenarios"], row["hashes"], row["warnings"]) == (3, 2, {"f": "abc"}, ["w"])
    (tmp_path / "m.json").write_text('{"a": 1}')
    assert tables.read_manifest(spark, str(tmp_path / "m.json")) == {"a": 1}
    assert len(tables.file_hashes(spark, str(tmp_path)).first()["sha256"]) == 64
    tables.write_by_model(spark.createDataFrame([("m2", "s", 1), ("m1", "s", 2)], "model_id string, scenario_id string, x int"), str(tmp_path / "o"))
    assert tables.models(spark, str(tmp_path / "o")) == ["m1", "m2"]


PAGE = """<h3>Heart</h3><ul><li><a href="/x">X one</a></li></ul><h3>Lung</h3><ul><li><a href="/y">Y</a></li></ul>
<article class="card lr_cards_details"><table class="lrtable"><tr><th>f</th></tr><tr><td><a href="#">Cough </a>more</td><td> 2.5 </td></tr><tr><td>Rash</td><td></td></tr><tr><td>three</td><td>a</td><td>b</td></tr></table></article>"""


def test_html(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<tr><td>a</td><td>1</td></tr>"), (3, None)], "page_id int, html string")
    assert [tuple(r)[2:] for r in html.heading_links(df, "Heart").collect()] == [("/x", "X one")]
    got = [(r["page_id"], r["finding"], r["lr"]) for r in html.lr_tables(df).orderBy("page_id", "finding_order").collect()]
    assert got == [(1, "Cough", "2.5"), (1, "Rash", "Not reported"), (2, "a", "1")]
    assert html.nav_links(df).count() == 2


def test_incremental(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    batch = lambda *values: spark.createDataFrame([("s", "t", i, 0, v) for i, v in enumerate(values)], CELLS).write.mode("append").parquet(source)
    batch("1.5", "abc")
    incremental.run_once(spark, source, target, check)
    batch("0")
    incremental.run_once(spark, source, target, check)
    assert sorted(r["status"] for r in spark.read.parquet(target).collect()) == ["non_numeric", "non_positive", "valid"]
