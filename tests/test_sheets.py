"""Workbooks: round trips, partitions, filters, hand-made XML."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pytest

from customsloom.sources import sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
WORKBOOK = f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">%s<sheets>%s</sheets></workbook>'


def book(path, parts: list[tuple[str, str]], strings: str | None = None, styles: str | None = None, properties: str = "") -> str:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", WORKBOOK % (properties, "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(parts))))
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(parts))) + "</Relationships>")
        for i, (_, xml) in enumerate(parts):
            z.writestr(f"xl/worksheets/s{i}.xml", xml)
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", strings)
        if styles is not None:
            z.writestr("xl/styles.xml", styles)
    return str(path)


def test_references():
    for n in (0, 25, 26, 51, 52, 701, 702, 16383):
        assert sheets.column_number(sheets.column_letters(n) + "17") == n
    assert sheets.column_letters(16383) == "XFD"


@pytest.mark.parametrize("step", [1, 7, 40, 333, 10_000])
def test_every_row_is_in_one_range(monkeypatch, step):
    monkeypatch.setattr(sheets, "CHUNK", 97)
    xml = ("<worksheet><cols><col/></cols><sheetData>" + "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' if i % 5 else f'<row r="{i}"/>' for i in range(1, 60)) + "</sheetData><rowBreaks/></worksheet>").encode()
    got = [n for lo in range(0, len(xml), step) for n, _ in sheets.cells_of(sheets.row_pieces(io.BytesIO(xml), lo, lo + step))]
    assert got == list(range(1, 60))


def test_types_and_texts_come_back(spark, tmp_path):
    texts = ["a", "", " lead", "tail ", "<&>\"'", "line\nbreak", "tab\tx", "bell\x07\r", "_x0041_", "čšž €", "x" * 5000, None]
    rows = [(i, t, i / 7 if i % 3 else None, i % 2 == 0, dt.date(2024, 2, 1 + i), dt.datetime(2023, 12, 31, 23, i, 5)) for i, t in enumerate(texts)]
    schema = "n bigint, t string, x double, ok boolean, day date, at timestamp_ntz"
    df = spark.createDataFrame(rows, schema).repartition(3)
    sheets.write_sheets(df, str(tmp_path / "a"))
    got = sheets.read_sheets(spark, str(tmp_path / "a"), schema, partitionbytes=300)
    want = sorted((r[0], r[1] or None, *r[2:]) for r in rows)  # an empty text is an empty cell
    assert sorted(tuple(r) for r in got.collect()) == want and got.rdd.getNumPartitions() > 3
    sheets.write_sheets(df.limit(2), str(tmp_path / "a"), mode="overwrite")
    assert sheets.read_sheets(spark, str(tmp_path / "a"), schema).count() == 2
    sheets.write_sheets(df.limit(2), str(tmp_path / "a"))
    plain = sheets.read_sheets(spark, str(tmp_path / "a"))
    assert plain.count() == 4 and set(plain.dtypes) == {(c, "string") for c in ("n", "t", "x", "ok", "day", "at")}
    assert {r["day"] for r in plain.collect()} <= {r[4].isoformat() for r in rows} and {r["ok"] for r in plain.collect()} <= {"true", "false"}


def test_conditions_and_columns_are_the_sources(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS n", "concat('k', id % 10) AS k", "IF(id % 4 = 0, NULL, id / 3) AS x", "date_add('2024-01-01', CAST(id AS INT)) AS d")
    sheets.write_sheets(df.repartition(2), str(tmp_path / "a"))
    cases = {
        "x > 20 AND x <= 150 AND k IN ('k1', 'k2')": [("x", ">", 20), ("x", "<=", 150), ("k", "in", ["k1", "k2", None])], "x IS NULL": [("x", "null"), ("missing", "null")], "d >= '2024-03-01' AND x IS NOT NULL": [("d", ">=", "2024-03-01"), ("x", "filled")],
        "k LIKE '%7' AND k LIKE 'k%' AND x < 100": [("k", "ends", "7"), ("k", "starts", "k"), ("k", "contains", "k7"), ("x", "<", 100)], "k = 'k0'": [("k", "=", "k0")],
    }
    for sql, where in cases.items():
        got = sheets.read_sheets(spark, str(tmp_path / "a"), "x double, k string, missing string, d date", where, partitionbytes=2000)
        want = [(r["x"], r["k"], None, r["d"]) for r in df.where(sql).collect()]
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want)) and want
    with pytest.raises(Exception, match="aren't read"):
        sheets.read_sheets(spark, str(tmp_path / "a"), "x double", [("k", "=", "k0")]).count()


def test_what_other_programs_write(spark, tmp_path):
    strings = f'<sst {NS}><si><t>Tarifa</t></si><si><r><t>Opis </t></r><r><t xml:space="preserve">blaga</t></r><rPh><t>no</t></rPh></si><si><t/></si><si><t>jeklo</t></si></sst>'
    styles = f'<styleSheet {NS}><numFmts><numFmt numFmtId="200" formatCode="dd/mm/yyyy"/><numFmt numFmtId="201" formatCode="0.0&quot;day&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="200"/><xf numFmtId="201"/><xf numFmtId="22"/></cellXfs></styleSheet>'
    sheet = f"""<x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><x:sheetData>
      <x:row r="2"><x:c r="B2" t="s"><x:v>0</x:v></x:c><x:c r="C2" t="s"><x:v>1</x:v></x:c><x:c r="E2" t="inlineStr"><x:is><x:t>Masa</x:t></x:is></x:c></x:row>
      <x:row r="3"><x:c r="B3"><x:v>73181590</x:v></x:c><x:c r="C3" t="s"><x:v>3</x:v></x:c><x:c r="E3"><x:v>1.50</x:v></x:c><x:c r="F3" s="1"><x:v>45292</x:v></x:c></x:row>
      <x:row r="4"/><x:row r="5"><x:c r="A5" s="3"/></x:row>
      <x:row r="9"><x:c r="B9" t="str"><x:f>1+1</x:f><x:v>0101 21</x:v></x:c><x:c r="C9" t="e"><x:v>#REF!</x:v></x:c><x:c r="E9" t="b"><x:v>1</x:v></x:c><x:c r="F9" s="2"><x:v>1E2</x:v></x:c></x:row>
      <x:row r="10"><x:c r="C10" t="s"><x:v>2</x:v></x:c><x:c r="F10" s="3"><x:v>45292.75</x:v></x:c></x:row></x:sheetData></x:worksheet>"""
    at = book(tmp_path / "b.xlsx", [("Notes", f"<worksheet {NS}><sheetData/></worksheet>"), ("AES izvoz", sheet)], strings, styles)
    got = sheets.read_sheets(spark, at, kind="export", header=1)
    assert got.columns == ["Tarifa", "Opis blaga", "Masa"]
    assert sorted(tuple(str(v) for v in r) for r in got.collect()) == [("0101 21", "None", "true"), ("73181590", "jeklo", "1.5"), ("None", "None", "None")]
    placed = sheets.read_sheets(spark, at, "code string, last string", sheet="AES izvoz", header=1, positions="1,5", partitionbytes=50)
    assert sorted((str(r[0]), r[1]) for r in placed.collect()) == [("0101 21", "100"), ("73181590", "2024-01-01"), ("None", "2024-01-01 18:00:00")]
    assert sheets.read_sheets(spark, at, "a string").count() == 0  # the first sheet has no rows
    typed = sheets.read_sheets(spark, at, "f date, e int", sheet="AES izvoz", header=1, positions="5,4").collect()
    assert {(str(r[0]), r[1]) for r in typed} == {("2024-01-01", None), ("1900-04-09", 1), ("2024-01-01", None)}
    with pytest.raises(Exception, match="no sheet"):
        sheets.read_sheets(spark, at, "a string", sheet="other").count()
    with pytest.raises(Exception, match="no workbook"):
        sheets.read_sheets(spark, str(tmp_path / "none.xlsx"), "a string").count()


def test_rows_without_references_and_the_later_calendar(spark, tmp_path):
    sheet = f'<worksheet {NS}><sheetData><row><c t="inlineStr"><is><t>a</t></is></c><c t="inlineStr"><is><t>b</t></is></c></row>' + "".join(f"<row><c><v>{i}</v></c><c><v>{i}</v></c></row>" for i in range(50)) + "</sheetData></worksheet>"
    at = book(tmp_path / "c.xlsx", [("s", sheet)], properties='<workbookPr date1904="1"/>')
    got = sheets.read_sheets(spark, at, "a bigint, b date", partitionbytes=64)
    assert [r["a"] for r in got.orderBy("a").collect()] == list(range(50)) and got.orderBy("a").first()["b"] == dt.date(1904, 1, 1)


def test_layouts(spark, tmp_path):
    imports = spark.createDataFrame([("DE", "SI", "87032319", "car", "1200,5")], "a string, b string, c string, d string, e string")
    sheets.write_sheets(imports, str(tmp_path / "i"), sheet="AIS import", preamble="Uvoz\n", notes="x")
    assert [tuple(r) for r in sheets.read_declarations(spark, str(tmp_path / "i"), "import").collect()] == [("DE", "SI", "87032319", "car", "1200,5")]
    few = spark.createDataFrame([("6203", "hlače")], "Tarifa string, `Opis blaga` string")
    sheets.write_sheets(few, str(tmp_path / "e"), preamble="Izvoz")
    assert [tuple(r) for r in sheets.read_declarations(spark, str(tmp_path / "e"), "export").collect()] == [(None, None, "6203", "hlače", None)]
    sheets.write_sheets(few, str(tmp_path / "f"), preamble="\n")
    with pytest.raises(ValueError, match="five columns"):
        sheets.read_declarations(spark, str(tmp_path / "f"), "import")


def test_long_tables_take_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 11)
    monkeypatch.setattr(sheets, "MOST_SHARED", 3)
    writer = sheets.SheetWriter({"path": str(tmp_path)}, spark.range(1).selectExpr("id AS n", "'' AS t").schema, False)
    import pyarrow as pa

    m = writer.write(iter([pa.RecordBatch.from_pydict({"n": list(range(i, i + 12)), "t": [f"t{j}" for j in range(i, i + 12)]}) for i in (0, 12)]))
    assert len(m.files) == 3
    writer.commit([m])
    assert sorted((r["n"], r["t"]) for r in sheets.read_sheets(spark, str(tmp_path), "n int, t string").collect()) == [(i, f"t{i}") for i in range(24)]
    m = writer.write(iter([pa.RecordBatch.from_pydict({"n": [1], "t": ["x"]})]))
    writer.abort([m, None])
    assert len(list(tmp_path.iterdir())) == 3


def test_shared_strings_are_read_once_a_partition_where_they_are_few(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "id int, note string").coalesce(1)
    sheets.write_sheets(rows, str(tmp_path / "s"))
    monkeypatch.setattr(sheets, "BATCH_ROWS", 5)
    reads, own = [], sheets.shared_strings
    monkeypatch.setattr(sheets, "shared_strings", lambda z, member, wanted: reads.append(wanted) or own(z, member, wanted))
    for most, times in ((1 << 20, 1), (0, 8)):
        monkeypatch.setattr(sheets, "MOST_STRINGS", most)
        reader = sheets.SheetReader({"path": str(tmp_path / "s")}, sheets.StructType.fromDDL("id int, note string"))
        (part,) = reader.partitions()
        reads.clear()
        got = [r for b in reader.read(part) for r in b.to_pylist()]
        assert got == [{"id": i, "note": f"text {i % 7}"} for i in range(40)] and len(reads) == 1 + times  # and one of the names
