import datetime as dt
import zipfile

import pytest

from millrace.engine.catalog import Catalog
from millrace.sources import books, delimited, jsons

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def xlsx(path, sheets):
    """sheets: name to rows of XML cells."""
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr/><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{r}</row>" for r in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')


def text(v):
    return f'<c t="inlineStr"><is><t>{v}</t></is></c>'


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "two books.xlsx")
    head = '<c t="s"><v>0</v></c>' + "".join(map(text, ("n", "x", "day", "flag", "mixed")))
    xlsx(path, {
        "First": [head, "", '<c t="s"><v>1</v></c><c><v>3</v></c><c><v>2.5</v></c><c s="1"><v>45658</v></c><c t="b"><v>1</v></c><c><v>7</v></c>', '<c r="B4"><v>4</v></c><c r="C4"><v>1</v></c><c r="D4" t="e"><v>#N/A</v></c><c r="F4" t="str"><v>z</v></c>'],
        "Empty": [],
        "Large": ["<c><v>%d</v></c>" % i for i in range(12_000)],
    })
    assert books.sheets(path) == ["First", "Empty", "Large"]
    df = books.read(spark, path, "First")
    assert dict(df.dtypes) == {"name": "string", "n": "bigint", "x": "double", "day": "date", "flag": "boolean", "mixed": "string"}
    assert [tuple(r) for r in df.collect()] == [("ab", 3, 2.5, dt.date(2025, 1, 1), True, "7"), (None, 4, 1.0, None, None, "z")]
    assert books.read(spark, path, "Empty").columns == [] and [r[0] for r in books.read(spark, path, "Large").collect()] == list(range(12_000))
    tables = Catalog.discover(spark, str(tmp_path))
    assert len(tables.specs) == 3
    name = next(n for n, s in tables.specs.items() if s.sheet == "First")
    assert tables.open(name).count() == 2


def test_ods(spark, tmp_path):
    ns = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = lambda kind, v, more="": f'<table:table-cell office:value-type="{kind}" office:{"date-value" if kind == "date" else "boolean-value" if kind == "boolean" else "value"}="{v}" {more}/>'
    word = lambda v, more="": f'<table:table-cell office:value-type="string" {more}><text:p>{v}</text:p></table:table-cell>'
    rows = [word("k") + word("w") + word("d"), cell("float", "1") + word("one") + cell("date", "2025-01-02T03:04:05"), cell("float", "2.5") + word("two", 'table:number-columns-repeated="1"') + cell("date", "2025-01-03") + '<table:table-cell table:number-columns-repeated="16000"/>']
    body = "".join(f"<table:table-row>{r}</table:table-row>" for r in rows) + f'<table:table-row table:number-rows-repeated="3">{cell("float", "9")}</table:table-row><table:table-row table:number-rows-repeated="1048000"><table:table-cell/></table:table-row>'
    path = str(tmp_path / "b.ods")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.xml", f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="One">{body}</table:table><table:table table:name="Two"><table:table-row>{word("x")}</table:table-row></table:table></office:spreadsheet></office:body></office:document-content>')
    assert books.sheets(path) == ["One", "Two"]
    df = books.read(spark, path, "One")
    assert dict(df.dtypes) == {"k": "double", "w": "string", "d": "timestamp_ntz"}
    assert [tuple(r) for r in df.collect()] == [(1.0, "one", dt.datetime(2025, 1, 2, 3, 4, 5)), (2.5, "two", dt.datetime(2025, 1, 3)), *[(9.0, None, None)] * 3]
    assert [tuple(r) for r in books.read(spark, path, "Two", header=False).collect()] == [("x",)]


def test_lines_of_a_file_are_split_only_where_quotes_pair(spark, tmp_path):
    plain, broken = tmp_path / "a.csv", tmp_path / "b.csv"
    plain.write_text("k,v\n" + "".join(f'{i},"a, ""{i}"""\n' for i in range(5_000)), encoding="utf-8")
    broken.write_text('k,v\n1,"two\nlines"\n2,x\n', encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        a = delimited.read(spark, str(plain))
        assert a.rdd.getNumPartitions() > 2 and [tuple(r) for r in a.orderBy("k").collect()] == [(i, f'a, "{i}"') for i in range(5_000)]
        b = delimited.read(spark, str(broken))
        assert b.rdd.getNumPartitions() == 1 and [tuple(r) for r in b.orderBy("k").collect()] == [(1, "two\nlines"), (2, "x")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_large_array_is_refused(spark, tmp_path, monkeypatch):
    f = tmp_path / "a.json"
    f.write_text("[" + "1," * 50 + "1]", encoding="utf-8")
    assert jsons.read(spark, str(f)).count() == 51
    monkeypatch.setattr(jsons, "MAX_ARRAY", 10)
    with pytest.raises(ValueError):
        jsons.read(spark, str(f))
