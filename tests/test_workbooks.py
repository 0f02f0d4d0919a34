"""Workbooks written here by hand: several sheets, an active one, headers below the first row, none at all."""

import zipfile

import pytest

from shelfwise.sources import workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(k):
    return (chr(64 + k // 26) if k >= 26 else "") + chr(65 + k % 26)


def write(path, sheets, active=0, shared=()):
    """sheets: {name: {row number: cells}}; a cell is a number, ("s", place in shared), text, or None."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {REL}><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{"".join(f"<sheet name=\"{n}\" r:id=\"rId{k}\"/>" for k, n in enumerate(sheets))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships>{"".join(f"<Relationship Id=\"rId{k}\" Target=\"worksheets/own{k}.xml\"/>" for k in range(len(sheets)))}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si><t>{x}</t></si>' for x in shared)}</sst>")
        for k, rows in enumerate(sheets.values()):
            body = ""
            for at, cells in rows.items():
                body += f'<row r="{at}">'
                for j, x in enumerate(cells):
                    ref = f'r="{letters(j)}{at}"'
                    if isinstance(x, tuple):
                        body += f'<c {ref} t="s"><v>{x[1]}</v></c>'
                    elif isinstance(x, str):
                        body += f'<c {ref} t="inlineStr"><is><t>{x}</t></is></c>'
                    elif x is not None:
                        body += f"<c {ref}><v>{x}</v></c>"
                body += "</row>"
            z.writestr(f"xl/worksheets/own{k}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "a.xlsx", {"Notes": {1: ["Artnr", "x"], 2: ["9999", "y"]}, "Data": {1: ["A report"], 3: ["Name", ("s", 0), "n"], 4: ["glove", 12345.0, 1], 5: ["mask", "N777"], 7: [None, None, 5], 8: ["tape", "12345.0", 2]}}, active=1, shared=["Art. nr"])
    write(tmp_path / "b.xlsx", {"Sheet": {1: ["what", "which", "code"], **{k: [f"word {k % 3}", k % 2, f"AB-{k}"] for k in range(2, 22)}}})
    write(tmp_path / "c.xlsx", {})
    write(tmp_path / "d.xlsx", {"Empty": {}})
    (tmp_path / "e.xlsx").write_bytes(b"no workbook")
    return str(tmp_path)


def test_rows_of_all_sheets(spark, folder):
    rows = {(x.path[-6:], x.sheet, x.row): x for x in workbooks.read(spark, folder, batch=3).collect()}
    assert len(rows) == 2 + 6 + 21 and {k[0] for k in rows} == {"a.xlsx", "b.xlsx"}
    assert rows["a.xlsx", "Data", 3].cells == ["Name", "Art. nr", "n"] and rows["a.xlsx", "Data", 7].cells == [None, None, "5"]
    assert rows["a.xlsx", "Data", 3].active and not rows["a.xlsx", "Notes", 1].active and rows["a.xlsx", "Data", 3].sheet_no == 2


def test_columns_by_header_and_by_values(spark, folder):
    rows = workbooks.read(spark, folder)
    got = {(x.path[-6:], x.sheet): (x.column, x.header, x.how) for x in workbooks.article_columns(workbooks.profile(rows)).collect()}
    assert got == {("a.xlsx", "Notes"): (1, "Artnr", "header"), ("a.xlsx", "Data"): (2, "Art. nr", "header"), ("b.xlsx", "Sheet"): (3, "code", "values")}
    numbers = workbooks.article_numbers(rows).orderBy("path", "row").collect()
    assert [(x.path[-6:], x.row, x.article_number) for x in numbers][:3] == [("a.xlsx", 4, "12345"), ("a.xlsx", 5, "N777"), ("a.xlsx", 8, "12345")]
    assert [x.article_number for x in numbers[3:]] == [f"AB-{k}" for k in range(2, 22)]


def test_preview(spark, folder):
    got = {(x.path[-6:], x.sheet): x for x in workbooks.preview(workbooks.read(spark, folder)).collect()}
    p = got["b.xlsx", "Sheet"]
    assert p.headers == ["what", "which", "code"] and [x[2] for x in p.preview_rows] == [f"AB-{k}" for k in range(2, 7)]
    assert (p.total_columns, p.total_data_rows, p.detected_column) == (3, 20, 3) and got["a.xlsx", "Data"].total_data_rows == 4


def test_erp(spark, tmp_path):
    write(tmp_path / "erp.xlsx", {"S": {1: ["Item. No", "Web Title ", "GID", "Other", "Supplier"], 2: [100.0, " glove ", 7.0, "o", "S1"], 3: [None, "lost"], 4: ["N200", "mask", "G", None, None], 5: ["100", "glove again", None, None, "S2"]}})
    rows = {x.article_number: x for x in workbooks.erp_rows(workbooks.read(spark, str(tmp_path))).collect()}
    assert sorted(rows) == ["100", "N200"] and (rows["100"].web_title, rows["100"].supplier, rows["100"].gid) == ("glove again", "S2", None)
    assert (rows["N200"].web_title, rows["N200"].gid, rows["N200"].web_text) == ("mask", "G", None)
