"""Workbook cells from XLSX bytes with the standard library (zipfile + ElementTree).

Used inside ``mapInPandas``: Spark spreads the workbooks over tasks; each
task parses its own files.  Only the first (or the named) sheet is read.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def workbook_rows(data: bytes, sheet: int | str = 0):
    """Yield (row_no, [cell text or None, ...]) for one sheet."""
    zf = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in zf.namelist():
        root = ET.fromstring(zf.read("xl/sharedStrings.xml"))
        for si in root.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter("{%s}t" % _NS["m"])))
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    sheets = wb.findall("m:sheets/m:sheet", _NS)
    target = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    rid = target.get(_REL)
    path = next(r.get("Target") for r in rels if r.get("Id") == rid)
    path = path.lstrip("/")
    path = path if path.startswith("xl/") else "xl/" + path
    root = ET.fromstring(zf.read(path))
    for row in root.findall("m:sheetData/m:row", _NS):
        cells = {}
        for c in row.findall("m:c", _NS):
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "inlineStr":
                text = "".join(x.text or "" for x in c.iter("{%s}t" % _NS["m"]))
            elif v is None:
                text = None
            elif t == "s":
                text = shared[int(v.text)]
            elif t == "b":
                text = "true" if v.text == "1" else "false"
            else:
                text = v.text
            cells[_col_index(c.get("r"))] = text
        width = max(cells) + 1 if cells else 0
        yield int(row.get("r")), [cells.get(i) for i in range(width)]


def write_workbook(rows: list[list], sheet_name: str = "Sheet1") -> bytes:
    """A minimal XLSX (inline strings and numbers) — used by tests to make fixtures."""
    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        s = str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return f'<c r="{ref}" t="inlineStr"><is><t>{s}</t></is></c>'

    def ref(ci, ri):
        name = ""
        ci += 1
        while ci:
            ci, rem = divmod(ci - 1, 26)
            name = chr(65 + rem) + name
        return f"{name}{ri}"
    body = "".join(f'<row r="{ri + 1}">' + "".join(cell(ref(ci, ri + 1), v) for ci, v in enumerate(r)) + "</row>"
                   for ri, r in enumerate(rows))
    sheet = (f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}"><sheetData>{body}'
             f"</sheetData></worksheet>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.'
                   'openxmlformats.org/package/2006/content-types"/>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" '
                   'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                   f'<sheet name="{sheet_name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns='
                   '"http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
                   'Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return buf.getvalue()
