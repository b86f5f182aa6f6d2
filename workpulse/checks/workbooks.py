"""Small workbooks, written as stand-ins of landed ones."""

import zipfile
from xml.sax.saxutils import escape, quoteattr

from workpulse.files import file_system

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DATE_STYLE, TIME_STYLE = 1, 2


def letters(at: int) -> str:
    out = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


class _Strings:
    def __init__(self):
        self.places = {}

    def place(self, text):
        return self.places.setdefault(text, len(self.places))


def _cell(value, reference, strings) -> str:
    """A cell of a text, a number (also a text of digits), a truth value, an error like ``#DIV/0!`` or raw XML in a one-element list."""
    if value is None:
        return ""
    if isinstance(value, list):
        return value[0].replace("{r}", reference)
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f'<c r="{reference}"><v>{value!r}</v></c>'
    if value.isascii() and value.isdigit() and str(int(value)) == value and len(value) < 15:
        return f'<c r="{reference}"><v>{value}</v></c>'
    if len(value) % 2:
        return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    return f'<c r="{reference}" t="s"><v>{strings.place(value)}</v></c>'


def _sheet(rows, strings):
    yield f'<worksheet xmlns="{_MAIN}"><sheetData>'
    for i, row in enumerate(rows, 1):
        cells = "".join(_cell(value, f"{letters(at)}{i}", strings) for at, value in enumerate(row))
        if cells:
            yield f'<row r="{i}">{cells}</row>'
    yield "</sheetData></worksheet>"


def write(path: str, sheets: dict, from_1904=False) -> None:
    """Write a workbook of the given rows by sheet name; the first row of each holds the headers."""
    system, place = file_system(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    strings, names = _Strings(), list(sheets)
    with system.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as held:
        for k, name in enumerate(names, 1):
            with held.open(f"xl/worksheets/sheet{k}.xml", "w") as part:
                for text in _sheet(sheets[name], strings):
                    part.write(text.encode())
        listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>' for k, name in enumerate(names, 1))
        held.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><workbookPr date1904="{int(from_1904)}"/><sheets>{listed}</sheets></workbook>')
        relations = "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        relations += f'<Relationship Id="s" Type="{_OFFICE}/sharedStrings" Target="/xl/sharedStrings.xml"/><Relationship Id="f" Type="{_OFFICE}/styles" Target="styles.xml"/>'
        held.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{relations}</Relationships>')
        held.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="w" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        shared = "".join(f'<si><t xml:space="preserve">{escape(text)}</t></si>' for text in strings.places)
        held.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{shared}</sst>')
        formats = '<numFmts count="1"><numFmt numFmtId="170" formatCode="[$-416]dd/mm/yyyy\\ hh:mm;@"/></numFmts>'
        styles = f'<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="46"/></cellXfs>'
        held.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}">{formats}{styles}</styleSheet>')
