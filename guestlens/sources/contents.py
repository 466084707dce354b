"""Delivered files as (path, content) rows, as the binaryFile source gives them, and adapters from their formats to reviews.

Every adapter is a function over such rows that runs where the files lie; which one applies is decided by the first bytes
(magic numbers), else by the look of the text. A file that can't be read gives no rows.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guestlens.sources.readers import ALIASES, BOM, header_key, sniff_delimiter

FILE_ROWS = 100_000  # rows of one written workbook or database, at most
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
Row = dict[str, str | None]


# ---- workbooks: a zip of XML parts
def workbook(names: list[str], rows: list[list]) -> bytes:
    """One sheet with a header line; numbers as numbers, NULL as an empty cell, everything else as inline text."""

    def cell(v) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)).replace("\r", "&#13;")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean).replace("&amp;#13;", "&#13;")}</t></is></c>'

    lines = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [names, *rows])
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def column_no(ref: str | None, default: int) -> int:
    """0 for A1, 27 for AB3; cells without a reference follow the one before."""
    if not ref:
        return default
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The cells of the first sheet, shared texts resolved."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(SHEET + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(SHEET + "si")]
        sheet = sorted(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml"))[0]
        for row in ElementTree.fromstring(z.read(sheet)).iter(SHEET + "row"):
            cells: list[str | None] = []
            for c in row.iter(SHEET + "c"):
                at = column_no(c.get("r"), len(cells))
                cells += [None] * (at + 1 - len(cells))
                v, kind = c.find(SHEET + "v"), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(SHEET + "t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text
            yield cells


def named(rows: Iterator[list[str | None]]) -> Iterator[Row]:
    """Rows under the normalised names of the first one."""
    head = next(rows, None)
    if head is None:
        return
    keys = [header_key(h or "") for h in head]
    for r in rows:
        yield dict(zip(keys, [*r, *[None] * (len(keys) - len(r))]))


# ---- formats
def xlsx(content: bytes) -> Iterator[Row]:
    yield from named(sheet_rows(content))


def delimited(content: bytes) -> Iterator[Row]:
    text = content.decode("utf-8-sig").replace(BOM, "")
    yield from named(csv.reader(io.StringIO(text), delimiter=sniff_delimiter(text.split("\n", 1)[0])))


def json_lines(content: bytes) -> Iterator[Row]:
    for line in content.decode().split("\n"):
        try:
            if isinstance(x := json.loads(line), dict):
                yield {header_key(k): v for k, v in x.items()}
        except ValueError:
            continue


def json_array(content: bytes) -> Iterator[Row]:
    for x in json.loads(content):
        yield {header_key(k): v for k, v in x.items()}


def database(content: bytes, sql: str | None = None) -> Iterator[Row]:
    """The rows of a statement on a SQLite file, of its first table by default."""
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(content)
        if sql is None:
            (name,) = con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY rowid LIMIT 1").fetchone()
            sql = 'SELECT * FROM "{}"'.format(name.replace('"', '""'))
        got = con.execute(sql)
        keys = [header_key(c[0]) for c in got.description]
        for r in got:
            yield dict(zip(keys, r))
    finally:
        con.close()


CARD = re.compile(r'<div[^>]*data-review-id="([^"]*)"[^>]*>(.*?)</div>', re.S)
PART = {k: re.compile(p, re.S) for k, p in {"author": r'class="author">(.*?)<', "rating": r'aria-label="([\d.]+) ', "comment": r'class="text">(.*?)</span>'}.items()}


def map_cards(content: bytes) -> Iterator[Row]:
    """Review cards of a map page."""
    for m in CARD.finditer(content.decode()):
        found = {k: p.search(m[2]) for k, p in PART.items()}
        yield {"id": html.unescape(m[1])} | {k: html.unescape(x[1]) if x else None for k, x in found.items()}


LD = re.compile(r"<script[^>]*ld\+json[^>]*>(.*?)</script>", re.S)


def json_ld(content: bytes) -> Iterator[Row]:
    for block in LD.findall(content.decode()):
        try:
            for r in json.loads(block).get("review", []):
                yield {"id": r.get("@id"), "comment": r.get("reviewBody"), "rating": (r.get("reviewRating") or {}).get("ratingValue")}
        except (ValueError, AttributeError):
            continue


def pasted(content: bytes) -> Iterator[Row]:
    """Blocks between blank lines: the first line names the review."""
    for block in re.split(r"\n\s*\n\s*\n", content.decode()):
        first, _, rest = block.strip("\n").partition("\n")
        if first:
            yield {"id": first, "comment": rest}


ADAPTERS: dict[str, Callable[[bytes], Iterator[Row]]] = {"xlsx": xlsx, "csv": delimited, "jsonl": json_lines, "json": json_array, "sqlite": database, "maps": map_cards, "jsonld": json_ld, "paste": pasted}


def kind_of(content: bytes) -> str | None:
    """The adapter a file is for: by magic numbers, else by the look of its text; NULL for old binary workbooks and unknown ones."""
    if content[:4] == b"PK\x03\x04":
        return "xlsx"
    if content[:16] == b"SQLite format 3\0":
        return "sqlite"
    if content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return None
    try:
        head = content.decode("utf-8-sig").lstrip()
    except UnicodeDecodeError:
        return None
    if head.startswith("<"):
        return "jsonld" if "ld+json" in head else "maps"
    if head.startswith("["):
        return "json"
    if head.startswith("{"):
        return "jsonl"
    line = head.split("\n", 1)[0]
    return "csv" if any(s in line for s in ";\t,") else "paste" if head else None


FIELDS = ("review_id", "guest_name", "comment", "rating", "source")


def read(files: DataFrame, kind: str | None = None, sql: str | None = None) -> DataFrame:
    """path, and the standard fields as text, of rows (path, content). Files of no known kind, broken and empty ones give none."""
    aliases = {f: [header_key(n) for n in (f, *ALIASES[f])] for f in FIELDS}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                k = kind or kind_of(content or b"")
                if k is None:
                    continue
                try:
                    got = list(database(content, sql) if k == "sqlite" else ADAPTERS[k](content))
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, sqlite3.Error, UnicodeDecodeError, csv.Error):
                    continue
                out = pd.DataFrame([[next((r[n] for n in aliases[f] if r.get(n) is not None), None) for f in FIELDS] for r in got], columns=list(FIELDS), dtype=object)
                yield out.map(lambda v: None if v is None else str(v)).assign(path=path)[["path", *FIELDS]]

    return files.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{f} string" for f in FIELDS))


def written(df: DataFrame, kind: str, key: str, rows_per_file: int = FILE_ROWS) -> DataFrame:
    """(path, content): df as files of one kind, each of at most about `rows_per_file` rows, whatever the size of df."""
    names = df.columns
    files = max(1, -(-df.count() // rows_per_file))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        no = int(pdf["file_no"].iloc[0])
        rows = [[None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v for v in r] for r in pdf[names].sort_values(key).itertuples(index=False)]
        return pd.DataFrame({"path": [f"part-{no:05d}.{kind}"], "content": [WRITERS[kind](names, rows)]})

    numbered = df.withColumn("file_no", F.pmod(F.xxhash64(key), F.lit(files)).cast("int"))
    return numbered.groupBy("file_no").applyInPandas(run, "path string, content binary")


def database_bytes(names: list[str], rows: list[list]) -> bytes:
    con = sqlite3.connect(":memory:")
    quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
    con.execute(f"CREATE TABLE rows ({quoted})")
    con.executemany(f"INSERT INTO rows VALUES ({', '.join('?' * len(names))})", rows)
    con.commit()
    return con.serialize()


def csv_bytes(names: list[str], rows: list[list]) -> bytes:
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=";", quoting=csv.QUOTE_ALL)
    w.writerows([names, *rows])
    return (BOM + out.getvalue()).encode()


def records(names: list[str], rows: list[list]) -> list[dict]:
    return [dict(zip(names, r)) for r in rows]


def page(names: list[str], rows: list[list]) -> bytes:
    cards = "".join(f'<div class="card" data-review-id="{html.escape(str(r["id"]))}"><span class="author">{html.escape(str(r.get("author") or ""))}</span><span aria-label="{r.get("rating") or 0} stars"></span><span class="text">{html.escape(r.get("comment") or "")}</span></div>' for r in records(names, rows))
    return f"<html><body>{cards}</body></html>".encode()


def ld_page(names: list[str], rows: list[list]) -> bytes:
    body = json.dumps({"@type": "Hotel", "review": [{"@id": r["id"], "reviewBody": r.get("comment"), "reviewRating": {"ratingValue": r.get("rating")}} for r in records(names, rows)]}, ensure_ascii=False)
    return ('<html><script type="application/ld+json">' + body.replace("</", "<\\/") + "</script></html>").encode()


WRITERS: dict[str, Callable[[list[str], list[list]], bytes]] = {
    "xlsx": workbook, "sqlite": database_bytes, "csv": csv_bytes, "jsonl": lambda n, r: "\n".join(json.dumps(x, ensure_ascii=False) for x in records(n, r)).encode(), "json": lambda n, r: json.dumps(records(n, r)).encode(), "maps": page, "jsonld": ld_page,
    "paste": lambda n, r: "\n\n\n".join(f"{x['id']}\n{x['comment']}" for x in records(n, r)).encode(),
}
