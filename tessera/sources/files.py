"""Readers: files of several kinds to text, Turtle, interchange JSON, and payloads cut short."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How files of each kind begin, and which ends of names say the kind.
MAGIC = ((b"%PDF", "pdf"), (b"PK\x03\x04", "zip"), (b"\xd0\xcf\x11\xe0", "ole"))
ENDINGS = {"docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "htm": "html", "html": "html", "mht": "html", "txt": "text", "md": "text", "csv": "text", "pdf": "pdf", "doc": "doc", "ttl": "text", "json": "text"}
#: The words of the marks at the begin and end of a file's text.
BEGINS, ENDS = "文件开始", "文件结束"
#: The keys of an empty payload.
PAYLOAD_KEYS = ("classes", "instances", "object_types", "link_types", "action_types", "links")


def kind_of(name: str, data: bytes) -> str:
    """What a file is, by how it begins, then by its name."""
    ending = ENDINGS.get(name.rsplit(".", 1)[-1].lower(), "text")
    start = next((kind for magic, kind in MAGIC if data.startswith(magic)), None)
    if start == "zip":
        return ending if ending in ("docx", "pptx", "xlsx") else "docx"
    if start is None and data[:200].lstrip().lower().startswith((b"<!doctype html", b"<html")):
        return "html"
    return start if start == "pdf" else ending


def _texts(element, tag: str) -> str:
    return "".join(t.text or "" for t in element.iter() if t.tag.endswith("}" + tag))


def _table_rows(table) -> list[str]:
    """The rows of an office table that aren't blank, their cells between bars."""
    rows = [[_texts(c, "t").strip() for c in r if c.tag.endswith("}tc")] for r in table.iter() if r.tag.endswith("}tr")]
    return [" | ".join(cells) for cells in rows if any(cells)]


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, then the rows of tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    tables = [e for e in body.iter() if e.tag.endswith("}tbl")]
    inside = {id(p) for t in tables for p in t.iter()}
    lines = [_texts(p, "t") for p in body.iter() if p.tag.endswith("}p") and id(p) not in inside]
    return "\n".join([x for x in lines if x.strip()] + [r for t in tables for r in _table_rows(t)])


def pptx_text(data: bytes) -> str:
    """The text of every slide that has any under its number: shapes and tables in the slide's order."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        pages = [ElementTree.fromstring(archive.read(n)) for _, n in slides]
    out = []
    for i, page in enumerate(pages, 1):
        said = []
        for shape in [e for e in page.iter() if e.tag.rsplit("}", 1)[-1] in ("sp", "graphicFrame")] or [page]:
            tables = [e for e in shape.iter() if e.tag.endswith("}tbl")]
            rows = [r for t in tables for r in _table_rows(t)]
            if rows:
                said.append("\n[表格内容]:\n" + "\n".join(rows) + "\n")
            elif not tables:
                said.append("\n".join(_texts(p, "t") for p in shape.iter() if p.tag.endswith("}p")).strip())
        if any(said):
            out.append(f"[Page {i}]:\n" + "\n".join(x for x in said if x))
    return "\n".join(out)


def _column(reference: str | None, after: int) -> int:
    """The number from 0 of a cell's column by its name, such as C7; without one it is the next."""
    letters = re.match("[A-Z]+", reference or "")
    at = 0
    for letter in letters[0] if letters else "":
        at = 26 * at + ord(letter) - 64
    return at - 1 if at else after


def xlsx_text(data: bytes) -> str:
    """The rows of every sheet that isn't empty, under its name."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = archive.namelist()
        shared = [_texts(e, "t") for e in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = [e for e in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")]
        relations = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels")) if "xl/_rels/workbook.xml.rels" in names else ()
        target = {e.get("Id"): e.get("Target") for e in relations}
        out = []
        for i, sheet in enumerate(sheets, 1):
            title, related = sheet.get("name"), next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
            path = target.get(related, f"worksheets/sheet{i}.xml")
            path = path[1:] if path.startswith("/") else f"xl/{path}"
            if path not in names:
                continue
            rows = []
            for row in ElementTree.fromstring(archive.read(path)).iter():
                if row.tag.endswith("}row"):
                    cells: list[str] = []
                    for c in row:
                        if c.tag.endswith("}c"):
                            value = _texts(c, "v") or _texts(c, "t")
                            cells += [""] * (_column(c.get("r"), len(cells)) - len(cells))  # empty cells are left out of the file
                            cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                    rows.append("\t".join(cells))
            if any(r.strip() for r in rows):
                out.append(f"-- Sheet: {title} --\n" + "\n".join(rows))
    return "\n".join(out)


def html_text(data: bytes) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", data.decode("utf-8", "ignore"))
    text = html.unescape(re.sub(r"(?s)<[^>]*>", " ", text))
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    return re.sub(r"\s+", " ", text).strip()


def file_text(name: str, data: bytes) -> str | None:
    """A file's text; null for kinds that need a reader that isn't installed."""
    kind = kind_of(name, data)
    try:
        if kind == "pdf":
            try:
                import pymupdf
            except ImportError:
                return None
            return "\n".join(page.get_text() for page in pymupdf.open(stream=data))
        if kind in ("docx", "pptx", "xlsx"):
            return {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text}[kind](data)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    if kind == "doc":  # old files: whatever they hold that is text
        if b"<html" in data[:4000].lower() or b"mime-version" in data[:4000].lower():
            return html_text(data)
        if data.startswith(b"PK\x03\x04"):
            try:
                return docx_text(data)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                return None
        plain = data.decode("utf-8", "ignore")
        return plain if len(plain) > 10 else None
    return html_text(data) if kind == "html" else data.decode("utf-8", "ignore")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of all files under a path."""

    def run(frames: Iterator) -> Iterator:
        for rows in frames:
            rows["text"] = [file_text(n, bytes(c)) for n, c in zip(rows["name"], rows["content"], strict=True)]
            yield rows[["name", "text"]]

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "content").mapInPandas(run, "name string, text string")


def marked(files: DataFrame) -> DataFrame:
    """Texts between markers with their file's name; blank ones go."""
    mark = lambda word: F.format_string(f"<<<<<< {word}：%s >>>>>>", "name")
    shown = F.concat(F.lit("\n\n"), mark(BEGINS), F.lit("\n"), "text", F.lit("\n"), mark(ENDS), F.lit("\n"))
    return files.where(F.trim("text") != "").withColumn("text", shown)


def unmarked(texts: DataFrame, column: str) -> DataFrame:
    """(name, text): the files of a text of ``marked``."""
    begin, end = (rf"<<<<<< {word}：{{}} >>>>>>" for word in (BEGINS, ENDS))
    first, last = begin.format(r"([^\n]*?)") + r"\n", r"\n" + end.format(r"\1")
    one = texts.select(F.explode(F.regexp_extract_all(column, F.lit(rf"(?s){first}.*?{last}"), 0)).alias("_p"))
    name = F.regexp_extract("_p", f"^{first}", 1)
    return one.select(name.alias("name"), F.regexp_extract("_p", rf"(?s)^{first}(.*){last}$", 2).alias("text"))


def repair(payload: str | None) -> str:
    """A payload as JSON: as it is if it parses, else what can be saved of it, else an empty one."""
    text = re.sub(r"^```(?:json)?\s*|```\s*$", "", (payload or "").strip(), flags=re.MULTILINE).strip()

    def parsed(candidate: str):
        try:
            got = json.loads(candidate)
        except ValueError:
            return None
        return got if isinstance(got, (dict, list)) else None

    def closed(candidate: str) -> str:
        """With the quotes and brackets shut that are open at the end."""
        open_, quoted, skip = [], False, False
        for c in candidate:
            if skip or (quoted and c == "\\"):
                skip = not skip
            elif c == '"':
                quoted = not quoted
            elif not quoted and c in "{[":
                open_.append("}" if c == "{" else "]")
            elif not quoted and c in "}]" and open_:
                open_.pop()
        return candidate + '"' * quoted + "".join(reversed(open_))

    def ladder():
        yield text
        yield closed(text)
        begin = text.find("{")
        if begin >= 0:  # the first whole object
            try:
                got, _ = json.JSONDecoder().raw_decode(text[begin:])
                yield json.dumps(got, ensure_ascii=False)
            except ValueError:
                pass
        for end in ("},", "}"):
            at = text.rfind(end)
            if at >= 0:
                yield closed(text[: at + 1])
        yield re.sub(r",\s*([}\]])", r"\1", text)

    for candidate in ladder():
        got = parsed(candidate)
        if got is not None:
            if isinstance(got, dict) and candidate is not text:
                got = {k: [] for k in PAYLOAD_KEYS} | got
            return json.dumps(got, ensure_ascii=False)
    return json.dumps({k: [] for k in PAYLOAD_KEYS})


@F.pandas_udf(T.StringType())
def _repair(values):
    return values.map(repair)


def repaired(rows: DataFrame, column: str) -> DataFrame:
    """Rows with a payload column that is JSON; only broken payloads leave the JVM's own parser's path."""
    sound = F.try_parse_json(column).isNotNull()
    return rows.where(sound).unionByName(rows.where(~sound).withColumn(column, _repair(column)))


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>\s]*>)|(?P<str>"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|"(?:[^"\\\n]|\\.)*")|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)|(?P<num>[+-]?\d+(?:\.\d+)?)|(?P<name>[^\s<>"'.;,\[\]()^@#]*:[^\s<>"';,\[\]()^@#]*[^\s<>"'.;,\[\]()^@#]|[A-Za-z][\w-]*:?|:)|(?P<mark>[.;,])""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def parse_turtle(text: str) -> list[tuple[str, str, str, str, str | None, str | None]]:
    """(s, p, o, kind, lang, datatype) of a Turtle text: prefixes, ``a``, lists by ; and , and plain literals.

    Blank nodes and collections are an error.
    """
    xsd, rdf_type = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"not in the supported Turtle: {text[at : at + 30]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes: dict[str, str] = {}
    out, at = [], 0

    def plain(raw: str) -> str:
        raw = raw[3:-3] if raw.startswith('"""') and len(raw) >= 6 else raw[1:-1]
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), raw)

    def uri(token: tuple[str, str]) -> str:
        kind, value = token
        if kind == "iri":
            return value[1:-1]
        prefix, _, local = value.partition(":")
        if kind != "name" or prefix not in prefixes:
            raise ValueError(f"unknown name {value!r}")
        return prefixes[prefix] + local

    while at < len(tokens):
        if tokens[at][1].lower() in ("@prefix", "prefix"):
            prefixes[tokens[at + 1][1].rstrip(":")] = tokens[at + 2][1][1:-1]
            at += 3 + (tokens[at][1][0] == "@")
            continue
        subject, at = uri(tokens[at]), at + 1
        while tokens[at][1] != ".":
            predicate, at = rdf_type if tokens[at] == ("name", "a") else uri(tokens[at]), at + 1
            while True:
                kind, value = tokens[at]
                at += 1
                if kind == "str":
                    lang = datatype = None
                    if at < len(tokens) and tokens[at][0] == "lang":
                        lang, at = tokens[at][1][1:], at + 1
                    elif at < len(tokens) and tokens[at][0] == "type":
                        datatype, at = uri(tokens[at + 1]), at + 2
                    out.append((subject, predicate, plain(value), "literal", lang, datatype))
                elif kind == "num":
                    out.append((subject, predicate, value, "literal", None, xsd + ("decimal" if "." in value else "integer")))
                elif value in ("true", "false"):
                    out.append((subject, predicate, value, "literal", None, xsd + "boolean"))
                else:
                    out.append((subject, predicate, uri((kind, value)), "iri", None, None))
                if tokens[at][1] != ",":
                    break
                at += 1
            while tokens[at][1] == ";":
                at += 1
        at += 1
    return out


def _parsed_or_error(text: str) -> tuple[list[tuple], str | None]:
    try:
        return parse_turtle(text), None
    except (ValueError, IndexError) as error:  # a file that ends within a statement runs out of tokens
        return [], str(error) or "cut short"


def read_turtle(texts: DataFrame) -> DataFrame:
    """Triples of Turtle texts (source, text); a file is parsed in one task.  A file that can't be read gives none, see ``turtle_errors``."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for rows in frames:
            found = [(s, *t) for s, x in zip(rows["source"], rows["text"], strict=True) if x for t in _parsed_or_error(x)[0]]
            yield pd.DataFrame(found, columns=["source", "s", "p", "o", "o_kind", "lang", "datatype"])

    return texts.select("source", "text").mapInPandas(run, "source string, s string, p string, o string, o_kind string, lang string, datatype string")


def turtle_errors(texts: DataFrame) -> DataFrame:
    """(source, error): the Turtle texts that can't be read, such as those with blank nodes or cut short, and why."""

    @F.pandas_udf(T.StringType())
    def error(values):
        return values.map(lambda x: _parsed_or_error(x)[1] if x else None)

    return texts.select("source", error("text").alias("error")).where("error is not null")


def read_interchange(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities (with pos) and relationships of interchange JSON files."""
    schema = "entities array<struct<name:string,type:string,properties:map<string,string>>>, relationships array<struct<source_name:string,target_name:string,relation:string>>"
    found = spark.read.schema(schema).json(path, multiLine=True)
    return found.select(F.posexplode("entities").alias("pos", "e")).select("pos", "e.*"), found.select(F.inline("relationships"))
