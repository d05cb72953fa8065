"""Sources that end in the frame schema: texts, documents, code, exports of other stores."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .frames import conform


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files as ``file``, ``text``, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def text_frames(files: DataFrame, size: int = 512, stride: int = 256) -> DataFrame:
    """Windows of text files as document frames ``file::para_i``."""
    parts = files.select("file", F.explode(T.char_windows(F.col("text"), size, stride)).alias("w"))
    name = F.element_at(F.split("file", "/"), -1)
    rows = parts.select(
        F.concat(name, F.lit("::para_"), F.col("w.pos").cast("string")).alias("doc_id"),
        name.alias("title"),
        F.col("w.part").alias("content"),
        F.lit("document").alias("pillar"),
        T.auto_tags(name, F.col("w.part")).alias("tags"),
    )
    return conform(rows.withColumn("checksum", F.sha2("content", 256)))


def grep_files(spark: SparkSession, path: str, pattern: str, glob: str | None = None) -> DataFrame:
    """``file``, ``line`` of text files whose lines match."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path).filter(F.col("value").rlike(pattern)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file``, ``size``, ``modified`` of files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(data: bytes) -> Iterator[str]:
    """Non-empty paragraphs of a Word file: its body, then headers and footers."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = [n for n in archive.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", n)]
        for name in sorted(names, key=lambda n: (n != "word/document.xml", n)):
            for paragraph in ElementTree.fromstring(archive.read(name)).iter(f"{WORD_XML}p"):
                text = "".join(t.text or "" for t in paragraph.iter(f"{WORD_XML}t")).strip()
                if text:
                    yield text


def docx_frames(binaries: DataFrame) -> DataFrame:
    """Paragraphs of Word files (``path``, ``content``): ``file``, ``pos``, ``text``.  A file
    that is no Word file gives no rows."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, k, t) for k, t in enumerate(docx_paragraphs(bytes(content)))]
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["file", "pos", "text"]).astype({"pos": "int64"})

    return binaries.select("path", "content").mapInPandas(run, "file string, pos long, text string")


def sql_batches(files: DataFrame) -> DataFrame:
    """Statements of SQL scripts split at GO lines: ``file``, ``pos``, ``kind``, ``name``,
    ``tags``, ``body``."""
    parts = files.select("file", F.posexplode(F.split("text", r"(?mi)^\s*GO\s*$")).alias("pos", "body")).filter(F.length(F.trim("body")) > 0)
    head = F.regexp_extract("body", r"(?is)^\s*(?:--[^\n]*\n\s*)*(?:create(?:\s+or\s+alter)?|alter)\s+(table|view|procedure|proc|function|trigger)\s+", 1)
    kind = F.when(head == "", "statement").when(F.lower(head) == "proc", "procedure").otherwise(F.lower(head))
    name = F.regexp_extract("body", r"(?is)(?:create(?:\s+or\s+alter)?|alter)\s+(?:table|view|procedure|proc|function|trigger)\s+([\[\]\w.]+)", 1)
    fks = F.transform(F.regexp_extract_all("body", F.lit(r"(?i)references\s+([\[\]\w.]+)"), F.lit(1)), lambda x: F.concat(F.lit("fk:"), F.lower(x)))
    flags = F.array_compact(F.array(F.when(F.col("body").rlike(r"(?i)\bcheck\s*\("), "check"), F.when(F.col("body").rlike(r"(?i)sp_executesql|exec(?:ute)?\s*\("), "dynamic_sql")))
    return parts.select("file", "pos", kind.alias("kind"), F.regexp_replace(name, r"[\[\]]", "").alias("name"), F.array_distinct(F.concat(fks, flags)).alias("tags"), "body")


def create_table_columns(batches: DataFrame) -> DataFrame:
    """Columns of CREATE TABLE batches: ``table``, ``column``, ``type``, ``nullable``.  Comments and
    strings are no part of them; names may stand in brackets or quotes and hold spaces; lines of
    constraints and indexes are no columns."""
    body = F.regexp_extract(T.code_only(F.col("body")), r"(?is)\((.*)\)\s*(?:with\s*\([^)]*\)|on\s+\[?\w+\]?|;|\s)*$", 1)
    lines = batches.filter("kind = 'table'").select(F.col("name").alias("table"), F.explode(F.split(body, r",(?![^(]*\))")).alias("line"))
    name = r"(?:\[[^\]]+\]|\"[^\"]+\"|\w+)"
    bare = lambda c: F.regexp_replace(c, r"^[\[\"]|[\]\"]$", "")
    plain = F.regexp_replace("line", r"^\s+|\s+$", "")
    kind = F.regexp_extract(plain, rf"^{name}\s+((?:{name}\.)?{name})", 1)
    found = lines.select("table", bare(F.regexp_extract(plain, rf"^({name})\s", 1)).alias("column"), bare(F.regexp_replace(kind, rf"^{name}\.", "")).alias("type"), (~plain.rlike(r"(?i)\bnot\s+null\b|\bprimary\s+key\b")).alias("nullable"), plain.rlike(r"(?i)^(constraint|primary|foreign|unique|check|index|period)\b").alias("other"))
    return found.filter((F.col("column") != "") & ~F.col("other")).drop("other")


def code_chunks(files: DataFrame) -> DataFrame:
    """Definitions in source files: ``file``, ``name``, ``kind``, ``line``, ``calls``; a chunk
    reaches to the next definition."""
    pattern = r"(?m)^[ \t]*((?:pub(?:\([^)]*\))?\s+|export\s+|async\s+|static\s+|public\s+|private\s+)*(?:def|fn|function|class|struct|interface|enum|trait)\s+[A-Za-z_]\w*)"
    parts = files.select("file", F.posexplode(F.split("text", f"(?={pattern})")).alias("pos", "body"))
    before = F.coalesce(F.sum(F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit("")))).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.regexp_extract("body", pattern, 1)
    kind = F.regexp_extract(starts, r"(def|fn|function|class|struct|interface|enum|trait)\s+\w+$", 1)
    lined = parts.withColumn("line", (before + 1).cast("int"))
    named = lined.withColumn("kind", kind).withColumn("name", F.regexp_extract(starts, r"(\w+)$", 1)).filter("kind <> ''")
    return named.select("file", "name", "kind", "line", F.array_remove(T.calls(F.col("body")), F.col("name")).alias("calls"))


def mem0_frames(records: DataFrame) -> DataFrame:
    """One exported memory a row (``id``, ``memory``, ``user_id``, ``created_at``,
    ``categories``) as frames; categories decide the pillar and become tags."""
    any_of = lambda *names: F.exists(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.lower(c).isin(*names))
    pillar = F.when(any_of("skill", "procedure", "howto"), "procedural").when(any_of("event", "episode", "conversation"), "episodic").otherwise("semantic")
    tags = F.concat(F.array(F.concat(F.lit("user_id:"), "user_id"), F.concat(F.lit("ingested_at:"), F.col("created_at").cast("string"))), F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.concat(F.lit("category:"), c)))
    return conform(records.select(F.col("id").cast("string").alias("doc_id"), F.col("memory").alias("content"), F.col("created_at").cast("timestamp").alias("created_at"), pillar.alias("pillar"), F.array_compact(tags).alias("tags")))


MEM0_SCHEMA = "id string, memory string, user_id string, created_at string, categories array<string>, metadata map<string,string>"
MEMVID_SCHEMA = "id string, content string, timestamp long, metadata map<string,string>"


def read_mem0(spark: SparkSession, path: str) -> DataFrame:
    return mem0_frames(spark.read.schema(MEM0_SCHEMA).json(path))


def memvid_frames(records: DataFrame) -> DataFrame:
    """Exported array entries (``id``, ``content``, ``timestamp``, ``metadata``) as episodes."""
    tags = F.transform(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return conform(records.select(F.col("id").alias("doc_id"), "content", F.timestamp_seconds("timestamp").alias("created_at"), F.lit("episodic").alias("pillar"), F.array_sort(tags).alias("tags")))


def read_memvid(spark: SparkSession, path: str) -> DataFrame:
    return memvid_frames(spark.read.schema(MEMVID_SCHEMA).json(path, multiLine=True))


def migrated(frames: DataFrame, enterprise: bool = False) -> tuple[DataFrame, DataFrame]:
    """What a migration may write and its counts by pillar; an enterprise store takes external
    pointers only."""
    kept = frames.filter("pillar = 'external'") if enterprise else frames
    return kept, kept.groupBy("pillar").agg(F.count("*").alias("n"))


def history_frames(visits: DataFrame, least_visits: int = 2, most: int = 1000) -> DataFrame:
    """Browser history (``url``, ``title``, ``visit_count``, ``last_visit_time``) as pointers,
    the newest first; without a title there is no pointer."""
    kept = visits.filter((F.col("visit_count") >= least_visits) & (F.length(F.trim("title")) > 0)).orderBy(F.col("last_visit_time").desc(), "url").limit(most)
    host = F.parse_url("url", F.lit("HOST"))
    return conform(kept.select(F.substring(F.sha2("url", 256), 1, 16).alias("doc_id"), F.col("title"), F.concat("title", F.lit(" — "), host).alias("content"), F.lit("external").alias("pillar"), F.array(F.lit("external:pointer"), F.concat(F.lit("external:uri="), "url")).alias("tags")))


def pointer(doc_id: Column, uri: Column, mime: Column, summary: Column) -> list[Column]:
    """Columns of an external pointer: the body is its summary."""
    tags = F.array_compact(F.array(F.lit("external:pointer"), F.concat(F.lit("external:uri="), uri), F.concat(F.lit("external:mime="), mime)))
    return [doc_id.alias("doc_id"), summary.alias("content"), F.lit("external").alias("pillar"), tags.alias("tags")]


def directive_source(path: Column) -> Column:
    """Reader of a directive by its path or address: ``openapi``, ``markdown``, null if none."""
    low = F.lower(path)
    described = low.rlike(r"\.(yaml|yml|json)$")
    web = path.rlike("^https?://")
    spec = F.when(web, described | low.contains("openapi") | low.contains("swagger")).when(path.rlike("^[A-Za-z]*://"), F.lit(False)).otherwise(described)
    return F.when(spec, "openapi").when(low.rlike(r"\.(md|markdown)$"), "markdown")


def openapi_operations(specs: DataFrame) -> DataFrame:
    """Operations of OpenAPI documents (``file``, ``text`` as JSON): ``path``, ``method``,
    ``operation_id``."""
    op = "struct<operationId:string,summary:string>"
    doc = F.from_json("text", f"paths map<string,struct<get:{op},post:{op},put:{op},patch:{op},delete:{op}>>")
    paths = specs.select("file", F.explode(doc["paths"]).alias("path", "item"))
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"item.{m}").alias("op")) for m in ("get", "post", "put", "patch", "delete")])
    return paths.select("file", "path", F.explode(methods).alias("m")).filter("m.op is not null").select("file", "path", "m.method", F.col("m.op.operationId").alias("operation_id"))


def markdown_requirements(files: DataFrame) -> DataFrame:
    """Sections of Markdown files: ``file``, ``pos``, ``level``, ``heading``, ``body``."""
    parts = files.select("file", F.posexplode(F.split("text", r"(?m)(?=^#{1,6} )")).alias("pos", "part")).filter(F.col("part").rlike(r"^#{1,6} "))
    mark = F.regexp_extract("part", r"^(#{1,6}) ", 1)
    return parts.select("file", "pos", F.length(mark).alias("level"), F.trim(F.regexp_extract("part", r"^#{1,6} ([^\n]*)", 1)).alias("heading"), F.regexp_replace("part", r"^[^\n]*\n?\s*|\s+$", "").alias("body"))


def database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a database query over JDBC."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


SHEET_XML = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Non-empty cells of a workbook: sheet name, row and column from 1, value as text; a
    merged range repeats its first cell."""

    def place(ref: str) -> tuple[int, int]:
        letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
        column = 0
        for letter in letters:
            column = column * 26 + ord(letter) - 64
        return int(digits), column

    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = set(archive.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{SHEET_XML}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{SHEET_XML}t")))
        titles = [s.get("name") for s in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{SHEET_XML}sheet")]
        for number, title in enumerate(titles, 1):
            sheet = ElementTree.fromstring(archive.read(f"xl/worksheets/sheet{number}.xml"))
            cells = {}
            for cell in sheet.iter(f"{SHEET_XML}c"):
                value = cell.find(f"{SHEET_XML}v")
                text = "".join(t.text or "" for t in cell.iter(f"{SHEET_XML}t")) if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text
                if text:
                    cells[place(cell.get("r"))] = text
            for merge in sheet.iter(f"{SHEET_XML}mergeCell"):
                (top, left), (bottom, right) = map(place, merge.get("ref").split(":"))
                for row in range(top, bottom + 1):
                    for column in range(left, right + 1):
                        if (top, left) in cells:
                            cells[row, column] = cells[top, left]
            for (row, column), text in sorted(cells.items()):
                yield title, row, column, text


def xlsx_rows(binaries: DataFrame) -> DataFrame:
    """Cells of workbooks (``path``, ``content``): ``file``, ``sheet``, ``row``, ``col``,
    ``value``.  A file that is no workbook gives no rows."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, *cell) for cell in xlsx_cells(bytes(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["file", "sheet", "row", "col", "value"]).astype({"row": "int64", "col": "int64"})

    return binaries.select("path", "content").mapInPandas(run, "file string, sheet string, row long, col long, value string")


def with_headers(cells: DataFrame) -> DataFrame:
    """Cells under the header of their column, which is the first row of a sheet that has the
    most filled cells: ``file``, ``sheet``, ``row``, ``header``, ``value``."""
    widths = cells.groupBy("file", "sheet", "row").agg(F.count("*").alias("n"))
    heads = widths.groupBy("file", "sheet").agg(F.max_by("row", F.struct("n", (-F.col("row")).alias("r"))).alias("head"))
    named = cells.join(heads, ["file", "sheet"])
    titles = named.filter(F.col("row") == F.col("head")).select("file", "sheet", "col", F.col("value").alias("header"))
    return named.filter(F.col("row") > F.col("head")).join(titles, ["file", "sheet", "col"]).select("file", "sheet", "row", "header", "value")


def parsed_pages(binaries: DataFrame, parse) -> DataFrame:
    """Pages of binary documents by a parser from bytes to page texts (a PDF library, say):
    ``file``, ``page`` from 1, ``text``.  Page clean-up operators take it from there."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(path, k, text) for path, content in zip(pdf["path"], pdf["content"], strict=True) for k, text in enumerate(parse(bytes(content)), 1)]
            yield pd.DataFrame(rows, columns=["file", "page", "text"]).astype({"page": "int64"})

    return binaries.select("path", "content").mapInPandas(run, "file string, page long, text string")


def transcript_frames(rows: DataFrame) -> DataFrame:
    """Transcribed segments (``file``, ``start``, ``end`` in seconds, ``text``) as frames."""
    name = F.element_at(F.split("file", "/"), -1)
    times = F.array(F.format_string("start:%.2f", F.col("start").cast("double")), F.format_string("end:%.2f", F.col("end").cast("double")))
    doc_id = F.concat(name, F.lit("::seg_"), F.lpad(F.floor(F.col("start") * 1000).cast("string"), 10, "0"))
    return conform(rows.filter(F.length(F.trim("text")) > 0).select(doc_id.alias("doc_id"), name.alias("title"), F.col("text").alias("content"), F.lit("document").alias("pillar"), times.alias("tags")))


def event_frames(events: DataFrame) -> DataFrame:
    """Ends of sessions and tool calls (``session``, ``kind``, ``ts``, ``summary``) as episodes;
    on a stream as on a table."""
    tags = F.array(F.concat(F.lit("event:"), "kind"), F.concat(F.lit("session:"), "session"))
    return conform(events.select(F.concat_ws("_", F.lit("event"), "session", F.unix_micros(F.col("ts").cast("timestamp")).cast("string")).alias("doc_id"), F.col("summary").alias("content"), F.col("ts").alias("created_at"), F.lit("episodic").alias("pillar"), tags.alias("tags")))


def procedure_facts(batches: DataFrame) -> DataFrame:
    """What a procedure's body shows (``name``, ``body``): parameters, JSON keys it reads,
    tables it changes, literals it compares, error codes it throws; one row per fact.  Comments
    show nothing, nor do strings what only code can say."""
    batches = batches.select("name", T.without_comments(F.col("body")).alias("body"), T.code_only(F.col("body")).alias("code"))
    of = lambda kind, pattern, where="code": F.transform(F.regexp_extract_all(where, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))
    facts = F.concat(
        of("parameter", r"(?i)(@\w+)\s+(?:n?varchar|n?char|int|bigint|bit|decimal|date\w*|uniqueidentifier)"),
        of("json", r"(?i)'\$\.([\w.]+)'", "body"),
        of("changes", r"(?i)\b(?:update|delete\s+from|merge\s+into|truncate\s+table)\s+(?:\[?\w+\]?\.)?\[?(\w+)"),
        of("literal", r"(?:=|<>)\s*N?'([^']*)'", "body"),
        of("error", r"(?i)\b(?:throw|raiserror)\s*\(?\s*(\d+)"),
    )
    return batches.select("name", F.explode(F.array_distinct(facts)).alias("f")).select("name", "f.kind", "f.value")
