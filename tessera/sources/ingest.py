"""Bringing rows and files in: database imports, documents from rows, file readers, embeddings."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# -- relational sources


def from_database(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Rows of a query over JDBC. ``partition``: a numeric column, its bounds and the number of readers."""
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    if partition:
        column, low, high, n = partition
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", column)
        return reader.option("lowerBound", low).option("upperBound", high).option("numPartitions", n).load()
    return reader.option("query", query).load()


def require_columns(df: DataFrame, *names: str | None) -> DataFrame:
    """``df``, if it has all the columns; None and ``*`` ask for nothing."""
    gone = [n for n in names if n and n != "*" and n not in df.columns]
    if gone:
        raise ValueError(f"columns not found: {', '.join(gone)}; there are {', '.join(df.columns)}")
    return df


def documents(
    rows: DataFrame,
    id_col: str,
    keyword_cols: Sequence[str] = (),
    content_cols: Sequence[str] | str = "*",
    bits_col: str | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """``doc_id``, ``bits``, ``keywords`` (array of field and word) and ``content``: one row per row with an id.

    A keyword column gives its words and its whole value, under its name in ``names``. The content is
    the columns as text joined by a space, all of them for ``*``; nulls are left out.
    """
    contents = list(rows.columns) if content_cols == "*" else [content_cols] if isinstance(content_cols, str) else list(content_cols)
    require_columns(rows, id_col, bits_col, *keyword_cols, *contents)
    none = F.array().cast("array<struct<field:string,word:string>>")

    def keywords(c: str) -> Column:
        value = F.col(c).cast("string")
        found = F.concat(F.filter(F.split(F.trim(value), r"\s+"), lambda w: w != ""), F.array(value))
        return F.coalesce(F.transform(F.array_distinct(found), lambda w: F.struct(F.lit((names or {}).get(c, c)).alias("field"), w.alias("word"))), none)

    bits = F.lit(0).cast("long") if bits_col is None else F.coalesce(F.col(bits_col).try_cast("long"), F.lit(0).cast("long"))
    return rows.where(F.col(id_col).isNotNull() & (F.trim(F.col(id_col).cast("string")) != "")).select(
        F.trim(F.col(id_col).cast("string")).alias("doc_id"),
        bits.alias("bits"),
        (F.concat(*map(keywords, keyword_cols)) if keyword_cols else none).alias("keywords"),
        F.concat_ws(" ", *[F.col(c).cast("string") for c in contents]).alias("content"),
    )


def changed_since(rows: DataFrame, time_col: str, mark) -> DataFrame:
    """Rows newer than the high-water mark; all of them without one."""
    return rows if mark is None else rows.where(F.col(time_col) > F.lit(mark))


def changed_ids(rows: DataFrame, id_col: str, time_col: str, mark) -> DataFrame:
    return changed_since(rows, time_col, mark).select(id_col)


def many_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of all tables with their table's name; columns that a table lacks are null."""
    out = None
    for name, df in tables.items():
        one = df.withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def transformed(rows: DataFrame, hook: Callable[[DataFrame], DataFrame] | Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``rows`` after one hook or several, each a DataFrame to a DataFrame."""
    for h in hook if isinstance(hook, Sequence) else [hook]:
        rows = rows.transform(h)
    return rows


# -- schemas and text about them


def row_text(rows: DataFrame, separator: str = ", ") -> Column:
    """All columns of a row as text; nulls are left out."""
    return F.concat_ws(separator, *[F.col(c).cast("string") for c in rows.columns])


def describe(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``table``, ``column``, ``type``, ``position`` and ``rows`` for the columns of each table."""
    out = None
    for name, df in tables.items():
        columns = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema.fields])
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.posexplode(columns).alias("position", "c"))
        one = one.select("table", "c.column", "c.type", "position", "rows")
        out = one if out is None else out.unionByName(one)
    return out


def table_text(name: str, df: DataFrame, rows: int, keys: Sequence[str] = (), schema: str = "default") -> str:
    """A description of a table: its columns with their types and marks, and its number of rows."""
    lines = [f"Table: {schema}.{name}", "Columns:"]
    lines += [f"  - {f.name} {f.dataType.simpleString()} {'(PK)' if f.name in keys else ''} {'' if f.nullable else 'NOT NULL'}" for f in df.schema.fields]
    return "\n".join([*lines, f"Row Count: {rows}", ""])


def training_text(name: str, df: DataFrame, header: str | None = None, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """One row with ``text``: the header, five example rows (by ``order``) and example queries."""
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in df.columns]
    head = header or f"Table: {name}\nColumns: {', '.join(df.columns)}\n"
    sql = [f"SELECT * FROM {name} LIMIT 5;", f"SELECT COUNT(*) FROM {name};", *[f"SELECT * FROM {name} WHERE {k} = <value>;" for k in keys[:1]]]
    keys_ = [F.col(c) for c in (order or df.columns)]
    some = df.orderBy(*keys_).limit(5).select(F.struct(*keys_, F.concat(F.lit("Row: "), F.concat_ws(", ", *cells)).alias("_line")).alias("r"))
    lines = some.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["_line"]), "\n").alias("l"))
    return lines.select(F.concat(F.lit(head + "\n\nData Examples:\n"), F.col("l"), F.lit("\n\nSQL Query Examples:\n" + "\n".join(sql))).alias("text"))


def qa_pairs(name: str, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``n`` and ``text``: questions about a table with their answers, the first row (by its columns) as example."""
    pair = lambda q, a: F.concat(F.lit("<s>[INST] "), q, F.lit(" [/INST] "), a, F.lit("</s>"))
    key = f"The primary key of the {name} table is {', '.join(keys)}" if keys else f"The {name} table does not have a primary key defined."
    texts = [
        pair(F.lit(f"What columns are in the {name} table?"), F.lit(f"The {name} table has the following columns: {', '.join(df.columns)}")),
        pair(F.lit(f"How many rows are in the {name} table?"), F.concat(F.lit(f"The {name} table has "), F.col("_rows").cast("string"), F.lit(" rows."))),
        pair(F.lit(f"What is the primary key of the {name} table?"), F.lit(key)),
    ]
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"_first.{c}").cast("string"), F.lit("None"))) for c in df.columns]
    texts.append(pair(F.lit(f"Show me an example row from the {name} table."), F.concat(F.lit("Here is an example row: "), F.concat_ws(", ", *cells))))
    if keys:
        value = F.col(f"_first.{keys[0]}").cast("string")
        question = F.concat(F.lit(f"How can I query the {name} table for a record with {keys[0]}="), value, F.lit("?"))
        answer = F.concat(F.lit(f"You can use the following SQL query:\nSELECT * FROM {name} WHERE {keys[0]} = "), value, F.lit(";"))
        texts.append(pair(question, answer))
    one = df.agg(F.count("*").alias("_rows"), F.min(F.struct(*df.columns)).alias("_first"))
    return one.select(F.posexplode(F.array(*texts)).alias("n", "text")).where("text is not null")


# -- files

#: Extensions that have a reader.
READERS = ("txt", "md", "html", "htm", "docx", "pdf")


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_to_text(page: str) -> str:
    p = _Visible()
    p.feed(page)
    p.close()
    return "".join(p.out)


def docx_to_text(raw: bytes) -> str:
    """The paragraphs of a document, a line each."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return "".join("".join(t.text or "" for t in p.iter(f"{w}t")) + "\n" for p in body.iter(f"{w}p"))


def pdf_to_text(raw: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ModuleNotFoundError as e:
        raise ValueError("reading PDF files needs the package pypdf") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages)


def file_text(extension: str, raw: bytes) -> str:
    if extension in ("txt", "md"):
        return raw.decode("utf-8", "replace")
    if extension in ("html", "htm"):
        return html_to_text(raw.decode("utf-8", "replace"))
    if extension == "docx":
        return docx_to_text(raw)
    if extension == "pdf":
        return pdf_to_text(raw)
    raise ValueError(f"no reader for files that end in .{extension}")


def scan_files(spark: SparkSession, path: str, extensions: Sequence[str] = READERS) -> DataFrame:
    """``path``, ``modified``, ``size``, ``extension`` and ``content`` (bytes) of the files below a folder.

    Extensions are compared in lower case; contents are read only where they are used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    wanted = [e.lower().lstrip(".") for e in extensions]
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), ext.alias("extension"), "content").where(F.col("extension").isin(wanted))


def read_files(files: DataFrame) -> DataFrame:
    """``path``, ``modified``, ``text`` and ``error`` (null if the file could be read)."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                row = part.slice(i, 1)
                try:
                    text, error = file_text(row.column("extension")[0].as_py(), row.column("content")[0].as_py()), None
                except Exception as e:  # a broken file is a row of the result
                    text, error = None, f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays(
                    [row.column("path"), row.column("modified"), pa.array([text], pa.string()), pa.array([error], pa.string())], ["path", "modified", "text", "error"]
                )

    return files.select("path", "modified", "extension", "content").mapInArrow(read, "path string, modified timestamp, text string, error string")


def word_embeddings(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """``word`` and ``vec`` from lines of a word and its numbers; a first line of two numbers is a header."""
    parts = F.split(F.trim("value"), r"\s+")
    vec = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.try_cast("double"))
    rows = spark.read.text(path).where(F.size(parts) > 2).select(F.get(parts, 0).alias("word"), vec.alias("vec"))
    return rows if dimension is None else rows.where(F.size("vec") == dimension)


def parse_config(text: str, kind: str) -> list[tuple[str, str | None]]:
    """(path, value) of every node of a JSON, YAML or INI text, in order."""
    if kind == "ini":
        import configparser

        p = configparser.ConfigParser()
        p.read_string(text)
        tree = {s: dict(p[s]) for s in p.sections()}
    elif kind == "yaml":
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise ValueError("reading YAML needs the package yaml") from e
        tree = yaml.safe_load(text)
    elif kind == "json":
        tree = json.loads(text)
    else:
        raise ValueError(f"unknown kind: {kind!r}")
    out: list[tuple[str, str | None]] = []

    def walk(node, path: str) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, f"{path}.{k}" if path else str(k))
        elif isinstance(node, list):
            for i, v in enumerate(node):
                walk(v, f"{path}[{i}]")
        else:
            out.append((path, None if node is None else str(node)))

    walk(tree, "")
    return out
