"""Text and JSON sources and sinks: mapping files, explanation files, repair, question files (SRC-8 .. SRC-12, SNK-*)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPLANATION = "inferred struct<subject:string,predicate:string,object:string>, explanations array<array<string>>, size struct<min:int,max:int>, explanationCount int, taskIds array<string>, sparqlQueries array<string>"

# The columns of a question file, in order.
QUESTION_COLUMNS = ("Task ID", "Root Entity", "Size of ontology TBox", "Size of ontology ABox", "Task Type", "Answer Type", "SPARQL Query", "Predicate", "Answer", "Min Tag Length", "Max Tag Length")
QUESTION_SCHEMA = T.StructType([T.StructField(c, T.IntegerType() if c.startswith(("Size", "Min", "Max")) else T.StringType()) for c in QUESTION_COLUMNS])


def repair_json(text: Column) -> Column:
    """SNK-14: comma-only lines go, repeated commas become one, commas before a bracket go, missing braces close."""
    t = F.regexp_replace(text, r"(?m)^\s*,\s*$", "")
    t = F.regexp_replace(t, r",(\s*,)+", ",")
    t = F.regexp_replace(t, r",(\s*[}\]])", "$1")
    t = F.regexp_replace(t, r",\s*$", "")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return F.concat(t, F.repeat(F.lit("}"), F.greatest(F.lit(0), count(t, "{") - count(t, "}"))))


def is_json(text: Column) -> Column:
    """Whether Spark reads the text as one JSON value."""
    return F.try_parse_json(text).isNotNull()


def _whole_pairs(text: str | None) -> list[tuple[str, str]]:
    decoder, found = json.JSONDecoder(), []
    at = (text or "").find("{") + 1
    while at > 0:
        try:
            while text[at] in " \t\r\n,":
                at += 1
            name, at = decoder.raw_decode(text, at)
            while text[at] in " \t\r\n:":
                at += 1
            value, at = decoder.raw_decode(text, at)
        except (ValueError, IndexError):
            break
        if not isinstance(name, str):
            break
        found.append((name, json.dumps(value)))
    return found


def partial_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """SRC-10: (key, name, value as JSON) of the whole pairs of an object before its first error; Arrow batches."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *pair) for i, t in enumerate(b.column(1).to_pylist()) for pair in _whole_pairs(t)]
            at, names, values = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(values, pa.string())], names=["key", "name", "value"])

    return rows.mapInArrow(run, f"key {kind}, name string, value string").withColumnRenamed("key", key)


def read_explanations(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: one row for each triple of a file that is one JSON object."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,struct<{_struct(EXPLANATION)}>>")).alias("triple_key", "e"))
    return rows.select("triple_key", "e.*")


def _struct(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(ddl))


def explanation_json(rows: DataFrame) -> DataFrame:
    """SNK-3: a line ``"key": {...}`` for each triple; joined by commas within braces they are one object."""
    body = F.to_json(F.struct(F.struct(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object")).alias("inferred"), "explanations", F.struct(F.col("min_size").alias("min"), F.col("max_size").alias("max")).alias("size"), F.col("explanation_count").alias("explanationCount"), F.col("task_ids").alias("taskIds"), F.col("sparql_queries").alias("sparqlQueries")))
    return rows.select(F.concat_ws("|", "s", "p", "o").alias("triple_key"), body.alias("json"))


def explanation_lines(rows: DataFrame) -> DataFrame:
    """SNK-3: the lines of the explanation file, in order: one valid JSON object of all triples (columns of ``explanation_json``).

    Sorted by triple; only the last line's comma differs, and it is found by the greatest key, so no row meets all others.
    """
    last = rows.agg(F.max("triple_key").alias("_last"))
    entry = F.concat(F.to_json(F.struct(F.col("triple_key").alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("triple_key").alias("k")))) - 6), F.lit(": "), "json")
    body = rows.crossJoin(F.broadcast(last)).select(F.lit(1).alias("_k"), "triple_key", F.concat(entry, F.when(F.col("triple_key") == F.col("_last"), F.lit("")).otherwise(F.lit(","))).alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "_k int, triple_key string, value string")
    return body.unionByName(ends).orderBy("_k", "triple_key").select("value")


def write_explanations(rows: DataFrame, path: str) -> None:
    """SNK-3: the file's lines as text parts in order; read together (``cat part-*``) they are one JSON object."""
    explanation_lines(rows).write.mode("overwrite").text(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: (original, abstract_uri, abstract_name) of the lines ``name -> <iri>``; headers and blanks go."""
    lines = spark.read.text(path).where(F.contains("value", F.lit("->")) & ~F.col("value").startswith("===") & ~F.col("value").startswith("Original"))
    parts = F.split("value", "->", 2)
    iri = F.regexp_replace(F.trim(parts[1]), "[<>]", "")
    name = F.regexp_extract(F.trim(parts[1]), "#([^>]+)>?$", 1)
    return lines.select(F.trim(parts[0]).alias("original"), iri.alias("abstract_uri"), F.when(name != "", name).otherwise(iri).alias("abstract_name"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7"""
    return spark.read.csv(path, header=True, schema=QUESTION_SCHEMA, quote='"', escape='"', multiLine=True)


def write_questions(rows: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-2: all strings quoted, quotes doubled, line breaks as blanks."""
    flat = rows.select(*[F.regexp_replace(c, "[\r\n]", " ").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    flat.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_contexts(spark: SparkSession, path: str, mode: str = "json", most: int = 15_000) -> DataFrame:
    """SRC-11, SRC-13: (root_entity, context) of the files of a folder, long ones cut with a remark.

    mode ttl takes Turtle files as they are, json takes JSON files, indented (as they are where they are no JSON).
    """
    from quillon.functions.answers import truncated

    files = spark.read.text(path, wholetext=True, pathGlobFilter=f"*.{mode}", recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("f"), "value")
    rows = files.select(F.regexp_replace("f", r"\.[^.]+$", "").alias("root_entity"), F.col("value").alias("context"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([_indented(t) for t in b.column(1).to_pylist()], pa.string())], names=["root_entity", "context"])

    rows = rows.mapInArrow(run, rows.schema) if mode == "json" else rows
    return rows.select("root_entity", truncated(F.col("context"), most).alias("context"))


def _indented(text: str) -> str:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


def _sheet(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet, as text."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree as ET

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{space}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        first = min((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for row in ET.fromstring(z.read(first)).iter(f"{space}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{space}c"):
                at = 0
                for letter in re.match("[A-Z]+", cell.get("r", "A"))[0]:
                    at = at * 26 + ord(letter) - 64
                cells += [None] * (at - 1 - len(cells))
                value, kind = cell.find(f"{space}v"), cell.get("t")
                text = "".join(t.text or "" for t in cell.iter(f"{space}t")) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                cells.append({"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text)
            out.append(cells)
    return out


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: the first sheet of a workbook, its first row as names, all columns strings; a sheet is one small file."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    head, *rows = _sheet(bytes(content)) or [[]]
    width = len(head)
    kinds = T.StructType([T.StructField(str(c) if c is not None else f"_c{k}", T.StringType()) for k, c in enumerate(head)])
    return spark.createDataFrame([tuple([*r, *[None] * width][:width]) for r in rows], kinds)


def read_table(spark: SparkSession, base: str) -> DataFrame:
    """SRC-8: ``base.xlsx`` if it is there, else ``base.csv``; an error names both."""
    for suffix in (".xlsx", ".csv"):
        path = spark._jvm.org.apache.hadoop.fs.Path(base + suffix)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return read_xlsx(spark, base + suffix) if suffix == ".xlsx" else spark.read.csv(base + suffix, header=True, quote='"', escape='"', multiLine=True)
    raise FileNotFoundError(f"neither {base}.xlsx nor {base}.csv is there")


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide result files (a column ``<model>_final_answer`` for each model) as rows of (keys, model, fields)."""
    fields = ("response", "final_answer", "confidence_score", "reasoning_steps_complexity", "response_time", "token_count", "quality_correctness")
    models = sorted(c.removesuffix("_final_answer") for c in wide.columns if c.endswith("_final_answer"))
    rows = [F.struct(F.lit(m).alias("model"), *[(F.col(f"{m}_{f}") if f"{m}_{f}" in wide.columns else F.lit(None)).cast("string").alias(f) for f in fields]) for m in models]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*") if rows else wide.select(*keys).limit(0)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """An error that names the missing columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
