"""Readers and writers: annotated JSON corpora, JSON lines, CSV tables, checkpoints."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolake.schema import PAPER


def read_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """paper_id, content of JSON files that hold one object keyed by paper; `file` is the base name.

    A file is one row until it is split, so large corpora should be stored as a table once.
    """
    raw = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return raw.select("file", F.explode(F.from_json("value", f"map<string, {PAPER}>")).alias("paper_id", "content"))


def merged_corpora(corpora: list[DataFrame]) -> DataFrame:
    """Papers of several corpora; of a paper in more than one, the last counts."""
    from annolake.operators.spans import last_wins

    out = None
    for k, corpus in enumerate(corpora):
        one = corpus.select("paper_id", "content", F.lit(k).alias("_file"))
        out = one if out is None else out.unionByName(one)
    return last_wins(out, ["paper_id"], ["_file"]).drop("_file")


def entities(corpus: DataFrame, field: str = "entities") -> DataFrame:
    """A row an entity, with ord, its place in the list."""
    return corpus.select("paper_id", F.posexplode(f"content.{field}").alias("ord", "x")).select("paper_id", "ord", "x.*")


def papers(corpus: DataFrame) -> DataFrame:
    """paper_id, title, abstract; from metadata, else from the top level."""
    return corpus.select("paper_id", *[F.coalesce(F.col(f"content.metadata.{c}"), F.col(f"content.{c}"), F.lit("")).alias(c) for c in ("title", "abstract")])


def write_corpus(papers: DataFrame, entities: DataFrame, path: str) -> None:
    """A JSON object a line, {paper_id: content}: the parts can be read in parallel."""
    fields = [c for c in entities.columns if c not in ("paper_id", "ord")]
    lists = entities.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("x")))), lambda e: e["x"]).alias("entities"))
    content = F.struct(F.struct("title", "abstract").alias("metadata"), F.coalesce("entities", F.array()).alias("entities"))
    papers.join(lists, "paper_id", "left").select(F.to_json(F.create_map("paper_id", content)).alias("value")).write.mode("errorifexists").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines, blank ones skipped; strict: a bad line fails the job, else it is left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).filter("trim(value) <> ''")
    made = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("x")).select("x.*")
    return made.filter("_corrupt is null").drop("_corrupt")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """Stored results; bad lines are skipped, and of rows with one key the one in the last file counts."""
    from annolake.operators.spans import first_wins

    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_name").alias("_name"), F.monotonically_increasing_id().alias("_line"))
    made = lines.filter("trim(value) <> ''").select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("x"), "_time", "_name", "_line").select("x.*", "_time", "_name", "_line")
    return first_wins(made.filter("_corrupt is null"), [key], [F.desc("_time"), F.desc("_name"), F.desc("_line")]).drop("_corrupt", "_time", "_name", "_line")


def read_tables(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    return [spark.read.option("header", True).option("inferSchema", True).csv(p) for p in paths]


def merged_tables(tables: list[DataFrame], sort: str | None = None, ascending: bool = False) -> DataFrame:
    """Tables below each other, columns by name, sorted if the column exists; a warning tells if it doesn't."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    if sort in out.columns:
        out = out.orderBy(F.col(sort).asc() if ascending else F.col(sort).desc())
    elif sort:
        warnings.warn(f"no column {sort} to sort by: {', '.join(out.columns)}", stacklevel=2)
    return out


def write_table(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def prediction_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> list[str]:
    """Paths of at least two prediction files, sorted by name; the place is the model's number."""
    found = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").collect()]
    if len(found) < 2:
        raise ValueError(f"at least two prediction files are needed in {folder}")
    return sorted(found, key=os.path.basename)


def read_predictions(spark: SparkSession, folder: str, field: str = "entities", pattern: str = "*.json") -> DataFrame:
    """name, paper_id, ord and the fields of each entity (or relation) of all prediction files of a folder; name: the file as it is shown.

    Names of files that would be shown alike are an error of the caller: they would be scored as one.
    """
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    corpus = raw.select("file", F.explode(F.from_json("value", f"map<string, {PAPER}>")).alias("paper_id", "content"))
    name = F.replace(F.regexp_replace("file", r"\.json$", ""), F.lit("_"), F.lit(" "))
    return corpus.select(name.alias("name"), "paper_id", F.posexplode(f"content.{field}").alias("ord", "x")).select("name", "paper_id", "ord", "x.*")


def safe_name(text: str, most: int = 80) -> str:
    """A name for files: letters, digits, dot, dash and underscore, runs of others as one underscore."""
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9.-]", "_", text)).strip("_")[:most] or "run"


def output_id(given: str | None = None) -> str:
    """An id for file names: letters, digits, dash and underscore of the one given, else the time and a random part."""
    text = f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}Z_{uuid.uuid4().hex[:8]}" if given is None else str(given)
    safe = re.sub(r"[^\w-]", "_", text).strip("_")
    if not safe:
        raise ValueError("an output id needs a letter, a digit or a dash")
    return safe


def free_paths(folder: str, given: str | None = None, kind: str = "ensemble") -> tuple[str, str, str]:
    """(predictions, settings, id): paths in a driver-side folder that neither file has yet; a given id gets a number until they are free."""
    os.makedirs(folder, exist_ok=True)
    first = name = output_id(given)
    number = 0
    while True:
        paths = tuple(os.path.join(folder, f"{kind}_{what}_{name}.json") for what in ("predictions", "config"))
        if not any(map(os.path.exists, paths)):
            return (*paths, name)
        number += 1
        name = output_id() if given is None else f"{first}_{number}"


def write_model_metadata(folder: str, labels: list[str], settings: dict, name: str = "labels") -> None:
    """label_mapping.json and training_args.json beside a model (driver-side files)."""
    os.makedirs(folder, exist_ok=True)
    for file, held in (("label_mapping.json", {name: labels}), ("training_args.json", settings)):
        with open(os.path.join(folder, file), "w", encoding="utf-8") as out:
            json.dump(held, out, indent=2, ensure_ascii=False, default=str)


def read_label_mapping(folder: str, name: str = "labels") -> dict[int, str]:
    """Number to label, as a model counts its outputs."""
    with open(os.path.join(folder, "label_mapping.json"), encoding="utf-8") as lines:
        return dict(enumerate(json.load(lines)[name]))


def display_name(file: str) -> str:
    return re.sub(r"\.json$", "", file).replace("_", " ")


def write_sidecar(path: str, config: dict) -> None:
    """The settings of a run, beside its output (a driver-side file)."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "x", encoding="utf-8") as out:
        json.dump(config, out, indent=2, ensure_ascii=False)


def read_sidecar(path: str) -> dict:
    """Settings as they were given: what a sidecar holds under 'run_config', else all."""
    with open(path, encoding="utf-8") as lines:
        held = json.load(lines)
    return held.get("run_config", held)


def read_prompts(path: str, system: str = "base", user: str = "base") -> tuple[str, str]:
    """System prompt and user template of a JSON file, each by its key; an unknown key raises KeyError."""
    with open(path, encoding="utf-8") as lines:
        held = json.load(lines)
    return held["system_prompts"][system], held["user_prompts"][user]


#: Tables of a stored knowledge base.
KNOWLEDGE = ("by_text", "by_label", "definitions")


def write_knowledge_base(folder: str, by_text: DataFrame, by_label: DataFrame, definitions: DataFrame) -> None:
    """The exact-match tables (see linking.known_uris) and definition_id, uri; each a table in the folder."""
    for name, table in zip(KNOWLEDGE, (by_text, by_label, definitions), strict=True):
        table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def read_knowledge_base(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in KNOWLEDGE}


def read_knowledge_base_json(spark: SparkSession, by_text: str, by_label: str, definitions: str) -> dict[str, DataFrame]:
    """The same tables of three JSON objects: text to uris, '["text", "label"]' to uris, definition to uri."""

    def entries(path: str, value: str) -> DataFrame:
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "held"))

    uris = [F.array_sort("held").alias("uris"), F.array_min("held").alias("uri")]
    pair = F.from_json("key", "array<string>")
    return {
        "by_text": entries(by_text, "array<string>").select(F.col("key").alias("text_norm"), *uris),
        "by_label": entries(by_label, "array<string>").select(pair[0].alias("text_norm"), pair[1].alias("label"), *uris),
        "definitions": entries(definitions, "string").select(F.col("key").alias("definition_id"), F.col("held").alias("uri")),
    }


def struct_of(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)
