"""Record documents: ``{type, source?, confidence?, items: [...]}`` as JSON or YAML files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stockweave.functions.ordered import number_rows

# Fixed value: confidence of a document that states none.
DEFAULT_CONFIDENCE = "medium"

EDGE = ("struct<rel: string, to: string, attrs: string, source: string, confidence: string, evidence: string, "
        "valid_from: string, valid_to: string>")
ITEM = (f"struct<name: string, aliases: array<string>, source: string, confidence: string, valid_from: string, "
        f"valid_to: string, attrs: string, edges: array<{EDGE}>>")
DOCUMENT = f"type string, source string, confidence string, items array<{ITEM}>"


def json_map(text) -> F.Column:
    """A JSON object's text as a map from key to the JSON text of its value (see ``functions.values``)."""
    parsed = F.from_json(text, "map<string,variant>")
    return F.coalesce(F.transform_values(parsed, lambda k, v: F.coalesce(F.to_json(v), F.lit("null"))),
                      F.create_map().cast("map<string,string>"))


def _yaml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml  # only needed where YAML files are read

    for pdf in batches:
        text = pdf["value"].map(lambda s: json.dumps(yaml.safe_load(s) or {}, default=str, ensure_ascii=False))
        yield pd.DataFrame({"file": pdf["file"], "value": text})


def read_documents(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """One row per document with its file. ``json`` takes one document per line and splits large files;
    ``json-file`` and ``yaml`` take one document per file."""
    reader = spark.read.text(path, wholetext=format != "json")
    rows = reader.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("line"))
    if format == "yaml":
        schema = StructType([StructField("file", StringType()), StructField("value", StringType())])
        rows = rows.select("file", "value").mapInPandas(_yaml_to_json, schema).withColumns(
            {"block": F.lit(0).cast("bigint"), "line": F.lit(0).cast("bigint")})
    parsed = F.from_json("value", StructType.fromDDL(DOCUMENT))
    return rows.filter(F.trim("value") != "").select("file", "block", "line", parsed.alias("d")).select("file", "block", "line", "d.*")


def read_records(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Items of all documents with defaults applied and a global ``seq``: files by name, then place in the file.

    An item's source and confidence override its document's, an edge's override its item's. A document without
    ``type`` or ``items`` ends the job with an error that names its file.
    """
    docs = read_documents(spark, path, format)
    fault = F.raise_error(F.concat("file", F.lit(": a document needs 'type' and 'items'")))
    docs = docs.withColumn("items", F.when(F.col("type").isNull() | F.col("items").isNull(), fault.cast(docs.schema["items"].dataType)).otherwise(F.col("items")))
    i = docs.select("file", "block", "line", "type", F.coalesce("source", F.element_at(F.split("file", "/"), -1)).alias("source"),
                    F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)).alias("confidence"), F.posexplode("items").alias("pos", "i"))
    edge = lambda e: F.struct(e["rel"].alias("rel"), e["to"].alias("to"), json_map(e["attrs"]).alias("attrs"), e["source"].alias("source"),
                              e["confidence"].alias("confidence"), e["evidence"].alias("evidence"), e["valid_from"].alias("valid_from"),
                              e["valid_to"].alias("valid_to"))
    flat = i.select(
        "file", "block", "line", "pos", "type", F.col("i.name").alias("name"), json_map(F.col("i.attrs")).alias("attrs"),
        F.coalesce("i.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("i.source", "source").alias("source"),
        F.coalesce("i.confidence", "confidence").alias("confidence"), F.col("i.valid_from").alias("valid_from"), F.col("i.valid_to").alias("valid_to"),
        F.current_timestamp().alias("seen_at"), F.transform(F.coalesce("i.edges", F.array().cast(f"array<{EDGE}>")), edge).alias("edges"))
    try:
        return number_rows(flat, ["file", "block", "line", "pos"], "seq", 0).drop("file", "block", "line", "pos")
    except PySparkException as e:
        named = re.search(r"\S+: a document needs 'type' and 'items'", str(e))
        if named:
            raise ValueError(named[0]) from e
        raise
