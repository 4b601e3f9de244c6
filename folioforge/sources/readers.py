"""Sources: Markdown collections, records, exports, binary inputs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import headers, text

#: Collections and their place under a vault; those in OPT_IN are read only if named.
COLLECTIONS = {"notes": "vault/notes", "books": "vault/library/books", "archive": "imports/source-vault"}
OPT_IN = ("archive",)
#: Collections that nothing may write to.
READ_ONLY = ("archive", "rules", "books")

CREATURE = "name string, source string, cr double, type string, size array<string>, alignment string, environment array<string>, ruleset string"
SPELL = "name string, source string, level int, school string, class array<string>, concentration boolean, ritual boolean, ruleset string"
ITEM = "name string, source string, rarity string, kind string, attunement boolean, ruleset string"
ENTITIES = {"creature": CREATURE, "spell": SPELL, "item": ITEM}


def documents(raw: DataFrame, collection: str) -> DataFrame:
    """(path, value) rows as documents: collection, path, title, meta, body, links."""
    meta = headers.parse_header(headers.header_text(F.col("value")))
    body = headers.body_text(F.col("value"))
    title = F.coalesce(F.element_at(F.col("meta"), "title")[0], F.nullif(F.regexp_extract("body", r"(?m)^#[ \t]+(.*)$", 1), F.lit("")), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    return (
        raw.withColumn("meta", meta)
        .withColumn("body", body)
        .select(F.lit(collection).alias("collection"), "path", title.alias("title"), "meta", "body", text.wikilinks(F.col("body")).alias("links"))
    )


def markdown(spark: SparkSession, root: str, collections: tuple[str, ...] | None = None) -> DataFrame:
    """All Markdown files of the named collections, by default those not opt-in.
    A collection without a folder has no rows."""
    names = collections or tuple(c for c in COLLECTIONS if c not in OPT_IN)
    out = None
    for name in names:
        if name not in COLLECTIONS:
            raise ValueError(f"no such collection: {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{COLLECTIONS[name]}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            raw = spark.createDataFrame([], "value string, path string")
        else:
            raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(f"{root}/{COLLECTIONS[name]}", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
        part = documents(raw, name)
        out = part if out is None else out.unionByName(part)
    return out


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """A single document, to inspect."""
    return documents(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")), "archive")


def binaries(spark: SparkSession, folder: str, kinds: str = "*.{pdf,epub}") -> DataFrame:
    """Book inputs as path, size, hash; what they hold is not parsed here."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", kinds).load(folder)
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("source_hash"), text.slug(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)).alias("slug"))


def records(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """JSON-lines records of an entity, with its fixed schema."""
    if entity not in ENTITIES:
        raise ValueError(f"unsupported entity type: {entity}")
    return spark.read.schema(ENTITIES[entity]).json(path)


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of any kind as one variant column, for ad-hoc lookups."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("record"))


def exports(spark: SparkSession, folder: str) -> DataFrame:
    """(file, member, value): JSON and text exports whole, members of ZIP archives
    one by one."""
    plain = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,txt}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("string").alias("member"), "value")
    zips = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.endswith((".json", ".txt")):
                            yield pd.DataFrame({"file": [path], "member": [name], "value": [archive.read(name).decode(errors="replace")]})

    return plain.unionByName(zips.mapInPandas(members, "file string, member string, value string"))


def json_field(c: str, path: str) -> Column:
    """A field of a JSON report."""
    return F.get_json_object(c, path)
