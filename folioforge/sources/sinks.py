"""Sinks: books, sidecars, assets, copies, mirrors, rendered text, canvases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text

OUTPUTS = ("summary", "json", "markdown")


def write_book(sections: DataFrame, overviews: DataFrame, out: str) -> None:
    """Chapters and overviews, a folder a slug; a slug that is written again
    replaces its own folder only.  Two books of one slug are refused."""
    twice = overviews.groupBy("slug").count().filter("count > 1").select("slug").first()
    if twice:
        raise ValueError(f"two books have the slug {twice['slug']}")
    options = {"partitionOverwriteMode": "dynamic"}
    sections.repartition("slug").sortWithinPartitions("slug", "ord").write.mode("overwrite").options(**options).partitionBy("slug").parquet(f"{out}/chapters")
    overviews.write.mode("overwrite").options(**options).partitionBy("slug").parquet(f"{out}/overview")


def write_sidecars(provenance: DataFrame, report: DataFrame, out: str) -> None:
    for name, df in (("provenance", provenance), ("report", report)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").json(f"{out}/{name}")


def asset_rows(assets: DataFrame, root: str, allowed: tuple[str, ...] = ("model", "size", "created")) -> DataFrame:
    """(title, folder, prompt, params, response, content) to file and note names;
    rows whose folder leaves root are refused, and the response keeps whitelisted
    fields only."""
    keep = F.map_filter("response", lambda k, _: k.isin(*allowed))
    name = text.asset_name(F.col("title"), F.col("content"))
    return assets.filter(text.inside(F.col("folder"), root)).select(F.concat("folder", F.lit("/"), name, F.lit(".png")).alias("file"), F.concat("folder", F.lit("/"), name, F.lit(".md")).alias("note"), "prompt", "params", keep.alias("response"))


def copy_one(spark: SparkSession, source: str, destination: str) -> None:
    """One file, byte for byte, to a place that the caller chose and that is free."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = hadoop.Path(source), hadoop.Path(destination)
    to = b.getFileSystem(conf)
    if to.exists(b):
        raise FileExistsError(destination)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, to, b, False, False, conf)


def book_markdown(sections: DataFrame, title: str = "slug") -> DataFrame:
    """(slug, file, text): the Markdown files of each book, an overview
    `__<slug>.md` and a chapter a section, from (slug, ord, heading, body)."""
    chapter = F.concat(F.lpad(F.col("ord").cast("string"), 3, "0"), F.lit("-"), text.slug(F.col("heading")), F.lit(".md"))
    chapters = sections.select("slug", chapter.alias("file"), F.concat(F.lit("# "), F.col("heading"), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "heading"))), lambda s: F.concat(s["ord"].cast("string"), F.lit(". "), s["heading"]))
    overview = sections.groupBy("slug").agg(F.first(title).alias("name"), lines.alias("lines"))
    body = F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n"))
    return overview.select("slug", F.concat(F.lit("__"), F.col("slug"), F.lit(".md")).alias("file"), body.alias("text")).unionByName(chapters)


def machine(df: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def render(df: DataFrame, output: str, title: str = "name") -> DataFrame:
    """Rows as summary lines, JSON, or Markdown."""
    if output not in OUTPUTS:
        raise ValueError(f"output not among {', '.join(OUTPUTS)}: {output}")
    if output == "json":
        return machine(df).withColumnRenamed("json", "text")
    rest = [c for c in df.columns if c != title]
    if output == "summary":
        return df.select(F.concat_ws(" | ", F.col(title), *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in rest]).alias("text"))
    return df.select(F.concat_ws("\n", F.concat(F.lit("## "), F.col(title)), *[F.concat(F.lit(f"- **{c}**: "), F.col(c).cast("string")) for c in rest]).alias("text"))


ENRICHER = r"\[\[/|&Reference\[|@UUID\["


def importer_text(name: Column, lines: list[Column]) -> Column:
    """Plain importer text: the name and its lines."""
    return F.concat_ws("\n", name, *lines)


def enriched_prose(name: Column, dice: Column) -> Column:
    return F.concat(F.lit("**"), name, F.lit("** strikes for [[/r "), dice, F.lit("]]."))


def importer_contract(c: Column) -> Column:
    """True where no enricher is inside the importer text."""
    return ~F.regexp_like(c, F.lit(ENRICHER))


def canvas(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A canvas document a board from its (board, id, text) nodes and (board, id,
    src, dst) edges."""
    n = nodes.groupBy("board").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("nodes"))
    e = edges.groupBy("board").agg(F.array_sort(F.collect_list(F.struct("id", F.col("src").alias("fromNode"), F.col("dst").alias("toNode")))).alias("edges"))
    none = F.from_json(F.lit("[]"), "array<struct<id:string,fromNode:string,toNode:string>>")
    return n.join(e, "board", "left").select("board", F.to_json(F.struct("nodes", F.coalesce("edges", none).alias("edges"))).alias("json"))


def canvas_faults(boards: DataFrame) -> DataFrame:
    """(board, edge): edges of canvas JSON whose ends are not among its nodes."""
    parsed = boards.select("board", F.from_json("json", "nodes array<struct<id:string,text:string>>, edges array<struct<id:string,fromNode:string,toNode:string>>").alias("c"))
    ids = F.transform("c.nodes", lambda n: n["id"])
    return parsed.select("board", F.explode(F.filter("c.edges", lambda e: ~F.array_contains(ids, e["fromNode"]) | ~F.array_contains(ids, e["toNode"]))["id"]).alias("edge"))


def mirror_changes(source: DataFrame, target: DataFrame) -> DataFrame:
    """(path, change) that a mirror needs: add, replace, remove."""
    s, t = source.select("path", F.col("hash").alias("new")), target.select("path", F.col("hash").alias("old"))
    change = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(F.col("old") != F.col("new"), "replace")
    return s.join(t, "path", "full").select("path", change.alias("change")).filter("change is not null")


def adapters(canonical: DataFrame, targets: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(target, path, content, hash): the files that each target is to hold, given as
    name -> (path, content) over a canonical row, and nothing but the canonical rows.
    A null path: the target has no file of the row."""
    files = F.array(*[F.struct(F.lit(t).alias("target"), path.alias("path"), content.alias("content")) for t, (path, content) in targets.items()])
    return canonical.select(F.explode(files).alias("f")).select("f.*").filter("path is not null").withColumn("hash", text.content_hash(F.col("content")))


def sync(wanted: DataFrame, out: str) -> None:
    """Writes adapters(), a folder a target, in place of all that was there: edits by
    hand and files of rows that are gone do not outlive it, and twice is as once."""
    wanted.repartition("target", "path").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("target").parquet(out)
