"""Sources and sinks: admission, deduplication, listing, upserts, cascading deletes, exports, logs (SRC1 to SRC8, SNK1 to SNK7)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.config import DEFAULT, Config


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below a path, with their bytes (SRC4)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def admitted(uploads: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add safe_name, sha256 and outcome: why an upload is rejected, first rule first, or 'ok' (SRC2)."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    magic = F.hex(F.substring("content", 1, 4)) != "25504446"
    outcome = F.when(~F.lower(name).endswith(".pdf"), "not a pdf").when(F.length("content") == 0, "empty").when(F.length("content") > config.max_upload_mb * 1_000_000, "too large").when(magic, "no pdf header").otherwise("ok")
    return uploads.withColumns({"safe_name": F.substring(F.regexp_replace(name, "[^A-Za-z0-9._ -]", "_"), 1, 180), "sha256": F.sha2("content", 256), "outcome": outcome})


def new_documents(batch: DataFrame, store: DataFrame, digest: str = "sha256", order: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(new, duplicates): the first of each digest that the store lacks; the rest with the doc_id they repeat (SRC3, JN10).

    Owners are found by partial aggregation, so a digest of very many documents is one row.
    """
    known = store.select(digest, F.col("doc_id").alias("existing"))
    first = batch.groupBy(digest).agg(F.min_by("doc_id", order).alias("existing"))
    owner = known.unionByName(first.join(known.select(digest), digest, "left_anti"))
    matched = batch.join(owner, digest)
    mine = matched.join(known.select(digest), digest, "left_anti").where("doc_id = existing")
    return mine.select(*batch.columns), matched.where("doc_id != existing")


def text_pages(content: bytes) -> Iterator[dict]:
    """The decoder of plain text: UTF-8, a form feed between pages."""
    for text in content.decode("utf-8", "replace").split("\f"):
        yield {"text": text}


def decode_pages(uploads: DataFrame, decoder: Callable[[bytes], Iterable[dict]] = text_pages, config: Config = DEFAULT) -> DataFrame:
    """(path, page_index, text, declared, error): pages of each file by a pluggable decoder (SRC1).

    A decoder may yield its pages; an over-long document is given up at the page that exceeds the limit, and gives an error row.
    """

    def pages(path: str, content: bytes) -> list[tuple]:
        rows, chars = [], 0
        for i, p in enumerate(decoder(content)):
            chars += len(p.get("text") or "")
            if i >= config.max_pages:
                raise ValueError(f"more than {config.max_pages} pages")
            if chars > config.max_document_chars:
                raise ValueError(f"more than {config.max_document_chars} characters")
            rows.append((path, i + 1, p.get("text"), p.get("label"), None))
        return rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows = pages(path, bytes(content))
                except Exception as e:  # noqa: BLE001  a file that cannot be read is a row, not a failed job
                    rows = [(path, None, None, None, str(e)[:500])]
                yield pd.DataFrame(rows, columns=["path", "page_index", "text", "declared", "error"]).astype({"page_index": "Int32"})

    return uploads.select("path", "content").mapInPandas(run, "path string, page_index int, text string, declared string, error string")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Hand-labelled facts of a JSON file {"facts": [...]} (SRC7)."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("facts").alias("x")).select("x.*")


def evolved(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`df` with columns it lacks added as nulls: the additive schema changes of a store."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def upserted(store: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    """Insert or replace by key; in a batch the row with the highest `seq` wins (SNK1)."""
    last = batch.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("seq")))).where("_n = 1").drop("_n")
    return store.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def inserted(store: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    """Insert where the key is absent; in a batch the row with the lowest `seq` wins (SNK2)."""
    first = batch.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("seq"))).where("_n = 1").drop("_n")
    return store.unionByName(first.join(store.select(*keys), list(keys), "left_anti"))


def updated(store: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows that meet a condition, with new values (SNK3)."""
    return store.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def without_document(store: dict[str, DataFrame], doc_id: str) -> dict[str, DataFrame]:
    """All tables without a document and what hangs on it; jobs stay (SNK4)."""
    facts = store["facts"].where(F.col("doc_id") == doc_id).select("fact_id")
    out = {}
    for name, df in store.items():
        if name == "jobs":
            out[name] = df
        elif name == "relations":
            left = df.join(facts.withColumnRenamed("fact_id", "fact_a"), "fact_a", "left_anti")
            out[name] = left.join(facts.withColumnRenamed("fact_id", "fact_b"), "fact_b", "left_anti").select(*df.columns)
        elif "doc_id" in df.columns:
            out[name] = df.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))
        else:
            out[name] = df.join(facts, "fact_id", "left_anti")
    return out


def removed_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows that a delete took from each table; a relation counts once."""
    counts = None
    for name in sorted(before):
        one = before[name].agg(F.count("*").alias("n")).crossJoin(after[name].agg(F.count("*").alias("m"))).select(F.lit(name).alias("name"), (F.col("n") - F.col("m")).alias("n"))  # one row each
        counts = one if counts is None else counts.unionByName(one)
    return counts


def replace_documents(df: DataFrame, path: str) -> None:
    """Write rows partitioned by doc_id, replacing only the documents that are there."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON file of a small report (SNK5)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def seed(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a seed table unless the target has one already (SRC8)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(conf).exists(path):
        return False
    spark.read.parquet(source).write.parquet(target)
    return True


def issue_rows(df: DataFrame, kind: str, severity: str, detail: Column, *payload: str) -> DataFrame:
    """Rows of the issue log for rows that met a problem (SNK6); ids are digests, so that a rerun logs the same rows."""
    body = F.to_json(F.struct(*payload)) if payload else F.lit(None).cast("string")
    doc = F.col("doc_id") if "doc_id" in df.columns else F.lit(None).cast("string")
    return df.select(doc.alias("doc_id"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), detail.alias("detail"), body.alias("payload")).withColumn("issue_id", F.concat(F.lit("i_"), F.substring(F.sha2(F.concat_ws("|", "doc_id", "kind", "detail", "payload"), 256), 1, 16)))
