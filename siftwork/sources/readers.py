"""Readers of source trees, labelled data and manifests, and writers that replace, append once or render."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..providers import EmbeddingProvider, ProviderError

TRUTH = (
    "name string, version string, description string, language string, entries array<struct<id:string, language:string, category:string, relative_path:string, "
    "cwe_id:string, sink_line:int, start_line:int, end_line:int, vulnerable:boolean>>"
)
PREDICTION = "struct<relative_path:string, start_line:int, end_line:int, language:string, category:string, cwe_id:string, risk_level:string, fingerprint:string>"
TRIAL = "struct<latency_ms:int, input_tokens:int, output_tokens:int, estimated_cost:string, currency:string, pricing_version:string>"


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of all files under root; path is relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.split("://")[-1].rstrip("/")
    return found.select(F.regexp_replace("path", rf"^.*?\Q{prefix}\E/", "").alias("path"), "length", "content")


def byte_facts(content: Column) -> Column:
    """struct(size, sha256, has_nul, control_bytes, binary) of a file's bytes; binary: a NUL, or over 30 % control bytes."""

    @F.pandas_udf("struct<nul: long, control: long>")
    def counted(values: pd.Series) -> pd.DataFrame:
        counts = [np.bincount(np.frombuffer(v or b"", np.uint8), minlength=32)[:32] for v in values]
        control = [int(c.sum() - c[[9, 10, 12, 13]].sum()) for c in counts]
        return pd.DataFrame({"nul": [int(c[0]) for c in counts], "control": control})

    size, found = F.length(content).cast("long"), counted(content)
    nul, control = found["nul"] > 0, found["control"]
    return F.struct(size.alias("size"), F.sha2(content, 256).alias("sha256"), nul.alias("has_nul"), control.alias("control_bytes"), (nul | (control * 10 > size * 3)).alias("binary"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled findings of one JSON file; a missing file is an error."""
    return spark.read.schema(TRUTH).option("multiLine", True).json(path).select(F.inline("entries")).withColumn("vulnerable", F.coalesce("vulnerable", F.lit(True))).fillna(0, ["sink_line", "start_line", "end_line"])


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of one JSON file, an object with a list or a bare list, in order of relevance; none if it is missing."""
    raw = spark.read.option("wholetext", True)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"prediction_index int, {PREDICTION[7:-1].replace(':', ' ')}")
    items = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{PREDICTION}>")).otherwise(F.from_json("value", f"predictions array<{PREDICTION}>")["predictions"])
    rows = raw.text(path).select(F.posexplode(items).alias("prediction_index", "p")).select("prediction_index", "p.*")
    return rows.fillna({"start_line": 0, "end_line": 0, "cwe_id": "", "risk_level": "Medium"})


def manifest_variants(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The experiment manifest, checked, and its (group_id, variant, language, fingerprint) rows."""
    manifest = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    if manifest.get("schema_version") != 1:
        raise ValueError("the manifest's schema_version must be 1")
    if not 3 <= int(manifest.get("repetitions", 0)) <= 5:
        raise ValueError("repetitions must be 3 to 5")
    if not manifest.get("groups"):
        raise ValueError("the manifest has no groups")
    rows, names = [], set()
    for group in manifest["groups"]:
        for variant in group["variants"]:
            if variant["name"] in names:
                raise ValueError(f"the variant {variant['name']} stands twice")
            names.add(variant["name"])
            for language in manifest["languages"]:
                chosen = variant["include_fingerprints"][language]
                if len(set(chosen)) != len(chosen):
                    raise ValueError(f"{variant['name']} names a {language} fingerprint twice")
                rows += [(group["id"], variant["name"], language, f) for f in chosen] or [(group["id"], variant["name"], language, None)]
    return manifest, spark.createDataFrame(rows, "group_id string, variant string, language string, fingerprint string")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of the keys in new, and new: what a partition overwrite leaves."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def appended_once(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of new that an insert that ignores conflicts adds: keys not in old, the first of each; null equals null."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    fresh = new.withColumn("_rank", first).where("_rank = 1").drop("_rank")
    condition = F.lit(True)
    for k in keys:
        condition = condition & fresh[k].eqNullSafe(old[k])
    return fresh.join(old, condition, "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row for each key, the one with the largest position."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(position)))
    return old.unionByName(new).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def recorded_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Node runs by (task_id, run_key): a run that succeeded stays, any other is replaced and its attempt counted."""
    o = old.select("task_id", "run_key", F.col("status").alias("_status"), F.col("attempt").alias("_attempt"))
    joined = new.drop("attempt").join(o, ["task_id", "run_key"], "left")
    taken = joined.where(F.col("_status").isNull() | (F.col("_status") != "success")).withColumn("attempt", F.coalesce(F.col("_attempt") + 1, F.lit(1))).drop("_status", "_attempt")
    return replaced(old, taken.select(*old.columns), ["task_id", "run_key"])


def batched_embeddings(chunks: DataFrame, provider: EmbeddingProvider, size: int = 10, dimension: int = 64, batch_col: str | None = None) -> DataFrame:
    """(chunk_id, embedding) from provider(list of texts) in batches of size; an answer of the wrong size fails the batch.

    provider returns (text_index, vector) pairs in any order. A batch that fails gives null vectors: those chunks can be
    found by keyword only. batch_col: a column whose values no batch crosses, chunks in order of their ids; without it a
    batch is what stands together in a task.
    """
    import pyarrow as pa

    def asked(part: list[tuple]) -> list[list[float] | None]:
        try:
            got = dict(provider([t for _, t, _ in part]))
            ordered = [list(map(float, got.get(k, ()))) for k in range(len(part))]
            if len(got) != len(part) or any(len(v) != dimension for v in ordered):
                raise ProviderError("EMBEDDING_PROVIDER_INVALID_ANSWER")
        except ProviderError:
            return [None] * len(part)
        return ordered

    def run(batches):
        waiting: list[tuple] = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in waiting], pa.int64()), pa.array(asked(waiting), pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and (len(waiting) == size or row[2] != waiting[-1][2]):
                    yield told()
                    waiting = []
                waiting.append(row)
        if waiting:
            yield told()

    rows = chunks.select("chunk_id", "content", F.col(batch_col).alias("batch") if batch_col else F.lit(0).alias("batch"))
    rows = rows.repartition("batch").sortWithinPartitions("batch", "chunk_id") if batch_col else rows
    return rows.mapInArrow(run, "chunk_id long, embedding array<float>")


def hash_provider(texts: list[str], dimension: int = 64) -> list[tuple[int, list[float]]]:
    """An offline provider: unit vectors from hashes of the texts."""
    from hashlib import blake2b

    out = []
    for k, t in enumerate(texts):
        raw = b"".join(blake2b(f"{k2}:{t}".encode(), digest_size=64).digest() for k2 in range(-(-dimension // 64)))[:dimension]
        v = [b / 127.5 - 1 for b in raw]
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        out.append((k, [x / norm for x in v]))
    return out


def text_or_none(content: Column) -> Column:
    """Text of a file's bytes; files that are not UTF-8 go through legacy_text()."""
    return text.decoded(content)


def legacy_text(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(id_col, text, encoding) for bytes that are not UTF-8: gb18030, then gbk, else null."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            texts, names = [], []
            for raw in batch.column(1).to_pylist():
                for name in ("utf-8-sig", "gb18030", "gbk"):
                    try:
                        texts.append(raw.decode(name)), names.append(name)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    texts.append(None), names.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(names, pa.string())], names=[id_col, "text", "encoding"])

    return files.select(id_col, "content").mapInArrow(run, f"{id_col} string, text string, encoding string")


def outcomes(registered: DataFrame, found: DataFrame) -> DataFrame:
    """registered (path) with length, content and error: FILE_STAT_FAILED where no such file was listed, FILE_READ_FAILED
    where a listed file has no content, or less of it than its length. found: what source_tree() gives."""
    out = registered.select("path").distinct().join(found, "path", "left")
    broken = F.col("content").isNull() | (F.length("content") != F.col("length"))
    return out.withColumn("error", F.when(F.col("length").isNull(), "FILE_STAT_FAILED").when(broken, "FILE_READ_FAILED"))


def json_lines(rows: DataFrame, name: str = "value") -> DataFrame:
    """(name): each row as a JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(name))


def written_json(rows: DataFrame, path: str) -> None:
    """Writes rows as JSON objects, one a line: the result file of an experiment."""
    json_lines(rows).write.mode("overwrite").text(path)
