"""Sources and sinks of documents, form schemas and correction logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that a page renderer is asked for.
SUFFIXES = ("pdf", "png", "jpg", "jpeg")
_RENDERERS: dict[str, Callable[[bytes], Iterator[tuple[int, int, int, bytes]]]] = {}


def register_renderer(suffix: str, render: Callable[[bytes], Iterator[tuple[int, int, int, bytes]]]) -> None:
    """render(content) yields (page_id, width, height, pixels); rendering and recognition are plug-ins."""
    _RENDERERS[suffix.lower()] = render


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, suffix, content, content_hash and whether the suffix is supported, for every file below path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return f.select("path", suffix.alias("suffix"), "content", F.sha2("content", 256).alias("content_hash"), suffix.isin(*SUFFIXES).alias("supported"))


def pages(files: DataFrame) -> DataFrame:
    """One row a page of each supported file that has a renderer."""
    renderers = dict(_RENDERERS)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(p, *page) for p, s, c in zip(*(batch.column(i).to_pylist() for i in range(3))) if s in renderers for page in renderers[s](c)]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["path", "page_id", "width", "height", "pixels"])

    return files.where("supported").select("path", "suffix", "content").mapInArrow(run, "path string, page_id int, width int, height int, pixels binary")


def form_schema(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a JSON form schema in declared order: ord, id, label, field_type, bbox_norm. A schema without fields has no rows."""
    schema = "form_type string, version string, fields array<struct<id:string,label:string,field_type:string,bbox_norm:array<double>>>"
    fields = spark.read.schema(schema).json(path, multiLine=True).select("form_type", F.posexplode("fields").alias("ord", "f"))
    return fields.select("form_type", "ord", "f.*")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """The correction log; lines that are no JSON are dropped."""
    schema = "block_id string, source string, old_confidence double, new_confidence double, old_text string, new_text string, _corrupt string"
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")


def log_corrections(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
