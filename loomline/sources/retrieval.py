"""A retrieval corpus on disk: documents, queries and graded judgements, and an inventory of files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Altered(ValueError):
    """A file does not have its pinned digest."""


def corpus(spark: SparkSession, folder: str, pinned: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """documents (id, kind, text), queries (id, text) and judgements (query_id, id, grade) of a folder.

    ``pinned`` maps file names to SHA-256 digests, checked first; such a file is read as one row (2 GB at most).
    Grades of 1 and 2 mean relevant.
    """
    for name, digest in (pinned or {}).items():
        found = spark.read.format("binaryFile").load(f"{folder}/{name}").select(F.sha2("content", 256)).first()
        if found is None or found[0] != digest:
            raise Altered(name)
    grades = spark.read.text(f"{folder}/qrels.json", wholetext=True).select(F.from_json("value", "map<string,map<string,int>>").alias("all"))
    by_query = grades.select(F.explode("all").alias("query_id", "grades"))
    return {
        "documents": spark.read.schema("id string, kind string, text string").json(f"{folder}/corpus.jsonl"),
        "queries": spark.read.schema("id string, text string").json(f"{folder}/queries.json", multiLine=True),
        "judgements": by_query.select("query_id", F.explode("grades").alias("id", "grade")),
    }


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, digest, path, bytes) of every file below a store of blobs named by digest (S13); contents are not read.

    kind: blob (a name of 64 hex digits), staged (below a folder ``staging``), unknown. The rows fit ``audits.inventory``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"))
    digest = F.regexp_extract("path", "/([0-9a-f]{64})$", 1)
    kind = F.when(F.contains("path", F.lit("/staging/")), "staged").when(digest != "", "blob").otherwise("unknown")
    return files.select(kind.alias("kind"), F.when(kind == "blob", digest).alias("digest"), "path", "bytes")
