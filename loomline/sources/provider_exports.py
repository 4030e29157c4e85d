"""Provider exports as rows: node maps and message lists become one row a message.

Both readers take a frame with one JSON conversation a row (``conversation`` string) and
parse it with an explicit schema, so only the named fields are read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = """conversation_id string, id string, title string, create_time double, current_node string, mapping map<string, struct<parent: string,
 message: struct<id: string, author: struct<role: string>, create_time: double, content: struct<content_type: string, parts: array<string>>,
 metadata: struct<model_slug: string, attachments: array<struct<file_name: string, name: string, mime_type: string, mimeType: string, file_size: bigint, size: bigint>>>>>>"""
LISTS = """uuid string, name string, created_at string, chat_messages array<struct<uuid: string, sender: string, parent_message_uuid: string, created_at: string, text: string,
 content: array<struct<type: string, text: string>>, attachments: array<struct<file_name: string, file_type: string, file_size: bigint>>>>"""


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """One row a conversation of files that each hold a JSON array of them; entries of other names are left out."""
    files = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_name").rlike(r"^conversations(-[0-9]+)?\.json$"))
    return files.select(F.explode(F.from_json("value", "array<string>")).alias("conversation"))


def millis(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def node_maps(exports: DataFrame) -> DataFrame:
    """(thread, node, parent, role, created_ms, model, text, parts, attachments, active, structural) of exports keyed by node.

    A node without a message is structural: it carries edges only. Unknown parts stay as JSON text.
    """
    c = exports.select(F.from_json("conversation", NODES).alias("c")).select(F.coalesce("c.conversation_id", "c.id").alias("thread"), "c.current_node", F.explode("c.mapping").alias("node", "n"))
    parts = F.coalesce(F.col("n.message.content.parts"), F.array().cast("array<string>"))
    return c.select(
        "thread", "node", F.col("n.parent").alias("parent"), F.col("n.message.author.role").alias("role"), millis(F.col("n.message.create_time")).alias("created_ms"),
        F.col("n.message.metadata.model_slug").alias("model"), F.array_join(parts, "\n").alias("text"), F.size(parts).alias("parts"),
        F.coalesce(F.size("n.message.metadata.attachments"), F.lit(0)).alias("attachments"), F.col("node").eqNullSafe(F.col("current_node")).alias("active"), F.col("n.message").isNull().alias("structural"),
    )


def message_lists(exports: DataFrame) -> DataFrame:
    """(thread, node, parent, inferred, role, created_ms, text, position) of exports that list messages.

    A message that names no parent follows the one before it (inferred).
    """
    c = exports.select(F.from_json("conversation", LISTS).alias("c")).select(F.col("c.uuid").alias("thread"), F.posexplode("c.chat_messages").alias("position", "m"))
    before = F.lag("m.uuid").over(Window.partitionBy("thread").orderBy("position"))
    spoken = F.array_join(F.transform(F.filter("m.content", lambda b: b.type == "text"), lambda b: b.text), "\n")
    absent = F.col("m.parent_message_uuid").isNull()
    return c.select(
        "thread", F.col("m.uuid").alias("node"), F.when(absent, before).otherwise(F.col("m.parent_message_uuid")).alias("parent"), (absent & before.isNotNull()).alias("inferred"),
        F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender")).alias("role"), F.unix_millis(F.try_to_timestamp("m.created_at")).alias("created_ms"),
        F.coalesce(F.when(F.length(spoken) > 0, spoken), F.col("m.text"), F.lit("")).alias("text"), "position",
    )
