"""What the search reads: text of parts by kind, and the five kinds of sources as one table."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.canonical import canonical_json

#: Kinds of parts whose text is a field of their data, by that field.
FIELDS = {"Text": "text", "Note": "text", "ReasoningMetadata": "summary", "File": "description", "Image": "description", "Audio": "description"}
#: Kinds whose text is JSON with sorted keys, by the field it is taken from (None: the whole data).
JSON_FIELDS = {"ToolResult": "content", "ToolCall": None, "StructuredData": "value", "Citation": None}


def part_texts(parts: DataFrame) -> DataFrame:
    """(id, text, blob, type, path) of parts (id, kind, data as JSON) that hold text.

    A tool result whose content is a string gives that string, any other its sorted JSON. Text kept in a
    blob gives its digest and no text. Parts without text (other kinds, no summary or description) give no row.
    """
    data, kind = F.try_parse_json("data"), F.col("kind")
    of = lambda f: F.try_variant_get(data, f"$.{f}", "string")
    content = F.expr("try_variant_get(try_parse_json(data), '$.content', 'variant')")
    plain = (kind == "ToolResult") & (F.schema_of_variant(content) == "STRING")
    held = F.coalesce(*[F.when(kind == k, of(f)) for k, f in FIELDS.items()], F.when(plain, of("content")))
    raw = F.coalesce(*[F.when(kind == k, F.col("data") if f is None else F.to_json(F.expr(f"try_variant_get(try_parse_json(data), '$.{f}', 'variant')"))) for k, f in JSON_FIELDS.items()])
    sorted_text = canonical_json(F.when(held.isNull(), raw))
    blob = F.when(kind.isin("Text", "Note"), F.try_variant_get(data, "$.textBlob.sha256", "string"))
    whole = F.when(kind.isin("ToolCall", "Citation"), "canonical-json/data").when(kind == "ToolResult", "canonical-json/data/content").when(kind == "StructuredData", "canonical-json/data/value")
    path = F.when(kind.isin("Text", "Note"), "").when(kind == "ReasoningMetadata", "data/summary").when(kind.isin("File", "Image", "Audio"), "data/description").when(plain, "data/content").otherwise(whole)
    found = parts.select("id", F.coalesce(held, sorted_text).alias("text"), blob.alias("blob"), F.when(kind.isin("ToolResult", "ToolCall"), "tool_output").otherwise("message").alias("type"), path.alias("path"))
    return found.where("text IS NOT NULL OR blob IS NOT NULL")


def media(column: Column, missing: str) -> Column:
    """A media type without its parameters."""
    return F.lower(F.trim(F.substring_index(F.coalesce(column, F.lit(missing)), ";", 1)))


def sources(parts: DataFrame, messages: DataFrame, attachments: DataFrame, documents: DataFrame, pages: DataFrame, registered: DataFrame) -> DataFrame:
    """source_key, source_type, source_id, text, digest, context, media_type of all five kinds of sources.

    parts: id, message_id, kind, data, attachment_id; messages: id, title, role (visible ones only); attachments: id,
    filename, media_type, digest; documents: id, title, attachment_id; pages: id, document_id, text; registered: id,
    document_id, attachment_digest, section, text. Keys start with p (part), f (file name of an image), d (document
    whose bytes are text and for which nothing is registered), e (page of a PDF) and x (registered text of the
    attachment as it stands).
    """
    key = lambda letter: F.concat(F.lit(f"{letter}:"), F.col("id").cast("string")).alias("source_key")
    title = F.substring("title", 1, 1024)
    said = messages.select(F.col("id").alias("message_id"), F.concat(title, F.lit(" > "), F.col("role")).alias("context"))
    files = attachments.select(F.col("id").alias("attachment_id"), "filename", F.col("media_type").alias("file_type"), F.col("digest").alias("file_digest"))
    owned = parts.join(said, "message_id").join(files, "attachment_id", "left")
    whose = owned.select("id", "message_id", "context", "file_type")
    text_type = F.when(F.startswith("path", F.lit("canonical-json")), "application/json").otherwise("text/plain")
    digest = F.coalesce("blob", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    of_parts = part_texts(parts).join(whose, "id").select(key("p"), F.col("type").alias("source_type"), F.col("message_id").alias("source_id"), "text", digest, "context", media(F.coalesce("file_type", text_type), "text/plain").alias("media_type"))
    named = owned.where("kind = 'Image' AND filename <> ''")
    of_names = named.select(key("f"), F.lit("message").alias("source_type"), F.col("message_id").alias("source_id"), F.col("filename").alias("text"), F.sha2("filename", 256).alias("digest"), "context", media(F.col("file_type"), "text/plain").alias("media_type"))
    d = documents.join(files, "attachment_id").where("file_digest IS NOT NULL").select(F.col("id").alias("document_id"), title.alias("context"), "file_digest", media(F.col("file_type"), "application/octet-stream").alias("media_type"))
    as_document = F.lit("document").alias("source_type")
    text_digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    of_pages = pages.join(d.where("media_type = 'application/pdf'"), "document_id").select(key("e"), as_document, F.col("document_id").alias("source_id"), "text", text_digest, "context", "media_type")
    current = registered.join(d, (registered.document_id == d.document_id) & (registered.attachment_digest == d.file_digest)).drop(d.document_id)
    section = F.substring(F.concat_ws(" > ", "context", "section"), 1, 4096).alias("context")
    of_registered = current.select(key("x"), as_document, F.col("document_id").alias("source_id"), "text", text_digest, section, "media_type")
    is_text = F.startswith("media_type", F.lit("text/")) | F.col("media_type").isin("application/json", "application/xml")
    bare = d.where(is_text).join(current.select("document_id").distinct(), "document_id", "left_anti").withColumnRenamed("document_id", "id")
    of_documents = bare.select(key("d"), as_document, F.col("id").alias("source_id"), F.lit(None).cast("string").alias("text"), F.col("file_digest").alias("digest"), "context", "media_type")
    return functools.reduce(DataFrame.unionByName, [of_parts, of_names, of_documents, of_pages, of_registered])


def current_pages(refs: DataFrame, pages: DataFrame, runs: DataFrame, documents: DataFrame, records: DataFrame, attachments: DataFrame) -> DataFrame:
    """Page references that all five tables still confirm (J12), as a chain of semi joins on the names they share.

    refs: page_id, run_id, page, source_digest, revision, document_id, identity, attachment_id, attachment_digest, attachment_bytes.
    """
    keys = (
        (pages.where("state = 'published'"), ["page_id", "run_id", "page", "source_digest", "revision"]), (runs, ["run_id", "document_id", "identity"]),
        (documents.withColumnRenamed("visible_run", "run_id"), ["document_id", "run_id"]), (records, ["document_id", "attachment_id"]),
        (attachments.where((F.col("availability") == "available") & (media(F.col("media_type"), "") == "application/pdf")), ["attachment_id", "attachment_digest", "attachment_bytes"]),
    )
    return functools.reduce(lambda kept, step: kept.join(step[0], step[1], "left_semi"), keys, refs)


def range_hash(content: Column, start: Column, end: Column) -> Column:
    """SHA-256 of the bytes from start to end, end exclusive."""
    return F.sha2(F.substring(content, start + 1, end - start), 256)
