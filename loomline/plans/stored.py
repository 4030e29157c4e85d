"""Queries on stored forms: a lexical index in runs, and tables that are published as a whole."""

import datetime

from pyspark.sql import functions as F

from loomline.operators import postings
from loomline.plans.registry import SQL, query
from loomline.plans.searches import COUNTS
from loomline.sources.archive import read
from loomline.sources.versions import Table, fresh_folder, publish_work
from loomline.streaming import activity, upkeep


def _docs(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.concat("source", F.lit(" the")).alias("context"))


def _index(spark):
    return postings.Index(spark, fresh_folder(spark, "postings"), ("text", "context"))


@query(SQL["bm25_two_columns"])
def bm25_indexed(spark, sf):
    """``bm25_two_columns`` from stored postings: only the folders of the two words are read."""
    index = _index(spark)
    index.add(_docs(spark, sf))
    return index.search([["the"], ["and"]], 20, [1.0, 2.0])


@query(SQL["phrase_match"])
def phrase_indexed(spark, sf):
    """``phrase_match`` from stored positions."""
    index = postings.Index(spark, fresh_folder(spark, "postings"))
    index.add(_docs(spark, sf))
    return index.matches([["of", "the"]])


LEFT = "(SELECT * FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 > 0)"


@query(f"WITH {COUNTS.replace('FROM documents', f'FROM {LEFT}')} SELECT id, score FROM w ORDER BY score DESC, id LIMIT 20")
def bm25_after_updates(spark, sf):
    """A run, a removal from it and a second run: no run is written again, the statistics follow."""
    docs, index = _docs(spark, sf), _index(spark)
    index.add(docs.where("id % 3 > 0"))
    index.remove(docs.where("id % 5 = 0").select("id"))
    index.add(docs.where("id % 3 = 0"))
    return index.search([["the"], ["and"]], 20, [1.0, 2.0])


@query(f"WITH {COUNTS.replace('FROM documents', f'FROM {LEFT}')} SELECT id, score FROM w ORDER BY score DESC, id LIMIT 20")
def bm25_after_merge(spark, sf):
    """The same after the runs were merged into one without the removed documents."""
    docs, index = _docs(spark, sf), _index(spark)
    index.add(docs.where("id % 3 > 0"))
    index.remove(docs.where("id % 5 = 0").select("id"))
    index.add(docs.where("id % 3 = 0"))
    index.merge()
    index.sweep()
    return index.search([["the"], ["and"]], 20, [1.0, 2.0])


SCOPES = ("source_rev", "message_rev", "thread_rev", "document_rev", "global_rev")


def _heads(spark, sf):
    """Heads as built: their revisions are those of the documents at that time."""
    return read(spark, sf, "documents").groupBy(F.col("doc_id").alias("source_key")).agg(
        F.max("n_chars").alias("chunks"), *[F.max(F.coalesce("n_chars", F.lit(0)) % (i + 2)).alias(s) for i, s in enumerate(SCOPES)]
    )


def _published(spark, sf):
    built = _heads(spark, sf)
    table = Table(spark, fresh_folder(spark, "heads"), ["source_key"], built.schema, 16)
    table.upsert(built.where("source_key % 2 = 0"))
    # since they were read, every third head moved on in one of its scopes
    now = built.select("source_key", *SCOPES).withColumn("thread_rev", F.col("thread_rev") + F.when(F.col("source_key") % 3 == 0, 1).otherwise(0))
    work = built.where("source_key % 5 < 3").withColumn("chunks", F.col("chunks") + 1)
    return table, publish_work(table, work, now, SCOPES)


HEADS = """h AS (SELECT doc_id AS source_key, max(n_chars) AS chunks, max(coalesce(n_chars, 0) % 2) AS source_rev, max(coalesce(n_chars, 0) % 3) AS message_rev, max(coalesce(n_chars, 0) % 4) AS thread_rev,
max(coalesce(n_chars, 0) % 5) AS document_rev, max(coalesce(n_chars, 0) % 6) AS global_rev FROM documents GROUP BY doc_id)"""


@query(f"WITH {HEADS} SELECT * REPLACE (CASE WHEN source_key % 5 < 3 AND source_key % 3 > 0 THEN chunks + 1 ELSE chunks END AS chunks) FROM h WHERE source_key % 2 = 0 OR (source_key % 5 < 3 AND source_key % 3 > 0)")
def published_heads(spark, sf):
    """The published rows: work whose five revisions still stand took the place of earlier rows (M5)."""
    table, _ = _published(spark, sf)
    return table.read()


@query(f"WITH {HEADS} SELECT source_key, CASE WHEN source_key % 3 = 0 THEN 'conflict' ELSE 'published' END AS outcome FROM h WHERE source_key % 5 < 3")
def publish_conflicts(spark, sf):
    return _published(spark, sf)[1][1]


@query(f"WITH {HEADS} SELECT * FROM h WHERE source_key % 2 = 0")
def pinned_heads(spark, sf):
    """A reader of the version before sees none of the later publication."""
    table, (version, _) = _published(spark, sf)
    return table.read(version - 1)


@query(f"WITH {HEADS} SELECT * REPLACE (chunks * 2 AS chunks) FROM h WHERE source_key % 7 > 0")
def rebuilt_epoch(spark, sf):
    """A new epoch filled in two parts beside the serving one, which it then replaces (M6)."""
    table, _ = _published(spark, sf)
    epoch = table.begin_epoch()
    new = _heads(spark, sf).where("source_key % 7 > 0").withColumn("chunks", F.col("chunks") * 2)
    table.upsert(new.where("source_key % 4 = 0"), epoch=epoch)
    table.switch(waiting=1)
    table.upsert(new.where("source_key % 4 > 0"), epoch=epoch)
    table.switch(waiting=0)
    table.sweep()
    return table.read()


@query("SELECT user_id, max(ts) AS latest, count(*) AS n FROM events GROUP BY user_id")
def activity_view(spark, sf):
    """``streaming_activity`` as a view whose buckets are rewritten for the users of each batch only."""
    log = activity.events(spark, sf, read(spark, sf, "events").schema).select("user_id", "ts")
    return upkeep.keep_activity(log, fresh_folder(spark, "activity"), 16).read()


@query("""WITH c AS (SELECT doc_id AS chunk_id, sha256(text) AS digest, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL), f AS (SELECT chunk_id, digest, bytes, min(chunk_id) OVER (PARTITION BY digest) AS m FROM c)
SELECT chunk_id, CASE WHEN bytes <= 4000 AND m IN (SELECT vec_id FROM embeddings) THEN m END AS vector_id, CASE WHEN bytes > 4000 THEN 'oversized' WHEN m NOT IN (SELECT vec_id FROM embeddings) THEN 'no_vector' END AS failure FROM f""")
def embedded_chunks(spark, sf):
    """The claim, embed, publish loop over all documents; the embedder looks vectors up, and texts of over 4,000 bytes are refused."""
    docs = read(spark, sf, "documents").where("text IS NOT NULL")
    table = upkeep.link_table(spark, fresh_folder(spark, "links"), 16)
    table.publish(upkeep.add_chunks(table, docs.select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))))
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("vector_id"))
    times = (datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i) for i in range(1000))
    upkeep.embed_all(table, lambda claims: claims.join(vectors, "chunk_id", "left").select("chunk_id", "vector_id", F.lit("no_vector").alias("error")), lambda: next(times), 4000, most_tries=2)
    return table.read().select("chunk_id", "vector_id", "failure")
