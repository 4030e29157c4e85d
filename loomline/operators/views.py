"""Small reads of the archive's views: cards, cursors, probes, references and filtered hits."""

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Conflict(ValueError):
    """The list that a cursor belongs to has changed."""


def cards(items: DataFrame, title_chars: int = 512, most_tags: int = 8, tag_chars: int = 128) -> DataFrame:
    """(id, title, title_cut, tags, tags_cut) of (id, title, tags): long titles and tags cut, with flags."""
    first = F.slice("tags", 1, most_tags)
    return items.select(
        "id", F.substring("title", 1, title_chars).alias("title"), (F.length("title") > title_chars).alias("title_cut"),
        F.transform(first, lambda t: F.substring(t, 1, tag_chars)).alias("tags"), ((F.size("tags") > most_tags) | F.exists(first, lambda t: F.length(t) > tag_chars)).alias("tags_cut"),
    )


def resumed(hits: DataFrame, score: float, last_id: int, k: int) -> DataFrame:
    """The next k of (id, score) hits after the row (score, last_id), best first, lower id first."""
    rest = hits.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("id") > last_id)))
    return rest.orderBy(F.desc("score"), "id").limit(k)


def page_of(placed: DataFrame, offset: int, k: int, place: str = "place") -> DataFrame:
    """Rows number offset + 1 to offset + k of a list with places."""
    return placed.where((F.col(place) > offset) & (F.col(place) <= offset + k))


def same_list(cursor: str, revision: str) -> None:
    """Refuse a cursor of another revision or scope."""
    if cursor != revision:
        raise Conflict("the list has changed since the cursor was made")


def unique_targets(hits: DataFrame, key: str) -> DataFrame:
    """(key, id) of keys that exactly one row answers (T10); the count stops the others."""
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select(key, "id")


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, shared): the share of each query's first list that the second holds (U6); rows query_id, vec_id."""
    both = second.select("query_id", "vec_id").distinct().withColumn("held", F.lit(1))
    return first.join(both, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.count("held") / F.count(F.lit(1)), 6).alias("shared"))


def missing_sources(entities: dict[str, DataFrame], sources: DataFrame) -> DataFrame:
    """(kind, id) of the rows (id, source_id) of any kind that name an import source which is absent."""
    found = [df.where("source_id IS NOT NULL").join(sources, "source_id", "left_anti").select(F.lit(kind).alias("kind"), "id") for kind, df in entities.items()]
    return functools.reduce(DataFrame.unionByName, found)


def dangling_identities(identities: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """(identity, kind) of identities (identity, kind, entity_id) whose entity (id) is absent."""
    known = functools.reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col("id").alias("entity_id")) for kind, df in entities.items()])
    return identities.join(known, ["kind", "entity_id"], "left_anti").select("identity", "kind")


def purpose_sums(attempts: DataFrame, key: str, value: Column, purpose: Column) -> DataFrame:
    """Inclusive and purpose-only totals in one pass (A2)."""
    return attempts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.count_if(purpose).alias("n_purpose"), F.coalesce(F.sum(F.when(purpose, value)), F.lit(0)).alias("purpose_total"))


def filtered_hits(chunks: DataFrame, heads: DataFrame, words: Column, term: str, keep: Column) -> DataFrame:
    """Best chunk of every head that passes the filter and holds the term (J2): (source_id, chunk_id, n).

    chunks: chunk_id, source_id, text; the filter reduces the heads before the chunks join them.
    """
    counted = chunks.select("chunk_id", "source_id", F.size(F.filter(words, lambda w: w == term)).alias("n")).where("n > 0")
    best = Window.partitionBy("source_id").orderBy(F.desc("n"), "chunk_id")
    hits = counted.join(heads.where(keep).select("source_id"), "source_id", "left_semi")
    return hits.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
