"""Lexical and vector search, rank fusion and retrieval measures."""

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.graph import cut as cut_lineage
from loomline.operators.nearest import Blocks, nearest, nearest_by_bits

K1, B = 1.2, 0.75
TOKEN = "[a-z0-9_]+"
WORD = re.compile(r"\w+")
#: Texts whose excerpts a task makes at once.
EXCERPTS = 200


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def once(value: Column) -> Column:
    """The value made once a row (explode of one element), however often later columns use it."""
    return F.explode(F.array(value))


def bm25(docs: DataFrame, terms: list[str], k: int, words: Callable[[Column], Column] = tokens, visible: DataFrame | None = None) -> DataFrame:
    """(id, score) of the k best rows that hold all terms; docs: id, text. Ties go to the lower id.

    Each text is cut into words once; only the asked terms' counts and the lengths
    leave a row, and statistics and scores are both made from that narrow table.
    Statistics cover all rows, hits the ``visible`` ones (id) only, if given (X5).
    """
    counts = docs.select("id", once(words(F.col("text"))).alias("t"))
    occurrences = lambda w: F.size(F.filter("t", lambda x: x == w))
    tf = [occurrences(w).alias(f"tf{i}") for i, w in enumerate(terms)]
    counts = cut_lineage(counts.select("id", F.size("t").alias("len"), *tf))
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    both = counts.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    found = both.select("id", F.round(score, 6).alias("score"))
    if visible is not None:
        found = found.join(visible.select("id"), "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").limit(k)


def matches(docs: DataFrame, columns: list[str], needles: list[list[str]]) -> DataFrame:
    """Ids of rows where every needle, a word or words that follow each other, stands in some one of the columns."""
    joined = [F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(c, F.lit(""))), " "), F.lit(" ")) for c in columns]
    cut = docs.select("id", once(F.array(*joined)).alias("t"))

    def holds(needle: Column) -> Column:
        return F.exists("t", lambda t: F.contains(t, needle))

    for words in needles:
        cut = cut.where(holds(F.lit(" " + " ".join(words) + " ")))
    return cut.select("id")


def phrase(docs: DataFrame, words: list[str]) -> DataFrame:
    """Ids of rows in which the words follow each other."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" "))
    return docs.where(F.contains(joined, F.lit(" " + " ".join(words) + " "))).select("id")


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def sign_bits(vector: Column) -> Column:
    """Words of 64 bits: bit d % 64 of word d / 64 is set where component d is not negative; a null component is not."""
    bit = lambda x, d: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), d)).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.transform(F.slice(vector, w + 1, F.lit(64)), bit), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(vector), F.lit(1)) - 1, F.lit(64)), word)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two rows of words, null if they are not of one length."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x))


def ranked(pairs: DataFrame, by: str, k: int, query: str = "query_id", item: str = "vec_id") -> DataFrame:
    """The k first of each query with their rank; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(query).orderBy(by, item)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _shown(ranking: DataFrame, name: str = "distance") -> DataFrame:
    """Ranked by the exact value, shown with 6 digits."""
    return ranking.withColumn(name, F.round(name, 6))


def knn(vectors: DataFrame | Blocks, queries: DataFrame, k: int) -> DataFrame:
    """Exact nearest neighbours of any number of queries (query_id, q)."""
    return _shown(ranked(nearest(vectors, queries, k), "distance", k))


def hamming_top(vectors: DataFrame | Blocks, queries: DataFrame, k: int) -> DataFrame:
    return ranked(nearest_by_bits(vectors, queries, k).drop("distance"), "hamming", k)


def dot_top(vectors: DataFrame | Blocks, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity, rank) by the largest product."""
    best = _shown(ranked(nearest(vectors, queries, k, "dot"), "distance", k))
    return best.select("query_id", "vec_id", (-F.col("distance")).alias("similarity"), "rank")


def coarse_then_rerank(vectors: DataFrame | Blocks, queries: DataFrame, candidates: int, k: int) -> DataFrame:
    """Nearest by sign bits first, then exact distances of the candidates only."""
    coarse = ranked(nearest_by_bits(vectors, queries, candidates), "hamming", candidates)
    return _shown(ranked(coarse.select("query_id", "vec_id", "distance"), "distance", k))


def knn_or_coarse(vectors: DataFrame, queries: DataFrame, k: int, candidates: int = 5000, least: int = 100_000) -> DataFrame:
    """``knn`` below ``least`` vectors, from there on ``coarse_then_rerank`` with max(k, candidates) (V5)."""
    few = vectors.limit(least).count() < least
    return knn(vectors, queries, k) if few else coarse_then_rerank(vectors, queries, max(k, candidates), k)


def fuse(first: DataFrame, second: DataFrame, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, vec_id, rank) lists; an item counts by its best rank in a list."""
    best = lambda df, name: df.groupBy("query_id", "vec_id").agg(F.min("rank").alias(name))
    both = best(first, "r1").join(best(second, "r2"), ["query_id", "vec_id"], "full")
    score = F.coalesce(1 / (F.lit(constant) + F.col("r1")), F.lit(0.0)) + F.coalesce(1 / (F.lit(constant) + F.col("r2")), F.lit(0.0))
    found = F.when(F.col("r2").isNull(), "first").when(F.col("r1").isNull(), "second").otherwise("both")
    return both.select("query_id", "vec_id", F.round(score, 9).alias("score"), found.alias("found"), "r1", "r2", score.alias("exact"))


def best_fused(fused: DataFrame, k: int) -> DataFrame:
    """The k best of each query of a fused list with their ``place``: ties go by the first list's rank, the second's, then the item."""
    order = (F.desc("exact"), F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last(), "vec_id")
    return fused.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k)


def measures(ranking: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recall at k and reciprocal rank of every query; relevant: query_id, vec_id."""
    hits = relevant.join(ranking.where(F.col("rank") <= k), ["query_id", "vec_id"], "left").groupBy("query_id")
    return hits.agg(F.round(F.count("rank") / F.count(F.lit(1)), 6).alias("recall"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def macro(each: DataFrame) -> DataFrame:
    """Number of queries and the means of their measures (recall, reciprocal_rank)."""
    return each.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("reciprocal_rank"))


def check_evaluation(ranking: DataFrame, relevant: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, fault) of evaluation input that ``measures`` must not be given.

    unjudged and unranked queries, queries without a relevant item, and items ranked twice; judged: query_id.
    """
    asked, ranked_ids, held = (df.select("query_id").distinct() for df in (judged, ranking, relevant))
    twice = ranking.groupBy("query_id", "vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("query_id").distinct()
    faults = [("unjudged", ranked_ids.join(asked, "query_id", "left_anti")), ("unranked", asked.join(ranked_ids, "query_id", "left_anti")), ("no_relevant", asked.join(held, "query_id", "left_anti")), ("duplicate", twice)]
    return functools.reduce(DataFrame.unionByName, [df.select("query_id", F.lit(name).alias("fault")) for name, df in faults])


def visible_measures(ranking: DataFrame, relevant: DataFrame, visible: DataFrame, k: int) -> DataFrame:
    """``measures`` where only visible items (vec_id) are relevant; queries without one are dropped (R8). The ranking stays as it is."""
    return measures(ranking, relevant.join(visible, "vec_id", "left_semi"), k)


def candidate_recall(exact: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the exact hits of each query that the candidates hold; both query_id, vec_id."""
    found = candidates.select("query_id", "vec_id", F.lit(1).alias("held"))
    hits = exact.select("query_id", "vec_id").join(found, ["query_id", "vec_id"], "left").groupBy("query_id")
    return hits.agg(F.round(F.count("held") / F.count(F.lit(1)), 6).alias("recall"))


def measures_by_label(ranking: DataFrame, labels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``measures`` where the items of a query's own label are relevant, without a row for each such pair.

    labels: vec_id, label; queries: query_id, label. Null labels have no relevant item and no row.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    same = ranking.where(F.col("rank") <= k).join(labels.withColumnRenamed("label", "found"), "vec_id").join(queries, "query_id").where("found = label")
    best = same.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    j = queries.join(sizes, "label").join(best, "query_id", "left")
    return j.select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def parse_query(query: str, most_chars: int = 4096, most_terms: int = 64, token: str = TOKEN) -> list[list[str]]:
    """The phrases of a query, each a list of words; quotes group words, terms without letter or digit are dropped.

    ``token`` is the pattern of a word: TOKEN, or ``\\w+`` for words of any script, as ``folded_tokens`` cuts them.
    """
    if len(query) > most_chars:
        raise ValueError(f"a query has at most {most_chars} characters")
    text = query.replace("\0", " ")
    if re.search(r'(?:^|\s)"[^"]*$', re.sub(r'(?<!\S)"[^"]*"', " ", text)):
        raise ValueError("close the quoted phrase")
    raw = [m.group(1) if m.group(1) is not None else m.group(2) for m in re.finditer(r'(?<!\S)"([^"]*)"|(\S+)', text)]
    phrases = [re.findall(token, fold(t)) for t in raw if any(c.isalnum() for c in t)]
    if len(phrases) > most_terms:
        raise ValueError(f"a query has at most {most_terms} terms")
    return [p for p in phrases if p]


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@functools.cache
def accents() -> tuple[str, str]:
    """Lower-case letters with marks, and the letters below the marks, by canonical decomposition."""
    pairs = [(chr(c), fold(chr(c))) for c in range(0xC0, 0x2000) if chr(c).islower() and not unicodedata.combining(chr(c))]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded_tokens(text: Column) -> Column:
    """Words of letters, digits and ``_`` of any script, lower-case and without diacritics; null stays null.

    Letters with a mark of their own are translated and combining marks removed, all in built-in functions.
    """
    marked, plain = accents()
    bare = F.regexp_replace(F.translate(F.lower(text), marked, plain), "\\p{Mn}", "")
    return F.regexp_extract_all(bare, F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the words of a phrase follow each other in an array of words."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda x: x == phrase[0]))
    want = F.array(*[F.lit(p) for p in phrase])
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words)))
    return F.when(F.size(words) < len(phrase), 0).otherwise(F.size(F.filter(starts, lambda i: F.slice(words, i, len(phrase)) == want)))


def lexical(docs: DataFrame, phrases: list[list[str]], k: int, columns: dict[str, float], every: bool = True, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(id, score) of the k best rows by BM25 over several weighted columns; rows hold every phrase, or any.

    A column's weight multiplies its counts; the length is that of all columns. No phrases: no rows.
    """
    if not phrases:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    cut = F.struct(*[words(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])
    made = docs.select("id", once(cut).alias("made")).select("id", *[F.col("made")[c].alias(c) for c in columns])
    total = lambda p, weighted: sum((phrase_count(F.col(c), p) * (w if weighted else 1) for c, w in columns.items()), F.lit(0))
    length = sum((F.size(c) for c in columns), F.lit(0)).alias("len")
    counts = made.select("id", length, *[total(p, True).alias(f"tf{i}") for i, p in enumerate(phrases)])
    counts, found = cut_lineage(counts), [F.col(f"tf{i}") > 0 for i in range(len(phrases))]
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.sum(h.cast("long")).alias(f"df{i}") for i, h in enumerate(found)])
    keep = functools.reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), found)
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    both = counts.where(keep).crossJoin(F.broadcast(stats))  # one row of statistics
    return both.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def filtered_knn(vectors: DataFrame, queries: DataFrame, allowed: DataFrame, candidates: int, k: int, first: bool = False) -> DataFrame:
    """Nearest neighbours among ``allowed`` (vec_id). The filter follows the candidates, so fewer than k may come back; ``first`` filters before."""
    if first:
        return knn(vectors.join(allowed, "vec_id", "left_semi"), queries, k)
    kept = ranked(nearest(vectors, queries, candidates), "distance", candidates).drop("rank").join(allowed, "vec_id", "left_semi")
    return _shown(ranked(kept, "distance", k))


def collapse(ranking: DataFrame, owners: DataFrame) -> DataFrame:
    """(query_id, owner_id, rank): each owner by its best item; owners: vec_id, owner_id."""
    return ranking.join(owners, "vec_id").groupBy("query_id", "owner_id").agg(F.min("rank").alias("rank"))


def one_vector_a_digest(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs to embed, one a digest (digest, vector_id the smallest chunk id), and links (id, vector_id) of all chunks."""
    vectors = chunks.groupBy("digest").agg(F.min("id").alias("vector_id"))
    return vectors, chunks.join(vectors, "digest").select("id", "vector_id")


def semantic_score(ranking: DataFrame, constant: int = 60) -> DataFrame:
    return ranking.withColumn("score", F.round(1 / (F.col("rank") + constant), 9))


def search(docs: DataFrame, vectors: DataFrame, mode: str, query: str, vector: DataFrame | None, k: int = 20, pool: int = 256) -> DataFrame:
    """(id, score, found, mode_used): exact and best_lexical by words, semantic by vector, hybrid by both fused."""
    phrases = parse_query(query)
    if mode == "semantic":
        near = semantic_score(knn(vectors, vector, min(k, pool)))
        return near.select(F.col("vec_id").alias("id"), "score", F.lit("second").alias("found"), F.lit("semantic").alias("mode_used"))
    words = lexical(docs, phrases, pool, {"text": 1.0, "context": 2.0})
    if mode == "exact" or vector is None:
        used = "exact" if mode == "exact" else "best_lexical"
        return words.orderBy(F.desc("score"), "id").limit(k).select("id", "score", F.lit("first").alias("found"), F.lit(used).alias("mode_used"))
    one = words.select(F.lit(0).alias("query_id"), F.col("id").alias("vec_id"), (-F.col("score")).alias("s"))
    both = fuse(ranked(one, "s", pool), knn(vectors, vector.withColumn("query_id", F.lit(0)), pool))
    return best_fused(both, k).select(F.col("vec_id").alias("id"), "score", "found", F.lit("hybrid").alias("mode_used"))


def search_each(docs: DataFrame, vectors: DataFrame, mode: str, query: str, queries: DataFrame, k: int = 20, pool: int = 256) -> DataFrame:
    """(query_id, id, score, found, mode_used): semantic or hybrid search with every vector of queries (query_id, q) beside one text."""
    if mode == "semantic":
        near = semantic_score(knn(vectors, queries, min(k, pool)))
        return near.select("query_id", F.col("vec_id").alias("id"), "score", F.lit("second").alias("found"), F.lit("semantic").alias("mode_used"))
    words = lexical(docs, parse_query(query), pool, {"text": 1.0, "context": 2.0})
    one = ranked(words.select(F.lit(0).alias("list"), F.col("id").alias("vec_id"), (-F.col("score")).alias("s")), "s", pool, "list").select("vec_id", "rank")
    both = fuse(queries.select(F.col("query_id").cast("long")).crossJoin(F.broadcast(one)), knn(vectors, queries, pool))  # at most ``pool`` rows
    return best_fused(both, k).select("query_id", F.col("vec_id").alias("id"), "score", "found", F.lit("hybrid").alias("mode_used"))


def excerpt(text: str, phrases: list[list[str]], size: int = 512, lead: int = 96) -> tuple[str, list[tuple[int, int]]]:
    """An excerpt from ``lead`` units before the first match and the matches in it, in UTF-16 units."""
    words = [(m.start(), m.end(), fold(m.group())) for m in WORD.finditer(text)]
    names = [w[2] for w in words]
    spans = sorted({(words[i][0], words[i + len(p) - 1][1]) for p in phrases for i in range(len(words) - len(p) + 1) if names[i : i + len(p)] == p})
    joined: list[tuple[int, int]] = []
    for a, b in spans:
        if joined and a < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    units = text.encode("utf-16-le", "surrogatepass")
    wide, at, here = [], 0, 0
    for edge in (x for span in joined for x in span):
        here += len(text[at:edge].encode("utf-16-le", "surrogatepass")) // 2
        wide.append(here)
        at = edge
    matches = list(zip(wide[::2], wide[1::2]))
    low = lambda i: 0xDC00 <= int.from_bytes(units[2 * i : 2 * i + 2], "little") <= 0xDFFF
    start = max(0, (matches[0][0] if matches else 0) - lead)
    end = min(len(units) // 2, start + size)
    start -= start > 0 and low(start)
    end -= end < len(units) // 2 and low(end)
    before, after = "…" if start else "", "…" if end < len(units) // 2 else ""
    shown = [(max(start, a) - start + len(before), min(end, b) - start + len(before)) for a, b in matches if b > start and a < end]
    return before + units[2 * start : 2 * end].decode("utf-16-le", "surrogatepass") + after, shown


def excerpts(hits: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(id, excerpt, highlights) of hits (id, text); a task turns EXCERPTS texts into Python objects at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EXCERPTS):
                piece = batch.slice(at, EXCERPTS)
                found = [excerpt(t or "", phrases) for t in piece.column(1).to_pylist()]
                ends = np.cumsum([0, *[len(h) for _, h in found]], dtype=np.int32)
                edges = np.array([e for _, h in found for span in h for e in span], np.int32).reshape(-1, 2)
                spans = pa.StructArray.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], names=["start", "end"])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([t for t, _ in found], pa.string()), pa.ListArray.from_arrays(pa.array(ends), spans)], names=["id", "excerpt", "highlights"])

    return hits.select("id", "text").mapInArrow(cut, f"id {dict(hits.dtypes)['id']}, excerpt string, highlights array<struct<start: int, end: int>>")
