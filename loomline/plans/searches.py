"""Queries on weighted words, filtered and collapsed neighbours, fused search and excerpts."""

from pyspark.sql import functions as F

from loomline.functions import chunking
from loomline.operators import search
from loomline.plans.registry import EVERY, SQL, also, query
from loomline.sources.archive import read

NEAR = f"""e AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_distance(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS exact, round(exact, 6) AS distance FROM embeddings v, embeddings q WHERE q.{EVERY}),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact, vec_id) AS rank FROM e)"""
COUNTS = """t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t, regexp_extract_all(lower(source || ' the'), '[a-z0-9_]+') AS c FROM documents),
c AS (SELECT id, len(t) + len(c) AS n, len(list_filter(t, lambda x: x = 'the')) + 2.0::DOUBLE * len(list_filter(c, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'and'))::DOUBLE + 2.0 * len(list_filter(c, lambda x: x = 'and')) AS b FROM t),
s AS (SELECT count(*) AS nn, avg(n) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
w AS (SELECT id, round(ln(1 + (nn - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av)) + ln(1 + (nn - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / av)), 6) AS score
FROM c, s WHERE a > 0 AND b > 0 ORDER BY score DESC, id LIMIT 256)"""


def _queries(spark, sf):
    return read(spark, sf, "embeddings").where(EVERY).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _docs(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.concat("source", F.lit(" the")).alias("context"))


@also("every", "wide")
@query(f"WITH {NEAR}, f AS (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY exact, vec_id) AS rank FROM x WHERE rank <= 1024 AND label = 3) SELECT * FROM f WHERE rank <= 10")
def filtered_knn(spark, sf, pool=1024):
    """With the 1,024 candidates of V6."""
    v = read(spark, sf, "embeddings")
    return search.filtered_knn(v, _queries(spark, sf), v.where("label = 3").select("vec_id"), pool, 10)


@also("every")
@query(f"WITH {NEAR}, f AS (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY exact, vec_id) AS rank FROM e WHERE label = 3) SELECT * FROM f WHERE rank <= 10")
def prefiltered_knn(spark, sf):
    v = read(spark, sf, "embeddings")
    return search.filtered_knn(v, _queries(spark, sf), v.where("label = 3").select("vec_id"), 100, 10, first=True)


@also("every")
@query(f"WITH {NEAR} SELECT query_id, label AS owner_id, min(rank) AS rank FROM x WHERE rank <= 50 GROUP BY query_id, label")
def collapsed_hits(spark, sf):
    v = read(spark, sf, "embeddings")
    return search.collapse(search.knn(v, _queries(spark, sf), 50), v.select("vec_id", F.col("label").alias("owner_id")))


@also("every")
@query(f"""WITH e AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings v, embeddings q WHERE q.{EVERY})
SELECT * FROM (SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM e) WHERE rank <= 10""")
def dot_ranking(spark, sf):
    return search.dot_top(read(spark, sf, "embeddings"), _queries(spark, sf), 10)


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(text)) AS vector_id FROM documents WHERE text IS NOT NULL")
def vector_links(spark, sf):
    d = read(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    return search.one_vector_a_digest(d)[1]


@query(f"WITH {COUNTS} SELECT id, score FROM w ORDER BY score DESC, id LIMIT 20")
def bm25_two_columns(spark, sf):
    return search.lexical(_docs(spark, sf), [["the"], ["and"]], 20, {"text": 1.0, "context": 2.0})


FOLDED = COUNTS.replace("lower(text), '[a-z0-9_]+'", "strip_accents(lower(text)), '[\\p{L}\\p{N}_]+'").replace("lower(source || ' the'), '[a-z0-9_]+'", "strip_accents(lower(source || ' the')), '[\\p{L}\\p{N}_]+'").replace("x = 'the'", "x = 'fur'").replace("x = 'and'", "x = 'und'")


@query(f"WITH {FOLDED} SELECT id, score FROM w ORDER BY score DESC, id LIMIT 20")
def bm25_folded(spark, sf):
    """Words of any script without their marks: a search for "fur" finds "für"."""
    return search.lexical(_docs(spark, sf), [["fur"], ["und"]], 20, {"text": 1.0, "context": 2.0}, words=search.folded_tokens)


@query("WITH t AS (SELECT query_id, round(count(rank) / count(*)::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS rr FROM (" + SQL["recall_and_mrr"].split("SELECT j.query_id")[0] + " SELECT j.query_id, x.rank FROM j LEFT JOIN (SELECT * FROM x WHERE rank <= 100) x ON j.query_id = x.query_id AND j.vec_id = x.vec_id) GROUP BY query_id) SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS reciprocal_rank FROM t")
def macro_metrics(spark, sf):
    """Means over all queries of recall at 100 and reciprocal rank."""
    v = read(spark, sf, "embeddings")
    each = search.measures_by_label(search.knn(v, _queries(spark, sf), 100), v.select("vec_id", "label"), v.where(EVERY).select(F.col("vec_id").alias("query_id"), "label"), 100)
    return search.macro(each)


@also("every")
@query(f"""WITH {COUNTS}, l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r1 FROM w), {NEAR}, k AS (SELECT query_id, vec_id AS id, rank AS r2 FROM x WHERE rank <= 256), a AS (SELECT vec_id AS query_id, id, r1 FROM embeddings, l WHERE {EVERY}),
f AS (SELECT coalesce(a.query_id, k.query_id) AS query_id, coalesce(a.id, k.id) AS id, round(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0), 9) AS score, CASE WHEN r2 IS NULL THEN 'first' WHEN r1 IS NULL THEN 'second' ELSE 'both' END AS found, r1, r2, coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0) AS exact FROM a FULL JOIN k ON a.query_id = k.query_id AND a.id = k.id)
SELECT query_id, id, score, found, 'hybrid' AS mode_used FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, r1 NULLS LAST, r2 NULLS LAST, id) AS n FROM f) WHERE n <= 20""")
def hybrid_search(spark, sf):
    return search.search_each(_docs(spark, sf), read(spark, sf, "embeddings"), "hybrid", "the and", _queries(spark, sf))


@also("every")
@query(f"WITH {NEAR} SELECT query_id, vec_id AS id, round(1.0::DOUBLE / (60 + rank), 9) AS score, 'second' AS found, 'semantic' AS mode_used FROM x WHERE rank <= 20")
def semantic_search(spark, sf):
    return search.search_each(_docs(spark, sf), read(spark, sf, "embeddings"), "semantic", "", _queries(spark, sf))


@query()
def search_excerpts(spark, sf):
    return search.excerpts(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), search.parse_query('the "of the"'))


@query("SELECT doc_id AS id, concat_ws(' > ', source, CASE WHEN doc_id % 2 = 0 THEN lang END) AS context FROM documents")
def context_prefixes(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), chunking.context_prefix(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("context"))


@query("""WITH t AS (SELECT doc_id, lang, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n FROM documents) SELECT lang, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, count(*) FILTER (n > 256) AS multi FROM t GROUP BY lang""")
def token_statistics(spark, sf):
    n = F.size(search.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n")
    t = read(spark, sf, "documents").select("lang", n)
    return t.groupBy("lang").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") > 256).alias("multi"))
