"""Groups of spelling variants by a rare-first q-gram prefix filter (operator 12).

Two words are near if one inserted, deleted or replaced code point makes one of the
other. Such an edit touches at most two bigrams, so of a word's three rarest bigrams
(and the next equals of the third) one is kept at the same place, or one further behind the edit.
Bigrams are ordered by their number over all words, then by themselves. A kept bigram
also splits the word: the edit lies on one side, and the other side is equal. So words
meet on (bigram, length, place, equal side), the place and length taken as they are
after the edit, and Spark's bounded edit distance verifies them. Keys of more than
HOT_KEY words are cut further by the other side less one code point, which near
words share as well: no key's words are ever paired with one another all at once.

A word's form is its commonest near word, if that is common enough; roots follow forms
to the last by pointer doubling, in rounds bounded by the logarithm of the largest
count. Everything is DataFrame work; only the vocabulary is shuffled, never the texts.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty
one in the deletion rule; repeated rows count again; an empty table gives no rows;
words of any length are compared whole (the cost grows with the length, in a hot key
with its square); other columns are not read.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import column, persist, small, table
from loomline.llm.importance import CRC_SQL, crc_sql

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR, MISPELT = 6, 5, 5, 199
#: Bigrams of a word that are joined: twice the edits and one.
RAREST = 3
#: Words of a key that are paired directly.
HOT_KEY = 32


def runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, word): every maximal run of letters, A-Z lower-cased."""
    lowered = F.translate(column(text), UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("word"))


def misspelt(words: DataFrame, divisor: int = MISPELT) -> DataFrame:
    """The words with one code point gone where the hash of doc_id and word says so."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    hashed = words.select("word", F.crc32(key.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    gone = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return hashed.select(F.when(F.col("h") % divisor == 0, gone).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and common enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(word, len, gram, at): of each word the three rarest bigrams, and up to two equals of the third behind them.

    The edit makes at most two new bigrams, so one that is kept among the three of one
    word is at most two further in the order of the other, equals taken from the front.
    """
    pair = lambda i: F.struct(F.substring("word", i, F.lit(2)).alias("gram"), (i - 1).alias("at"))
    grams = words.select("word", F.length("word").alias("len"), F.inline(F.transform(F.sequence(F.lit(1), F.length("word") - 1), pair)))
    # letters of LETTERS make at most 90 * 90 bigrams
    order = small(persist(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))))
    ranked = grams.join(order, "gram").groupBy("word", "len").agg(F.sort_array(F.collect_list(F.struct("freq", "gram", "at"))).alias("g"))
    third = F.col("g")[F.least(F.lit(RAREST), F.size("g")) - 1]
    kept = F.filter("g", lambda x, i: (i < RAREST) | ((i < RAREST + 2) & (x["gram"] == third["gram"])))
    return ranked.select("word", "len", F.inline(kept)).drop("freq")


def _keys(grams: DataFrame) -> DataFrame:
    """(key, word, longer, rest): where a word meets others of its length and (longer) those with one code point more."""
    before, after = F.substring(F.col("word"), F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 3, F.col("len"))

    def key(side: int, longer: int, moved: int) -> Column:
        equal, rest = (before, after) if side == 0 else (after, before)
        own = F.xxhash64("gram", F.col("len") + longer, F.col("at") + moved, F.lit(side), equal)
        return F.struct(own.alias("key"), F.lit(bool(longer)).alias("longer"), rest.alias("rest"))

    # an edit behind the bigram leaves its place, one in front of it moves it in the longer word
    meets = F.array(key(0, 0, 0), key(1, 0, 0), key(0, 1, 0), key(1, 1, 1))
    return grams.select("word", F.inline(meets))


def _cut(keys: DataFrame) -> DataFrame:
    """Finer keys of hot ones: the other side less one code point, with its place among words of one length."""
    own = F.col("longer")
    less = lambda i: F.concat(F.substring("rest", F.lit(1), i), F.substring(F.col("rest"), i + 2, F.length("rest")))
    places = F.when(F.length("rest") > 0, F.sequence(F.lit(0), F.length("rest") - 1)).otherwise(F.array().cast(T.ArrayType(T.IntegerType())))
    same = F.transform(places, lambda i: F.xxhash64("key", i, less(i)))
    shorter = F.array_distinct(F.transform(places, lambda i: F.xxhash64("key", F.lit(-1), less(i))))
    # words of a length share the place of a replaced code point; a shorter word is the longer one's rest less one
    fine = F.when(own, F.array(F.xxhash64("key", F.lit(-1), "rest"))).otherwise(F.concat(same, shorter))
    return keys.select("word", "longer", F.explode(fine).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): all pairs of words that one edit parts, each once, a < b. words: distinct ``word``."""
    keys = persist(_keys(rarest_bigrams(words)))
    counts = keys.where(~F.col("longer")).groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > HOT_KEY)
    hot = small(persist(counts.select("key")))
    usual = keys.select("word", "longer", "key").join(hot, "key", "left_anti")
    rows = usual.unionByName(_cut(keys.join(hot, "key", "left_semi"))).distinct()
    own = rows.where(~F.col("longer")).select("key", F.col("word").alias("other"))
    met = rows.join(own, "key").where(F.col("longer") | (F.col("word") < F.col("other"))).where(F.levenshtein("word", "other", 1) == 1)
    return met.select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).distinct()


def roots(forms: DataFrame, largest: int, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, root) of the words that have a form, by doubling pointers.

    A form is at least ``factor`` times as common as its word, so a chain is not longer
    than the logarithm of the largest count, and the rounds that of the chain.
    """
    at = forms.select("word", F.col("form").alias("root"))
    chain = max(1, math.ceil(math.log(max(largest, factor), factor)))
    for _ in range(max(1, math.ceil(math.log2(chain)))):
        at = persist(at)
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return at


def variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near and form_n of a vocabulary (word, n)."""
    words = persist(words)
    pairs = persist(near_pairs(words.select("word")))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    commonest = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")  # of equal counts the smallest in code-point order
    near = both.join(other, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), commonest)
    is_form = -F.col("best.less") >= factor * F.col("n")
    linked = persist(words.join(near, "word").select("word", "n", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    largest = words.agg(F.max("n")).first()[0] or 1
    ends = roots(linked.where(F.col("form").isNotNull()), largest, factor)
    found = words.join(linked.drop("n"), "word", "left").join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: spelling variants among the words of all documents."""
    return variants(vocabulary(misspelt(runs(table(spark, sf_dir, "documents")))))


SQL = rf"""WITH RECURSIVE {CRC_SQL},
  runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS w FROM documents),
  keyed AS MATERIALIZED (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM runs),
  {crc_sql("hashed", "keyed", "k")},
  kept AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(w, 1, (crc % length(w))::INT) || substr(w, (crc % length(w))::INT + 2) ELSE w END AS word FROM keyed JOIN hashed ON k = value),
  v AS MATERIALIZED (SELECT word, count(*) AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
  gone AS MATERIALIZED (SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
  pairs AS (SELECT word AS a, rest AS b FROM gone WHERE rest IN (SELECT word FROM v) UNION SELECT x.word, y.word FROM gone x JOIN gone y USING (i, rest) WHERE x.word < y.word),
  near AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  best AS MATERIALIZED (SELECT v.word, v.n, count(o.word) AS n_near, arg_min(o.word, (-o.n, o.word)) AS other, max(o.n) AS other_n
    FROM v LEFT JOIN near ON v.word = a LEFT JOIN v o ON o.word = b GROUP BY v.word, v.n),
  formed AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM best),
  walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word JOIN formed e ON e.word = w.at WHERE e.form IS NULL"""
