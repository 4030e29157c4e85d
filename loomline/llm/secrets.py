"""Secret scans with a trigram inverted index (operator 3), DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: an OR of ANDs of
trigrams that every match must contain (compared in lower case). The index has one
posting (trigram, doc_id) for each trigram of those queries that a text contains.
Postings are intersected per document and clause; documents that satisfy a clause
are the rule's candidates, and only they are verified with the regex. A rule from
whose regex no trigram follows (such as the run of hex digits) scans every text.

Texts stay where they are: the candidates (a doc_id and a bit for each rule) are
broadcast if they are few by count; otherwise a row's own postings are intersected
in the row, which gives the same candidates without moving a text.

Defined cases: null text counts as empty; null and repeated doc_ids share their
candidates, and each row is verified by its own text; matches that start together are
listed in the order of the rules; texts are scanned whole, however long; an empty
table gives no rows. Extra columns are kept, whatever their names; ``spans`` replaces
a column of that name.
"""

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import BROADCAST_ROWS, column, fresh, persist, table


@dataclass(frozen=True)
class Rule:
    """kind, a regex that Java, RE2 and Python read alike, least length of a group, case of its trigrams."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: Base rules first, in their order; the others add spans.
RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("bearer", r"[bB]earer [A-Za-z0-9_.=+/-]{20,}"),
    Rule("url_password", r"://[A-Za-z0-9._%+-]{1,64}:[^\x20\x09-\x0D/@:]{3,64}@[A-Za-z0-9.-]+"),
)
BASE = ("assign", "access", "hex")
#: Strings that one regex element may stand for, before it counts as unknown.
EXPAND = 8


def literals(parsed) -> list[list[set[str]]]:
    """Alternatives of a parsed regex; each a list of runs, each run a set of lower-case strings."""
    paths: list[list[set[str]]] = [[{""}]]

    def extend(options: set[str]) -> None:
        for p in paths:
            p[-1] = {a + b for a in p[-1] for b in options}

    def stop() -> None:
        for p in paths:
            p.append({""})

    for op, arg in parsed:
        if op is sre.LITERAL:
            extend({chr(arg).lower()})
        elif op is sre.IN:
            chars = {chr(v).lower() for o, v in arg if o is sre.LITERAL}
            known = all(o is sre.LITERAL for o, _ in arg) and len(chars) <= EXPAND
            extend(chars) if known else stop()
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            if (least, most) == (0, 1):
                paths = [p[:-1] + [set(p[-1])] for p in paths] + [a[:-1] + [{x + y for x in a[-1] for y in b[0]}] + b[1:] for a in paths for b in literals(inner)]
            else:
                stop()
        elif op is sre.SUBPATTERN:
            paths = [a[:-1] + [{x + y for x in a[-1] for y in b[0]}] + b[1:] for a in paths for b in literals(arg[-1])]
        elif op is sre.BRANCH:
            branches = [b for branch in arg[1] for b in literals(branch)]
            paths = [a[:-1] + [{x + y for x in a[-1] for y in b[0]}] + b[1:] for a in paths for b in branches]
        else:
            stop()
    return paths


def trigram_query(regex: str) -> list[frozenset[str]]:
    """An OR of ANDs of trigrams that any match contains; [] if nothing is mandatory."""
    clauses = set()
    for path in literals(sre_parser.parse(regex)):
        options = [frozenset()]
        for run in path:
            if all(len(s) >= 3 for s in run) and len(run) <= 2 * EXPAND:
                options = [o | {s[i : i + 3] for i in range(len(s) - 2)} for o in options for s in run]
        if frozenset() in options:
            return []
        clauses.update(options)
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def grams_of(rules=RULES) -> list[str]:
    """All trigrams that the rules ask for."""
    return sorted({g for r in rules for clause in trigram_query(r.regex) for g in clause})


def held(low: Column, rules=RULES) -> Column:
    """Array of the asked trigrams that a lower-case text contains."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams_of(rules)]))


def postings(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """(trigram, doc_id): the inverted index over the trigrams that the rules ask for."""
    return docs.select("doc_id", F.lower(column(text)).alias("low")).select("doc_id", F.explode(held(F.col("low"), rules)).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """doc_id and ``bits``: bit i is set if the document satisfies the trigram query of rule i."""
    spark = docs.sparkSession
    clauses = [(at, i, sorted(clause)) for at, r in enumerate(rules) for i, clause in enumerate(trigram_query(r.regex))]
    asked = [(at, i, g, 1 << k, (1 << len(grams)) - 1) for at, i, grams in clauses for k, g in enumerate(grams)]
    query = spark.createDataFrame(asked, "rule int, clause int, trigram string, bit long, need long")
    hits = postings(docs, rules, text).join(F.broadcast(query), "trigram")  # a row for each trigram of the rule set
    met = hits.groupBy("doc_id", "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.max("need").alias("need")).where("bits = need")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("bits"))


def bits_in_row(text: Column, rules=RULES) -> Column:
    """The same bits from the row's own postings."""
    found, bits = held(F.lower(text), rules), F.lit(0).cast("long")
    for at, rule in enumerate(rules):
        clauses = [F.size(F.array_intersect(found, F.array(*map(F.lit, sorted(c))))) == len(c) for c in trigram_query(rule.regex)]
        met = clauses[0] if clauses else F.lit(False)
        for c in clauses[1:]:
            met = met | c
        bits = bits.bitwiseOR(F.when(met, F.lit(1 << at).cast("long")).otherwise(0))
    return bits


def spans_of(rule: Rule, at: int, text: Column) -> Column:
    """Array of (start, ord, end, kind) of a rule's leftmost matches, code points, end exclusive.

    The pieces between the matches and the matches give the offsets: match i starts
    after pieces 0..i and matches 0..i-1.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    pieces = F.split(text, rule.regex, -1)
    steps = F.arrays_zip(
        F.transform(pieces, lambda p: F.length(p)).alias("gap"),
        F.transform(whole, lambda m: F.length(m)).alias("len"),
        (F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), lambda g: F.length(g)) if rule.group else F.transform(whole, lambda m: F.length(m))).alias("part"),
    )
    item = "struct<start:int,ord:int,end:int,kind:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["len"]
        span = F.struct(begin.alias("start"), F.lit(at).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        grown = F.when(x["part"] >= rule.least, F.concat(acc["spans"], F.array(span.cast(item)))).otherwise(acc["spans"])
        return F.struct(F.coalesce(end, begin).alias("at"), grown.alias("spans"))

    return F.when(F.size(whole) > 0, F.aggregate(steps, start, step, lambda acc: acc["spans"])).otherwise(F.array().cast(f"array<{item}>"))


def spans(docs: DataFrame, rules=RULES, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs with ``spans``: array of (start, ord, end, kind) sorted by start, then rule order."""
    docs = docs.drop("spans")
    a, b = fresh(docs, "candidate_id", "candidate_rules")
    found = persist(candidates(docs, rules, text)).select(F.col("doc_id").alias(a), F.col("bits").alias(b))
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        df = docs.join(F.broadcast(found), F.col("doc_id").eqNullSafe(F.col(a)), "left").drop(a)
    else:
        df = docs.withColumn(b, bits_in_row(column(text), rules))
    body, each = F.coalesce(column(text), F.lit("")), []
    for at, rule in enumerate(rules):
        own = spans_of(rule, at, body)
        if trigram_query(rule.regex):
            own = F.when(F.coalesce(F.col(b), F.lit(0)).bitwiseAND(1 << at) != 0, own).otherwise(F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>"))
        each.append(own)
    return df.withColumn("spans", F.array_sort(F.concat(*each))).drop(b)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: secret spans of every document."""
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def _sql_spans(rule: Rule, at: int) -> str:
    rx = rule.regex.replace("'", "''")
    part = f"regexp_extract_all(x, '{rx}', {rule.group})" if rule.group else "w"
    return f"""
  SELECT doc_id, {at} AS ord, '{rule.kind}' AS kind,
    list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(w[1:i-1], lambda s: length(s))), 0) AS start_, length(w[i]) AS len
  FROM (SELECT doc_id, w, p, g, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(x, '{rx}') AS w, regexp_split_to_array(x, '{rx}') AS p, {part.replace("w", f"regexp_extract_all(x, '{rx}')") if part == "w" else part} AS g FROM d))
  WHERE length(g[i]) >= {rule.least}"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
s AS ({' UNION ALL '.join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
t AS (SELECT doc_id, ord, kind, CAST(start_ AS BIGINT) AS start_, kind || ':' || CAST(start_ AS BIGINT) || ':' || CAST(start_ + len AS BIGINT) AS span FROM s),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start_, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY start_, ord) AS spans FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
