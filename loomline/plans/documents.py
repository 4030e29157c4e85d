"""Queries of document pages: the words of messages are set on pages as PDF runs and read back."""

from pyspark.sql import functions as F

from loomline.operators import layout
from loomline.plans.registry import query
from loomline.sources.archive import read


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS w FROM conversations), l AS (SELECT conv_id, turn, w, unnest(range(0, (len(w) + 7) // 8)) AS line FROM t)
SELECT conv_id AS document, turn AS page, 'ok' AS outcome, 'geometric' AS mode, 1 AS columns, string_agg(CASE WHEN line = 0 THEN '' WHEN line % 10 = 0 THEN chr(10) || chr(10) ELSE chr(10) END || array_to_string(w[line * 8 + 1 : line * 8 + 8], ' '), '' ORDER BY line) || chr(10) AS text
FROM l GROUP BY conv_id, turn""")
def pdf_page_text(spark, sf):
    """Eight words a line, a wide gap after ten lines; a message is a page of its conversation."""
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    w = read(spark, sf, "conversations").select("conv_id", "turn", words.alias("w"))
    # a row of eight words, so that no word carries its whole message along
    w = w.select("conv_id", "turn", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 8).cast("int")), lambda n: F.slice("w", 8 * n + 1, 8))).alias("line", "w")).where(F.size("w") > 0)
    w = w.select("conv_id", "turn", "line", "w", F.posexplode("w").alias("place", "str"))
    place, line, i = F.col("place"), F.col("line"), 8 * F.col("line") + F.col("place")
    before = F.aggregate(F.slice("w", 1, place), F.lit(0), lambda n, x: n + F.length(x))
    x, y = 40 + 5 * before + 3 * place, 700 - 15 * line - 30 * F.floor(line / 10)
    numbers = [F.lit(n) for n in (10, 0, 0, 10)] + [x, y]
    runs = w.select(
        F.col("conv_id").alias("document"), F.col("turn").alias("page"), i.alias("item_index"), "str", F.array(*[n.cast("double") for n in numbers]).alias("transform"),
        (5.0 * F.length("str")).alias("width"), F.lit(10.0).alias("height"), F.lit("ltr").alias("dir"), F.lit(False).alias("has_eol"), F.lit(False).alias("monospace"),
    )
    return layout.pages(runs).drop("reasons", "runs")
