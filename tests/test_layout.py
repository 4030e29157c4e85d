"""Reading order of pages: columns, cells, indents, blocks, other directions and bounds."""

from loomline.operators import audits, layout

SCHEMA = "document string, page int, item_index int, str string, transform array<double>, width double, height double, dir string, has_eol boolean, monospace boolean"


def run(page, index, text, x, y, size=10.0, **other):
    row = {"transform": [size, 0.0, 0.0, size, float(x), float(y)], "width": len(text or "") * size / 2, "height": size, "dir": "ltr", "has_eol": False, "monospace": False} | other
    return ("d", page, index, text, row["transform"], row["width"], row["height"], row["dir"], row["has_eol"], row["monospace"])


def read(spark, rows):
    return {r.page: r for r in layout.pages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_pages(spark):
    rows = []
    for i in range(4):  # 1: two columns below a title across both, the right one listed first
        rows += [run(1, 2 * i, f"right side of the page {i}", 320, 700 - 14 * i), run(1, 2 * i + 1, f"left side of the page {i}", 40, 700 - 14 * i)]
    rows += [run(1, 8, "A title that stands across the two columns of this page, in full", 40, 740, 12.0)]
    rows += [run(2, 0, "two", 300, 685), run(2, 1, "one", 300, 700), run(2, 2, "pear", 40, 701), run(2, 3, "plum", 40, 685)]  # cells
    mono = {"monospace": True}
    rows += [run(3, 0, "if x:", 50, 700, **mono), run(3, 1, "y = 1", 74, 686, **mono), run(3, 2, "z = 2", 50, 672, **mono), run(3, 3, "Prose ", 40, 650), run(3, 4, "goes", 71, 650), run(3, 5, "on", 95, 650), run(3, 6, "s", 105.5, 650)]
    rows += [run(4, 1, "\u05d0\u05d1", 10, 700, dir="rtl"), run(4, 0, "turned", 10, 10, transform=[0.0, 10.0, -10.0, 0.0, 9.0, 9.0], has_eol=True), run(4, 2, " ", 0, 0, dir="ttb")]
    rows += [run(5, 0, "", 1, 1)]
    found = read(spark, rows)
    title = "A title that stands across the two columns of this page, in full"
    sides = ["\n".join(f"{side} side of the page {i}" for i in range(4)) for side in ("left", "right")]
    assert (found[1].columns, found[1].text) == (2, "\n\n".join([title, *sides]) + "\n")
    assert found[1].runs == [8, 1, 3, 5, 7, 0, 2, 4, 6]
    assert (found[2].columns, found[2].text) == (1, "pear\tone\nplum\ttwo\n")
    assert found[3].text == "if x:\n    y = 1\nz = 2\n\nProse goes ons\n"
    assert (found[4].mode, found[4].text, found[4].runs) == ("source_order", "turned\n\u05d0\u05d1 ", [0, 1, 2])
    assert found[4].reasons == ["non_ltr", "rotated_or_skewed"]
    assert (found[5].outcome, found[5].text) == ("ok", "")


def test_bounds_and_faults(spark):
    rows = [run(1, 0, None, 0, 0), run(2, 0, "a", float("inf"), 0), run(3, 10_000, "a", 0, 0), run(4, 0, "x" * 262_145, 0, 0), run(5, 0, "x" * 262_144, 0, 0), run(6, 0, "a", 0, 0), run(None, 0, "a", 0, 0), run(7, 0, "a", 0, 0, transform=[1.0])]
    rows += [run(8, 0, "a", 0, 0)] * 10_001
    found = read(spark, rows)
    assert {p: r.outcome for p, r in found.items()} == {1: "parse_failed", 2: "parse_failed", 3: "parse_failed", 4: "capacity", 5: "capacity", 6: "ok", None: "ok", 7: "parse_failed", 8: "capacity"}
    assert found[6].text == "a\n" and found[4].text is None
    assert read(spark, []) == {}


def test_gaps_over_blocks_agree_with_one_pass(spark):
    log = [("a", s) for s in (1, 2, 3, 5, 5, 9, 10, 40, 41)] + [("b", -9), ("b", -8), ("b", -1), (None, 3), (None, 7)]
    expected = set()
    for stream in {s for s, _ in log}:
        seen = sorted(n for s, n in log if s == stream)
        expected |= {(stream, b, a) for a, b in zip(seen, seen[1:]) if b != a + 1}
    df = spark.createDataFrame(log, "stream string, sequence long")
    for block in (1, 4, 65_536):
        assert {tuple(r) for r in audits.gaps(df, block).select("stream", "sequence", "previous").collect()} == expected


def test_required_counts_null_absent_and_foreign(spark):
    states = spark.createDataFrame([(1, "t", 10), (2, "t", None), (3, "u", 10), (4, "t", 99)], "id int, thread string, context int")
    contexts = spark.createDataFrame([(10, "t")], "id int, thread string")
    assert {r.id for r in audits.required(states, "context", contexts, "thread", "missing_context").collect()} == {2, 3, 4}


def test_many_pages_are_read_together(spark):
    """Pages alone, and all of them in batches that end within pages, come out alike; no task is called page by page."""
    rows, words = [], ["", " ", "a", " b", "left side of the page", "right side of the page", "\U0001f600 wide"]
    for p in range(40):
        rows += [run(p, i, words[4 + i % 2 if p > 20 else (p * i + i) % 7], 40 + 280 * (i % 2) + p % 3, 700 - 14 * (i // 2), monospace=p % 5 == 0, dir="rtl" if p == 7 else "ltr") for i in range(p % 9 + 1)]
    rows += [run(None, i, words[i], 40, 700) for i in (4, 5)] + [run(50, 0, None, 0, 0), run(50, 1, "a", 0, 0, transform=None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = read(spark, rows)
        assert len(found) == 42 and found[50].outcome == "parse_failed" and {r.columns for r in found.values()} == {1, 2, None}
        for p in (None, 5, 7, 8, 26, 39):
            assert read(spark, [r for r in rows if r[1] == p]) == {p: found[p]}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    plan = layout.pages(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
