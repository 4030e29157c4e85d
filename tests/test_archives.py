"""Exports of one long thread, without a row that holds all of it."""

import hashlib

from loomline.operators import archives


def chain(digests):
    out = ""
    for d in digests:
        out = hashlib.sha256((out + d).encode()).hexdigest()
    return out


def test_digest_tree_of_a_long_group(spark):
    rows = [("a", i, f"{i:064x}") for i in range(70)] + [("b", 0, "x")]
    level = [d for _, _, d in rows[:70]]
    for _ in range(4):  # 70, 18, 5, 2, 1
        level = [chain(level[i : i + 4]) for i in range(0, len(level), 4)]
    once = chain(["x"])
    want = {"a": level[0], "b": chain([chain([chain([once])])])}
    assert {r.group: r.digest for r in archives.tree_digest(spark.createDataFrame(rows, "group string, ordinal long, digest string").repartition(5), 4).collect()} == want


def test_pieces_make_the_thread(spark):
    m = spark.createDataFrame([(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 5, "user", None), (2, 7, "user", "d")], "thread_id long, turn long, role string, text string")
    whole = {r.thread_id: r.text for r in archives.markdown(m).collect()}
    joined: dict = {}
    for r in archives.markdown_pieces(m).collect():
        joined[r.thread_id] = joined.get(r.thread_id, "") + r.text
    assert joined == whole
