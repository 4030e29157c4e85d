"""Each operator's query or stage, end to end, against a plain version; hot keys, blocks and ranges are forced to be many."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from brute import components, hits, line_classes, simhash, spans
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import common, decontaminate, fingerprint, html_blocks, html_extract, language, linededup, mixing, secrets, simhash as sim, toxicity, urls

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        p = rng.randrange(len(s))
        s[p : p + rng.randrange(2)] = rng.choice(("", "q", "z"))
    return "".join(s)


def documents(rng):
    """Rows with near and exact copies, lines that recur and nearly recur, secrets, benchmark passages, nulls."""
    base, lines = [prose(rng, 60) for _ in range(4)], [prose(rng, 6) for _ in range(6)]
    texts = [None, None, "", " ", "solo", "Yes.", "Yes.\nNo.", "\n\n", "Ünï çode Ähnlich KK"]
    for i in range(110):
        kind, own = i % 5, rng.choice(base)
        if kind == 0:
            texts.append(own)
        elif kind == 1:
            texts.append(edited(rng, own, 1))
        elif kind == 2:
            texts.append("\n".join([prose(rng, 8), edited(rng, rng.choice(lines), rng.randrange(4)), rng.choice(lines), "Yes."]))
        elif kind == 3:
            texts.append(f"{prose(rng, 4)} one two three FOUR five six seven eight nine ten eleven {prose(rng, 4)}" if i % 2 else f'{prose(rng, 3)} token="{"a1" * 5}" {"0a" * 14}\npassword : abc')
        else:
            texts.append(prose(rng, rng.randrange(1, 30)))
    rows = [(i if i % 37 else None, t, "en" if i % 3 else "de", f"s{min(i % 7, 3)}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + rows[20:24] + rows[:1]


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Eta1 eta2"), (3, None), (4, ""), (5, "solo"), (6, "one two three four five six seven eight nine ten")]


@pytest.fixture(scope="module")
def rows():
    return documents(random.Random(11))


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def folder(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], 1, int(i % 5 == 4)) for i, r in enumerate(rows) if r[0] is not None and i < 118]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.fixture
def hot(monkeypatch):
    """Keys of more than two rows are hot, groups of more than four are cut into blocks."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(mixing, "HOT_ROWS", 2)
    monkeypatch.setattr(sim, "GROUP_ROWS", 4)
    monkeypatch.setattr(linededup, "GROUP_ROWS", 4)


@pytest.fixture(params=["broadcast", "shuffle"])
def joins(request, monkeypatch, hot):
    """With small tables broadcast, and with every table too large for that."""
    if request.param == "shuffle":
        for module in (common, decontaminate, linededup, sim, mixing):
            monkeypatch.setattr(module, "small", lambda df, rows=0, parts=None: df)
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)


def counted(values):
    return Counter(map(repr, values))


def test_simhash_query(spark, folder, rows, joins):
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in sim.query(spark, folder).collect()]
    assert counted(found) == counted((d, *c[:2]) for (d, *_), c in zip(rows, components([r[:2] for r in rows])))


def test_simhash_stage(spark, folder, rows, docs, joins):
    kept = [(r.doc_id, r.text) for r in sim.stage(spark, docs, folder).collect()]
    of = components([r[:2] for r in rows])
    assert len(kept) == len({g for *_, g in of})
    least = {r[:2]: c for r, (_, c, _) in zip(rows, of)}
    assert all(d == least[d, t] for d, t in kept)


@pytest.mark.parametrize("least", [1, linededup.NEAR_CHARS])
def test_line_classes(spark, docs, rows, joins, least):
    found = linededup.dedup(docs, least=least).select("doc_id", "text", "rewritten").collect()
    classes = line_classes([r[:2] for r in rows], least, linededup.NEAR_CHARS, linededup.EDITS)
    kept = Counter()  # a class is kept in one document, or in rows of one doc_id
    class_of = {s: k for k, own in enumerate(classes) for s in own}
    for r in found:
        if r.text is None:
            assert r.rewritten.text is None and not r.rewritten.dropped
            continue
        lines, gone = r.text.split("\n"), set(r.rewritten.dropped)
        assert r.rewritten.text == "\n".join(s for i, s in enumerate(lines) if i not in gone)
        assert all(lines[i] in class_of for i in gone)
        stays = [lines[i] for i in range(len(lines)) if i not in gone and lines[i] in class_of]
        assert len(stays) == len(set(stays))
        kept.update({(class_of[s], s, r.doc_id) for s in stays})
    assert sorted({k for k, _, _ in kept}) == list(range(len(classes))) and len(kept) == len(classes)
    for k, _, doc_id in kept:
        assert doc_id == min((d for d, t, *_ in rows if set((t or "").split("\n")) & set(classes[k]) and d is not None), default=None)


def test_decontamination(spark, folder, rows, joins):
    found = [(r.doc_id, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.query(spark, folder).collect()]
    want = []
    for d, t, *_ in rows:
        at, ids = hits(t, ITEMS)
        want.append((d, len(at), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    assert counted(found) == counted(want)


def test_short_items_leave_long_ones_alone(spark, docs):
    """An item of one word adds fingerprints of its own length only."""
    body = docs.select("doc_id", common.text_hash().alias("th"), "text")
    n = lambda lengths: {r.n: r["count"] for r in decontaminate.fingerprints(body, lengths).groupBy("n").count().collect()}
    assert n((1, 10))[10] == n((10,))[10]


@pytest.mark.parametrize("most", [0, 1000])
def test_secret_spans(docs, rows, most):
    found = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.spans(docs, broadcast_rows=most).collect()]
    assert counted(found) == counted((d, spans(t, secrets.RULES)) for d, t, *_ in rows)
    assert any(s for _, s in found)


def test_mixing(spark, folder, rows, docs, joins):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    query = mixing.query(spark, folder).collect()
    assert counted((r.doc_id, r["size"]) for r in query) == counted((d, size(t)) for d, t, *_ in rows)
    budget = sum(r["size"] for r in query)
    assert sum(r.taken for r in query) <= budget and all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in query)
    stage = mixing.stage(spark, docs, folder).collect()
    assert counted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in stage) == counted(tuple(r) for r in query if r.taken)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    assert {r.source: r.source_size for r in stage} == {s: n for s, n in sizes.items() if n}
    targets = {r.source: r.target for r in stage}
    assert abs(sum(targets.values()) - budget) < 1e-6 and all(targets[s] <= 3 * sizes[s] for s in targets)
    taken = Counter()
    for r in stage:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 3 * max(size(t) for _, t, _, x, _ in rows if x == s) for s in targets)


def test_mixing_against_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(40)), "en", rng.choice(["a", "a", "a", "a", "b", "c", None]), 0) for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})").fetchall()
    assert counted(tuple(r) for r in mixing.query(spark, str(tmp_path)).collect()) == counted(want)


def test_next_documents(docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 8)
    df = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 30).otherwise(F.col("doc_id")))  # one doc_id fills several ranges
    of = [(r.doc_id, r.text or "", r.th) for r in df.withColumn("th", common.text_hash()).collect()]
    of.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2], r[1]))
    want = []
    for (d, x, _), (_, y, _) in zip(of, of[1:] + of[:1]):
        n = len(x) // 4
        changed = x[: len(x) - n] + y[:n]
        a, b, c = map(fingerprint.winnowed, (x, changed, y))
        want.append((d, len(x), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.shown(a), fingerprint.shown(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    assert counted(tuple(r) for r in fingerprint.with_next(df).collect()) == counted(want)


def auc(truth, score):
    order = np.argsort(score)
    rank = np.empty(len(score))
    for v in np.unique(score):
        at = np.flatnonzero(np.asarray(score)[order] == v)
        rank[order[at]] = at.mean() + 1
    n = truth.sum()
    return (rank[truth == 1].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def test_held_out_toxicity_and_language(spark):
    """Bounds that no constant answer meets."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in toxicity.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    truth, predicted = np.array([labels[r.doc_id] for r in found]), np.array([r.predicted for r in found])
    assert predicted[truth == 1].mean() > 0.8 and truth[predicted == 1].mean() > 0.8
    assert auc(truth, np.array([r.score for r in found])) > 0.93
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in language.query(spark, sf).collect() if r.held_out]
    for name in set(lang.values()):
        assert np.mean([r.lang_pred == name for r in found if lang[r.doc_id] == name]) > 0.97


def test_code_switched_words(spark):
    """Word labels follow the language within a text."""
    model = language.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    held = {r.lang: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400").where(common.crc_mod("doc_id", 3) == 1).collect()}
    text = held["en"][:300] + " " + held["de"][:300]
    (row,) = spark.createDataFrame([(text,)], "text string").select(language.word_tagger(model)("text").alias("runs")).collect()
    for lang, low, high in (("en", 0, 300), ("de", 300, len(text))):
        right = sum(max(0, min(r.end, high) - max(r.start, low)) for r in row.runs if r.lang == lang)
        assert right > 0.8 * (high - low)


def test_defined_rows(spark, folder, rows):
    """Null, empty, blank and wordless texts, and repeated rows."""
    scores = {(r.doc_id, r.score) for r in toxicity.query(spark, folder).collect()}
    none = {r[0] for r in rows if not (r[1] or "").strip()} - {None}
    assert len({s for d, s in scores if d in none}) == 1 and len([d for d, _ in scores if d is not None]) == len({r[0] for r in rows} - {None})
    langs = {r.doc_id: (r.lang_pred, r.score) for r in language.query(spark, folder).collect()}
    assert all(langs[d] == ("und", 0.0) for d in none)
    prints = {r.doc_id: r.fingerprint for r in sim.query(spark, folder).collect()}
    assert all(prints[d] == "0" * 16 and simhash(None) == 0 for d in none)
    assert all(r.taken == 0 for r in mixing.query(spark, folder).collect() if r.doc_id in none)


PAGES = [
    ("<p>The energy is <math>E=mc</math> as shown by the well known equation of the paper.</p>", "The energy is E=mc as shown by the well known equation of the paper."),
    ("<p>Short article.</p>", "Short article."),
    ("Plain text only, no markup at all.", "Plain text only, no markup at all."),
    ("<html><body><table><tr><td class=menu>Home News</td><td><p>The council met on Tuesday to discuss the new bridge across the river.</p><p>A vote is expected in June.</p></td></tr></table>", "The council met on Tuesday to discuss the new bridge across the river. A vote is expected in June."),
    ("<html><head><title>T</title><body><div><a href=1>Home</a> <a href=2>About</a></div><div><p>First paragraph of the story, which is long enough to read.</p><p>Second one.</p></div><div>Copyright 2020 The Site. All rights reserved.</div>", "First paragraph of the story, which is long enough to read. Second one."),
    ("<main><h1>Results</h1><table><tr><th>Year</th><th>Sales</th></tr><tr><td>1999</td><td>12</td></tr></table></main><footer>Imprint</footer>", "Results Year Sales 1999 12"),
    ("<div role=navigation><ul><li><a href=/>Start</a></li><li><a href=/b>Shop</a></li></ul></div><div role=main><p>Only one paragraph here, and nothing else to see.</p></div><div role=contentinfo>Terms of Use</div>", "Only one paragraph here, and nothing else to see."),
    ("<article><h1>Title</h1><p>Body text of the article goes here.</p><ul><li>one thing</li><li>another thing</li></ul></article><section class=comments><h3>Comments</h3><div class=comment><p>Great article!</p></div></section>", "Title Body text of the article goes here. one thing another thing"),
    ("<noscript>Please enable JavaScript to view this page.</noscript><div id=content><p>We went to the lake, and it was cold.</p></div>", "We went to the lake, and it was cold."),
    ("<div class=cookie-banner>We use cookies to improve your experience. <button>OK</button></div><article><p>The match ended in a draw after extra time, said the coach.</p></article>", "The match ended in a draw after extra time, said the coach."),
    ("<dl><dt>Term</dt><dd>The explanation of the term.</dd></dl>", "Term The explanation of the term."),
    ("<header><h1>The Journal</h1></header><nav><a href=1>Home</a> | <a href=2>World</a></nav><article><h2>Rain</h2><p>It rained for three days in the north of the country.</p><blockquote><p>We have never seen this, she said.</p></blockquote></article><aside><h3>Most read</h3><ul><li><a href=x>Snow in May</a></li></ul></aside><footer>&copy; 2021</footer>", "Rain It rained for three days in the north of the country. We have never seen this, she said."),
]


def test_unlike_pages(spark):
    found = html_extract.extract(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "page_id int, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: t for i, (_, t) in enumerate(PAGES)}
    assert [b.text for b in html_blocks.blocks("<head><title>x</title><p>kept<svg><text>A</text></svg> <iframe>old</iframe>")] == ["keptA", "old"]


CLASHES = "drop_id drop_th drop_at rewritten toxicity fp key n th at mix_id mix_th size taken target source_size bucket bucket_of copies_of size_of of_source own_source mix_bounds mix_docs n_docs hit_id candidate_id candidate_rules row_th again_id component_id DROP_TH a.b".split()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_clashing_names(spark, docs, folder, name, stage):
    """Extra columns of any name, the operators' own among them, pass through; the mix replaces its four."""
    extra = docs
    for c in CLASHES:
        if c.lower() not in {x.lower() for x in extra.columns}:
            extra = extra.withColumn(c, F.lit(7))
    plain, found = stage(spark, docs, folder), stage(spark, extra, folder)
    own = {"size", "taken", "target", "source_size"} if name == "source_mixing" else set()
    assert set(found.columns) == set(extra.columns) | own
    passed = [c for c in found.columns if c not in {*docs.columns, *own}]
    assert all(all(r[c] == 7 for c in passed) for r in found.collect())
    assert counted((r.doc_id, r.text) for r in found.collect()) == counted((r.doc_id, r.text) for r in plain.collect())


def test_clashing_names_elsewhere(docs, spark):
    extra = docs.withColumns({"candidate_id": F.lit(7), "candidate_rules": F.lit(7), "spans": F.lit(7)})
    assert secrets.spans(extra).where("candidate_id = 7 and candidate_rules = 7 and size(spans) > 0").count() > 0
    pages = spark.createDataFrame([("http://a.net/x", 7, 7, 7)], "url string, judged_url int, judged_terms int, Host int")
    (row,) = urls.judge(pages).collect()
    assert (row.judged_url, row.judged_terms, row.host, row.verdict) == (7, 7, "a.net", "block")


def test_url_vocabulary(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("strict\tKaboom\nsoft\tfoo\nsoft\tbar\nother\tx\n")
    strict, soft = urls.read_terms(spark, str(tmp_path / "terms.txt"))
    assert (strict, soft) == (("kaboom",), ("bar", "foo"))
    pages = spark.createDataFrame([("http://a.com/kaboom",), ("http://a.com/foo-foo",), ("http://a.com/foo-bar",), ("http://a.com/xkaboom",)], "url string")
    assert [r.verdict for r in urls.judge(pages, strict=strict, soft=soft).collect()] == ["block", "allow", "block", "allow"]


def test_pipeline_against_plain_stages(spark, folder, rows):
    """run() equals the plain version of every stage applied in turn."""
    toxic = {(r.doc_id): r.predicted for r in toxicity.query(spark, folder).collect() if r.doc_id is not None}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        after = [tuple(r) for r in docs.collect()]
        if name == "toxicity":
            assert counted(r for r in after if r[0] is not None) == counted(r for r in before if r[0] is not None and not toxic[r[0]])
        elif name == "line_dedup":
            assert len(after) == len(before) and all((t is None and n is None) or n == len(t) for _, t, _, _, n in after)
            classes = line_classes([r[:2] for r in before], linededup.NEAR_CHARS, linededup.NEAR_CHARS, linededup.EDITS)
            lines = Counter(s for _, t, *_ in {r[:2] for r in after} for s in (t or "").split("\n"))
            assert all(sum(lines[s] for s in own) == 1 for own in classes)
        elif name == "simhash_near_dedup":
            assert len(after) == len({g for *_, g in components([r[:2] for r in before])})
        else:
            assert counted(after) == counted(r for r in before if not hits(r[1], ITEMS)[0])
    want = mixing.stage(spark, docs, folder)
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == want.columns and counted(tuple(r) for r in found.collect()) == counted(tuple(r) for r in want.collect())
