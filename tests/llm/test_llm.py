"""The ten operators on small tables: odd cases, and brute-force versions of those beyond SQL."""

import hashlib
import random
from itertools import pairwise

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from loomline.llm import crf, decontaminate, fingerprint, html_blocks, html_extract, linededup, mixing, queries, secrets, simhash, urls, winnow

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, empties, a long text, copies, near copies and repeated rows."""
    rng, top = random.Random(5), tmp_path_factory.mktemp("tables")
    base = prose(rng, 400)
    line = "this very line of more than twenty-four characters repeats"
    item = "one two three four five six seven eight nine ten eleven twelve"
    texts = [base, base, base.replace("alpha", "alpha1", 1), None, "", " ", "solo", f"{prose(rng, 30)}\n{line}\n{line}", f"{line}\n{prose(rng, 20)}", f"{line[:-1]}z\n{prose(rng, 20)}", prose(rng, 60_000)]
    texts += [f"{prose(rng, 5)} {item.upper()} {prose(rng, 5)}", 'token: "abcdef123" AKIA' + "A" * 20 + " 0123456789abcdef01234567 ghp_" + "a1" * 18, "password=x secret=ok1 é token=é"]
    texts += [prose(rng, 40) + (" vilest vilest" if i % 3 == 0 else "") for i in range(60)]
    rows = [(i, t, "en" if i % 2 else "de", None if i == 4 else f"s{i % 3}", 0, "x") for i, t in enumerate(texts)]
    rows += [rows[0], (None, "a null id", None, None, None, None), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, item), (2, item), (3, "lonely words here"), (4, None), (5, "")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 14 and (i - 14) % 3 == 0)) for i in range(74)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    pages = [(1, "http://a.Example.net/en/x", "<nav><a href=x>Home</a></nav><article><h1>T &amp; x</h1><p>One <b>two</b><br>three.<p>Four five six seven eight.</article><footer>f</footer>"), (2, None, None), (3, "no scheme casino", ""), (4, "https://x.org?ads=1&click=2", "plain"), (5, "http://example.com/de/", "<p>x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    for name, schema in (("documents", DOCS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{top}/empty/{name}.parquet")
    return str(top)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, folder, name):
    n = {"op8_html_extraction": 5, "op9_url_filter": 5}.get(name, 77)
    assert queries.QUERIES[name](spark, folder).count() == n
    assert queries.QUERIES[name](spark, f"{folder}/empty").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    own = sorted(map(repr, (tuple(r) for r in df.select(columns).collect())))
    assert own == sorted(map(repr, db.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()))


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 8)  # hot keys are cut into blocks
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(150)}
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df), "a", "b").collect()}
    group = list(range(len(fps)))

    def find(i):
        return i if group[i] == i else find(group[i])

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            group[find(i)] = find(int(j))
    own = [roots.get(int(f), int(f)) for f in fps.view(np.int64)]
    assert all((find(i) == find(j)) == (own[i] == own[j]) for i in range(len(fps)) for j in range(i))


def test_winnow_guarantee():
    r = np.random.default_rng(0)
    for k, w in ((5, 6), (1, 1), (3, 8), (16, 64)):
        x = r.integers(0, 9, 400).astype(np.uint64)
        h = winnow.gram_hashes(x, k)
        brute = {max(range(i, i + w), key=lambda j: (-int(h[j] >> np.uint64(32)), j)) for i in range(len(h) - w + 1)}
        assert sorted(brute) == winnow.select(h, w).tolist()
        span = x[100 : 100 + w + k - 1]
        assert set(winnow.gram_hashes(span, k)[winnow.select(winnow.gram_hashes(span, k), w)].tolist()) & set(h[winnow.select(h, w)].tolist())


def test_edit_distance():
    r = random.Random(2)
    for _ in range(3000):
        a = "".join(r.choices("abc", k=r.choice((4, 24, 63, 66, 120))))
        b = list(a)
        for _ in range(r.randrange(5)):
            p = r.randrange(len(b))
            b[p : p + r.randrange(2)] = r.choice(("", "a", "z"))
        a, b = sorted((a, "".join(b)), key=len)
        for limit in (1, 2, 3):
            assert linededup.edit_distance_within(a, b, limit) == (linededup.distance(a, b) <= limit)
            if len(b) >= 24 and linededup.distance(a, b) <= limit:
                own, both = linededup.line_keys(a, limit)[0], sum(linededup.line_keys(b, limit), [])
                assert set(own) & set(both)


def test_line_dedup_keeps_first(spark, folder):
    found = {r.doc_id: r for r in linededup.query(spark, folder).collect() if r.doc_id is not None}
    assert found[7].dropped == "2" and found[8].dropped == "0" and found[9].dropped == "0"
    assert found[1].n_dropped == 1 and found[0].n_dropped == 0 and found[3].n_lines == 0


def test_crf_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    chain = crf.Chain(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = np.array([3, 1, 4])
    scores = rng.normal(size=(8, 2))
    found, at = crf.forward_backward(scores, lengths, chain), 0
    for n in lengths:
        total, sums = 0.0, np.zeros((n, 2))
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            p = np.exp(chain.start[y[0]] + sum(scores[at + i, y[i]] for i in range(n)) + sum(chain.transitions[a, b] for a, b in pairwise(y)))
            total += p
            sums[range(n), y] += p
        assert np.allclose(found[at : at + n], sums / total)
        at += n


def test_chunked_messages():
    """Long sequences are cut into chunks, whose marginals are those of the whole."""
    rng = np.random.default_rng(1)
    chain = crf.Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([3, 1, 40, 17, 100, 8, 64])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    for chunk in (1, 2, 7, 8, 16, 64):
        assert np.allclose(crf.forward_backward(scores, lengths, chain, chunk=1000), crf.forward_backward(scores, lengths, chain, chunk=chunk))


def test_features_are_all_grams():
    slots, owners = crf.Features((1, 2), (1,), (2, 3)).of(["Abc", "x", "abcdefghijkl"])
    assert np.bincount(owners).tolist() == [1 + 2 + 1 + 2 + 1, 1 + 1 + 1, 1 + 2 + 1 + 11 + 10]
    again, of = crf.Features((1, 2), (1,), (2, 3)).of(["zz", "abcdefghijkl"])
    assert sorted(again[of == 1]) == sorted(slots[owners == 2])


def test_ring_filter():
    rng = random.Random(0)
    flips = lambda n: sum(1 << b for b in rng.sample(range(64), n))
    assert simhash.ring_near(np.array([0] + [flips(rng.randrange(1, 4)) for _ in range(3000)], np.uint64)).all()
    assert not simhash.ring_near(np.array([flips(rng.randrange(4, 9)) for _ in range(3000)], np.uint64)).any()


def test_fingerprint_pairs(spark, folder):
    found = {r.doc_id: r for r in fingerprint.query(spark, folder).collect() if r.doc_id is not None}
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    for a, b in list(pairwise(docs))[1:]:
        x, y = a.text or "", b.text or ""
        n = len(x) // 4
        assert found[a.doc_id].edited_sha256 == hashlib.sha256((x[: len(x) - n] + y[:n]).encode()).hexdigest()
    assert found[0].fingerprint == found[1].fingerprint and found[3].fingerprint == ""


def test_html(spark, folder):
    found = {r.page_id: r.text for r in html_extract.query(spark, folder).collect()}
    assert found[1] == "T & x One two three. Four five six seven eight." and found[2] == ""
    assert [b.text for b in html_blocks.blocks('<p>a<script>x="</p>"</script>b<div>c&nbsp; d</div>')] == ["ab", "c d"]


def test_url_verdicts(spark, folder):
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.query(spark, folder).collect()}
    assert found[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and found[2] == ("", "", None, "allow")
    assert found[3][3] == "block" and found[4] == ("x.org", "", None, "block") and found[5][2:] == ("example.com/de/", "block")


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]


def test_mixing_targets(spark, folder):
    rows = mixing.query(spark, folder).collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    assert sum(r.taken for r in rows) <= sum(r.size for r in rows)


def test_decontamination_shuffle_path(spark, folder, monkeypatch):
    before = sorted(map(repr, decontaminate.query(spark, folder).collect()))
    for module in (decontaminate, linededup, simhash, mixing):
        monkeypatch.setattr(module, "small", lambda df, rows=0, parts=None: df)
    assert before == sorted(map(repr, decontaminate.query(spark, folder).collect()))


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert corpus_pipeline.run(spark, folder).where("taken > 3 * size").count() == 0
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0
