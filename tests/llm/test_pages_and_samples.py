"""Pages by hand of unlike sites, names that say nothing, the recurrent labeller against a plain one, and what is learned from."""

import math
import random
import zlib

import numpy as np
import pytest

from loomline.llm import fingerprint, html_extract, language, toxicity

PARAS = [
    "The river rose for three days before the bridge was closed to traffic.", "Nobody in the village remembered a flood of this kind.", "Engineers measured the water every hour and wrote the figures down.",
    "On Tuesday morning the level fell by two centimetres.", "The school will open again next week, the mayor said.",
]
P = "".join(f"<p>{x}</p>" for x in PARAS)
ALL = " ".join(PARAS)
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/a>About us</a></li></ul></nav>"
FOOT = "<footer><p>© 2024 The Valley News</p><p>All rights reserved.</p></footer>"
HAND = {
    "german ids": (f"<div id=kopf><a href=/>Startseite</a></div><div id=inhalt><h1>Hochwasser</h1>{P}</div><div id=fuss><p>Impressum Datenschutz</p></div>", f"Hochwasser {ALL}"),
    "french ids": (f"<div id=entete><p>Le Journal</p></div><div id=contenu><h1>Crue</h1>{P}</div><div id=pied><p>Mentions légales</p></div>", f"Crue {ALL}"),
    "spanish ids": (f"<div id=cabecera><p>Inicio</p></div><div id=contenido><h1>Crecida</h1>{P}</div><div id=pie><p>Aviso legal</p></div>", f"Crecida {ALL}"),
    "reading list": (f"{NAV}<main><h1>Floods</h1>{P}<h2>Further reading</h2><ul><li><a href=/1>A history of the valley floods</a></li><li><a href=/2>How bridges are measured</a></li><li><a href=/3>The mayor of the valley</a></li></ul></main>{FOOT}", f"Floods {ALL} Further reading A history of the valley floods How bridges are measured The mayor of the valley"),
    "prices": (f"{NAV}<article><h1>Market day</h1>{P}<table><tr><th>Dish</th><th>Price</th></tr><tr><td>Soup</td><td>4.50</td></tr><tr><td>Fish</td><td>11.00</td></tr></table></article>{FOOT}", f"Market day {ALL} Dish Price Soup 4.50 Fish 11.00"),
    "main only": (f"<header><a href=/>The Valley</a></header><main>{P}</main>", ALL),
    "bare paragraphs": (P, ALL),
    "div of divs": (f"{NAV}<div><div><h1>Floods</h1></div><div>{P}</div></div>{FOOT}", f"Floods {ALL}"),
    "sidebar": (f"{NAV}<div class=wrapper><div class=content><h1>Floods</h1>{P}</div><div class=sidebar><h3>Related articles</h3><ul><li><a href=/x>Rain</a></li><li><a href=/y>Snow</a></li></ul></div></div>{FOOT}", f"Floods {ALL}"),
    "comments": (f"{NAV}<article><h1>Floods</h1>{P}</article><section class=comments><h3>Comments</h3><div class=comment><p>I was there and it was bad.</p></div><div class=comment><p>Great article!</p></div></section>{FOOT}", f"Floods {ALL}"),
    "cookie bar": (f"<div class=cookie-banner><p>We use cookies to improve this site.</p><button>Accept all</button></div>{NAV}<article><h1>Floods</h1>{P}</article>{FOOT}", f"Floods {ALL}"),
    "advert inside": (f"<article><h1>Floods</h1><p>{PARAS[0]}</p><p>{PARAS[1]}</p><div class=ad>Sponsored Buy now and save 50%</div><p>{PARAS[2]}</p><p>{PARAS[3]}</p><p>{PARAS[4]}</p></article>", f"Floods {ALL}"),
    "framework names": (f"{NAV}<div class='css-1x2y3z'><div class='sc-abcdef kjQwer'><h1>Floods</h1>{P}</div></div>{FOOT}", f"Floods {ALL}"),
    "camel names": (f"<div id=siteHeader><p>Daily News</p></div><div id=articleBody><h1>Floods</h1>{P}</div><div id=siteFooter><p>Contact us</p></div>", f"Floods {ALL}"),
    "quote": (f"{NAV}<article><h1>Floods</h1><p>{PARAS[0]}</p><blockquote><p>{PARAS[1]}</p></blockquote><p>{PARAS[2]}</p></article>{FOOT}", f"Floods {PARAS[0]} {PARAS[1]} {PARAS[2]}"),
    "code": (f"{NAV}<article><h1>Sorting</h1><p>{PARAS[0]}</p><pre>sorted(rows, key=len)</pre><p>{PARAS[1]}</p></article>{FOOT}", f"Sorting {PARAS[0]} sorted(rows, key=len) {PARAS[1]}"),
    "steps": (f"{NAV}<article><h1>Bread</h1><p>{PARAS[0]}</p><ol><li>Mix flour and water.</li><li>Let it rest for an hour.</li><li>Bake it until brown.</li></ol><p>{PARAS[1]}</p></article>{FOOT}", f"Bread {PARAS[0]} Mix flour and water. Let it rest for an hour. Bake it until brown. {PARAS[1]}"),
    "newsletter box": (f"{NAV}<article><h1>Floods</h1>{P}</article><div class=newsletter><form><label>Email address</label><input><button>Sign up</button></form></div>{FOOT}", f"Floods {ALL}"),
    "share bar": (f"{NAV}<article><h1>Floods</h1><div class=share><a href=/t>Tweet</a> <a href=/f>Share on Facebook</a></div>{P}</article>{FOOT}", f"Floods {ALL}"),
    "noscript": (f"<noscript>Please enable JavaScript to view this page.</noscript>{NAV}<main><h1>Floods</h1>{P}</main>{FOOT}", f"Floods {ALL}"),
    "one paragraph": (f"{NAV}<article><h1>Short</h1><p>{PARAS[0]}</p></article>{FOOT}", f"Short {PARAS[0]}"),
    "layout table": (f"<table><tr><td><a href=/>Home</a><a href=/n>News</a></td><td><h1>Floods</h1>{P}</td></tr></table>", f"Floods {ALL}"),
    "figure": (f"{NAV}<article><h1>Floods</h1><p>{PARAS[0]}</p><figure><img src=x><figcaption>The bridge on Monday evening.</figcaption></figure><p>{PARAS[1]}</p></article>{FOOT}", f"Floods {PARAS[0]} The bridge on Monday evening. {PARAS[1]}"),
    "subheads": (f"{NAV}<div class=post><h1>Floods</h1><p>{PARAS[0]}</p><h2>What happened</h2><p>{PARAS[1]}</p><h2>What comes next</h2><p>{PARAS[4]}</p></div>{FOOT}", f"Floods {PARAS[0]} What happened {PARAS[1]} What comes next {PARAS[4]}"),
    "inline links": (f"{NAV}<article><h1>Floods</h1><p>The <a href=/r>river</a> rose for <b>three days</b> before the bridge was closed.</p><p>{PARAS[1]}</p></article>{FOOT}", f"Floods The river rose for three days before the bridge was closed. {PARAS[1]}"),
    "breadcrumbs": (f"<div class=breadcrumb><a href=/>Home</a> | <a href=/n>News</a></div><article><h1>Floods</h1>{P}</article>{FOOT}", f"Floods {ALL}"),
    "open paragraphs": (f"{NAV}<article><h1>Floods</h1><p>{PARAS[0]}<p>{PARAS[1]}<p>{PARAS[2]}</article>{FOOT}", f"Floods {PARAS[0]} {PARAS[1]} {PARAS[2]}"),
    "section names": (f"<section class=hero><h2>Daily News</h2></section><section class=story><h1>Floods</h1>{P}</section><section class=related><h3>Most read</h3><p><a href=/x>Rain in May</a></p></section>{FOOT}", f"Floods {ALL}"),
    "roles": (f"<div role=banner><p>The Journal</p></div><div role=navigation><a href=/>Home</a> <a href=/n>News</a></div><div role=main><h1>Floods</h1>{P}</div><div role=contentinfo><p>Privacy Policy</p></div>", f"Floods {ALL}"),
    "chinese names": (f"<div class=头部><a href=/>Home</a></div><div class=正文><h1>Floods</h1>{P}</div><div class=footer><p>Copyright</p></div>", f"Floods {ALL}"),
    "definition list": (f"{NAV}<article><h1>Terms</h1><p>{PARAS[0]}</p><dl><dt>Flood</dt><dd>Water where it should not be.</dd><dt>Bridge</dt><dd>A way over water.</dd></dl></article>{FOOT}", f"Terms {PARAS[0]} Flood Water where it should not be. Bridge A way over water."),
    "hidden": (f"{NAV}<div style='display:none'><p>Nothing to see in this box.</p></div><article><h1>Floods</h1>{P}</article>{FOOT}", f"Floods {ALL}"),
}


def extracted(spark, pages):
    found = html_extract.extract(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_pages_by_hand(spark):
    found = extracted(spark, [f"<html><body>{html}</body></html>" for html, _ in HAND.values()])
    assert {n: t for n, t in zip(HAND, found) if t != HAND[n][1]} == {}


@pytest.mark.parametrize("kind", ["class", "id"])
def test_unknown_names_say_nothing(spark, kind):
    rng = random.Random(7)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300)]
    pages = [f"{NAV}<div {kind}={n}><h1>Floods</h1>{P}</div>{FOOT}" for n in names] + [f"<div {kind}={n}>{P}</div>" for n in names]
    found = extracted(spark, pages)
    assert found[:300] == [f"Floods {ALL}"] * 300 and found[300:] == [ALL] * 300


def test_lstm_against_a_plain_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 3, 4)).astype(np.float32)
    mask = (np.arange(5)[:, None] < np.array([5, 2, 4])).astype(np.float32)
    wx, wh, b = (rng.normal(size=s).astype(np.float32) for s in ((4, 24), (6, 24), (24,)))
    found = html_extract.lstm(x, mask, wx, wh, b)
    s = lambda z: 1 / (1 + math.exp(-z))
    for j, n in enumerate((5, 2, 4)):
        h, c = [0.0] * 6, [0.0] * 6
        for t in range(n):
            z = [sum(float(x[t, j, i]) * float(wx[i, k]) for i in range(4)) + sum(h[i] * float(wh[i, k]) for i in range(6)) + float(b[k]) for k in range(24)]
            c = [s(z[6 + i]) * c[i] + s(z[i]) * math.tanh(z[18 + i]) for i in range(6)]
            h = [s(z[12 + i]) * math.tanh(c[i]) for i in range(6)]
            assert np.allclose(found[t, j], h, atol=1e-5)


def test_a_repeated_document_is_learned_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda texts, langs: seen.append(list(zip(texts, langs))))
    a, b, *_ = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(a, "der alte Mann", "de")] * 10_000 + [(a, "ein anderer Text", "de"), (a, "der alte Mann", "aa"), (b, "the old man", "en"), (None, "x", "en")]
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(seen[0]) == [("der alte Mann", "aa"), ("ein anderer Text", "de"), ("the old man", "en")]


def test_labels_of_both_kinds_are_chosen_alike(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, share: seen.append(sorted(zip(texts, toxic.tolist()))))
    ids = [i for i in range(40) if i not in (1, 2)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], "another")] * 500, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)] + [(i, 0) for i in range(40)]
    for order in (labels, labels[::-1]):
        toxicity.train(docs, spark.createDataFrame(order, "doc_id long, toxic int"))
    assert seen[0] == seen[1] and len({t for t, _ in seen[0]}) == len(seen[0]) and all(y == int(t.split()[-1]) % 2 for t, y in seen[0] if t.startswith("text"))


def test_short_texts_keep_several_grams():
    rng = random.Random(3)
    for n in range(18, 400):
        text, after = ("".join(rng.choices("abcdefgh ", k=n)) for _ in range(2))
        own, changed = fingerprint.winnowed(text), fingerprint.winnowed(fingerprint.edited(text, after))
        assert fingerprint.likeness(own, changed) > 0, n
        assert fingerprint.likeness(own, fingerprint.winnowed(text)) == 1
