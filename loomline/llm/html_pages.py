"""Made-up labelled pages to train the block labeller.

Layouts are unlike on purpose: semantic elements, named boxes, boxes without names,
tables as layout, roles, bare paragraphs, and pages of a single paragraph. Most words
are random letters, so that the labeller goes by structure and by the fixed wording of
page furniture; names are left out or replaced by chance words now and then.
"""

import random
from collections.abc import Callable

#: Fixed word lists of page furniture: class or id words, and phrases, by role.
NAMES = {
    "nav": "nav menu navbar navigation topnav mainmenu breadcrumb breadcrumbs tabs pager pagination skip toc links menubar submenu menue navi navegacion enlaces liens".split(),
    "header": "header masthead banner top site branding logo topbar head hero kopf kopfzeile entete cabecera encabezado".split(),
    "footer": "footer bottom colophon copyright legal foot credits imprint fuss fusszeile impressum pied pie".split(),
    "side": "sidebar aside side widget rail related recommended popular trending archive tags more secondary right seitenleiste rand lateral barra cote".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo adbox dfp teaser partner outbrain werbung anzeige anzeigen publicite publicidad anuncio".split(),
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay paywall newsletter message toast disclaimer hinweis avis aviso".split(),
    "form": "form search login signup subscribe newsletter contact register searchbox suche anmeldung recherche buscar".split(),
    "comments": "comments comment disqus replies discussion responses reply commentlist feedback thread kommentare kommentar commentaires comentarios".split(),
    "share": "share social sharing follow sharebar tools meta print teilen partager compartir".split(),
    "main": "content article post entry story body main text articlebody entrycontent prose copy read inhalt artikel beitrag haupt contenu texte contenido articulo texto".split(),
    "wrap": "wrapper container page wrap row col outer inner site layout grid box section".split(),
}
PHRASES = {
    "nav": "Home|About|About us|Contact|News|Sports|Next|Previous|Start|Kontakt|Accueil|Inicio|Blog|Shop|Help|Archive|Products|Services|Careers|Startseite|Home News|Skip to content|Back to top".split("|"),
    "header": "Daily News|Welcome|The Journal|Weather|Sign in|Log in|Menu|Your source for everything|Subscribe|Edition".split("|"),
    "footer": "© 2024|All rights reserved.|Privacy Policy|Terms of Use|Imprint|Impressum|Datenschutz|Mentions légales|Aviso legal|Contact us|©|·|Copyright|Powered by|Terms and conditions apply.".split("|"),
    "side": "Related articles|Most read|Popular posts|Recent posts|Tags|Archives|You may also like|Read more|Categories|Latest".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Special offer|Save 50%|Click here|Limited time|Anzeige|Publicité|Publicidad|Sponsored content".split("|"),
    "notice": "We use cookies|Accept all|This site uses cookies.|Subscribe to continue reading|Update your browser|Please enable JavaScript to view this page.|By continuing you agree to our use of cookies.|Wir verwenden Cookies|Your browser does not support frames.".split("|"),
    "form": "Search|Email address|Password|Name|Submit|Sign up|Log in|Send|Your name|Suche|Rechercher|Buscar".split("|"),
    "comments": "Comments|Reply|Leave a comment|3 replies|said:|Posted by|Report|Like|Great article!|I agree|I disagree|Thanks for sharing|Kommentare|Commentaires".split("|"),
    "share": "Share|Tweet|Print|Email|Share on Facebook|Follow us|Copy link|Partager|Teilen".split("|"),
}
#: Words of names that say something; a labeller should take any other name for none.
KNOWN = frozenset(w for words in NAMES.values() for w in words) | {"hidden", "navigation", "contentinfo", "complementary", "dialog"}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "form": "search", "notice": "dialog", "main": "main"}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "notice": "dialog", "ad": "aside", "comments": "section", "share": "div", "main": "article"}
#: Common short words of several languages.
COMMON = "the of and to in is that for it as was with on by be at this der die und den von zu das mit le la les et des en du un une que el los y las con por il di che non per".split()
#: Words that may say something of a block: those of the phrases above, and the common ones.
TOLD = frozenset(w for phrases in PHRASES.values() for p in phrases for w in p.lower().split()) | frozenset(COMMON)
LETTERS = "eeeeaaaiiioounnnssstttrrrlllddmmccpphhgbvfkywjxqzéüöñçàß"


class Writer:
    """One page: its HTML and, for each block of text it writes, whether that block is article text."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.truth, self.told, self.sure = rng, [], [], False, False
        self.letters = "".join(rng.sample(LETTERS, 25))
        self.named = rng.choice((1.0, 0.9, 0.6, 0.0, 0.0))

    def word(self) -> str:
        r = self.rng
        if r.random() < 0.35:
            return r.choice(COMMON)
        w = "".join(r.choices(self.letters, k=r.choice((2, 3, 4, 5, 6, 7, 8, 9, 12))))
        x = r.random()
        return w if x > 0.12 else str(r.randrange(3000)) if x < 0.03 else w + r.choice((",", ",", ",", ";", ":", " –", "!", '"', "*", "#", ")", "..."))

    def words(self, least: int, most: int) -> str:
        text = " ".join(self.word() for _ in range(self.rng.randint(least, most)))
        return text[:1].upper() + text[1:] + self.rng.choice((".", ".", ".", ".", "", "!", "?", ":"))

    def marked(self, text: str) -> str:
        """Inline markup around some words, as articles have it."""
        r = self.rng
        if r.random() < 0.25 and " " in text:
            a, b = text.split(" ", 1)
            start, end = r.choice((("<b>", "</b>"), ("<em>", "</em>"), ('<a href="/x">', "</a>"), ("<span>", "</span>"), ("<b>", ""), ("<math><mi>", "</mi></math>"), ("<code>", "</code>"), ("<svg><text>", "</text></svg>"), ("<sup>", "</sup>")))
            text = f"{a} {start}{b}{end}" if r.random() < 0.3 else f"{start}{a}{end} {b}"
        return text.replace(" ", "<br>", 1) if r.random() < 0.05 else text

    def put(self, tag: str, text: str, main: bool, attributes: str = "") -> None:
        open_end = tag in ("p", "li", "td", "dd", "dt") and self.rng.random() < 0.08
        self.html.append(f"<{tag}{attributes}>{text}" + ("" if open_end else f"</{tag}>"))
        self.truth.append(main)

    def link(self, text: str, main: bool = False) -> str:
        self.truth.append(main)
        return f'<a href="/{self.rng.randrange(99)}">{text}</a>'

    def name(self, role: str) -> str:
        r = self.rng
        if r.random() > self.named:
            return ""
        if role in ROLES and r.random() < 0.15:
            return f' role="{ROLES[role]}"'
        own = [r.choice(NAMES[role]) for _ in range(r.choice((1, 1, 1, 2)))]
        if r.random() < 0.3:
            own.append("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)))
        value = r.choice((" ", " ", "-", "_")).join(own)
        return f' {r.choice(("class", "class", "id"))}={r.choice((chr(34) + value + chr(34), chr(39) + value + chr(39)))}'

    def box(self, role: str, fill: Callable[[], None], tag: str | None = None) -> None:
        """An element of a role around what fill writes; semantic or a plain box."""
        r = self.rng
        tag, name = tag or (TAGS[role] if r.random() < 0.4 else r.choice(("div", "div", "div", "section"))), self.name(role)
        self.html.append(f"<{tag}{name}>")
        # furniture in a plain box without a name must say what it is, or it is no furniture
        before, self.told = self.told, self.told or (not name and tag in ("div", "section", "td", "li"))
        fill()
        self.told = before
        self.html.append(f"</{tag}>")

    # page furniture

    def links(self, role: str) -> None:
        r = self.rng
        texts = [r.choice(PHRASES[role]) if r.random() < 0.6 else self.words(1, 3).rstrip(".!?:") for _ in range(r.randint(2, 9))]
        kind = r.random()
        if kind < 0.6:
            self.html.append("<ul>" + "".join(f"<li>{self.link(t)}</li>" for t in texts) + "</ul>")
        elif kind < 0.8:
            self.html.append(r.choice((" ", " | ", " &middot; ", "&nbsp;")).join(f'<a href="/{i}">{t}</a>' for i, t in enumerate(texts)))
            self.truth.append(False)
        else:
            self.html.append("".join(f"<div>{self.link(t)}</div>" for t in texts))

    def prose(self, role: str, least: int, most: int) -> None:
        r = self.rng
        own = self.words(least, most)
        if self.told or r.random() < 0.5:
            own = r.choice(PHRASES[role]) + " " + own
        self.put(r.choice(("p", "p", "div")), own, False)

    def furniture(self, role: str) -> None:
        r = self.rng

        def fill() -> None:
            if role in ("nav", "share"):
                self.links(role)
            elif role == "form":
                for _ in range(r.randint(1, 3)):
                    self.put(r.choice(("label", "div", "p")) if r.random() < 0.5 else "div", r.choice(PHRASES["form"]), False)
                    self.html.append("<input><div><button>Go</button></div><hr>")
            elif role == "comments":
                self.put(r.choice(("h3", "h4", "div")), r.choice(PHRASES["comments"]), False)
                for _ in range(r.randint(1, 5)):
                    self.box("comments", lambda: (self.put("p", self.words(1, 60), False), r.random() < 0.4 and self.put("div", r.choice(PHRASES["comments"]), False)), r.choice(("li", "div", "article")))
            elif role == "footer":
                if r.random() < 0.4:
                    self.links("footer")
                for _ in range(r.randint(1, 3)):
                    self.put(r.choice(("p", "div", "small")) if r.random() < 0.7 else "div", r.choice(PHRASES["footer"]) + r.choice(("", " " + self.words(1, 12))), False)
                    self.html.append("<hr>")
            elif role == "header":
                self.put(r.choice(("div", "h2", "h1", "p")), r.choice(PHRASES["header"]) if r.random() < 0.6 else self.words(1, 4), False)
                if r.random() < 0.4:
                    self.prose("header", 2, 10)
            else:
                if r.random() < 0.5:
                    self.put(r.choice(("h2", "h3", "h4", "div")), r.choice(PHRASES[role]), False)
                    self.told = False
                if role == "side" and r.random() < 0.6:
                    self.links(role)
                else:
                    for _ in range(r.randint(1, 3)):
                        self.prose(role, 1, 40)

        if role in ("ad", "notice", "footer", "header") and r.random() < 0.35:
            # a single run of text straight in the box; a box without a name says what it is
            tag, name = (TAGS[role], self.name(role)) if r.random() < 0.3 else (r.choice(("div", "div", "p", "section", "ins")), self.name(role))
            own = r.choice(PHRASES[role]) + " " + self.words(1, 20)
            if name and r.random() < 0.6:
                own = self.words(1, 45)
            self.put(tag if tag != "ins" else "div", own, False, name)
        elif role == "notice" and r.random() < 0.25:
            tag = r.choice(("noscript", "template", "iframe"))
            self.put(tag, r.choice(PHRASES["notice"]), False)
        else:
            self.box(role, fill)

    # article text

    def part(self) -> None:
        """One piece of an article."""
        r = self.rng
        kind = r.random()
        if self.sure and r.random() < 0.04:
            # the wording of page furniture inside an article is the article's
            self.put("p", r.choice(PHRASES[r.choice(("footer", "footer", "header", "side", "form", "nav"))]), True)
        elif kind < 0.06:
            self.put(r.choice(("h2", "h3", "h4")), self.words(1, 8), True)
        elif kind < 0.16:
            tag = r.choice(("ul", "ol"))
            self.html.append(f"<{tag}>")
            for _ in range(r.randint(2, 6)):
                self.put("li", self.marked(self.words(1, r.choice((3, 20)))), True)
            self.html.append(f"</{tag}>")
        elif kind < 0.19:
            self.html.append("<blockquote>")
            self.put("p", self.words(4, 40), True)
            self.html.append("</blockquote>")
        elif kind < 0.21:
            self.put("pre", self.words(4, 20), True)
        elif kind < 0.23:
            # a reading list
            tag = r.choice(("ul", "ol"))
            self.html.append(f"<{tag}>")
            for _ in range(r.randint(2, 6)):
                own = self.link(self.words(1, 9).rstrip(".!?:"), True)
                self.html.append(f"<li>{own}{r.choice(('', '', ' ' + self.words(1, 8)))}</li>")
            self.html.append(f"</{tag}>")
        elif kind < 0.26:
            self.html.append("<table>")
            for row in range(r.randint(1, 4)):
                self.html.append("<tr>")
                for _ in range(r.randint(2, 4)):
                    own = self.words(1, 6) if r.random() < 0.6 else r.choice((str(r.randrange(5000)), f"{r.randrange(900)}.{r.randrange(10, 99)}", f"{r.randrange(100)} %", self.word()))
                    self.put("th" if not row and r.random() < 0.5 else "td", own, True)
                self.html.append("</tr>")
            self.html.append("</table>")
        elif kind < 0.29:
            self.html.append("<dl>")
            for _ in range(r.randint(1, 4)):
                self.put("dt", self.words(1, 3), True)
                self.put("dd", self.words(2, 20), True)
            self.html.append("</dl>")
        elif kind < 0.32:
            self.html.append("<figure><img src=x>")
            self.put("figcaption", self.words(2, 15), True)
            self.html.append("</figure>")
        elif kind < 0.36:
            self.put("div", self.marked(self.words(5, 60)), True)
        else:
            self.put("p", self.marked(self.words(*r.choice(((1, 4), (3, 12), (5, 30), (5, 90), (20, 90))))), True)

    def article(self, n: int, title: bool, inside: float = 0.0) -> None:
        r = self.rng
        if title:
            self.put(r.choice(("h1", "h1", "h1", "h2")), self.words(1, 12), True)
        for _ in range(n):
            if r.random() < inside:
                self.furniture(r.choice(("ad", "share", "side", "notice", "form")))
            self.part()

    def body(self) -> None:
        """The article in its place."""
        r = self.rng
        n = r.choice((1, 1, 1, 2, 3, 5, 8, 10))
        inside = r.choice((0.0, 0.0, 0.1, 0.25))

        def fill() -> None:
            if r.random() < 0.25:
                self.box("main", lambda: self.article(n, r.random() < 0.8, inside), "div")
            else:
                self.article(n, r.random() < 0.8, inside)
            if r.random() < 0.1:
                self.furniture(r.choice(("comments", "share")))

        kind = r.random()
        if kind < 0.45:
            self.sure = True
            self.box("main", fill, r.choice(("article", "article", "main")))
            self.sure = False
        elif kind < 0.85:
            self.box("main", fill, r.choice(("div", "section")))
        else:
            fill()

    def bare(self) -> None:
        """A page without furniture: paragraphs, or text straight in the body."""
        r = self.rng
        kind = r.random()
        if kind < 0.3:
            self.html.append(self.marked(self.words(1, 80)))
            self.truth.append(True)
        elif kind < 0.6:
            self.put(r.choice(("p", "p", "div", "article", "main", "pre", "li")), self.marked(self.words(1, 40)), True)
        else:
            first, last = (("nav", "notice", "header", "ad", "form"), ("footer", "footer", "comments", "share", "side", "ad"))
            boxed = r.choice(("", "", "div", "td"))
            if r.random() < 0.5:
                self.furniture(r.choice(first))
            self.html.append("<table><tr><td>" if boxed == "td" else f"<{boxed}>" if boxed else "")
            self.article(r.choice((1, 2, 3, 6)), r.random() < 0.5, r.choice((0.0, 0.0, 0.3)))
            self.html.append("</td></tr></table>" if boxed == "td" else f"</{boxed}>" if boxed else "")
            if r.random() < 0.5:
                self.furniture(r.choice(last))

    def plain(self) -> None:
        """The commonest page: a menu, a box of paragraphs that says nothing of itself, a footer."""
        r, self.named = self.rng, 0.0
        for role in r.choice((("nav",), ("header", "nav"), ("nav", "nav"), ())):
            self.furniture(role)
        depth = r.choice((0, 1, 1, 1, 2))
        self.html.append("<div>" * depth)
        self.article(r.choice((1, 2, 3, 5, 8)), r.random() < 0.6)
        self.html.append("</div>" * depth)
        for role in r.choice((("footer",), ("footer",), ("nav", "footer"), ("comments", "footer"), ())):
            self.furniture(role)

    def tabular(self) -> None:
        """A table as layout: a cell of links, a cell of text, perhaps rows above and below."""
        r = self.rng
        self.html.append(f"<table{self.name('wrap')}>")
        if r.random() < 0.5:
            self.html.append("<tr>")
            self.put("td", r.choice(PHRASES["header"]) + r.choice(("", " " + self.words(1, 3))), False, " colspan=2" + self.name("header"))
            self.html.append("</tr>")
        cells = [self.menu_cell, self.text_cell]
        if r.random() < 0.3:
            cells.reverse()
        self.html.append("<tr>")
        for cell in cells:
            cell()
        self.html.append("</tr>")
        if r.random() < 0.6:
            self.html.append("<tr>")
            self.put("td", r.choice(PHRASES["footer"]) + r.choice(("", " " + self.words(1, 8))), False, " colspan=2" + self.name("footer"))
            self.html.append("</tr>")
        self.html.append("</table>")

    def menu_cell(self) -> None:
        r = self.rng
        if r.random() < 0.4:
            own = " ".join(r.choice(PHRASES["nav"]) for _ in range(r.randint(1, 5)))
            self.put("td", own, False, self.name("nav") or ' class="menu"')
        else:
            self.box("nav", lambda: self.links("nav"), "td")

    def text_cell(self) -> None:
        r = self.rng
        if r.random() < 0.3:
            self.put("td", self.marked(self.words(8, 80)), True, self.name("main"))
        else:
            self.box("main", lambda: self.article(r.choice((1, 2, 4)), r.random() < 0.6), "td")

    def page(self) -> None:
        r = self.rng
        self.html.append(r.choice(("<!DOCTYPE html>", "")) + r.choice(("<html><head><title>x</title></head><body>", "<html><head><meta charset=utf-8><title>x</title><script>if(a<b){}</script><body>", "<body>", "")))
        kind = r.random()
        if kind < 0.25:
            self.bare()
        elif kind < 0.35:
            self.plain()
        elif kind < 0.45:
            self.tabular()
        else:
            depth = r.choice((0, 0, 1, 2))
            self.html += [f"<div{self.name('wrap')}>" for _ in range(depth)]
            for role in r.sample(("header", "nav", "notice", "ad", "nav", "form", "side"), r.randint(0, 4)):
                self.furniture(role)
            self.body()
            for role in r.sample(("comments", "side", "ad", "share", "form", "notice", "nav"), r.randint(0, 4)):
                self.furniture(role)
            if r.random() < 0.7:
                self.furniture("footer")
            self.html += ["</div>"] * depth
        self.html.append("</body></html>")


def pages(n: int, seed: int = 0) -> list[tuple[str, list[bool]]]:
    """n pages as (html, whether each block of text is article text)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = Writer(rng)
        w.page()
        out.append(("".join(w.html), w.truth))
    return out
