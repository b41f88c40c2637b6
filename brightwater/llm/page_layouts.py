"""Labelled pages to learn from: articles in many layouts, with everything that surrounds an article on the web.

``data-label`` on an element says whether its text belongs to the article ("main") or not ("other"); pages that were labelled by hand can say the same and be learnt from with these.
"""

from __future__ import annotations

import random

#: What sites call the parts of a page. Each line: the names of one kind of part; a page picks among them.
MAIN_NAMES = (
    "article article-body article-content article__body articletext post post-content post-body post__content entry entry-content entry-body hentry story story-body story-text content content-body main-content "
    "page-content body-text text rich-text prose markdown-body blog-post news-text single-content td-post-content field-item text-block maincontent main wiki-content document"
).split()
ASIDE_NAMES = {
    "menu": "nav navbar nav-menu menu main-menu top-menu topbar navigation site-nav primary-nav breadcrumb breadcrumbs crumbs pagination pager toc tabs hamburger drawer submenu skip-links language-switcher tags tag-list".split(),
    "header": "header site-header page-header masthead top banner-top logo brand branding site-title tagline hero-top head".split(),
    "footer": "footer site-footer page-footer foot bottom colophon copyright legal legal-links imprint footer-widgets bottom-bar credits".split(),
    "sidebar": "sidebar side-bar side aside rail right-rail left-column widget widget-area related related-posts recommended more-stories popular trending most-read latest teaser-list see-also recent secondary complementary".split(),
    "notice": "cookie cookie-banner cookie-notice consent gdpr privacy-banner notice alert announcement message warning paywall overlay modal popup toast subscribe-wall info-bar outdated-browser maintenance".split(),
    "advert": "ad ads advert advertisement ad-slot adsbox banner banner-ad sponsor sponsored promo promotion promoted dfp google-ads adsbygoogle ad-unit native-ad partner-content affiliate commercial outbrain taboola".split(),
    "form": "form search search-form search-box login login-form signup subscribe newsletter newsletter-form contact contact-form comment-form respond survey poll feedback registration".split(),
    "comments": "comments comment comment-list commentlist comment-body comment-thread comment-section discussion disqus replies reply reactions responses user-comments reader-comments guestbook feedback-list talkback opinions reviews kommentare commentaires comentarios".split(),
    "share": "share share-bar social social-links sharing follow follow-us share-buttons addthis print-tools toolbar actions".split(),
}
_TAGS = {
    "menu": ("nav", "nav", "div", "ul", "div"), "header": ("header", "header", "div", "td"), "footer": ("footer", "footer", "div", "td"), "sidebar": ("aside", "aside", "div", "section", "td"),
    "notice": ("div", "div", "section", "aside", "p"), "advert": ("div", "div", "aside", "section", "ins"), "form": ("form", "form", "div"), "comments": ("section", "div", "ol", "div"), "share": ("div", "ul", "p"),
}
_SHORT = {
    "menu": "Home|About us|Contact|News|Sports|Products|Services|Blog|FAQ|Sitemap|Next page|Previous|Startseite|Über uns|Kontakt|Nachrichten|Accueil|À propos|Actualités|Inicio|Noticias|Contacto|Skip to content|Menu|Read more|Topics|Archive".split("|"),
    "share": "Share|Tweet|Print|Email this|Follow us|Teilen|Partager|Compartir|Copy link|Like|Save".split("|"),
    "form": "Search|Your name|Email address|Password|Log in|Sign up|Submit|Subscribe|Suche|Anmelden|Rechercher|Buscar|Leave a reply|Send|Required fields are marked *|Remember me|Message".split("|"),
    "sidebar": "Related articles|Most read|Popular posts|Recent comments|You may also like|Latest news|Archives|Categories|Tags|Trending|Mehr zum Thema|À lire aussi|Más leídas|Recommended for you".split("|"),
    "advert": "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Ad|Promoted|Buy now|Shop the sale|Get 50% off today!|Limited offer: order now and save.".split("|"),
    "header": "The Daily Courier|Example News|Login|Register|Your trusted source|My Site|Willkommen|Today's edition|Weather 12°C".split("|"),
    "comments": "Comments (12)|3 comments|Leave a comment|Reply|Report|Kommentare|Commentaires|Show all replies|Great article, thanks!|I don't agree at all.|First!|Antworten|says:|2 hours ago|posted on 3 May 2020 at 10:15".split("|"),
    "footer": "© 2024 Example Inc. All rights reserved.|Copyright 2019|Privacy policy|Terms of use|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by WordPress|Contact us|All rights reserved|&copy; example.com &middot; Alle Rechte vorbehalten".split("|"),
    "notice": (
        "We use cookies to improve your experience. By continuing you accept our privacy policy.|This website uses cookies.|Accept all|Wir verwenden Cookies, um Inhalte zu personalisieren.|Ce site utilise des cookies.|"
        "Este sitio utiliza cookies.|Subscribe to continue reading.|Please enable JavaScript.|Your browser is out of date.|You have 2 free articles left this month.|Sign in to read the full story.|Scheduled maintenance on Sunday."
    ).split("|"),
}
_SYLLABLES = ("the of and to in er on re ti en es an th or st ed ing nd at le", "der die und sch en ein ich ge be ver lich keit ung ö ü ent", "le la de es que tion ment é è eau ou ai oi re on", "el la de os ción ado ar en que ent ra mos í ñ a")


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """``n`` pages, the same for the same seed."""
    return [_Page(random.Random(f"{seed}:{i}")).html() for i in range(n)]


class _Page:
    def __init__(self, r: random.Random):
        syllables = r.choice(_SYLLABLES).split()
        self.r, self.words = r, ["".join(r.choices(syllables, k=k)) for k in r.choices((1, 2, 3), k=90)]
        self.noise = r.choice(["", "", "", "", "%%%", "***", "&amp;&amp;", "$$$"])
        self.semantic = r.random()  # how often parts have tags of their own rather than names

    def word(self) -> str:
        return self.r.choice(self.words)

    def sentence(self, least: int = 1, most: int = 22) -> str:
        words = [w + "," if i % 7 == 3 else w for i, w in enumerate(self.r.choices(self.words, k=self.r.randint(least, most)))]
        if self.noise:
            words = [w + (self.noise if self.r.random() < 0.6 else "") for w in words]
        return " ".join(words).strip(",").capitalize() + self.r.choice(["."] * 8 + ["!", "?", ""])

    def prose(self, most: int = 8) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, most])))
        if self.r.random() < 0.15:
            words = text.split(" ")
            k = self.r.randrange(len(words))
            words[k] = self.r.choice(["<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<code>{}</code>", "{}<br>"]).format(words[k])
            text = " ".join(words)
        return text

    def attributes(self, names: list[str]) -> str:
        name = self.r.choice(names)
        shown = self.r.choice([name, name, name.replace("-", "_"), f"{name}-{self.r.randint(1, 99)}", f"{self.word()} {name}", f"{self.r.choice(['js', 'c', 'site', 'block', 'widget'])}-{name}"])
        return f' {self.r.choice(["class", "class", "class", "id"])}="{shown}"'

    def links(self, words: list[str], least=2, most=9) -> str:
        tag = self.r.choice(["li", "li", "li", "div", "span", ""])
        shown = [self.r.choice([self.r.choice(words), self.word(), f"{self.word()} {self.word()}".capitalize()]) for _ in range(self.r.randint(least, most))]
        own = "".join(f"<{tag}><a href=\"/{i}\">{w}</a></{tag}>" if tag else f'<a href="/{i}">{w}</a> | ' for i, w in enumerate(shown))
        return f"<ul>{own}</ul>" if tag == "li" else own

    def inside(self, kind: str) -> str:
        r, short = self.r, _SHORT.get(kind, _SHORT["menu"])
        if kind == "menu":
            return self.links(short, 3, 10)
        if kind == "share":
            return self.links(short, 1, 5)
        if kind == "comments":
            one = lambda: f"<{r.choice(['li', 'div', 'article'])}{self.attributes(['comment', 'comment-body', 'reply', 'c-item', 'thread'])}><p><b>{self.word().capitalize()}</b> {r.choice(short)}</p>" + "".join(f"<p>{self.prose(4)}</p>" for _ in range(r.choice([1, 1, 2])))
            shut = r.random() < 0.9
            body = "".join(one() + ("</div></li></article>" if shut else "") for _ in range(r.randint(1, 5)))
            return f"<h{r.choice('234')}>{r.choice(short)}</h3>" + body if r.random() < 0.7 else body
        if kind == "form":
            fields = "".join(f'<{(t := r.choice(["label", "p", "div"]))}>{r.choice(short)}</{t}><input name="q">' for _ in range(r.randint(1, 4)))
            return (f"<h3>{r.choice(short)}</h3>" if r.random() < 0.4 else "") + fields + (f"<p>{self.sentence(4)}</p>" if r.random() < 0.4 else "") + "<button>OK</button>"
        body = []
        if r.random() < 0.5:
            body.append(f"<{(t := r.choice(['h2', 'h3', 'h4', 'p', 'div']))}>{r.choice(short)}</{t}>")
        for _ in range(r.randint(1, 4)):
            text = r.choice([r.choice(short), self.sentence(3), self.sentence(3) + " " + self.sentence(2)])
            body.append(r.choice(["<p>{}</p>", "<div>{}</div>", "{} ", '<li><a href="/y">{}</a></li>', "<p><a href='/z'>{}</a></p>", "<span>{}</span> "]).format(text))
        if kind in ("footer", "sidebar", "header") and r.random() < 0.5:
            body.append(self.links(short))
        return "".join(body)

    def part(self, kind: str, tag: str | None = None) -> str:
        """One part that is not the article."""
        tag = tag or self.r.choice(_TAGS[kind])
        own = tag in ("nav", "header", "footer", "aside", "form")
        named = "" if own and self.r.random() < self.semantic else self.attributes(ASIDE_NAMES[kind])
        return f'<{tag}{named} data-label="other">{self.inside(kind)}</{tag}>'

    def article(self) -> str:
        r, out = self.r, []
        title = f"<h1>{self.sentence(1, 9).rstrip('.')}</h1>"
        if r.random() < 0.8:
            out.append(r.choice([title, title, title, f"<header>{title}</header>", f"<header>{title}<p>{self.sentence(4)}</p></header>", f'<div class="{r.choice(["title", "headline", "entry-header", "post-title"])}">{title}</div>']))
        if r.random() < 0.15:
            out.append(f'<p class="{r.choice(["byline", "author", "meta", "dateline", "date"])}">{self.word().capitalize()} {self.word().capitalize()}, {r.randint(1, 28)}. {r.randint(1, 12)}. 20{r.randint(10, 24)}</p>')
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
            k = r.random()
            if k < 0.66:
                out.append(f"<p>{self.prose()}" + ("</p>" if r.random() < 0.9 else ""))
            elif k < 0.72:
                out.append(f"<p><b>{self.sentence(1, 14)}<br>")
            elif k < 0.78:
                out.append(f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{self.sentence(1, 6).rstrip('.')}</{h}>")
            elif k < 0.83:
                out.append(f"<{(u := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.sentence(1, 14)}</li>" for _ in range(r.randint(2, 6))) + f"</{u}>")
            elif k < 0.86:
                out.append(f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(self.prose(3))}</blockquote>")
            elif k < 0.89:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{r.choice([self.word(), str(r.randint(0, 999))])}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif k < 0.91:
                out.append(f'<figure><img src="a.jpg" alt="x"><figcaption>{self.sentence(3, 10)}</figcaption></figure>')
            elif k < 0.92:
                out.append(f"<pre><code>{self.word()} = {self.word()}({r.randint(0, 9)});\n{self.word()}++;</code></pre>")
            elif k < 0.93:
                out.append(f"<div>{self.prose()}</div>")
            else:
                out.append(self.part(r.choice(["advert", "advert", "advert", "sidebar", "share", "form", "notice", "menu"]), r.choice([None, "div", "div", "p"])))
        return "".join(out)

    def html(self) -> str:
        r = self.r
        body = self.article()
        tag = r.choice(["article", "article", "article", "main", "div", "div", "div", "section", "td"])
        named = "" if tag in ("article", "main") and r.random() < 0.6 else self.attributes(MAIN_NAMES)
        main = f'<{tag}{named} data-label="main">{body}</{tag}>'
        if tag == "td":
            main = f"<table><tr>{self.part('sidebar', 'td') if r.random() < 0.6 else ''}{main}{self.part('sidebar', 'td') if r.random() < 0.4 else ''}</tr></table>"
        after = [self.part(k) for k in r.sample(["comments", "comments", "share", "sidebar", "advert", "form", "menu"], r.randint(0, 4))]
        if r.random() < 0.4:
            outer = r.choice(["main", "div", "div", "section"])
            inside = after if r.random() < 0.5 else []
            main = f"<{outer}{self.attributes(['container', 'wrapper', 'page', 'layout', 'row', 'col', 'content', 'main', 'site', 'inner'])}>{main}{''.join(inside)}</{outer}>"
            after = [] if inside else after
        before = [self.part(k) for k in ("notice", "header", "menu", "menu", "advert", "form", "sidebar") if r.random() < (0.75 if k in ("menu", "header") else 0.35)]
        if r.random() < 0.5:
            r.shuffle(before)
        last = [self.part(k) for k in ("sidebar", "footer", "notice", "footer") if r.random() < (0.7 if k == "footer" else 0.3)]
        whole = "".join(before) + main + "".join(after + last)
        if r.random() < 0.08:
            whole = f'<form id="aspnetForm" action="/">{whole}</form>'
        if r.random() < 0.3:
            whole = f"<div{self.attributes(['page', 'wrapper', 'container', 'site', 'app', 'root', 'layout'])}>{whole}</div>"
        return f'<!DOCTYPE html><html data-label="other"><head><title>{self.sentence(2, 8)}</title><style>p{{margin:0}}</style><script>var a = "<p>";</script></head><body>{whole}' + ("</body></html>" if r.random() < 0.9 else "")
