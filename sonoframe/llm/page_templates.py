"""Made-up pages with known main text, to train the block labeller on.

Pages come from many layouts: with semantic elements or plain divisions, with telling, misleading or meaningless
class names, with menus, notices, adverts, sidebars, forms and reader comments around and inside the article, and
with the flaws of real markup. Prose is of invented syllables, so that only the words of page furniture carry
meaning and any language's article is alike.
"""

from __future__ import annotations

import html
import random

#: Words of page furniture.
MENU = "Home|About|About us|Contact|News|Blog|Products|Services|Login|Sign in|Register|FAQ|Help|Archive|Sports|World|Politics|Business|Tech|Search|Start|Kontakt|Impressum|Accueil|Inicio|Über uns|À propos|Contacto".split("|")
NOTICE = "We use cookies to improve your experience.|This site uses cookies. Accept all|By continuing you agree to our privacy policy.|Subscribe to read the full story.|Sign up for our newsletter|You have 3 free articles left.|Please enable JavaScript.|Diese Website verwendet Cookies.|Ce site utilise des cookies.|Este sitio utiliza cookies.".split("|")
ADVERT = "Advertisement|Sponsored content|Buy now and save 50%|Limited offer: order today|Anzeige|Publicité|Publicidad|Shop the sale|Promoted by our partners".split("|")
ASIDE = "Related articles|Most read|Popular posts|Recent posts|Categories|Tags|Follow us|Share this|You may also like|Read more|Trending now|Latest news|Archives|Share on Facebook|Tweet|Mehr zum Thema|Lire aussi|Más leídas".split("|")
FOOTER = "© 2024 All rights reserved|Privacy policy|Terms of use|Imprint|Cookie settings|Copyright 2023|Powered by|Contact us|Sitemap|Datenschutz|Mentions légales|Aviso legal|Back to top".split("|")
COMMENT = "Comments|Leave a reply|Reply|Report|Posted 2 hours ago|says:|Like|3 comments|Log in to comment|Kommentare|Commentaires|Comentarios|Anonymous|Share your thoughts".split("|")
FORM = "Name|Email|Website|Submit|Send|Search|Your message|Subscribe|Password|Remember me|Enter your email".split("|")
GOOD = "content|article|post|entry-content|article-body|story|main|text|post-content|body|page-content|story-body|entry|prose|single-post".split("|")
BAD = {
    "menu": "nav|menu|navbar|main-nav|navigation|topbar|breadcrumb|site-nav|links".split("|"),
    "header": "header|masthead|site-header|page-header|top|branding|logo|hero".split("|"),
    "footer": "footer|site-footer|bottom|copyright|legal|colophon".split("|"),
    "side": "sidebar|aside|widget|related|rail|secondary|widget-area|more-stories|recommended|social|share|tags|toc".split("|"),
    "notice": "cookie|cookie-banner|consent|notice|alert|banner|popup|modal|gdpr|message|paywall|newsletter|disclaimer".split("|"),
    "advert": "ad|ads|advert|advertisement|sponsor|sponsored|promo|banner-ad|ad-slot|adsense".split("|"),
    "comments": "comments|comment-list|comment|discussion|replies|responses|disqus|comment-body|user-comments|reader-comments".split("|"),
    "form": "form|search|search-form|subscribe|login|signup|contact-form".split("|"),
}
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "notice": "div", "advert": "div", "comments": "section", "form": "form"}

#: Elements without text of their own whose content only looks like markup, or that are left open.
BARE = [
    "<script>for(i=0;i<n;i++){f(i)}</script>", "<script>if (a<b && c>d) { g(x => x<y) }</SCRIPT >", "<script><!--\nvar a = '<p>';\n</script>", "<script>//<![CDATA[\nvar d = \"</p>\";\n//]]></script>", "<script>s = 'it\\'s <b'</script>", "<style>a>b{c:'<d'}</style>", "<template><template><p>x</p></template><p>y</p></template>",
    '<svg viewBox="0 0 1 1"><g><path d="M0 0"></g></svg>', "<svg><svg></svg></svg>", "<svg><path d='M1 1'>", '<object data="x.swf">', "<object><object></object>", "<canvas>", "<iframe src='/x'></iframe>", '<iframe src="/x">', "<noscript><img src='/x'></noscript>",
]
FORMULA = "<math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math>"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        alphabet = r.choice(["aeiou", "aeiouäöü", "aeiouéèê", "aeiouáíóñ", "аеиоу"])
        consonants = "bcdfghklmnprstvwz" if alphabet[0] == "a" else "бвгдклмнпрст"
        self.syllables = [r.choice(consonants) * r.randint(0, 1) + r.choice(alphabet) + r.choice(consonants) * r.randint(0, 1) for _ in range(50)]
        self.junk = r.random() < 0.1
        self.semantic = r.random() < 0.7
        self.flaws = random.Random(-seed - 1)
        self.out: list[str] = []
        self.truth: list[tuple[str, bool]] = []

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        words = [self.word() + ("," if self.r.random() < 0.08 else "") for _ in range(self.r.randint(low, high))]
        text = " ".join(words).rstrip(",")
        return text[:1].upper() + text[1:] + self.r.choice("....!?")

    def prose(self, low: int = 1, high: int = 7) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        return text.upper() if self.r.random() < 0.02 else text + ("" if self.r.random() < 0.95 else " $$$ *** %%% &&&")

    def attribute(self, names: list[str], strength: float = 0.8) -> str:
        r = self.r
        if self.junk or r.random() > strength:
            return "" if r.random() < 0.5 else f' class="{r.choice("abcxyz")}{r.randint(1, 99)}{r.choice(["", " row", " col-8", " box", " wrap", " inner"])}"'
        name = r.choice(names)
        if r.random() < 0.3:
            name += r.choice([" wrap", " inner", "-wrapper", " clearfix", "-1", " col-4", "__item"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def say(self, text: str, content: bool, tag: str, attribute: str = "", inner: str | None = None) -> None:
        """One leaf block."""
        r = self.r
        shown = html.escape(text, quote=False) if inner is None else inner
        if content and inner is None and r.random() < 0.25:
            words = shown.split(" ")
            k = r.randrange(len(words))
            if self.flaws.random() < 0.1:
                words.insert(k, FORMULA)
                text = " ".join(words).replace(FORMULA, "x = 1 2")
                k += 1
            words[k] = r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<strong>{}</strong>", "<span>{}</span>"]).format(words[k])
            shown = " ".join(words)
        close = "" if tag in ("p", "li") and r.random() < 0.1 else f"</{tag}>"
        self.out.append(f"<{tag}{attribute}>{shown}{close}" + r.choice(["", "\n", " "]))
        self.truth.append((" ".join(html.unescape(text).split()), content))

    def links(self, words: list[str], n: int, own: bool) -> None:
        r = self.r
        plain = r.random() < 0.3
        if not plain:
            self.out.append("<ul>")
        for _ in range(n):
            text = (self.word().title() if r.random() < 0.6 else self.sentence(2, 7).rstrip(".!?")) if own else r.choice(words)
            self.say(text, False, "div" if plain else "li", "", f'<a href="/{r.randint(1, 99)}">{html.escape(text)}</a>')
        if not plain:
            self.out.append("</ul>")

    def part(self, kind: str, *, nested: bool = False) -> None:
        """One piece of page furniture."""
        r = self.r
        semantic = self.semantic and r.random() < 0.8
        tag = SEMANTIC[kind] if semantic else "div"
        attribute = self.attribute(BAD[kind], 0.5 if semantic and tag != "div" else 0.9)
        if kind in ("notice", "advert", "comments") and not attribute and tag in ("div", "section"):
            attribute = f' class="{r.choice(BAD[kind])}"' if not self.junk or nested else ""
        self.out.append(f"<{tag}{attribute}>")
        own = r.random() < 0.5
        if kind == "menu":
            self.links(MENU, r.randint(3, 9), own)
        elif kind == "header":
            self.say(self.sentence(1, 4) if own else r.choice(MENU), False, r.choice(["h1", "h2", "div", "p"]))
            if r.random() < 0.5:
                self.links(MENU, r.randint(3, 7), own)
            if r.random() < 0.3:
                self.say(self.sentence(2, 8), False, "p")
        elif kind == "footer":
            if r.random() < 0.4:
                self.links(FOOTER, r.randint(2, 6), False)
            text = r.choice(["© ", "Copyright ", "&copy; "]) + self.word() + ".example · " + self.prose(1, 3) if own else r.choice(FOOTER)
            self.say(text.replace("&copy;", "©"), False, r.choice(["p", "div", "p"]))
            if r.random() < 0.3:
                self.say(self.prose(1, 2), False, "p")
        elif kind == "side":
            self.say(r.choice(ASIDE) if r.random() < 0.7 else self.sentence(1, 4), False, r.choice(["h2", "h3", "h4", "div"]))
            if r.random() < 0.7:
                self.links(ASIDE, r.randint(2, 7), True)
            else:
                for _ in range(r.randint(1, 3)):
                    self.say(self.prose(1, 3), False, "p")
        elif kind == "notice":
            self.say(r.choice(NOTICE) if r.random() < 0.6 else self.prose(1, 2), False, r.choice(["p", "div", "p"]))
            if r.random() < 0.3:
                self.say(r.choice(["Accept", "OK", "Accept all", "Close", "Dismiss"]), False, "button")
        elif kind == "advert":
            self.say(r.choice(ADVERT) if r.random() < 0.4 else self.prose(1, 2), False, r.choice(["p", "div", "p"]))
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                self.say(r.choice(FORM) if r.random() < 0.8 else self.sentence(2, 8), False, r.choice(["div", "p", "button", "fieldset"]))
        else:
            self.say(r.choice(COMMENT) if r.random() < 0.8 else self.sentence(1, 3), False, r.choice(["h2", "h3", "h4"]))
            item, own_class = r.choice(["div", "li", "article", "div", "li", "div"]), self.attribute(BAD["comments"], 0.7)
            for _ in range(r.randint(1, 5)):
                self.out.append(f"<{item}{own_class}>")
                if r.random() < 0.7:
                    self.say(self.word().title() + r.choice(["", " says:", " · 2 hours ago", " wrote"]), False, r.choice(["div", "p", "h4", "header"]))
                for _ in range(r.randint(1, 2)):
                    self.say(self.prose(1, 4), False, r.choice(["p", "div", "p"]))
                if r.random() < 0.3:
                    self.say(r.choice(COMMENT), False, "div")
                self.out.append(f"</{item}>")
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        r = self.r
        tag = r.choice(["article", "article", "main", "section", "div"]) if self.semantic else "div"
        attribute = self.attribute(GOOD, 0.5 if tag in ("article", "main") else 0.95)
        wrapped = r.random() < 0.35
        self.out.append(f"<{tag}{attribute}>")
        head = r.random()
        if head < 0.8:
            if head < 0.15:
                self.out.append("<header>")
            self.say(self.sentence(2, 10).rstrip("."), True, r.choice(["h1", "h1", "h2"]))
            if head < 0.15:
                self.out.append("</header>")
        if wrapped:
            self.out.append(f"<div{self.attribute(GOOD, 0.7)}>")
        for _ in range(r.randint(1, 14)):
            if self.flaws.random() < 0.06:
                self.out.append(self.flaws.choice(BARE))
            kind = r.random()
            if kind < 0.7:
                self.say(self.prose(), True, "p" if r.random() < 0.93 else "div")
            elif kind < 0.76:
                self.say(self.sentence(1, 3), True, "p")
            elif kind < 0.82:
                self.say(self.sentence(1, 6).rstrip("."), True, r.choice(["h2", "h3"]))
            elif kind < 0.87:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.say(self.sentence(2, 10), True, "li")
                self.out.append("</ul>")
            elif kind < 0.90:
                self.out.append("<blockquote>")
                self.say(self.prose(1, 2), True, "p")
                self.out.append("</blockquote>")
            elif kind < 0.92:
                self.say(self.prose(1, 2), True, "pre")
            else:
                self.part(r.choice(["advert", "advert", "notice", "side", "form"]), nested=True)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            # texts often end oddly
            word = self.word()
            self.say(r.choice([word.title() + ".", self.sentence(1, 2), " ".join([word] * r.randint(5, 60)), "This work is licensed under the " + word.title() + " License, version 3.", self.sentence(3, 6)]), True, "p")
        if wrapped:
            self.out.append("</div>")
        if r.random() < 0.15:
            self.part("comments", nested=True)
        self.out.append(f"</{tag}>")

    def page(self) -> tuple[str, list[tuple[str, bool]]]:
        r = self.r
        title = self.sentence(2, 9)
        self.out.append('<!DOCTYPE html><html lang="xx"><head><meta charset="utf-8">')
        self.say(title, False, "title")
        self.out.append("<style>p{margin:0}</style><script>var t=\"</p>\";</script>" + (self.flaws.choice(BARE[:7]) if self.flaws.random() < 0.4 else "") + "</head><body>")
        for kind, p in (("notice", 0.25), ("header", 0.4), ("menu", 0.8), ("advert", 0.4), ("form", 0.1)):
            if r.random() < p:
                self.part(kind)
        outer = r.random() < 0.4
        if outer:
            self.out.append(f"<{'main' if self.semantic and r.random() < 0.5 else 'div'}{self.attribute(['container', 'page', 'wrapper', 'layout', 'site'], 0.8)}>")
        if r.random() < 0.2:
            self.part("side")
        self.article()
        for kind, p in (("comments", 0.3), ("side", 0.45), ("advert", 0.25), ("form", 0.15)):
            if r.random() < p:
                self.part(kind)
        if outer:
            self.out.append("</div>")
        for kind, p in (("footer", 0.8), ("notice", 0.2)):
            if r.random() < p:
                self.part(kind)
        self.out.append("</body></html>")
        return "".join(self.out), self.truth


def pages(n: int, seed: int = 1) -> list[tuple[str, list[tuple[str, bool]]]]:
    """``n`` pages with the text and label of each leaf block in order."""
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
