"""Labelled pages: layouts written and labelled by hand, their texts drawn by a fixed rule.

In a layout, blocks of elements with the attribute ``data-main`` are main text, up to an element with ``data-rest`` inside. ``{...}`` stands for drawn text: ``w3`` three
words, ``s`` a sentence, ``l`` a paragraph, ``P`` some paragraphs of main text, ``X`` a part that isn't, ``M`` items of a menu, and a kind of names, such as ``side``, for a class or id of that kind.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

# Names that pages give to their parts, and what is written there.
NAMES = {
    "ad": "ad ads advert advertisement sponsored promo banner adsbox ad-slot sponsor commercial".split(),
    "side": "sidebar side rail widget related aside recommended more-stories trending popular right-column".split(),
    "foot": "footer foot site-footer page-footer colophon bottom legal copyright footer-links".split(),
    "head": "header head site-header masthead topbar top branding page-header logo".split(),
    "menu": "menu nav navbar navigation main-nav breadcrumbs toc links pagination pager tabs skip".split(),
    "note": "cookie notice consent gdpr alert cookie-banner notification popup modal paywall disclaimer warning toast".split(),
    "body": "content post entry-content article-body story post-content main text article page-content entry body-text".split(),
    "form": "newsletter subscribe search signup login contact-form search-box register feedback".split(),
    "talk": "comments comment-list respond disqus_thread replies discussion reader-comments comment responses feedback-thread".split(),
    "share": "share social sharing tools toolbar tags meta byline author-box".split(),
}
SAYINGS = {
    "note": ["We use cookies to improve this site.", "This site uses cookies. Read our privacy policy.", "Please enable JavaScript.", "You have 3 free articles left.", "Wir verwenden Cookies.", "Ce site utilise des cookies.", "Usamos cookies en este sitio."],
    "form": ["Subscribe to our newsletter", "Your email address", "Sign up", "Search", "Log in", "Send", "Password", "Leave a comment", "Abonnieren", "S'inscrire", "Buscar"],
    "foot": ["All rights reserved.", "Privacy policy", "Terms of use", "Contact us", "Imprint", "Impressum", "Mentions légales", "About us", "Aviso legal"],
    "share": ["Share", "Tweet", "Print", "Email", "Follow us", "5 min read", "Share on Facebook", "Teilen", "Partager"],
    "talk": ["3 comments", "Reply", "Leave a reply", "Comments", "Great article!", "Thanks for sharing this.", "Kommentare", "Commentaires", "I don't agree at all.", "12 replies"],
    "side": ["Read more", "Related articles", "Most popular", "You may also like", "Trending now", "Mehr zum Thema", "À lire aussi"],
    "ad": ["Advertisement", "Sponsored", "Buy now!", "Anzeige", "Publicité", "Up to 50 % off today."],
}
WORDS = "the of a to in is on by it or be at as an we us if so no up he was for are but not you all any can had her one our out day get has him his how man new now old see two way who boy did its let put say she too use that with have this will your from they know want been good much some time very when come here just like long make many more only over such take than them well were what wonder country question morning water house river letter winter evening market children government mountain history machine village different important together always between because through another being under never world place again after think still great might small found every right while those house against und der die das nicht mit ein eine auf für ist von dem den des sich auch nach wird bei einer les des est pas pour dans sur avec une qui que plus par sont aux los las una por con para como más pero sus este entre cuando".split()

LAYOUTS = [
    # The common frames.
    '<html><head><title>{w5}</title></head><body><nav><ul>{M}</ul></nav><div class="{ad}">{s}</div><article data-main><h1>{w6}</h1>{P}{X}{P}</article><footer>&copy; {w1}.example.com &middot; {s}</footer></body></html>',
    "<body><nav><ul>{M}</ul></nav><main data-main><h1>{w4}</h1>{P}<h2>{w3}</h2>{P}</main><footer><p>&copy; {w2}</p><p>{foot!}</p></footer></body>",
    '<body><header><h1>{w2}</h1><p>{s}</p></header><nav>{M}</nav><article data-main><h2>{w5}</h2>{P}</article><aside><h3>{side!}</h3><ul>{M}</ul><p>{s}</p></aside><footer>{s} {foot!}</footer></body>',
    '<body><div id="{head}"><a href="/">{w2}</a><span>{w4}</span></div><div id="{menu}"><ul>{M}</ul></div><div id="{body}" data-main><h1>{w5}</h1>{P}{X}{P}</div><div id="{side}"><h4>{side!}</h4><ul>{M}</ul></div><div id="{foot}">{w2} {s}</div>{X}</body>',
    '<div class="wrap"><div class="{menu}">{M}</div><div class="{body}"><div data-main><h1>{w5}</h1><p>{l}</p>{P}</div><div class="{share}"><span>{share!}</span> <a href="#">{w1}</a></div></div><div class="{side}"><p>{s}</p>{M}</div></div>',
    # Comments of readers, as articles too.
    '<body><article class="{body}" data-main><h1>{w6}</h1>{P}{X}{P}<section id="{talk}" data-rest><h3>{talk!}</h3><article class="comment"><p>{s}</p><a href="#">{talk!}</a></article><article class="comment"><p>{l}</p></article></section></article><footer>{foot!}</footer></body>',
    '<body><main><article data-main><h1>{w4}</h1>{P}</article><div class="{talk}"><h2>{talk!}</h2><ol><li><p>{l}</p></li><li><p>{s}</p></li><li>{s}</li></ol><form><label>{form!}</label><textarea></textarea><button>{form!}</button></form></div></main>{X}</body>',
    '<body><div class="{body}" data-main>{P}{X}{P}</div><div id="{talk}"><div class="comment"><cite>{w2}</cite><p>{l}</p></div><div class="comment"><cite>{w2}</cite><p>{l}</p><p>{s}</p></div></div><div class="{foot}"><p>{s}</p></div></body>',
    '<body><article data-main><h1>{w3}</h1>{P}</article><section class="{talk}"><p>{l}</p><p>{l}</p><p>{s}</p></section></body>',
    # Notices, forms, adverts inside and around the text.
    '<body><div class="{note}"><p>{note!}</p><button>OK</button></div><article data-main><h1>{w5}</h1>{P}{X}{P}<div class="{ad}" data-rest><p>{ad!}</p><p>{s}</p></div>{P}</article><footer><p>{foot!}</p></footer>{X}</body>',
    '<body><div id="{note}" role="dialog">{s} <a href="#">{w2}</a></div><div class="{body}" data-main><h1>{w5}</h1><p>{l}</p><form class="{form}" data-rest><p>{form!}</p><label>{form!}</label><button>{form!}</button></form>{P}</div></body>',
    '<body><header class="{head}"><p>{s}</p><form><input><button>{form!}</button></form></header><main data-main><p>{l}</p><aside class="{side}" data-rest><h3>{side!}</h3><p>{s}</p><ul>{M}</ul></aside>{P}{X}{P}<figure data-rest class="{ad}"><a href="#">{s}</a></figure>{P}</main><footer class="{foot}"><ul>{M}</ul><p>{s}</p></footer></body>',
    '<body><article data-main><h1>{w5}</h1><div class="{share}" data-rest><span>{share!}</span></div>{P}<nav data-rest class="{menu}">{M}</nav>{P}<footer data-rest>{share!} {w2}</footer></article>{X}</body>',
    '<body><section class="{form}"><h3>{form!}</h3><p>{s}</p><form><label>{form!}</label><button>{form!}</button></form></section><article data-main>{P}{X}{P}</article><section class="{note}"><p>{note!}</p></section></body>',
    # Lists, tables, quotations, captions, code in the text.
    '<body><nav>{M}</nav><article data-main><h1>{w4}</h1><p>{l}</p><ul><li>{s}</li><li>{w3}</li><li>{l}</li></ul><blockquote><p>{l}</p></blockquote><pre>{w5}</pre>{P}</article><footer>{s}</footer></body>',
    '<body><div class="{menu}"><ul>{M}</ul></div><div class="{body}" data-main><h1>{w4}</h1><table><tr><th>{w1}</th><th>{w2}</th></tr><tr><td>{w1}</td><td>{s}</td></tr></table>{P}{X}{P}<figure><figcaption>{s}</figcaption></figure><dl><dt>{w2}</dt><dd>{s}</dd></dl></div><div class="{side}"><ul>{M}</ul></div>{X}</body>',
    '<table><tr><td class="{menu}">{M}</td><td data-main><h1>{w4}</h1>{P}</td><td class="{side}"><p>{s}</p></td></tr><tr><td class="{foot}">{foot!}</td></tr></table>',
    '<body><main data-main><p>{w1}.</p><p>{w1}</p><p>{w2}.</p><h2>{w1}</h2><p>{w4}</p></main><footer>{s}</footer></body>',
    '<body><nav><a href="/">{w1}</a></nav><div class="{ad}">{s} {s}</div><article data-main><h1>{w1}</h1><p><b>{w8}.<br><p>{w1}.</p><p>{junk}</p><p>{w1}.</p></article><footer>&copy; {w1} &middot; {s} {s}</footer></body>',
    # Links in the text; text in the rest.
    '<body><article data-main><h1><a href="/">{w5}</a></h1><p>{s} <a href="/">{w3}</a> {s}</p><p><a href="/">{s}</a></p>{P}{X}{P}</article><aside><p>{l}</p><p>{l}</p></aside><footer><p>{l}</p></footer></body>',
    '<body><div class="{ad}"><p>{l}</p></div><div class="{body}" data-main><h1>{w5}</h1>{P}</div><div class="{ad}"><p>{l}</p><p>{s}</p></div><div class="{foot}"><p>{l}</p></div>{X}</body>',
    '<body><header><p>{l}</p></header><div class="{body}" data-main>{P}{X}{P}</div><nav><p>{s}</p>{M}</nav></body>',
    # Little or nothing names the parts.
    '<body><p><a href="/">{w1}</a> <a href="/">{w1}</a> <a href="/">{w2}</a></p><div data-main><h1>{w5}</h1><p>{l}</p>{P}</div><p>&copy; {w2} <a href="/">{foot!}</a></p></body>',
    '<body><div><a href="/">{w1}</a></div><ul>{M}</ul><div data-main><p>{l}</p><p>{l}</p>{P}{X}{P}</div><div><a href="/">{foot!}</a> <a href="/">{w2}</a></div>{X}</body>',
    '<div data-main><p>{l}</p>{P}</div><div>&copy; {w3}. {foot!}</div>',
    # Pages without a main text.
    '<body><nav><ul>{M}</ul></nav><ul class="{menu}">{M}</ul><footer>{foot!}</footer></body>',
    '<body><header>{w2}</header><form class="{form}"><label>{form!}</label><input><button>{form!}</button></form><footer>&copy; {w3}</footer></body>',
    '<body><div class="{note}"><p>{note!}</p></div><div class="{side}"><h3>{side!}</h3><ul>{M}</ul></div></body>',
    # Hidden parts.
    '<body><nav>{M}</nav><article data-main><h1>{w4}</h1>{P}{X}{P}<div hidden data-rest><p>{s}</p></div><p style="display:none" data-rest>{l}</p>{P}</article><footer>{foot!} {s}</footer></body>',
    '<body><main><section class="{body}" data-main><h2>{w3}</h2>{P}</section><section data-main><h2>{w3}</h2>{P}</section><section class="{side}"><h2>{side!}</h2><p>{s}</p></section></main>{X}</body>',
]


def _draw(what: str, rnd: random.Random) -> str:
    words = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    sentence = lambda: words(rnd.randint(3, 18)).capitalize() + rnd.choice([".", ".", ".", "!", "?"])
    if what.endswith("!"):
        return rnd.choice(SAYINGS[what[:-1]])
    if what in NAMES:
        return rnd.choice(NAMES[what])
    if what == "s":
        return sentence()
    if what == "l":
        return " ".join(sentence() for _ in range(rnd.randint(2, 7)))
    if what == "junk":
        return " ".join(w + rnd.choice(["###", "&amp;&amp;", "%%%", "***", "$$$"]) for w in words(rnd.randint(5, 40)).split())
    if what == "X":
        kind = rnd.choice(["ad", "ad", "form", "note", "share", "side", "talk", "menu"])
        tag, inner = rnd.choice(["div", "div", "section", "aside", "p", "ul"]), rnd.choice(["<p>{s}</p>", "<p>{s}</p><p>{s}</p>", "<h3>{%s!}</h3><p>{s}</p>" % kind, "<span>{%s!}</span>" % kind, "{s} {s}", "<p>{l}</p>", "{M}"])
        tag = "form" if kind == "form" and rnd.random() < 0.5 else tag if "<p>" not in inner or tag != "p" else "div"
        inner = re.sub(r"\{(\w+!?)\}", lambda m: _draw(m[1] if m[1] != "menu!" else "w2", rnd), inner)
        return '<%s %s="%s" data-rest>%s</%s>' % (tag, rnd.choice(["class", "class", "id"]), rnd.choice(NAMES[kind]), inner, tag)
    if what == "M":
        item = rnd.choice(['<li><a href="/">{}</a></li>', '<a href="/">{}</a> ', '<li><a href="/">{}</a></li>'])
        return "".join(item.format(words(rnd.randint(1, 3))) for _ in range(rnd.randint(2, 8)))
    if what == "P":
        some = [rnd.choice(["w1.", "w3", "s", "s", "l", "l", "l", "junk"]) for _ in range(rnd.randint(1, 7))]
        return "".join(rnd.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<p><b>{}<br>"]).format(words(int(s[1])) + s[2:] if s[0] == "w" else _draw(s, rnd)) for s in some)
    return words(int(what[1:]))


def labelled_pages(times: int = 12, layouts: list[str] | None = None) -> Iterator[str]:
    """Each layout ``times`` times with other texts and names; the same at every call."""
    for k, layout in enumerate(LAYOUTS if layouts is None else layouts):
        rnd = random.Random(k)
        for _ in range(times):
            yield re.sub(r"\{(\w+!?)\}", lambda m: _draw(m[1], rnd), layout)
