"""The labelled table that the extraction's tree is fitted on: small pages of many layouts, with their main text marked.

{mN} stands for about N words of main text, {xN} for about N words of anything else. Pages are rendered with different numbers of
words and read by the extraction's own reader, so the tree learns from blocks as it meets them.
"""

from __future__ import annotations

_MENU = "<nav><ul><li><a href=/a>{x1}</a><li><a href=/b>{x2}</a><li><a href=/c>{x1}</a></ul></nav>"
_LINKS = "<ul><li><a href=/a>{x1}</a><li><a href=/b>{x2}</a><li><a href=/c>{x1}</a></ul>"
_BAR = "<div><a href=/a>{x1}</a> | <a href=/b>{x2}</a> | <a href=/c>{x1}</a></div>"
_FOOTER = "<footer><p>{x5}</p></footer>"
_FOOT = "<div class=footer>{x6}</div>"
_AD = "<div class=ad>{x10}</div>"
_COOKIES = "<div class=cookie-notice>{x14} <a href=/p>{x2}</a></div>"
_RELATED = "<aside><h3>{x1}</h3><ul><li><a href=/r>{x6}</a><li><a href=/s>{x5}</a></ul></aside>"
_COMMENTS = "<section id=comments><h2>{x1}</h2><div class=comment><p>{x20}</p></div><div class=comment><p>{x4}</p></div></section>"
_TEXT = "<p>{m50}</p><p>{m30}</p><p>{m8}</p><p>{m70}</p>"
_FULL = "<p>{m50}</p><p>{m2}</p><p>{m60}</p><p>{m1}</p><p>{m20}</p><p>{m4}</p>"
_SHORT = "<p>{m6}</p><p>{m7}</p><p>{m5}</p>"

LAYOUTS = [
    # an article, and what stands around it
    f"{_MENU}{_AD}<article><h1>{{m8}}</h1>{_TEXT}</article>{_FOOTER}", f"{_MENU}{_AD}<article><h1>{{m5}}</h1>{_FULL}</article>{_FOOTER}", f"<article><h1>{{m2}}</h1>{_FULL}{_FULL}</article>{_COMMENTS}",
    f"<article><header><h1>{{m3}}</h1><p>{{m8}}</p></header><p>{{m40}}</p></article>", f"{_MENU}<article><p>{{m40}}</p></article>{_COMMENTS}", f"<div class=left-rail><h3>{{x1}}</h3><p>{{x40}}</p></div><article><p>{{m40}}</p></article>", f"<article><p>{{m40}}</p><div class=pub>{{x7}}</div></article>", f"{_MENU}{_AD}<article><h1>{{m6}}</h1>{_SHORT}</article>{_FOOTER}", f"{_MENU}<article><h1>{{m3}}</h1><p>{{m2}}</p></article>{_COMMENTS}{_FOOTER}",
    f"{_COOKIES}<header><h2>{{x2}}</h2>{_BAR}</header><main><article><h1>{{m7}}</h1>{_TEXT}<ul><li>{{m6}}<li>{{m4}}<li><a href=/x>{{m3}}</a></ul>{_TEXT}</article></main>{_RELATED}{_COMMENTS}{_FOOTER}",
    f"<main><article><header><h1>{{m6}}</h1><p>{{m9}}</p><p>{{x2}}</p></header>{_TEXT}<aside>{{x30}}</aside></article></main>", f"<article><header><h1>{{m6}}</h1><p>{{m14}}</p><p class=byline>{{x3}}</p></header>{_SHORT}<form><p>{{x4}}</p><label>{{x2}}</label></form></article>",
    f"<article><h1>{{m6}}</h1><div class=share><a href=/f>{{x1}}</a> <a href=/t>{{x1}}</a></div><p class=share-price>{{m30}}</p>{_TEXT}<div class=advert>{{x12}}</div>{_SHORT}<div class=tags><a href=/g>{{x1}}</a></div></article>{_FOOT}",
    f"<article><div class=post-header><h1>{{m4}}</h1><span class=byline>{{x3}}</span></div>{_TEXT}</article><div class=comment-list><article><p>{{x25}}</p></article><article><p>{{x12}}</p></article></div>",
    f"<article><h1>{{m5}}</h1><p>{{m40}}</p><table><tr><td>{{m2}}<td>{{m3}}</table><h2>{{m3}}</h2><blockquote>{{m20}}</blockquote><figure><figcaption>{{m8}}</figcaption></figure></article>{_RELATED}",
    f"{_MENU}<article><header><h1>{{m7}}</h1><p>{{x2}}</p></header>{_TEXT}</article>", f"<main><article><header><h1>{{m4}}</h1><p>{{x2}}</p><p>{{m10}}</p></header>{_SHORT}</article></main>{_FOOTER}",
    f"<main><article><h1>{{m4}}</h1><p>{{m8}}</p><p>{{m3}}</p><div class=ad>{{x9}}</div><form><p>{{x3}}</p></form></article></main>{_RELATED}", f"{_MENU}<article><h1>{{m4}}</h1>{_SHORT}<div class=ad>{{x8}}</div>{_TEXT}<div class=promo>{{x15}}</div></article>{_COMMENTS}",
    f"<form id=f><h1>{{m3}}</h1><p>{{m40}}</p><p>{{m2}}</p><p>{{m40}}</p><label>{{x2}}</label></form>", f"<div class='cookie-notice main'>{{x40}}</div><main><p>{{m40}}</p></main><footer>{{x40}}</footer>", f"{_COOKIES}<main><h1>{{m4}}</h1>{_SHORT}</main>{_FOOTER}",
    f"{_LINKS}<div><h1>{{m5}}</h1><p>{{m40}}</p><p>{{m40}}</p><p>{{m3}}</p></div><div><h3>{{x1}}</h3><div><p>{{x7}}</p></div><div><p>{{x3}}</p></div></div>",
    f"{_COOKIES}<article><p>{{m20}}</p><div class=newsletter>{{x12}}</div><p>{{m2}}</p></article>", f"<article><p>{{m6}}</p><div class=sponsored>{{x7}}</div></article>", f"<article>{_TEXT}<section class=related><p>{{x18}}</p></section></article>{_FOOT}",
    # a plain container holds the text
    f"{_LINKS}<div><h1>{{m6}}</h1>{_TEXT}</div>{_FOOT}", f"{_LINKS}<div>{_SHORT}{_SHORT}</div>", f"<div>{_SHORT}{_SHORT}</div>", f"<div><h1>{{m4}}</h1>{_SHORT}</div>{_FOOT}", "<p>{m4}</p>", "<div><p>{m5}</p></div>", "<p>{m9}</p><p>{m4}</p>", "{m12}", "<h1>{m3}</h1><p>{m5}</p>",
    f"<body>{_LINKS}{_TEXT}</body>", f"<body>{_BAR}<h1>{{m5}}</h1>{_TEXT}<hr>{_BAR}</body>", f"<div id=page>{_BAR}<div id=content>{_TEXT}{_SHORT}</div>{_COOKIES}</div>", f"<div class=wrap><div class=left>{_LINKS}</div><div><h2>{{m5}}</h2>{_TEXT}</div><div class=right><h4>{{x2}}</h4>{_LINKS}</div></div>",
    f"{_MENU}<div><p>{{m7}}</p><p>{{m6}}</p><p>{{m8}}</p></div>{_RELATED}{_FOOTER}", f"{_COOKIES}<div><p>{{m12}}</p></div>", f"{_LINKS}<section><h2>{{m3}}</h2><p>{{m30}}</p></section><section><h2>{{m4}}</h2><p>{{m25}}</p><p>{{m20}}</p></section>{_FOOT}",
    f"<table><tr><td>{_LINKS}</td><td><p>{{m40}}</p><p>{{m30}}</p></td></tr></table>", f"<form id=f>{_BAR}<h1>{{m4}}</h1>{_TEXT}<p>{{m5}}</p><label>{{x2}}</label></form>", f"<form><div><article><h1>{{m4}}</h1>{_TEXT}</article></div><label>{{x2}}</label></form>",
    # what readers say and what else is near, in containers of their own and without telling names
    f"{_LINKS}<div><h1>{{m6}}</h1>{_TEXT}{_TEXT}</div><div><h3>{{x2}}</h3><div><p>{{x14}}</p></div><div><p>{{x6}}</p></div><div><p>{{x20}}</p></div></div>", f"<div><h1>{{m6}}</h1>{_TEXT}{_TEXT}</div><div><h4>{{x2}}</h4><p>{{x8}}</p></div><div><p>{{x4}}</p></div>",
    f"<article>{_TEXT}</article><div><h3>{{x2}}</h3><div><p>{{x10}}</p></div><div><p>{{x15}}</p></div></div>", f"<main><h1>{{m5}}</h1>{_TEXT}</main><div><p>{{x12}}</p></div>",
    # named loosely or wrongly
    f"<div class=content-header><h1>{{m5}}</h1></div><div class=main-content>{_TEXT}</div><div class=social-links><a href=/t>{{x1}}</a></div>", f"<div class=post><h1 class=page-header>{{m5}}</h1>{_TEXT}<p class=promoted-idea>{{m40}}</p></div>{_FOOT}", f"<main class=page-with-sidebar><h1>{{m5}}</h1>{_TEXT}</main><div class=sidebar><p>{{x20}}</p></div>",
    # no main text
    "{x1}", "<p>{x1}</p>", f"{_MENU}{_FOOTER}", f"<nav><a href=/>{{x1}}</a></nav>", f"{_LINKS}<p>{{x3}}</p>{_LINKS}{_FOOT}", f"{_COOKIES}{_FOOTER}",
]
