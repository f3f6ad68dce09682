"""Main texts of pages of many layouts, against what a reader would copy out."""

import pytest

from tessera.llm.html import Page

A = "The council met on Tuesday, and after a long debate it voted to rebuild the old bridge over the river."
B = "Work will begin in spring; the engineers expect it to take two years, and traffic will be led around the town."
C = "Residents had asked for it since the flood of 1997, which carried away the eastern arch."
H = "Bridge to be rebuilt"
R = "I think this is a waste of money, honestly, and I have said so in every meeting since the flood, again and again."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 The Town Paper. All rights reserved, of course.</footer>"
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Another story, number {k}</a></li>" for k in range(6)) + "</ul>"
BODY = f"<h1>{H}</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
FULL = f"{H} {A} {B} {C}"

LAYOUTS = {
    "article": (f"{NAV}<article>{BODY}</article>{FOOT}", FULL),
    "main": (f"{NAV}<main>{BODY}</main>{FOOT}", FULL),
    "content div": (f"{NAV}<div id=content>{BODY}</div><div class=sidebar>{LINKS}</div>{FOOT}", FULL),
    "nested divs": (f"{NAV}<div><div><div class=post-body>{BODY}</div></div></div>{FOOT}", FULL),
    "table layout": (f"<table><tr><td><a href=/>Home</a><br><a href=/x>Sport</a></td><td>{BODY}</td></tr></table>", FULL),
    "bare paragraphs": (f"{NAV}{BODY}{FOOT}", FULL),
    "heading beside the body": (f"{NAV}<div><h1>{H}</h1></div><div><p>{A}</p><p>{B}</p><p>{C}</p></div>{FOOT}", FULL),
    "lead beside the body": (f"{NAV}<h1>{H}</h1><p>{A}</p><div class=text><p>{B}</p><p>{C}</p><p>{B} {A}</p><p>{A} {C}</p><p>{B} {C} {B}</p></div>{FOOT}", f"{FULL} {B} {A} {A} {C} {B} {C} {B}"),
    "article with header": (f"{NAV}<article><header><h1>{H}</h1></header><p>{A}</p><p>{B}</p><p>{C}</p></article>{FOOT}", FULL),
    "comments after": (f"{NAV}<article>{BODY}</article><div class=comments><p>{R}</p><p>{R}</p></div>{FOOT}", FULL),
    "comments inside": (f"<article>{BODY}<section id=comments><p>{R}</p><p>{R} {R}</p></section></article>", FULL),
    "comment list inside": (f"<article>{BODY}<ol class=comment-list><li>{R}</li><li>{R}</li></ol></article>", FULL),
    "comments as articles": (f"{NAV}<article>{BODY}</article><section class=comments><article class=comment><p>{R}</p></article><article class=comment><p>{R} {R}</p></article></section>", FULL),
    "a longer comment as article": (f"{NAV}<article>{BODY}</article><div><article class=comment><p>{R} {R} {R} {R} {R}</p></article></div>", FULL),
    "more comments than article": (f"<article><h1>{H}</h1><p>{A}</p></article><div id=disqus><p>{R} {R}</p><p>{R} {R}</p><p>{R} {R}</p></div>", f"{H} {A}"),
    "share price": (f"{NAV}<div class=share-price>{BODY}</div>{FOOT}", FULL),
    "notice of motion": (f"<article><h1>{H}</h1><p>{A}</p><div class=ad-notice-of-motion><p>{B}</p></div><p>{C}</p></article>", FULL),
    "page with sidebar in its name": (f"<div class=has-sidebar>{NAV}<article>{BODY}</article></div>", FULL),
    "body of a no-sidebar theme": (f"<html><body class='sidebar no-nav'><div class=entry>{BODY}</div></body></html>", FULL),
    "advert": (f"<div class=ad>Buy now, it is cheap and good.</div><article>{BODY}</article>", FULL),
    "advert inside": (f"<article><h1>{H}</h1><p>{A}</p><div class=advertisement>Buy now, it is cheap.</div><p>{B}</p><p>{C}</p></article>", FULL),
    "cookie notice": (f"<div class=cookie-notice><p>We use cookies, as everyone does. Please agree.</p></div><article>{BODY}</article>", FULL),
    "link list inside": (f"<article><h1>{H}</h1><p>{A}</p><ul><li><a href=/1>The plan of 1998</a></li><li><a href=/2>The plan of 2011</a></li></ul><p>{B}</p><p>{C}</p></article>", f"{H} {A} The plan of 1998 The plan of 2011 {B} {C}"),
    "link list inside a div": (f"{NAV}<div class=story><h1>{H}</h1><p>{A}</p><ul><li><a href=/1>The plan of 1998</a></li></ul><p>{B}</p><p>{C}</p></div>{FOOT}", f"{H} {A} The plan of 1998 {B} {C}"),
    "related stories at the end": (f"<article>{BODY}{LINKS}</article>", FULL),
    "related box": (f"<article>{BODY}</article><div class=related-posts>{LINKS}</div>", FULL),
    "form": (f"<article>{BODY}<form><p>Your name, please.</p><input name=x></form></article>", FULL),
    "script and style": (f"<style>p {{a: b}}</style><article>{BODY}<script>var a = '<p>x</p>';</script></article>", FULL),
    "aside": (f"<article>{BODY}<aside><p>Also read: the flood of 1997, in pictures, by our staff.</p></aside></article>", FULL),
    "hidden": (f"<article>{BODY}<div style='display:none'><p>{R}</p></div></article>", FULL),
    "unclosed paragraphs": (f"<article><h1>{H}</h1><p>{A}<p>{B}<p>{C}</article>", FULL),
    "references and white space": (f"<article><h1>{H}</h1><p>Caf&eacute; &amp;  \n bar&#33; It was open, and full.</p><p>{A}</p></article>", f"{H} Caf\u00e9 & bar! It was open, and full. {A}"),
    "inline markup": (f"<article><p>{A[:20]}<b>{A[20:40]}</b><i>{A[40:]}</i></p><p>{B}</p></article>", f"{A} {B}"),
    "links in prose": (f"<article><p>{A} See <a href=/p>the plan</a>.</p><p>{B}</p></article>", f"{A} See the plan. {B}"),
    "definition list": (f"<article><h1>{H}</h1><p>{A}</p><dl><dt>Cost</dt><dd>Two million, at least.</dd></dl><p>{B}</p></article>", f"{H} {A} Cost Two million, at least. {B}"),
    "table of figures": (f"<article><h1>{H}</h1><p>{A}</p><table><tr><td>1997</td><td>flood</td></tr></table><p>{B}</p></article>", f"{H} {A} 1997 flood {B}"),
    "short article": (f"{NAV}<article><h1>{H}</h1><p>It will be rebuilt.</p></article>{FOOT}", f"{H} It will be rebuilt."),
    "hidden in a title": (f'<article><h1>{H}</h1><p title="A hidden gem of text">{A}</p><p data-x="how hidden = x">{B}</p><p style="color: red" alt="display: none">{C}</p></article>', FULL),
    "attribute hidden": (f"<article>{BODY}<div hidden><p>{R}</p></div><div class=x hidden=until-found><p>{R}</p></div><p style='color:red; DISPLAY : none'>{R}</p></article>", FULL),
    **{f"a section about {x}": (f"<article><h1>{H}</h1><p>{A}</p><section id={x}><h2>What was said</h2><p>{B}</p><p>{C}</p></section></article>{FOOT}", f"{H} {A} What was said {B} {C}") for x in ("discussion", "search", "related", "navigation", "menu", "notice", "sharing")},
    "discussion of readers": (f"<article>{BODY}<section id=discussion><h2>Discussion</h2><div class=comment><p>{R}</p></div><div class=comment><p>{R}</p></div></section></article>", FULL),
    "discussion as a list": (f"<article>{BODY}<section id=discussion><h2>Discussion</h2><ol><li>{R}</li><li>{R}</li></ol></section></article>", FULL),
    "related links with a heading": (f"<article>{BODY}<section id=related><h2>Related</h2>{LINKS}</section></article>", FULL),
    "newsletter with a heading": (f"<article>{BODY}<div id=newsletter><h3>News by mail</h3><p>Sign up now, it is free, and we never, ever share it.</p></div></article>", FULL),
    "two articles": (f"{NAV}<main><article><h1>{H}</h1><p>{A}</p><p>{B}</p></article><article><h2>More</h2><p>{C}</p><p>{B}</p></article></main>{FOOT}", f"{H} {A} {B} More {C} {B}"),
    "cards elsewhere": (f"{NAV}<main><article>{BODY}</article></main><div class=more><article><h3>Other</h3><p>{R}</p></article></div>{FOOT}", FULL),
    "a last paragraph that is a link": (f"<article>{BODY}<p><a href=/plan>Read the whole plan, with all its figures.</a></p></article>", f"{FULL} Read the whole plan, with all its figures."),
    "formula": (f"<article><h1>{H}</h1><p>{A} Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>{B}</p></article>", f"{H} {A} Here x=2 holds. {B}"),
    "without scripts": (f"<noscript>Please enable scripts, dear reader, for this page.</noscript><article><h1>{H}</h1><p>{A} <noscript>Seen without.</noscript></p><p>{B}</p></article>", f"{H} {A} Seen without. {B}"),
    "feedback": (f"{NAV}<div class=story>{BODY}</div><div class=feedback><p>{R}</p><p>{R}</p></div>{FOOT}", FULL),
    "only a menu": (NAV, ""),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    page, text = LAYOUTS[name]
    assert Page(page).main_text() == text


def test_a_page_of_many_blocks():
    many = "".join(f"<p>Paragraph {k}, which says little.</p>" for k in range(3000))
    assert Page(f"{NAV}<div>{many}</div>{FOOT}").main_text().count("Paragraph") == 3000
