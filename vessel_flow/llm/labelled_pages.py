"""Labelled pages for the content model: templates in which ``data-y`` marks
the subtrees that are the article (1) or not (0).  Marks are inherited; pages
start unmarked (0).  ``{h}`` a heading, ``{p}`` a long, ``{s}`` a short
paragraph's text, ``{l}`` a list of links, ``{w}`` a word, ``{n}`` a name that
tells nothing."""

from __future__ import annotations

import random
import re

# what stands around an article, by the part it plays
_AROUND = [
    '<nav><ul>{l}</ul></nav>',
    '<nav class="navbar" role="navigation"><ul class="nav">{l}</ul></nav>',
    '<header><a href="/">{w}</a><p>{s}</p></header>',
    '<header id="masthead" class="site-header"><h1>{w}</h1><p>{s}</p></header>',
    '<div class="menu"><ul>{l}</ul></div>',
    '<div id="topmenu" class="main-menu"><ul>{l}</ul></div>',
    '<div class="ad">{s}</div>',
    '<div class="ads"><p>{s}</p></div>',
    '<div class="advert"><a href="/x">{s}</a></div>',
    '<aside class="advertisement sponsored"><p>{s}</p></aside>',
    '<div class="banner promo">{s}</div>',
    '<div class="cookie notice"><p>{s}</p></div>',
    '<div id="cookie-banner" class="consent">{p}</div>',
    '<div class="notice"><p>{s}</p></div>',
    '<div class="alert" role="alert">{s}</div>',
    '<div class="popup modal">{s}</div>',
    '<div class="breadcrumbs"><a href="/">{w}</a> <a href="/a">{w}</a></div>',
    '<form action="/search"><p>{w}</p><input name="q"></form>',
    '<form class="login"><label>{w}</label><p>{s}</p></form>',
    '<div class="newsletter signup"><p>{s}</p><form><p>{w}</p></form></div>',
    '<aside><p>{s}</p><ul>{l}</ul></aside>',
    '<aside class="sidebar"><h3>{w}</h3><p>{p}</p></aside>',
    '<div class="sidebar widget"><h2>{w}</h2><ul>{l}</ul><p>{s}</p></div>',
    '<div class="related"><h3>{w}</h3><ul>{l}</ul></div>',
    '<div class="share social"><ul>{l}</ul></div>',
    '<div class="tags"><ul>{l}</ul></div>',
    '<section id="comments" class="comments"><h3>{w}</h3><div class="comment"><p>{p}</p></div><div class="comment">'
    '<p>{s}</p></div></section>',
    '<div class="comments"><p class="comment">{s}</p><p class="comment">{p}</p></div>',
    '<div id="comments"><ul><li><p>{s}</p></li><li><p>{p}</p></li></ul></div>',
    '<ol class="commentlist"><li class="reply"><p>{s}</p></li></ol>',
    '<footer>&copy; {w} &middot; {s}</footer>',
    '<footer class="site-footer"><p>{s}</p><ul>{l}</ul></footer>',
    '<div id="footer" class="footer"><p>{p}</p></div>',
    '<div class="copyright legal">{s}</div>',
    '<section class="comments"><p>{p}</p><p>{p}</p></section>',
    '<section id="discussion" class="comment-thread"><h2>{w}</h2><p>{p}</p></section>',
    '<div class="comment-list"><div class="comment"><p>{p}</p></div></div>',
    '<div class="ad"><p>{p}</p></div>',
    '<aside class="newsletter"><h3>{w}</h3><p>{p}</p></aside>',
    '<div class="sidebar"><p>{p}</p><p>{p}</p></div>',
]
_ARTICLE = [
    '<article data-y="1"><h1>{h}</h1><p>{p}</p><p>{s}</p><p>{p}</p></article>',
    '<article data-y="1"><h1>{h}</h1><p>{s}</p></article>',
    '<article data-y="1"><h1>{h}</h1><p>{s}</p><p>{s}</p>{in}</article>',
    '<article data-y="1">{in}<h1>{h}</h1><p>{w}</p>{in}<p>{s}</p></article>',
    '<article data-y="1"><p>{s}</p></article>',
    '<article data-y="1"><h1>{h}</h1></article>',
    '<main data-y="1"><h1>{h}</h1><p>{s}</p>{in}<p>{w}</p></main>',
    '<div class="content" data-y="1"><h1>{h}</h1><p>{s}</p>{in}<p>{s}</p></div>',
    '<article data-y="1"><h1>{h}</h1><p>{p}</p>{in}<p>{p}</p><p>{s}</p></article>',
    '<article class="post" data-y="1"><h1>{h}</h1><h2>{h}</h2><p>{p}</p><ul><li>{s}</li><li>{p}</li></ul></article>',
    '<main><article data-y="1"><h1>{h}</h1><p>{p}</p><blockquote>{s}</blockquote><pre>{s}</pre></article></main>',
    '<main id="main" data-y="1"><h1>{h}</h1><section><h2>{h}</h2><p>{p}</p><p>{s}</p></section></main>',
    '<div class="content" data-y="1"><h1>{h}</h1><p>{p}</p><p>{p}</p>{in}<p>{s}</p></div>',
    '<div id="content"><div class="post" data-y="1"><h2>{h}</h2><div class="entry">{p}</div></div></div>',
    '<div class="article-body" data-y="1"><p>{s}</p><p>{p}</p><table><tr><th>{w}</th><td>{w}</td></tr><tr><td>{w}'
    '</td><td>{s}</td></tr></table><p>{p}</p></div>',
    '<div class="main text story" data-y="1"><h1>{h}</h1><p>{p}</p><figure><figcaption>{s}</figcaption></figure>'
    '<ol><li>{s}</li><li>{s}</li></ol></div>',
    '<div id="wrapper"><div id="page"><div class="body" data-y="1"><h1>{h}</h1><p>{p}</p><dl><dt>{w}</dt><dd>{s}</dd>'
    '</dl><p>{s}</p></div></div></div>',
    '<section class="article" data-y="1"><h1>{h}</h1><p>{p}</p><h3>{h}</h3><p>{s}</p><p>{s}</p></section>',
    '<div data-y="1"><h1>{h}</h1><p>{p}</p><p>{p}</p><p>{p}</p></div>',
]
# less usual forms: single paragraphs, roles, forms inside, wrappers without a name
_ARTICLE += [
    '<main data-y="1"><p>{p}</p></main>',
    '<main data-y="1"><p>{s}</p><p>{s}</p></main>',
    '<main data-y="1"><div><p>{p}</p></div></main>',
    '<main data-y="1">{p}</main>',
    '<div role="main" data-y="1"><p>{p}</p></div>',
    '<div role="main" data-y="1"><h1>{h}</h1><p>{s}</p></div>',
    '<div role="article" data-y="1"><p>{p}</p><p>{s}</p></div>',
    '<section role="main" data-y="1"><h2>{h}</h2><p>{p}</p></section>',
    '<article data-y="1"><p>{p}</p></article>',
    '<article data-y="1">{p}</article>',
    '<article data-y="1"><p>{p}</p><form data-y="0"><p>{w}</p></form></article>',
    '<article data-y="1"><h1>{h}</h1><form data-y="0" action="/s"><label>{w}</label><p>{s}</p></form><p>{s}</p><p>{p}</p></article>',
    '<main data-y="1"><p>{p}</p><form data-y="0" class="subscribe"><p>{s}</p><button>{w}</button></form><p>{s}</p></main>',
    '<article data-y="1"><header><h1>{h}</h1><p>{s}</p></header><p>{p}</p><footer data-y="0"><p>{s}</p></footer></article>',
    '<article data-y="1"><div><div><p>{p}</p></div><div><p>{s}</p></div></div></article>',
    '<div><div><div data-y="1"><h1>{h}</h1><div><p>{p}</p><p>{s}</p></div></div></div></div>',
    '<div data-y="1"><p>{p}</p><p>{p}</p></div>',
    '<div data-y="1"><h2>{h}</h2><p>{p}</p></div>',
    '<section data-y="1"><p>{p}</p><p>{p}</p></section>',
    '<section data-y="1"><h1>{h}</h1><div><p>{s}</p><p>{p}</p></div></section>',
    '<div id="main-content" data-y="1"><p>{p}</p></div>',
    '<div class="entry-content" data-y="1"><p>{s}</p><h3>{h}</h3><p>{p}</p></div>',
    '<div class="post-body" data-y="1"><p>{p}</p><ul><li>{s}</li><li>{s}</li></ul></div>',
    '<div class="story text" data-y="1">{p}<br>{p}</div>',
    '<table><tr><td><ul>{l}</ul></td><td class="main" data-y="1"><h1>{h}</h1><p>{p}</p></td></tr></table>',
    '<div class="x7 k2" data-y="1"><h1>{h}</h1><p>{p}</p><p>{s}</p></div>',
    '<div id="c14" data-y="1"><p>{p}</p><p>{p}</p><p>{s}</p></div>',
    '<article data-y="1"><h1>{h}</h1><p class="lead intro">{s}</p><p>{p}</p><p class="byline">{s}</p></article>',
    '<main data-y="1"><h1>{h}</h1><p>{p}</p><aside data-y="0"><p>{s}</p></aside><p>{p}</p></main>',
    '<main data-y="1"><article><p>{p}</p></article><article><p>{s}</p></article></main>',
    '<p data-y="1">{p}</p><p data-y="1">{p}</p>',
    '<p data-y="1">{p}</p>',
    '<article data-y="1"><h1>{h}</h1><p>{p}</p><form data-y="0"><label>{w}</label><input name="q"></form><p>{p}</p></article>',
    '<article data-y="1"><p>{s}</p><form data-y="0">{w} <input name="q"><button>{w}</button></form><p>{s}</p></article>',
    '<main data-y="1"><p>{p}</p><form data-y="0"><p>{s}</p><select><option>{w}</select></form></main>',
    '<div role="main" data-y="1"><p>{s}</p></div>',
    '<div role="main" data-y="1"><p>{p}</p><p>{p}</p></div>',
    '<div role="main" class="{n}" data-y="1"><div><p>{p}</p></div></div>',
    '<div class="main" data-y="1"><p>{p}</p></div>',
    '<h1 data-y="1">{h}</h1><p data-y="1">{p}</p><p data-y="1">{s}</p><p data-y="1">{p}</p>',
    '<h2 data-y="1">{h}</h2><p data-y="1">{p}</p><ul data-y="1"><li>{s}</li><li>{s}</li></ul><p data-y="1">{p}</p>',
    '<div id="content" data-y="1"><p>{p}</p></div>',
    '<div id="content" data-y="1"><p>{s}</p><p>{p}</p></div>',
    '<div class="content" data-y="1"><p>{p}</p></div>',
    '<div class="{n}" data-y="1"><p>{p}</p><p>{p}</p></div>',
    '<div class="{n}"><div class="{n}" data-y="1"><h1>{h}</h1><p>{p}</p></div></div>',
    '<section class="{n}" data-y="1"><p class="{n}">{p}</p><p class="{n}">{s}</p></section>',
    '<article class="{n}" data-y="1"><div class="{n}"><p>{p}</p></div><div class="{n}"><p>{s}</p></div></article>',
    '<main id="{n}" data-y="1"><div class="{n}"><p>{s}</p><p>{s}</p></div></main>',
]
# inline elements with a name: part of the text, or an advert in the middle of it
_WORDS_INLINE = ['<span class="{n}">{s}</span>', '<a class="{n}" href="/a">{w}</a>', '<em id="{n}">{w}</em>', '<b class="{n}">{s}</b>',
                 '<code class="{n}">{w}</code>', '<span id="{n}">{w}</span>']
_NAMES = "highlight term note ref link word name quote mark date price key x1 k9 lang abbr value em-1 title author lead".split()
_ADS_INLINE = ['<span class="ad" data-y="0">{s}</span>', '<span class="ads sponsored" data-y="0">{s}</span>',
               '<a class="advert promo" data-y="0" href="/x">{s}</a>', '<span class="advertisement" data-y="0">{w}</span>',
               '<span class="share social" data-y="0">{w}</span>', '<a class="banner" data-y="0" href="/b">{w}</a>']
_SYLLABLES = "an the er on re ha st in ou ti ed or es la mi do sa ve lo ru".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(n))


def _fill(template: str, r: random.Random) -> str:
    while "{in}" in template:  # now and then a part that is not content stands inside the article
        part = re.sub(r"^<(\w+)", r'<\1 data-y="0"', r.choice(_AROUND)) if r.random() < 0.6 else ""
        template = template.replace("{in}", part, 1)
    for mark in ("{p}", "{s}"):
        at = 0
        while (at := template.find(mark, at)) >= 0:
            roll = r.random()
            more = ""
            if roll < 0.25:
                more = " " + r.choice(_WORDS_INLINE).replace("{n}", r.choice(_NAMES) if r.random() < 0.3 else "{n}") + " {w}"
            elif roll < 0.4:
                more = " " + r.choice(_ADS_INLINE) + " {w}"
            template = template[:at + len(mark)] + more + template[at + len(mark):]
            at += len(mark) + len(more)
    out = template
    makers = {"{h}": lambda: _words(r, r.randint(2, 10)), "{p}": lambda: _words(r, r.randint(12, 90)) + ".",
              "{s}": lambda: _words(r, r.randint(1, 12)) + ".", "{w}": lambda: _words(r, r.randint(1, 2)),
              "{n}": lambda: _words(r, 1) + _words(r, 1),  # a name that tells nothing
              "{l}": lambda: "".join(f'<li><a href="/{i}">{_words(r, r.randint(1, 3))}</a></li>'
                                     for i in range(r.randint(2, 7)))}
    for mark, make in makers.items():
        while mark in out:
            out = out.replace(mark, make(), 1)
    return out


def pages(n: int = 240, seed: int = 7) -> list[str]:
    """``n`` pages, each article form and every surrounding part among them."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        parts = [_AROUND[(5 * k + j * 7) % len(_AROUND)] for j in range(r.randint(2, 7))]
        at = r.randint(1, len(parts))
        body = parts[:at] + [_ARTICLE[k % len(_ARTICLE)]] + parts[at:]
        out.append("<!DOCTYPE html><html><head><title>x</title></head><body>"
                   + "".join(_fill(x, r) for x in body) + "</body></html>")
    return out
