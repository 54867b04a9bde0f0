"""The small labelled table that the tree of ``larkspur.llm.extract`` is fitted on: invented pages whose main text stands in elements marked data-main.

Pages are put together from a few parts in every wrapping in which such parts occur, with texts
of the same lengths on either side, so that length alone tells nothing where an element's role does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

_WORDS = "river stone market early window garden seven letters carry north music paper winter bridge silent harbour orange travel simple doctor yellow morning".split()

#: Words of a paragraph, from a single one to long ones.
_LENGTHS = (1, 2, 3, 5, 8, 12, 16, 21, 25, 28, 32, 38, 45, 55, 70, 95, 140)


class _Text:
    def __init__(self, seed: int):
        self.seed = count(seed)

    def say(self, n: int) -> str:
        start = next(self.seed) * 7
        return " ".join(_WORDS[(start + i * (1 + start % 5)) % len(_WORDS)] for i in range(n)).capitalize() + ("." if n > 3 else "")

    def linked(self, n: int, of: int) -> str:
        return f'{self.say(of - n)} <a href="/x">{self.say(n)}</a>' if n < of else f'<a href="/x">{self.say(n)}</a>'


def _wrapped(role: str, way: int, inside: str) -> str:
    """One part of a page in one of the ways in which pages wrap it; way 2 is a bare division."""
    ways = {
        "menu": (f"<nav>{inside}</nav>", f'<div class="main-menu">{inside}</div>', f'<div role="navigation">{inside}</div>'),
        "header": (f"<header>{inside}</header>", f'<div id="site-header">{inside}</div>', f'<div role="banner">{inside}</div>'),
        "footer": (f"<footer>{inside}</footer>", f'<div class="footer">{inside}</div>', f'<div role="contentinfo">{inside}</div>'),
        "side": (f"<aside>{inside}</aside>", f'<div class="sidebar">{inside}</div>', f'<section class="related">{inside}</section>'),
        "notice": (f'<div class="cookie-notice">{inside}</div>', f'<div role="alert">{inside}</div>', f'<p class="notice">{inside}</p>'),
        "advert": (f'<div class="ad">{inside}</div>', f'<div id="advert-top">{inside}</div>', f'<section class="sponsored">{inside}</section>'),
        "form": (f"<form>{inside}</form>", f'<div class="newsletter">{inside}</div>', f'<form action="/s"><label>{inside}</label></form>'),
        "comments": (f'<section class="comments">{inside}</section>', f'<div id="comments">{inside}</div>', f'<ol class="commentlist"><li>{inside}</li></ol>'),
        "unseen": (f"<div hidden>{inside}</div>", f'<div style="display:none">{inside}</div>', f"<noscript>{inside}</noscript>"),
        "article": (f"<article data-main>{inside}</article>", f'<div class="post-content" data-main>{inside}</div>', f"<main data-main>{inside}</main>"),
    }
    return ways[role][way]


def _boilerplate(role: str, way: int, t: _Text, n: int) -> str:
    other = _LENGTHS[(n * 5 + way) % len(_LENGTHS)]
    if role == "menu":
        inside = f"<ul>{''.join(f'<li>{t.linked(k, k)}</li>' for k in (1, 2, n))}</ul>" + f"<div>{t.say(other)}</div>" * (n % 2)
    elif role == "comments":
        inside = f"<h3>{t.say(2)}</h3><p>{t.say(n)}</p><p>{t.say(other)}</p>"
    elif role in ("side", "footer", "header"):
        inside = f"<h2>{t.say(n % 4 + 1)}</h2><p>{t.say(n)}</p><p>{t.linked(2, 4)}</p><p>{t.say(other)}</p>"
    else:
        inside = f"<p>{t.say(n)}</p>" if (role, way) != ("notice", 2) else t.say(n)
    return _wrapped(role, way, inside)


def _article(t: _Text, first: int, *, listed: bool = False) -> str:
    order = [_LENGTHS[(first + 4 * i) % len(_LENGTHS)] for i in range(6)]
    parts = [f"<h1>{t.say(6)}</h1>", *(f"<p>{t.say(n)}</p>" for n in order[:3]), f"<h2>{t.say(3)}</h2>", f"<p>{t.linked(order[3] // 2 + 1, order[3] + 1)}</p>", *(f"<p>{t.say(n)}</p>" for n in order[4:])]
    if listed:
        parts.insert(4, f"<ul><li>{t.say(1)}</li><li>{t.say(5)}</li><li>{t.linked(3, 3)}</li></ul>")
    return "".join(parts)


def pages() -> Iterator[str]:
    """The labelled pages, always the same."""
    roles = ("menu", "header", "footer", "side", "notice", "advert", "form", "comments", "unseen")
    for way in range(3):
        for k, n in enumerate(_LENGTHS):
            t = _Text(100 * way + 10 * k)
            part = {r: _boilerplate(r, (way + i) % 3, t, _LENGTHS[(k + i) % len(_LENGTHS)]) for i, r in enumerate(roles)}
            text = _wrapped("article", way, _article(t, k, listed=k % 2 == 0))
            for i in range(3):
                around = [part[roles[(j * (i + 1) + k) % len(roles)]] for j in range(len(roles))]
                yield "<body>" + "".join(around[: 3 + k % 4]) + text + "".join(around[3 + k % 4 :]) + "</body>"
            # side matter inside the article, and an article's own header: its heading stays, its other lines go
            inside = [r for r in roles if r != "header"]
            inner = part[inside[(k + way) % len(inside)]]
            before = (part["menu"], part["advert"], "")[k % 3]
            yield f"<body>{before}<article><header><h1 data-main>{t.say(1 + k % 9)}</h1><p>{t.say(n)}</p></header><div data-main><p>{t.say(n)}</p><p>{t.say(30)}</p></div>{inner}<div data-main><p>{t.say(2)}</p></div><footer><p>{t.say(n)}</p></footer></article></body>"
            # no roles at all: words and links of a block and its neighbours have to tell
            links = "".join(f"<div>{t.linked(m, m)}</div>" for m in (1, 2, 3, n)) if k % 2 else f"<ul>{''.join(f'<li>{t.linked(m, m)}</li>' for m in (1, 2, 3, n))}</ul>"
            long = _LENGTHS[8 + k % 9]
            heading = f"<h{1 + k % 3}>{t.say(1 + (k * 5 + way) % 9)}</h{1 + k % 3}>" if k % 4 else ""
            for i in range(3):
                paragraphs = [_LENGTHS[8 + (k + 2 * i) % 9], n, _LENGTHS[8 + (k + 5 + i) % 9], _LENGTHS[(k * 3 + i) % len(_LENGTHS)], _LENGTHS[8 + (k * 7 + i) % 9]]
                yield f"<body><div>{t.say(1 + i)}</div>{links if (k + i) % 3 else ''}<div data-main>{heading}{''.join(f'<p>{t.linked(3, m) if m > 20 and m % 2 else t.say(m)}</p>' for m in paragraphs[i:])}</div>{links if (k + i) % 2 else ''}<div>{t.say(1 + (k + i) % 7)}</div></body>"
            # an article and nothing else, short or long, and bare paragraphs and nothing else
            yield f"<body>{_wrapped('article', way, f'<p>{t.say(n)}</p>')}</body>"
            yield f"<body>{_wrapped('article', way, f'<ul><li>{t.linked(n, n)}</li><li>{t.say(n)}</li></ul><p>{t.linked(n, n)}</p>')}</body>"
            for i in range(4):
                mixed = "".join(f"<p>{t.linked(m, m) if (j + i) % 2 else t.say(m)}</p>" for j, m in enumerate(_LENGTHS[(k * 3 + 5 * i + j * (i + 1)) % len(_LENGTHS)] for j in range(9)))
                yield f"<body><div>{t.say(1 + i)}</div>{_wrapped('article', (way + i) % 3, mixed)}<div>{t.say(4 - i)}</div></body>"
            yield f"<body><div data-main><p>{t.say(_LENGTHS[3 + k % 9])}</p><p>{t.say(long)}</p><p>{t.say(n)}</p><p>{t.say(long)}</p></div></body>"
            # long boilerplate beside bare paragraphs
            yield f"<body>{part['menu']}<div data-main><p>{t.say(long)}</p><p>{t.say(_LENGTHS[8 + (k + 2) % 9])}</p></div>{part['comments']}{part['side']}{part['footer']}</body>"
