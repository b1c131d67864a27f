"""Seeded page layouts with known main text, to train the block classifier on.

Layouts vary in the elements and class names used, in what surrounds the article and what stands within
it, in lengths, and in faults (unclosed tags). Text of the article starts with MARK, which training strips.
"""

from __future__ import annotations

import random

MARK = ""
_SYLLABLES = "ba de ki lo mu ra se ti vo ne ar en is ol un".split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))


def _label(rng: random.Random) -> str:
    """A word or a few as they stand in links: any case, with or without punctuation."""
    text = " ".join(_word(rng) for _ in range(rng.choice([1, 1, 1, 2, 3, 4])))
    return rng.choice([str, str, str.capitalize, str.title, str.upper])(text) + rng.choice(["", "", "", ",", ".", "!", "...", "&amp;", "###"])


def _sentence(rng: random.Random, least: int = 4, most: int = 22) -> str:
    words = [_word(rng) for _ in range(rng.randint(least, most))]
    if rng.random() < 0.3:
        words[len(words) // 2] += ","
    if rng.random() < 0.06:
        words = [w + rng.choice(["***", "&amp;&amp;&amp;", "###", "!!", ",", "."]) for w in words]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])


def _prose(rng: random.Random, least: int = 1, most: int = 8) -> str:
    return " ".join(_sentence(rng) for _ in range(rng.randint(least, most)))


def _inline(rng: random.Random, text: str) -> str:
    words = text.split(" ")
    for _ in range(rng.choice([0, 0, 1, 2])):
        k = rng.randrange(len(words))
        words[k] = rng.choice(["<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<span>{}</span>", "<code>{}</code>", "{} <button>Copy</button>"]).format(words[k])
    return " ".join(words)


def _attr(rng: random.Random, names: str, chance: float = 0.75) -> str:
    if rng.random() > chance:
        return rng.choice(["", f' class="{_word(rng)}"', f' id="{_word(rng)}{rng.randint(1, 99)}"'])
    name = rng.choice(names.split())
    name = rng.choice([name, f"{name}-{_word(rng)}", f"{_word(rng)}-{name}", f"{name}Box", f"site-{name}"])
    return f' {rng.choice(["class", "class", "id"])}="{name}"'


def _wrap(rng: random.Random, tags: str, names: str, inner: str, chance: float = 0.75) -> str:
    tag = rng.choice(tags.split())
    sure = 0.95 if tag in ("div", "section", "p", "ul") else chance
    return f"<{tag}{_attr(rng, names, sure)}>{inner}</{tag}>"


def _links(rng: random.Random, least: int = 2, most: int = 12) -> str:
    items = [f'<a href="/{_word(rng)}">{_label(rng)}</a>' for _ in range(rng.randint(least, most))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.75 else rng.choice([" | ", " ", "<br>"]).join(items)


def _body_text(rng: random.Random) -> str:
    one = lambda: rng.choice([_sentence(rng, 2, 12), _sentence(rng), _prose(rng)])
    return "".join(f"<p>{one()}</p>" for _ in range(rng.randint(1, 4))) if rng.random() < 0.5 else one()


def _menu(rng: random.Random) -> str:
    return _wrap(rng, "nav nav div ul", "nav navbar menu navigation breadcrumb pagination topnav", _links(rng))


def _header(rng: random.Random) -> str:
    inner = f"<h1>{_sentence(rng, 1, 4)}</h1>" + rng.choice(["", f"<p>{_sentence(rng)}</p>", _menu(rng), _links(rng)])
    return _wrap(rng, "header header div", "header masthead banner branding", inner)


def _footer(rng: random.Random) -> str:
    inner = rng.choice([f"&copy; {_word(rng)} &middot; {_prose(rng, 1, 2)}", _body_text(rng), _links(rng) + f"<p>{_sentence(rng)}</p>", f"<p>&copy; {_sentence(rng)}</p>"])
    return _wrap(rng, "footer footer div", "footer foot copyright legal bottom", inner)


def _side(rng: random.Random) -> str:
    inner = f"<h3>{_sentence(rng, 1, 4)}</h3>" * (rng.random() < 0.7) + rng.choice([_links(rng), _body_text(rng), _links(rng) + _body_text(rng)])
    return _wrap(rng, "aside aside div section", "sidebar side rail widget secondary related recommended popular trending", inner)


def _advert(rng: random.Random) -> str:
    return _wrap(rng, "div div div aside p section", "ad ads advert advertisement sponsored promo promotion ad-slot", rng.choice([_sentence(rng, 1, 30), _prose(rng, 1, 3), f'<a href="/buy">{_sentence(rng)}</a>', _body_text(rng)]))


def _notice(rng: random.Random) -> str:
    inner = rng.choice([_prose(rng, 1, 3), f"<p>{_prose(rng, 1, 3)}</p>"]) + "<button>Accept</button>" * (rng.random() < 0.6)
    return _wrap(rng, "div div section p", "notice cookie cookie-banner consent gdpr alert warning popup modal overlay", inner)


def _form(rng: random.Random) -> str:
    inner = f"<label>{_sentence(rng, 1, 5)}</label><input name=q>" + rng.choice(["", f"<p>{_sentence(rng)}</p>", f"<h3>{_sentence(rng, 1, 5)}</h3>"]) + "<button>Send</button>"
    return _wrap(rng, "form form div", "form search login newsletter signup subscribe", inner)


def _comments(rng: random.Random) -> str:
    one = lambda: _wrap(rng, "div li article p", "comment reply response", rng.choice([_prose(rng, 1, 5), f"<p>{_prose(rng, 1, 5)}</p>", f"<h4>{_word(rng)}</h4><p>{_prose(rng, 1, 4)}</p>"]), 0.9)
    inner = f"<h3>{_sentence(rng, 1, 3)}</h3>" * (rng.random() < 0.6) + "".join(one() for _ in range(rng.randint(1, 6)))
    return _wrap(rng, "section div div ul", "comments comment-list discussion responses replies disqus reader-comments", inner, 0.97)


def _share(rng: random.Random) -> str:
    return _wrap(rng, "div ul p", "share sharing social follow tags author byline meta", rng.choice([_links(rng, 1, 6), _sentence(rng, 1, 6)]))


def _block(rng: random.Random) -> str:
    """A block of the article."""
    mark = lambda x: MARK + x
    kind = rng.random()
    if kind < 0.7:
        return f"<p>{mark(_inline(rng, rng.choice([_sentence(rng, 1, 8), _prose(rng), _prose(rng, 2, 14)])))}" + "</p>" * (rng.random() < 0.93)
    if kind < 0.78:
        return f"<h2>{mark(_sentence(rng, 1, 8))}</h2>"
    if kind < 0.85:
        return "<ul>" + "".join(f"<li>{mark(_inline(rng, _sentence(rng)))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
    if kind < 0.9:
        return f"<blockquote>{rng.choice(['<p>', ''])}{mark(_prose(rng, 1, 3))}</blockquote>"
    if kind < 0.94:
        return "<table>" + "".join("<tr>" + "".join(f"<td>{mark(_sentence(rng, 1, 5))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
    if kind < 0.97:
        return f"<figure><img src=a.png><figcaption>{mark(_sentence(rng))}</figcaption></figure>"
    return f"<div>{mark(_inline(rng, _prose(rng)))}</div>"


def page(rng: random.Random) -> str:
    title = _sentence(rng, 2, 12)
    body = [f"<h1>{MARK}{title}</h1>"] * (rng.random() < 0.9)
    if rng.random() < 0.3:
        body.append(f"<p><b>{MARK}{title}" + rng.choice(["<br>", "</b></p>"]))
    body += [_block(rng) for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 14, 25]))]
    for extra, chance in ((_advert, 0.25), (_share, 0.2), (_menu, 0.07), (_side, 0.1), (_form, 0.1), (_notice, 0.08), (_comments, 0.1)):
        if rng.random() < chance:
            body.insert(rng.randint(1 if body else 0, len(body)), extra(rng))
    style = rng.random()
    article = "".join(body)
    if style < 0.55:
        article = f"<article{_attr(rng, 'post article entry', 0.4)}>{article}</article>"
    elif style < 0.9:
        article = f"<div{_attr(rng, 'content article post entry-content story main-content body-text')}>{article}</div>"
    if rng.random() < 0.4:
        article = _wrap(rng, "main div section", "main content page wrapper container", article, 0.5)
    before = [f(rng) for f, c in ((_header, 0.4), (_menu, 0.8), (_notice, 0.3), (_advert, 0.5), (_form, 0.2), (_side, 0.15)) if rng.random() < c]
    after = [f(rng) for f, c in ((_share, 0.2), (_comments, 0.4), (_side, 0.4), (_advert, 0.2), (_form, 0.2), (_menu, 0.1), (_notice, 0.15)) if rng.random() < c]
    rng.shuffle(before)
    rng.shuffle(after)
    after += [_footer(rng)] * (rng.random() < 0.85)
    inner = "".join(before) + article + "".join(after)
    if rng.random() < 0.2:
        inner = f"<div{_attr(rng, 'page wrapper container site', 0.6)}>{inner}</div>"
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{inner}" + "</body></html>" * (rng.random() < 0.9)


def pages(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
