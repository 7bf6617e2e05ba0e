"""Pages with known labels, made from a rule, for fitting the block classifier of operator 2.

Every page has a menu, a header, an article and some of the other regions that pages have. Regions are marked by
an element, by a class or id, by both or not at all, and some marks mislead, so that the fitted weights
learn how far each kind of evidence can be trusted.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from .html_extract import REGIONS

_LETTERS = "eeeeaaaoooiiuttnnssrrhlldcmpgbfyw"


class _Writer:
    """Writes one page and remembers the label of every text in it."""

    def __init__(self, rng: random.Random, unmarked: float):
        self.rng, self.unmarked, self.labels = rng, unmarked, {}

    def words(self, least: int, most: int, sentence: bool) -> str:
        n = self.rng.randint(least, most)
        words = ["".join(self.rng.choices(_LETTERS, k=self.rng.randint(2, 9))) for _ in range(n)]
        for k in range(n - 1):
            if sentence and self.rng.random() < 0.12:
                words[k] += self.rng.choice(",,,.;")
        text = " ".join(words).capitalize()
        return text + self.rng.choice(".....!?") if sentence else text

    def text(self, label: int, least: int, most: int, sentence: bool = True, link: float = 0.0) -> str:
        text = self.words(least, most, sentence)
        self.labels[text] = label
        if self.rng.random() < link:
            return f'<a href="/x">{text}</a>'
        if len(text) > 60 and self.rng.random() < 0.2:
            first, rest = text.split(" ", 1)
            return f'{first} <a href="/y">{rest[:20]}</a>{rest[20:]}' if rest[20:21] else text
        return text

    def region(self, kind: str, inside: str, plain: str = "div", unmarked: float = 0.15) -> str:
        """The inside within an element that tells its kind by name, by class, both, or not."""
        tags, roles, names = (x.split() for x in REGIONS[kind])
        rng, attributes, tag = self.rng, "", plain
        if rng.random() > unmarked * self.unmarked:
            if tags and rng.random() < 0.6:
                tag = tags[0]
            if tag == plain or rng.random() < 0.4:
                name = rng.choice(names) + rng.choice(("", "-box", "_1", "Area"))
                attributes = f' {rng.choice(("class", "id"))}="{name}"'
            elif roles and rng.random() < 0.2:
                attributes = f' role="{roles[0]}"'
        elif rng.random() < 0.5:
            attributes = f' class="{rng.choice(("box", "row", "col-2", "wrap", "inner"))}"'
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def links(self, n: int) -> str:
        items = "".join(f"<li>{self.text(0, 1, 4, False, 0.95)}</li>" for _ in range(n))
        return f"<ul>{items}</ul>" if self.rng.random() < 0.8 else items.replace("li>", "span> ").replace("</span> ", "</span>")

    def paragraphs(self, label: int, n: int, least: int = 1, most: int = 90) -> str:
        return "".join(f"<p>{self.text(label, least, self.rng.choice((4, 12, 40, most)) + least)}</p>" for _ in range(n))

    def article(self) -> str:
        rng = self.rng
        parts = [f"<h1>{self.text(1, 2, 9, rng.random() < 0.3)}</h1>"] if rng.random() < 0.7 else []
        for _ in range(rng.randint(1, 7)):
            kind = rng.random()
            if kind < 0.68:
                parts.append(self.paragraphs(1, rng.randint(1, 4)))
            elif kind < 0.76:
                parts.append(f"<h2>{self.text(1, 1, 6, False)}</h2>")
            elif kind < 0.84:
                parts.append("<ul>%s</ul>" % "".join(f"<li>{self.text(1, 2, 25, rng.random() < 0.6)}</li>" for _ in range(rng.randint(2, 5))))
            elif kind < 0.89:
                parts.append(f"<blockquote>{self.text(1, 4, 50)}</blockquote>")
            elif kind < 0.93:
                parts.append("<table>%s</table>" % "".join(f"<tr><td>{self.text(1, 1, 3, False)}<td>{self.text(1, 1, 6, False)}</tr>" for _ in range(rng.randint(2, 4))))
            elif kind < 0.96:
                parts.append(f"<pre>{self.text(1, 3, 20, False)}</pre>")
            else:
                parts.append(self.text(1, 3, 40))  # text without an element of its own
        inside = "".join(parts)
        if rng.random() < 0.15:
            inside += self.region("share", self.links(rng.randint(2, 4)), unmarked=0.0)
        if rng.random() < 0.1:
            inside += self.region("advert", f"<p>{self.text(0, 3, 25)}</p>", unmarked=0.05)
        if rng.random() < 0.15:  # controls and adverts between the paragraphs
            at = rng.randint(0, len(parts))
            odd = rng.choice((f"<button>{self.text(0, 1, 2, False)}</button>", f"<label>{self.text(0, 1, 3, False)}</label><input>", self.region("advert", self.text(0, 3, 25), unmarked=0.0)))
            inside = "".join(parts[:at]) + odd + inside[len("".join(parts[:at])) :]
        return self.region("content", inside, unmarked=0.25)

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.03:  # text alone
            return self.text(1, 3, 90) if rng.random() < 0.5 else f"<html><body>{self.paragraphs(1, rng.randint(1, 4))}</body></html>"
        before = [self.region("menu", self.links(rng.randint(2, 8)))]
        if rng.random() < 0.6:
            name = rng.choice(("p", "p", "div", "h1"))
            before.insert(0, self.region("header", f"<{name}>{self.text(0, 1, 5, False, 0.5)}</{name}><p>{self.text(0, 2, 10)}</p>"))
        if rng.random() < 0.3:
            before.append(self.region("notice", f"<p>{self.text(0, 6, 40)}</p><button>{self.text(0, 1, 2, False)}</button>", unmarked=0.05))
        if rng.random() < 0.4:
            before.append(self.region("advert", self.text(0, 2, 25), unmarked=0.03))
        after = []
        if rng.random() < 0.4:
            after.append(self.region("side", f"<h3>{self.text(0, 1, 4, False)}</h3>{self.links(rng.randint(2, 6))}" + (self.paragraphs(0, rng.randint(1, 2)) if rng.random() < 0.4 else ""), unmarked=0.05))
        if rng.random() < 0.35:
            after.append(self.region("form", f"<p>{self.text(0, 4, 25)}</p><label>{self.text(0, 1, 3, False)}</label><input><button>{self.text(0, 1, 2, False)}</button>", unmarked=0.03))
        if rng.random() < 0.4:
            each = "".join(f"<div><b>{self.text(0, 1, 2, False)}</b>{self.paragraphs(0, rng.randint(1, 2), 2, 60)}</div>" for _ in range(rng.randint(1, 6)))
            if rng.random() < 0.5:
                title, told = self.text(0, 1, 3, False), 0.0
            else:  # a heading that says it, whose region may say nothing
                title, told = rng.choice(("{} Comments", "Comments ({})", "{} replies", "Comments")).format(rng.randint(1, 99)), 0.3
                self.labels[title] = 0
            after.append(self.region("comments", f"<{(h := rng.choice(('h2', 'h3', 'h4')))}>{title}</{h}>{each}", "section", unmarked=told))
        if rng.random() < 0.2:
            after.append(self.region("advert", f"<p>{self.text(0, 3, 30)}</p>", unmarked=0.03))
        after.append(self.region("footer", rng.choice(("<p>%s</p>", "%s")) % self.text(0, 3, 25, rng.random() < 0.5) + (self.links(rng.randint(2, 4)) if rng.random() < 0.4 else "")))
        body = "".join(before) + self.article() + "".join(after)
        if rng.random() < 0.08:
            body = f'<form action="/">{body}</form>'
        if rng.random() < 0.15:
            body = f'<div class="{rng.choice(("has-sidebar", "page with-comments", "no-ads", "header-fixed", "menu-open"))}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8, False)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int, unmarked: float = 1.0) -> Iterator[tuple[str, dict[str, int]]]:
    """Pages and, by text of a block, whether it is content (1) or boilerplate (0).

    unmarked: factor on the shares of regions that nothing tells apart.
    """
    rng = random.Random(seed)
    for _ in range(n):
        writer = _Writer(rng, unmarked)
        page = writer.page()
        yield page, writer.labels
