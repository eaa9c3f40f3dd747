"""The small labelled table that the block classifier is trained on.

It holds no phrases of any site: a row tells the shape of a kind of block - how many words, how many of them function
words, names or numbers, what joins and what ends them - where it stands, whether it belongs to a site, an author or a
page, and its label. A layout rule with a fixed seed makes sites of one to forty pages out of these rows, in words made of
syllables, since a block is told by its neighbours and by its coming back as well.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

SYLLABLES = "ar bel cor dum es fin gal hus ib jo kel lor mes nuv op pel qui ras sum ter vor wen yst zan".split()
#: Function words of a made-up sentence, commonest first.
GLUE_WORDS = "the a of to and in is it that for on with as this was you by at from be are or not have which an they will when there has".split()

TEXT, FURNITURE = 0, 1


@dataclass(frozen=True)
class Shape:
    """A kind of block: ``words`` from and to, per sentence; ``sentences``; the share of function words; how likely a name or number is."""

    label: int
    words: tuple[int, int]
    sentences: tuple[int, int] = (1, 1)
    function: float = 0.4
    names: float = 0.05
    numbers: float = 0.03
    capital: bool = True  # the first word
    end: str = "."
    comma: float = 0.06
    scope: str = "page"  # site: the same on all pages of the site; author: on all pages of one of its authors


PARAGRAPH = Shape(TEXT, (9, 24), (2, 6))
BRIEF = Shape(TEXT, (8, 19), (1, 2))
HEADING = Shape(TEXT, (3, 8), function=0.35, names=0.12, end="")
INTRO = Shape(TEXT, (2, 7), function=0.4, names=0.15, end=":")
BARE_INTRO = Shape(TEXT, (2, 7), function=0.4, names=0.15, end="")
ITEM = Shape(TEXT, (2, 9), function=0.35, capital=False, end="", comma=0.1)
TERSE_ITEM = Shape(TEXT, (1, 4), function=0.1, capital=False, end="")
QUOTE = Shape(TEXT, (9, 20), (1, 3))
STUFFED = Shape(TEXT, (14, 60), function=0.03, names=0.02, capital=False, end="")

CONSENT = (Shape(FURNITURE, (5, 17), (1, 3), scope="site"), Shape(FURNITURE, (6, 16), (2, 5), scope="site"), Shape(FURNITURE, (12, 32), (2, 4), scope="site"))
PROMPT = (Shape(FURNITURE, (4, 12), names=0.08, scope="site"), Shape(FURNITURE, (2, 5), function=0.3, end="", scope="site"), Shape(FURNITURE, (1, 2), function=0.0, end="", scope="site"), Shape(FURNITURE, (3, 5), end="?", scope="site"))
NOTE = Shape(FURNITURE, (8, 16), names=0.06, scope="site")
BIO = Shape(FURNITURE, (6, 16), (1, 2), names=0.06, scope="author")
LEGAL = (Shape(FURNITURE, (4, 14), names=0.08, scope="site"), Shape(FURNITURE, (3, 8), function=0.25, numbers=0.2, names=0.25, scope="site"), Shape(FURNITURE, (9, 18), (2, 4), scope="site"), Shape(FURNITURE, (2, 5), function=0.2, names=0.3, end="", scope="site"))
WIDGET = Shape(FURNITURE, (1, 4), function=0.25, end="", scope="site")
RELATED = Shape(FURNITURE, (2, 3), function=0.25, end="", scope="site")
#: What joins the entries of a menu or of a line of links.
JOINTS = (" | ", " · ", " / ", " > ", " • ", "   ", "\t", "  |  ", " ~ ")
MARKS = ("", "- ", "» ", "* ", "{k}. ", "• ")
BYLINES = ("{f} {A} | {d} {M} {y} | {d} {w} {w}", "{F} {f} {A}", "{F} {f} {y}-0{k}-{d} {f} {A}", "{F} {f} {M} {f} {A} {f} {B}", "{F}: {A} / {F}: {B}", "{F} {w} {d} {M} {y}", "{f} {A}, {d}.{k}.{y}", "{A}, {S} {w}", "{d} {M} {y}", "{A}", "{M} {d}, {y} · {d} {w}")
TAGS = ("{F}: {w}, {x}, {t}", "{F} {f} {w}, {x}, {t}", "{F} {w}, {x}, {z}, {t}", "#{w} #{x} #{t}", "{F}: {W}, {X}")
COUNTS = ("{d},{d}{d} {w} · {d} {x}", "{F} {d} {f} {d}", "{F}: {k}/5 ({d} {w})", "{d} {w}")
CRUMBS = ("{F} > {w} > {title}", "{w} » {title}", "{F} {f} {f}: {w} / {title}", "{F} / {W} / {title}")
CODE = ("{w} --{x} {t} --{z}={d}", "    return {w} + {d}", "{w}('{x}', {t})", "$ {w} {x}", "for {w} in {x}:", "{w}.{x}({d});")
CAPTIONS = ("{F} {k}: {d} {w}, {x} {f} {z}", "{F} {k}: {f} {w} {x} {f} {f} {z}", "{F} {k}. {W} {x}")
SPAM = ("{w} {A}; {w} {B}; {x} {A}; {x} {B}; {z} {A}", "#{w}{x} #{w} #{w}{z} #{x} #{w} #{w} #{w}{t}", "http://www.{h}.example/{w}/{x}", "* [{w} {x}](https://{h}.example/{z}/{w})", "{W} {x} : https://www.{h}.example/{z}?id={d}", "{w} {x}, {w} {z}, {x} {w}, {w}, {z} {w}, {w} {t}, {w} {x}")
LINKED = ("http://www.{h}.example/{w}/{x}.html - {sentence}", "https://{h}.example/{w}?id={d} - {sentence}", "{W} {x} (https://{h}.example/{w}): {sentence}")

#: Forms of headings and of words before a list that many pages share, their subject ``t`` aside.
FRAMES = ("{t} f f w f f x", "F f w x f f {t}", "F {t} w f x", "W f w x: z f {t}", "F w x f {t}", "F x f z f {t}", "{t}, {d} w f f x", "W w f f x: {t}", "{t} f w", "F {t}", "W {t}", "{t}: w f x", "{d} w f {t}", "F w, f f {t} x f f", "W f f x: f f {t}", "F {d} x f w: {t}")
INTRO_FRAMES = ("{t} w:", "F f w f {t}:", "W f {t}:", "F w, {t} w f f:", "F w f {t}", "W f w f w f {t}", "F f {t}:", "{t} w", "W:", "F f f:")

Page = tuple[str, str, str, list[tuple[str, int]]]


class Writer:
    """Makes blocks of made-up words."""

    def __init__(self, rnd: random.Random):
        self.rnd = rnd

    def word(self, longest: int = 3) -> str:
        return "".join(self.rnd.choice(SYLLABLES) for _ in range(self.rnd.randint(1, longest)))

    def name(self) -> str:
        return self.word(3).capitalize()

    def sentence(self, s: Shape, words: list[str]) -> str:
        rnd, out = self.rnd, []
        for k in range(rnd.randint(*s.words)):
            r = rnd.random()
            if r < s.function:
                w = GLUE_WORDS[min(int(rnd.expovariate(0.12)), len(GLUE_WORDS) - 1)]
            elif r < s.function + s.names and k:
                w = rnd.choice(words[:4]).capitalize() if rnd.random() < 0.4 else self.name()
            elif r < s.function + s.names + s.numbers:
                w = str(rnd.randint(1, 300))
            else:
                w = rnd.choice(words) if rnd.random() < 0.6 else self.word()
            out.append(w + ("," if rnd.random() < s.comma else ""))
        out[-1] = out[-1].rstrip(",")
        if s.capital:
            out[0] = out[0][:1].upper() + out[0][1:]
        return " ".join(out) + s.end

    def block(self, s: Shape, words: list[str]) -> str:
        return " ".join(self.sentence(s, words) for _ in range(self.rnd.randint(*s.sentences)))


def pages(sites: int = 240, seed: int = 7) -> list[Page]:
    """``url, external id, title, [(line, is furniture)]`` of the labelled pages of ``sites`` sites."""
    rnd = random.Random(seed)
    w = Writer(rnd)

    def frame(text: str) -> str:  # its function words are fixed, and some of its other words
        pool = {"f": lambda: rnd.choice(GLUE_WORDS), "F": lambda: rnd.choice(GLUE_WORDS).capitalize(), "W": w.name}
        loose = rnd.random() < 0.6
        for c in "wxz":
            pool[c] = (lambda c=c: "{" + c + "}") if loose else w.word
        return "".join(pool[c]() if c in pool and "{" + c + "}" not in text else c for c in text)

    heads, intros = [frame(x) for x in FRAMES for _ in range(2)], [frame(x) for x in INTRO_FRAMES]
    out: list[Page] = []
    for site in range(sites):
        out += _site(rnd, site, heads, intros)
    return out


def _site(rnd: random.Random, number: int, head_frames: list[str], intro_frames: list[str]) -> list[Page]:
    w = Writer(rnd)
    size = min(40, 1 + int(rnd.expovariate(0.12)))
    host, name = w.word(), None
    name = host.capitalize() + rnd.choice(("", "", " Notes", " & Co", "Lab", " Weekly"))
    own = [w.word() for _ in range(30)]
    authors = [f"{w.name()} {w.name()}" for _ in range(rnd.randint(1, 4))]
    shout = rnd.random() < 0.12

    def named(text: str) -> str:  # a site likes to name itself in what it says everywhere
        parts = text.split(" ")
        if rnd.random() < 0.5 and len(parts) > 2:
            parts[rnd.randrange(1, len(parts))] = name + (parts[-1][-1:] if parts[-1][-1:] in ".?" and rnd.random() < 0 else "")
        return " ".join(parts)

    consents = [named(w.block(rnd.choice(CONSENT), own)) + (" " + " | ".join(w.name() for _ in range(3)) if rnd.random() < 0.25 else "") for _ in range(2)]
    prompts = [named(w.block(rnd.choice(PROMPT), own)) for _ in range(4)] + [rnd.choice(JOINTS).join(w.name() + rnd.choice(("", " " + w.word())) for _ in range(rnd.randint(3, 4))) for _ in range(2)]
    prompts[-1] = w.name() + " " + w.word() + ": " + prompts[-1]
    notes = [w.block(NOTE, own) for _ in range(3)]
    bios = {a: [f"{a} {w.block(BIO, own)[:1].lower()}{w.block(BIO, own)[1:]}" for _ in range(2)] for a in authors}
    legals = [named(w.block(rnd.choice(LEGAL), own)) for _ in range(6)] + [f"© {rnd.randint(200, 2024)} {name}. " + w.block(LEGAL[3], own) + ".", rnd.choice(JOINTS).join(w.name() + " " + w.word() for _ in range(3))]
    widgets, heads = [w.block(WIDGET, own) for _ in range(5)] + [name], [w.block(RELATED, own) for _ in range(2)]
    if rnd.random() < 0.4:
        heads.append(f"{w.name()} {rnd.choice(GLUE_WORDS)} {name}")
    menu = [w.name() + (" " + w.word() if rnd.random() < 0.25 else "") for _ in range(rnd.randint(5, 12))]
    glue, listed, mark = rnd.choice(JOINTS), rnd.random() < 0.45, rnd.choice(("* ", "", "- "))
    odds = {k: rnd.random() * m for k, m in (("consent", 0.9), ("menu", 1.2), ("crumb", 1.1), ("by", 1.1), ("prompt", 1.0), ("tag", 1.1), ("bio", 1.0), ("related", 1.1), ("pager", 1.0), ("widget", 0.8), ("legal", 1.5), ("note", 0.5))}
    crumb, by, tag, count = rnd.choice(CRUMBS), rnd.choice(BYLINES), rnd.choice(TAGS), rnd.choice(COUNTS)
    fixed = {k: v for k, v in (("F", w.name()), ("f", rnd.choice(GLUE_WORDS)))}
    titles = []
    framed = rnd.random() < 0.7  # the site titles its pages by shared forms

    def heading(topic: str, words: list[str]) -> str:
        if framed:
            return rnd.choice(head_frames).format(t=topic, d=rnd.randint(2, 200), **{c: rnd.choice(words) for c in "wxz"})
        t = w.block(HEADING, words).split(" ")
        t[rnd.randrange(len(t))] = topic
        return " ".join(t)

    for _ in range(size + 6):
        topic = w.name()
        titles.append((heading(topic, own), topic))
    out: list[Page] = []
    for p in range(size):
        title, topic = titles[p]
        words = [topic.lower()] + rnd.sample(own, 8) + [w.word() for _ in range(4)]
        lines: list[tuple[str, int]] = []
        bare = rnd.random() < 0.12  # a page without furniture

        def fill(template: str) -> str:
            a, b = rnd.choice(authors), rnd.choice(authors)
            values = {"A": a, "B": b, "S": name, "d": rnd.randint(1, 30), "k": rnd.randint(1, 5), "y": rnd.choice((rnd.randint(210, 230), rnd.randint(1995, 2025))), "M": w.name(), "h": w.word(), "t": topic.lower(), "title": title, "sentence": w.block(BRIEF, words), **{c: rnd.choice(words) for c in "wxz"}, "W": rnd.choice(words).capitalize(), "X": rnd.choice(words).capitalize(), **fixed}
            return template.format(**values)

        def own_text(text: str) -> None:
            lines.append((text, TEXT))

        def furniture(kind: str, *texts: str) -> None:
            if not bare and rnd.random() < odds[kind]:
                lines.extend((t.upper() if shout else t, FURNITURE) for t in texts)

        def others(k: int) -> list[str]:
            return [rnd.choice(MARKS).format(k=i + 1) + rnd.choice(titles)[0] for i in range(k)]

        furniture("consent", consents[0])
        furniture("widget", rnd.choice(widgets))
        furniture("menu", *([rnd.choice((mark, mark, "  " + mark)) + m for m in menu] if listed else [glue.join(rnd.sample(menu, len(menu)) if rnd.random() < 0.3 else menu)]))
        furniture("crumb", fill(crumb))
        if rnd.random() < 0.35:
            own_text(title)
        furniture("by", fill(by))
        kind = rnd.random()
        if kind < 0.06:  # spam and empty templates are the page's own, too
            template = rnd.choice(SPAM)
            for _ in range(rnd.randint(2, 9)):
                own_text(fill(template))
        elif kind < 0.1:
            for _ in range(rnd.randint(1, 4)):
                own_text(w.block(STUFFED, [words[1], words[1], words[1], *words]))
        elif kind < 0.14:
            for _ in range(rnd.randint(1, 3)):
                own_text(w.block(rnd.choice((BRIEF, HEADING, BARE_INTRO)), words))
        for _ in range(0 if kind < 0.1 else rnd.choice((1, 1, 2, 2, 3, 4))):
            if rnd.random() < 0.4:
                own_text(heading(topic, words) if rnd.random() < 0.7 else w.block(HEADING, words))
            for _ in range(rnd.choice((1, 1, 2))):
                own_text(w.block(PARAGRAPH if rnd.random() < 0.8 else BRIEF, words))
            if rnd.random() < 0.3:
                furniture("prompt", rnd.choice(prompts))
            kind = rnd.random()
            if kind < 0.2:
                if rnd.random() < 0.7:
                    intro = w.block(rnd.choice((INTRO, BARE_INTRO)), words)
                    own_text(rnd.choice(intro_frames).format(t=topic, **{c: rnd.choice(words) for c in "wxz"}) if framed else f"{topic} {intro}" if rnd.random() < 0.5 else intro)
                mark_, shape = rnd.choice(("- ", "• ", "* ", "{k}. ", "{k}) ", "")), rnd.choice((ITEM, ITEM, TERSE_ITEM))
                for k in range(rnd.randint(1, 8)):
                    text = w.block(shape, words)
                    own_text(mark_.format(k=k + 1) + (text if rnd.random() < 0.6 else text.capitalize()) + rnd.choice(("", "", f" ({topic})", f" - {topic}")))
                    if rnd.random() < 0.08:
                        furniture("prompt", rnd.choice(prompts))
            elif kind < 0.26:
                for _ in range(rnd.randint(2, 5)):
                    own_text(f"{rnd.choice(words).capitalize()}: {w.block(BRIEF, words)}")
            elif kind < 0.3:
                for _ in range(rnd.randint(1, 4)):
                    own_text(fill(rnd.choice(LINKED)))
            elif kind < 0.36:
                for _ in range(rnd.randint(1, 4)):
                    own_text(fill(rnd.choice(CODE)))
            elif kind < 0.44:
                own_text(fill(rnd.choice(CAPTIONS)))
            elif kind < 0.5:
                own_text(f"\"{w.block(QUOTE, words)}\" ({w.name()})")
        furniture("tag", fill(tag))
        furniture("prompt", *rnd.sample(prompts, rnd.randint(1, 2)))
        furniture("note", rnd.choice(notes))
        furniture("bio", rnd.choice(bios[rnd.choice(authors)]))
        furniture("related", *([rnd.choice(heads)] if rnd.random() < 0.85 else []), *others(rnd.randint(1, 6)))
        furniture("pager", f"{fixed['F']}: {rnd.choice(titles)[0]}")
        furniture("pager", f"{w.name()}: {rnd.choice(titles)[0]}")
        furniture("widget", *rnd.sample(widgets, rnd.randint(1, 2)), *([fill(count)] if rnd.random() < 0.4 else []))
        if rnd.random() < 0.3:
            furniture("consent", consents[1])
        furniture("legal", *rnd.sample(legals, rnd.randint(1, 4)))
        if rnd.random() < 0.08:  # a line of text after it all
            own_text(w.block(BRIEF, words))
        url = f"https://{host}.example/{own[0]}/{topic.lower()}-{p}" if rnd.random() < 0.95 else ""
        out.append((url, f"s{number}p{p}", title if rnd.random() < 0.92 else "", [x for x in lines if x[0].strip()]))
    return out
