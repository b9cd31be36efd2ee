"""Main-text extraction: a bidirectional LSTM labels the leaf blocks of a page in the context of the whole page."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import small_batches, tidied

#: HTML elements that begin and end blocks.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes when it is open above it in the same container.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol menu dl table tbody thead tfoot select div section article".split())

#: Elements whose content is no text. Their names end at a blank, a slash or the bracket: <svg-icon> is none of them.
RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style", "noscript", "template", "svg", "iframe")}
NAME = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
#: The rest of a tag, to the first bracket outside quotes; it gives nothing back, so one attempt reads a character once.
REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

DIGITS = "0123456789"
PATH_SLOTS, WORD_SLOTS, SHAPE = 160, 48, 8
WIDTH, HIDDEN = PATH_SLOTS + WORD_SLOTS + SHAPE, 24
#: Pages that training invents, and passes over them.
PAGES, EPOCHS = 1000, 9
#: A private-use letter that begins the main blocks of invented pages, until their labels are read.
MARK = "\ue000"


#: Labels of a path that the model sees at most; text and structure are read at any depth.
DEEP = 256
#: Blocks times pages that the network reads at a time; a longer page is read in stretches that hand their state on.
STRETCH = 8192


#: What a worker remembers of words and paths before it starts anew.
REMEMBERED = 200_000


def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % slots


class Leaf:
    """A block of text: the path of its open blocks, its text, the characters within links."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _label(name: str, attributes: str) -> str:
    """An element of a path: the tag and the words of its class, id and role."""
    if "=" not in attributes:
        return name
    words = [name]
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        words += PARTS.findall(CAMEL.sub(" ", a or b or c).lower())
    return " ".join(words)


def _cut(stack: list[tuple[str, str]]) -> tuple[str, ...]:
    """The labels of a path. Beyond ``DEEP`` open elements those in the middle are left out: they would make a path of
    n open elements cost n for every block, and pages nest some tens deep."""
    if len(stack) > DEEP:
        stack = stack[: DEEP // 2] + stack[-DEEP // 2 :]
    return tuple(label for _, label in stack)


class _Tags:
    """Where the tags of one page end. A tag that never ends is found once: what its search has passed is remembered, so a
    page of broken quotes is read in linear time."""

    def __init__(self, page: str):
        self.page, self.last, self.dead, self.broken = page, page.rfind(">"), set(), False

    def end(self, at: int) -> int:
        """The place of the bracket that ends the tag whose name ends at ``at``, or -1."""
        if at > self.last:
            return -1
        if not self.broken:
            if found := REST.match(self.page, at):
                return found.end() - 1
            self.broken = True
        passed = []
        while (found := SPECIAL.search(self.page, at)) and (here := found.start()) not in self.dead:
            mark = found.group()
            if mark == ">":
                return here
            passed.append(here)
            if (at := self.page.find(mark, here + 1) + 1) == 0:
                break
        self.dead.update(passed)
        return -1


def _tokens(page: str) -> Iterator[tuple[str | None, str | bool, str]]:
    """(None, text, "") for runs of text, (name, closes, attributes) for tags."""
    tags, at, size = _Tags(page), 0, len(page)
    while at < size:
        here = page.find("<", at)
        if here != at:
            yield None, page[at : here if here >= 0 else size], ""
            if here < 0:
                return
        if page.startswith("<!--", here):
            at = page.find("-->", here + 4) + 3
            if at == 2:
                return
            continue
        found = NAME.match(page, here)
        if found is None:
            if page[here + 1 : here + 2] in ("!", "?") and here < tags.last:
                at = page.find(">", here) + 1
            else:
                yield None, "<", ""
                at = here + 1
            continue
        slash, name = found.groups()
        name, stop = name.lower(), found.end()
        if not slash and name in RAW and page[stop : stop + 1] in (" ", "\t", "\n", "\r", "\f", "\v", "/", ">"):
            if name == "svg" and (end := tags.end(stop)) >= 0 and page[end - 1] == "/":
                at = end + 1
                continue
            if stop <= tags.last:
                close = RAW[name].search(page, page.find(">", stop) + 1)
                if close is None:
                    return
                at = close.end()
                continue
        end = tags.end(stop)
        if end < 0:
            yield None, "<", ""
            at = here + 1
        else:
            yield name, slash == "/", page[stop:end]
            at = end + 1


def leaves(page: str) -> list[Leaf]:
    """The leaf blocks of a page in page order; scripts, styles and comments are no text."""
    found: list[Leaf] = []
    stack: list[tuple[str, str]] = []
    opened: dict[str, int] = {}
    path: tuple[str, ...] = ()
    text: list[str] = []
    linked, link = 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                found.append(Leaf(path, whole, min(linked, len(whole))))
            text.clear()
        linked = 0

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    for name, closes, rest in _tokens(page):
        if name is None:
            text.append(closes)
            if link:
                linked += len(closes.strip())
            continue
        if name not in BLOCKS:
            if name == "a":
                link = not closes
            elif name == "br":
                text.append(" ")
            continue
        flush()
        if closes:
            if opened.get(name):
                while pop() != name:
                    pass
                link = False
        else:
            if stack and stack[-1][0] == "p":
                pop()
            if name in CLOSES:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in CLOSES[name]:
                        while len(stack) > depth:
                            pop()
                        break
                    if stack[depth][0] in CONTAINERS:
                        break
            if name not in VOID:
                stack.append((name, _label(name, rest)))
                opened[name] = opened.get(name, 0) + 1
        path = _cut(stack)
    flush()
    return found


_PATHS: dict[tuple[str, ...], np.ndarray] = {}
_WORDS: dict[str, int] = {}


def _path(path: tuple[str, ...]) -> np.ndarray:
    """Hashed words of a tag path, those of its last element heavier."""
    if (found := _PATHS.get(path)) is None:
        if len(_PATHS) > 20_000:
            _PATHS.clear()
        found = _PATHS[path] = np.zeros(PATH_SLOTS, dtype=np.float32)
        for depth, label in enumerate(path):
            for word in label.split(" "):
                found[_slot(word, PATH_SLOTS)] += 1.0 if depth == len(path) - 1 else 0.7
        np.minimum(found, 2, out=found)
    return found


def _word_slots(words: list[str]) -> list[int]:
    slots = list(map(_WORDS.get, words))
    if None in slots:
        if len(_WORDS) > REMEMBERED:
            _WORDS.clear()
        for k, slot in enumerate(slots):
            if slot is None:
                slots[k] = _WORDS[words[k]] = _slot(words[k], WORD_SLOTS)
    return slots


def features(blocks: list[Leaf], first: int = 0, whole: int | None = None) -> np.ndarray:
    """A vector a block: hashed words of its tag path, hashed words of its text, and its shape. ``blocks`` may be a stretch
    of a page of ``whole`` blocks that begins at ``first``."""
    whole = whole or len(blocks)
    x = np.empty((len(blocks), WIDTH), dtype=np.float32)
    counts, shape, slots = [], [], []
    for k, leaf in enumerate(blocks):
        text = leaf.text
        words, chars, last = text.lower().split(" "), len(text), text[-1]
        x[k, :PATH_SLOTS] = _path(leaf.path)
        slots += _word_slots(words)
        n = len(words)
        counts.append(n)
        shape.append((n, leaf.linked / chars, min(1.0, 8 * text.count(",") / n), min(1.0, 8 * text.count(". ") / n), last in ".!?。", any(map(text.__contains__, DIGITS)), (first + k) / whole, 1.0))
    n = np.array(counts)
    owner = np.repeat(np.arange(len(blocks)) * WORD_SLOTS, n)
    grid = np.bincount(owner + np.array(slots), minlength=len(blocks) * WORD_SLOTS).reshape(-1, WORD_SLOTS)
    x[:, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = np.sqrt(grid / n[:, None])
    x[:, -SHAPE:] = shape
    x[:, -SHAPE] = np.log1p(n) / 4
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Two LSTMs, one from each end of the page, and a logistic output on both states of a block."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {}
        for side in "fb":
            self.p[side + "x"] = rng.normal(0, (1 / WIDTH) ** 0.5, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[side + "h"] = rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, dtype=np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p[side + "b"] = bias
        self.p["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["ob"] = np.zeros(1, dtype=np.float32)

    def _side(self, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None, state: list | None = None) -> np.ndarray:
        """x (steps, pages, WIDTH) in the order of reading; the state stays as it is where the mask ends. ``state`` is where
        reading begins, and takes where it ends."""
        steps, pages, _ = x.shape
        drive = (x.reshape(-1, WIDTH) @ self.p[side + "x"] + self.p[side + "b"]).reshape(steps, pages, -1)
        h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
        if state:
            h, c = state
        out = np.empty((steps, pages, HIDDEN), dtype=np.float32)
        for t in range(steps):
            z = drive[t] + h @ self.p[side + "h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            fresh = f * c + i * g
            bent = np.tanh(fresh)
            if keep is not None:
                keep.append((h, c, i, f, o, g, bent, m))
            c = np.where(m, fresh, c)
            h = np.where(m, o * bent, h)
            out[t] = h
        if state is not None:
            state[:] = [h, c]
        return out

    def long_page(self, blocks: list[Leaf], stretch: int = STRETCH) -> np.ndarray:
        """``chances`` of one page, read in stretches: only the states of its blocks are held for the whole page."""
        both = np.empty((len(blocks), 2 * HIDDEN), dtype=np.float32)
        edges = [(a, min(a + stretch, len(blocks))) for a in range(0, len(blocks), stretch)]
        for side, order, way in (("f", edges, 1), ("b", edges[::-1], -1)):
            state: list = []
            for a, b in order:
                x = features(blocks[a:b], a, len(blocks))[::way, None]
                read = self._side(side, x, np.ones((b - a, 1), dtype=bool), None, state)[::way, 0]
                both[a:b, slice(HIDDEN) if side == "f" else slice(HIDDEN, None)] = read
        return _sigmoid(both @ self.p["o"] + self.p["ob"][0])

    def chances(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The chance of every block to be main text; x is (steps, pages, WIDTH)."""
        kf, kb = (None, None) if keep is None else ([], [])
        forward = self._side("f", x, mask, kf)
        backward = self._side("b", x[::-1], mask[::-1], kb)[::-1]
        both = np.concatenate([forward, backward], axis=2)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "both": both}
        return _sigmoid(both @ self.p["o"] + self.p["ob"][0])

    def _back(self, side: str, x: np.ndarray, keep: list, dout: np.ndarray, grad: dict) -> None:
        dh = dc = np.zeros_like(dout[0])
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
        for t in range(len(keep) - 1, -1, -1):
            h, c, i, f, o, g, bent, m = keep[t]
            dh = dh + dout[t]
            live = dh * m
            dfresh = dc * m + live * o * (1 - bent * bent)
            dz = np.concatenate([dfresh * g * i * (1 - i), dfresh * c * f * (1 - f), live * bent * o * (1 - o), dfresh * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            grad[side + "h"] += h.T @ dz
            dh = dh * ~m + dz @ self.p[side + "h"].T
            dc = np.where(m, dfresh * f, dc)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad[side + "x"] += x.reshape(-1, WIDTH).T @ flat
        grad[side + "b"] += flat.sum(axis=0)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        keep: dict = {}
        chance = self.chances(x, mask, keep)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((chance - y) * mask / mask.sum()).astype(np.float32)
        grad["o"] += (keep["both"] * d[:, :, None]).sum(axis=(0, 1))
        grad["ob"] += d.sum()
        dboth = d[:, :, None] * self.p["o"]
        self._back("f", x, keep["f"], dboth[:, :, :HIDDEN], grad)
        self._back("b", x[::-1], keep["b"], dboth[::-1][:, :, HIDDEN:], grad)
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01, seed: int = 5) -> BiLstm:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = sorted(rng.permutation(len(pages)), key=lambda j: len(pages[j][1]))
            groups = [order[a : a + batch] for a in range(0, len(order), batch)]
            for g in rng.permutation(len(groups)):
                x, mask, y = padded([pages[j] for j in groups[g]])
                grad, step = self.gradient(x, mask, y), step + 1
                scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((q * q).sum() for q in grad.values())))))
                pace = rate * (0.5 if epoch >= epochs - 2 else 1.0)
                for k, q in grad.items():
                    q = q * scale
                    m[k], v[k] = 0.9 * m[k] + 0.1 * q, 0.99 * v[k] + 0.01 * q * q
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in pages)
    x = np.zeros((steps, len(pages), WIDTH), dtype=np.float32)
    mask, y = np.zeros((steps, len(pages)), dtype=bool), np.zeros((steps, len(pages)), dtype=np.float32)
    for j, (a, b) in enumerate(pages):
        x[: len(b), j], mask[: len(b), j], y[: len(b), j] = a, True, b
    return x, mask, y


#: Names that page authors give to what is not, and what is, the main text.
ASIDE_NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs tabs links mainmenu",
    "header": "header masthead top banner logo branding site",
    "footer": "footer foot bottom copyright legal colophon imprint",
    "aside": "sidebar side aside widget related trending popular recommended more tags archive",
    "notice": "cookie consent notice gdpr alert privacy popup modal overlay warning message",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner partner",
    "form": "form search login subscribe newsletter signup contact field",
    "comments": "comments comment reply replies discussion responses thread respond disqus",
    "share": "share social follow tools toolbar actions meta byline pagination pager",
}
MAIN_NAMES = "article post content entry story body main text page story-body post-content article-body prose"
PHRASES = {
    "nav": "home about contact news products services help login sign in register blog",
    "header": "welcome to your daily source search menu",
    "footer": "copyright all rights reserved terms of use privacy policy imprint",
    "aside": "related articles most read popular posts recent archive tags categories",
    "notice": "we use cookies to improve your experience accept all reject settings",
    "ad": "advertisement sponsored buy now save off limited offer click here",
    "form": "your name email subscribe submit search password enter send",
    "comments": "reply report great post thanks says ago comment comments likes leave a",
    "share": "share tweet facebook follow us print email next previous page posted by",
}


class PageMaker:
    """Invents pages of many layouts whose main blocks are known."""

    def __init__(self, seed: int = 7):
        self.rng = random.Random(seed)

    def one(self, choices: str) -> str:
        words = choices.split()
        return words[self.rng.randrange(len(words))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        letters = "etaoinshrdlucmwfgypbvkéüñ"
        return "".join(letters[min(int(self.rng.expovariate(1 / 7)), len(letters) - 1)] for _ in range(self.rng.randrange(2, 10)))

    def prose(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.rng.randrange(low, high))]
        draw = self.rng.random()
        if draw < 0.04:
            words = [w + self.one("%%% *** ### &amp;&amp;&amp; $$$ | !!") for w in words]
        elif draw < 0.06:
            words = [words[0]] * len(words)
        elif draw < 0.09:
            words = [self.one(PHRASES[self.one("footer form comments share nav")]) for _ in words]
        elif draw < 0.11:
            words = [w.upper() for w in words]
        for j in range(len(words)):
            if self.chance(0.12):
                words[j] += "," if self.chance(0.5) else "."
        return " ".join(words).capitalize() + ("." if self.chance(0.85) else "")

    def attrs(self, names: str, always: bool = False) -> str:
        if not always and self.chance(0.25):
            return ""
        name = self.one(names)
        if self.chance(0.35):
            name += self.one("- _ -") + self.one("wrap inner box area container block item list main left right")
        kind = "id" if self.chance(0.25) else "class"
        return f' {kind}="{name}"'

    def phrase(self, kind: str, low: int, high: int) -> str:
        if self.chance(0.45):
            return self.prose(low, high)
        return " ".join(self.one(PHRASES[kind]) if self.chance(0.7) else self.word() for _ in range(self.rng.randrange(low, high))).capitalize()

    def aside(self, kind: str) -> str:
        """A part that is not main text; its text is marked by a leading letter that the labels are read from."""
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        own = tag != "div" and self.chance(0.6)
        tag = tag if own else self.one("div div section")
        head = self.attrs(ASIDE_NAMES[kind], always=not own or kind == "comments" or tag == "section")
        if self.chance(0.15):
            head += f' role="{self.one("navigation banner contentinfo complementary search")}"' if kind in ("nav", "header", "footer", "aside", "form") else ""
        body = []
        if kind in ("nav", "aside", "share", "header") and self.chance(0.8):
            items = [f'<a href="/{self.word()}">{self.phrase(kind, 1, 5)}</a>' for _ in range(self.rng.randrange(2, 9))]
            body.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.chance(0.7) else " | ".join(items) if self.chance(0.5) else "".join(f"<div>{i}</div>" for i in items))
        if kind == "comments":
            for _ in range(self.rng.randrange(1, 6)):
                inner = f"<b>{self.word()}</b> " * self.chance(0.4) + self.prose(4, 40)
                body.append(f'<div{self.attrs("comment reply comment-body", True)}><p>{inner}</p></div>' if self.chance(0.6) else f"<li>{inner}</li>" if self.chance(0.5) else f"<p>{inner}</p>")
        if kind == "form":
            body.append(f"<label>{self.phrase(kind, 1, 4)}</label><input name=q><button>{self.phrase(kind, 1, 3)}</button>")
        if kind in ("footer", "notice", "ad", "aside", "header") or not body:
            low, high = (2, 26) if kind in ("notice", "ad", "aside") else (1, 12)
            for _ in range(self.rng.randrange(1, 3)):
                text = self.phrase(kind, low, high)
                body.append(f"&copy; {text}" if kind == "footer" and self.chance(0.5) else f"<p>{text}</p>" if self.chance(0.5) else f"<h3>{text}</h3>" if self.chance(0.15) else f"<div>{text}</div>" if self.chance(0.3) else text)
        return f"<{tag}{head}>{''.join(body)}</{tag}>"

    def main(self, mark: str) -> str:
        body = [f"<h1>{mark}{self.prose(2, 9)}</h1>"] if self.chance(0.85) else []
        for _ in range(self.rng.randrange(1, 14)):
            draw = self.rng.random()
            text = mark + self.prose(1, 70)
            if draw < 0.7:
                inner = f"<b>{text}" + ("</b>" if self.chance(0.5) else "<br>") if self.chance(0.12) else f'{text} <a href="/x">{self.word()}</a> {self.prose(1, 9)}' if self.chance(0.15) else text
                body.append(f"<p>{inner}" + ("</p>" if self.chance(0.8) else ""))
            elif draw < 0.78:
                body.append(f"<h2>{mark}{self.prose(1, 8)}</h2>")
            elif draw < 0.86:
                body.append("<ul>" + "".join(f"<li>{mark}{self.prose(1, 16)}</li>" for _ in range(self.rng.randrange(2, 6))) + "</ul>")
            elif draw < 0.9:
                body.append(f"<blockquote>{text}</blockquote>")
            elif draw < 0.93:
                body.append("<table>" + "".join(f"<tr><td>{mark}{self.word()}</td><td>{mark}{self.prose(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif draw < 0.97:
                body.append(f"<div>{text}</div>")
            else:
                body.append(self.aside(self.one("ad ad share aside")))
        return "".join(body)

    def page(self, mark: str = MARK) -> str:
        tag = self.one("article article main div div section")
        head = self.attrs(MAIN_NAMES, always=tag in ("div", "section"))
        main = f"<{tag}{head}>{self.main(mark)}"
        if self.chance(0.2):
            main += self.aside("comments")
        if self.chance(0.1):
            main += self.aside(self.one("share ad form"))
        main += f"</{tag}>"
        before = "".join(self.aside(k) for k in ("notice", "header", "nav", "ad", "form", "aside", "share") if self.chance({"nav": 0.85, "ad": 0.45}.get(k, 0.3)))
        after = "".join(self.aside(k) for k in ("share", "comments", "aside", "ad", "form", "footer", "notice") if self.chance({"footer": 0.85}.get(k, 0.3)))
        if self.chance(0.3):
            wrap = f'<div{self.attrs("wrapper page container layout site root", True)}>'
            before, after = wrap + before, after + "</div>"
        return f"<!DOCTYPE html><html><head><title>{self.prose(2, 8)}</title><script>var a='<p>';</script></head><body>{before}{main}{after}</body></html>"


def training_pages(count: int = PAGES, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of invented pages; a private-use letter marks main text and is taken out before use."""
    maker, found = PageMaker(seed), []
    while len(found) < count:
        blocks = leaves(maker.page())
        y = np.array([leaf.text.startswith(MARK) for leaf in blocks], dtype=np.float32)
        for leaf in blocks:
            leaf.text = leaf.text.replace(MARK, "") or "-"
        if blocks:
            x = features(blocks)
            # a third of the blocks are learned without their words: the path and the context must do
            x[[maker.chance(0.33) for _ in blocks], PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = 0
            found.append((x, y))
    return found


def train(count: int = PAGES, epochs: int = EPOCHS) -> BiLstm:
    """A model from invented pages alone: its bound is ``count`` whatever the table holds."""
    return BiLstm().fit(training_pages(count), epochs)


def main_texts(pages: list[str], model: BiLstm, together: int = 64, stretch: int = STRETCH) -> list[str]:
    """The main text of each page, its blocks joined by line breaks. Pages of like length are read side by side, as many as
    make ``stretch`` blocks with the longest's padding; a page of more than that is read alone."""
    parsed = [leaves(p) for p in pages]
    result = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if parsed[k]), key=lambda k: len(parsed[k]))
    at = 0
    while at < len(order):
        group = order[at : at + together]
        while len(group) > 1 and len(group) * len(parsed[group[-1]]) > stretch:
            group = group[: max(1, min(len(group) - 1, stretch // len(parsed[group[-1]])))]
        at += len(group)
        if len(parsed[group[-1]]) > stretch:
            columns = [model.long_page(parsed[group[0]], stretch)]
        else:
            x, mask, _ = padded([(features(parsed[k]), np.zeros(len(parsed[k]), dtype=np.float32)) for k in group])
            columns = model.chances(x, mask).T
        for k, chance in zip(group, columns, strict=True):
            result[k] = "\n".join(leaf.text for leaf, c in zip(parsed[k], chance, strict=False) if c >= 0.5)
            parsed[k] = []
    return result


def extract(pages: DataFrame, model: BiLstm, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url and main text of every page; ``text`` is empty where no block is main text.

    A null or empty html has empty text. Repeated rows and ids are extracted each, in no order; other columns, clashing
    names among them, are ignored (the result's own is ``text``, whatever the input has); an empty table gives no rows.
    Whole pages are read, however long, in time linear in their length (markup that never ends included) and in memory
    of the page, its blocks and one stretch of vectors; nothing is shuffled.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for first in range(0, len(texts), 256):
                got = main_texts(texts[first : first + 256], model)
                part = batch.slice(first, len(got))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(got, pa.string())], names=["id", "url", "text"])

    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
