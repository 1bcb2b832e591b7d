"""Main text of web pages by a recurrent block labeller, trained here in numpy.

A page is read as the sequence of its leaf blocks: runs of text between block-level tags, in page order. Each block
has a vector of its tag path (tags and class, id and role words of all ancestors, hashed), of its own tags, of its
hashed words and of a few counts. A bidirectional LSTM reads the whole sequence, so that every block is classified
with the page around it; blocks with a probability of at least one half are the main text.

The network learns from a bounded sample of the given pages. Their blocks are labelled by markup that names its
purpose (an article or main element, without navigation, forms and so on inside it). As one site's markup would
teach little more than itself, the same texts are also laid out anew: in other containers, with menus, notices,
comments and other parts around and inside, made of the pages' own texts so that markup and position decide.

Defined results: null and empty pages, and pages without main text, give ''. Scripts, styles, comments and markup are
no blocks. Character references are decoded, white space in a block becomes one space, blocks are joined by one
space. Unclosed, stray and cut-off tags are read as browsers do in the main: a tag that the page's end cuts is
dropped, '<' before anything but a letter, '/', '!' or '?' is text. Repeated rows are pages of their own; other columns
are ignored whatever their names. Pages of any length are read whole, some thousand blocks at a time.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their part in a page, and words that name such parts.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style template iframe noembed noframes xmp".split())
ONLY_TEXT = frozenset("title textarea".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li "
    "main menu nav ol p pre section table ul".split()
)
SAME_CLOSES = {"li": "li", "option": "option", "tr": "tr", "td": "td", "th": "td", "dd": "dd", "dt": "dd"}
LISTS = frozenset("ul ol menu table dl select tbody thead".split())
MAIN = frozenset("article main".split())
ASIDE = frozenset("head title nav header footer aside form menu dialog button select option textarea label legend fieldset noscript".split())
ASIDE_WORDS = frozenset(
    "nav menu sidebar comment comments ad ads advert advertisement banner cookie cookies notice promo sponsor sponsored related share social "
    "footer header breadcrumb breadcrumbs newsletter subscribe popup modal widget pagination login search".split()
)

PATH_BITS, OWN_BITS, WORD_BUCKETS, COUNTS = 512, 128, 48, 10
INPUTS = PATH_BITS + OWN_BITS + WORD_BUCKETS + COUNTS
#: Blocks that are turned into vectors at once.
CHUNK = 4096

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ANY_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORD_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    path: int  # hashed tags and words of all ancestors, as bits
    own: int  # of the innermost element and its parent
    links: int  # characters inside links
    depth: int
    tag: str
    label: int  # 1 main text, 0 not, -1 unknown; for training only


@dataclass
class _Open:
    tag: str
    path: int
    own: int
    in_main: bool
    in_aside: bool
    given: int


_bits: dict[tuple[str, int], int] = {}


def _bit(name: str, size: int) -> int:
    """One hashed bit; the few names of markup are remembered."""
    key = (name, size)
    if key not in _bits:
        if len(_bits) > 100_000:
            _bits.clear()
        _bits[key] = 1 << (zlib.crc32(name.encode("utf-8", "replace")) % size)
    return _bits[key]


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in their order."""
    page = page or ""
    found: list[Block] = []
    stack = [_Open("", 0, 0, False, False, -1)]
    counts: dict[str, int] = {}
    text: list[str] = []
    links = in_links = 0

    def flush() -> None:
        nonlocal links
        words = " ".join(entities.unescape("".join(text)).split()) if text else ""
        text.clear()
        if words:
            at = stack[-1]
            k = len(stack) - 1
            while k > 0 and stack[k].tag in INLINE:
                k -= 1
            at = stack[k]
            label = at.given if at.given >= 0 else int(at.in_main and not at.in_aside)
            found.append(Block(words, at.path, at.own, min(links, len(words)), len(stack), at.tag, label))
        links = 0

    def close(tag: str) -> None:
        """Close the innermost open element of that name and all within it."""
        nonlocal in_links
        while stack[-1].tag != tag:
            gone = stack.pop().tag
            counts[gone] -= 1
            in_links -= gone == "a"
        stack.pop()
        counts[tag] -= 1
        in_links -= tag == "a"

    def add(part: str) -> None:
        nonlocal links
        if part:
            text.append(part)
            if in_links:
                links += len(part.strip())

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        follow = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if follow in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (follow.isascii() and follow.isalpha()) and follow != "/":
            add("<")
            at = lt + 1
            continue
        m = _TAG.match(page, lt) or _ANY_TAG.match(page, lt)
        if m is None:
            end = page.find(">", lt)
            # '</' before no letter is a comment for browsers; a tag without an end is cut off
            at = n if end < 0 else end + 1
            continue
        at, closing, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
        if closing:
            if tag not in INLINE:
                flush()
            if counts.get(tag):
                close(tag)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in DROPPED:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            at = n if end is None else end.start()
            if tag not in INLINE:
                flush()
            if end is not None:
                gt = page.find(">", at)
                at = n if gt < 0 else gt + 1
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P and counts.get("p"):
                close("p")
            same = SAME_CLOSES.get(tag)
            if same:
                k = len(stack) - 1
                while k > 0 and SAME_CLOSES.get(stack[k].tag) != same and stack[k].tag not in LISTS and stack[k].tag not in ("div", "section", "article"):
                    k -= 1
                if k > 0 and SAME_CLOSES.get(stack[k].tag) == same:
                    close(stack[k].tag)
        if tag in VOID:
            continue
        up = stack[-1]
        named = {k.lower(): v.strip("\"'") for k, v in _NAMED.findall(attributes)} if "=" in attributes else {}
        given = int(named.pop("data-y")) if named.get("data-y") in ("0", "1") else up.given
        words = {w.lower() for v in named.values() for w in _WORD_OF_NAME.findall(v)}
        path = _bit("t " + tag, PATH_BITS)
        own = _bit("t " + tag, OWN_BITS)
        for w in words:
            path |= _bit("w " + w, PATH_BITS)
            own |= _bit("w " + w, OWN_BITS)
        inherited = up.own if up.tag in INLINE or tag in INLINE else 0
        stack.append(_Open(tag, up.path | path, own | inherited, up.in_main or tag in MAIN, up.in_aside or tag in ASIDE or bool(words & ASIDE_WORDS), given))
        counts[tag] = counts.get(tag, 0) + 1
        in_links += tag == "a"
        if tag in ONLY_TEXT:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            stop = n if end is None else end.start()
            add(page[at:stop])
            at = stop
    flush()
    return found


@functools.lru_cache(200_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORD_BUCKETS


def vectors(some: Sequence[Block], first: int, total: int) -> np.ndarray:
    """Input vectors of consecutive blocks, the first of which is number `first` of `total`."""
    out = np.zeros((len(some), INPUTS), dtype=np.float32)
    raw = b"".join(b.path.to_bytes(PATH_BITS // 8, "little") + b.own.to_bytes(OWN_BITS // 8, "little") for b in some)
    bits = np.frombuffer(raw, dtype=np.uint8).reshape(len(some), -1)
    out[:, : PATH_BITS + OWN_BITS] = np.unpackbits(bits, axis=1, bitorder="little")
    codes: list[int] = []
    sizes = []
    for i, b in enumerate(some):
        words, n, tail = b.text.split(), len(b.text), b.text[-200:]
        codes += map(_bucket, words)
        sizes.append(len(words))
        out[i, -COUNTS:] = (
            math.log1p(n) / 8,
            math.log1p(len(words)) / 6,
            b.links / n,
            tail[-1] in ".!?…。",
            min(1.0, b.text.count(",") / len(words)),
            sum(map(tail.count, "0123456789")) / len(tail),
            b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            (first + i) / total,
            1 - (first + i) / total,
            math.log1p(b.depth) / 4,
        )
    cells = np.repeat(np.arange(len(some)), sizes) * WORD_BUCKETS + np.array(codes, dtype=np.int64)
    hashed = np.bincount(cells, minlength=len(some) * WORD_BUCKETS).reshape(len(some), WORD_BUCKETS)
    norms = np.sqrt((hashed * hashed).sum(axis=1, keepdims=True))
    out[:, PATH_BITS + OWN_BITS : PATH_BITS + OWN_BITS + WORD_BUCKETS] = 0.3 * hashed / norms
    return out


@dataclass(frozen=True)
class Training:
    """Sample and descent. `pages` bounds the sample: so many pages of at most `chars` characters, by hash of their
    text, those with an article or main element first; each gives `layouts` new layouts besides itself, and an
    example has `longest` blocks at most."""

    pages: int = 240
    chars: int = 200_000
    layouts: int = 6
    hidden: int = 16
    epochs: int = 10
    batch: int = 24
    rate: float = 0.008
    longest: int = 160
    seed: int = 11


Network = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class _Pass:
    """One direction over a batch, with what the way back needs."""

    h: np.ndarray
    gates: np.ndarray
    cells: np.ndarray
    end: tuple[np.ndarray, np.ndarray] = field(default=None)


def _forward(net: Network, side: str, x: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None) -> _Pass:
    """LSTM over x (batch, time, inputs) from a state, or from zero."""
    wx, wh, b = net[side + "x"], net[side + "h"], net[side + "b"]
    n, steps, size = len(x), x.shape[1], wh.shape[0]
    given = (x.reshape(-1, x.shape[2]) @ wx + b).reshape(n, steps, -1)
    h, c = state or (np.zeros((n, size), np.float32), np.zeros((n, size), np.float32))
    out = _Pass(np.empty((n, steps, size), np.float32), np.empty_like(given), np.empty((n, steps + 1, size), np.float32))
    out.cells[:, 0] = c
    for t in range(steps):
        a = given[:, t] + h @ wh
        a[:, : 3 * size] = _sigmoid(a[:, : 3 * size])
        a[:, 3 * size :] = np.tanh(a[:, 3 * size :])
        c = a[:, size : 2 * size] * c + a[:, :size] * a[:, 3 * size :]
        h = a[:, 2 * size : 3 * size] * np.tanh(c)
        out.h[:, t], out.gates[:, t], out.cells[:, t + 1] = h, a, c
    out.end = (h, c)
    return out


def _backward(net: Network, side: str, x: np.ndarray, run: _Pass, dh_all: np.ndarray, grads: Network) -> None:
    """Adds the gradients of one direction."""
    wh = net[side + "h"]
    n, steps, size = run.h.shape
    da_all = np.empty_like(run.gates)
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (run.gates[:, t, k * size : (k + 1) * size] for k in range(4))
        tc = np.tanh(run.cells[:, t + 1])
        dh = dh + dh_all[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        da = da_all[:, t]
        da[:, :size] = dc * g * i * (1 - i)
        da[:, size : 2 * size] = dc * run.cells[:, t] * f * (1 - f)
        da[:, 2 * size : 3 * size] = dh * tc * o * (1 - o)
        da[:, 3 * size :] = dc * i * (1 - g * g)
        dc = dc * f
        dh = da @ wh.T
    before = np.concatenate((np.zeros((n, 1, size), np.float32), run.h[:, :-1]), axis=1)
    flat = da_all.reshape(-1, 4 * size)
    grads[side + "x"] += x.reshape(-1, x.shape[2]).T @ flat
    grads[side + "h"] += before.reshape(-1, size).T @ flat
    grads[side + "b"] += flat.sum(axis=0)


def _turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's first `length` steps in reverse; the padding stays behind them."""
    t = np.arange(x.shape[1])[None, :]
    at = np.where(t < lengths[:, None], lengths[:, None] - 1 - t, t)
    return x[np.arange(len(x))[:, None], at]


def _padded(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((len(pages), lengths.max(), pages[0].shape[1] if pages[0].ndim > 1 else 1), dtype=np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p if p.ndim > 1 else p[:, None]
    return x, lengths


def fit(sequences: Sequence[tuple[np.ndarray, np.ndarray]], how: Training) -> Network:
    """Network from (vectors, labels of 0, 1 or -1 for unknown) of whole pages, by Adam on the log loss."""
    rng = np.random.default_rng(how.seed)
    size = how.hidden
    net: Network = {"w": np.zeros(2 * size, np.float32), "w0": np.zeros(1, np.float32)}
    for side in "fb":
        net[side + "x"] = (rng.standard_normal((INPUTS, 4 * size)) * 0.08).astype(np.float32)
        net[side + "h"] = (rng.standard_normal((size, 4 * size)) * 0.15).astype(np.float32)
        net[side + "b"] = np.repeat([0, 1, 0, 0], size).astype(np.float32)
    net["w"] = (rng.standard_normal(2 * size) * 0.3).astype(np.float32)
    m, v = ({k: np.zeros_like(a) for k, a in net.items()} for _ in range(2))
    step = 0
    for epoch in range(how.epochs):
        rate = how.rate * (1 - 0.9 * epoch / how.epochs)
        order = rng.permutation(len(sequences))
        order = np.concatenate([c[np.argsort([len(sequences[i][0]) for i in c], kind="stable")] for c in np.array_split(order, max(1, len(order) // 200))])
        groups = np.array_split(order, max(1, len(order) // how.batch))
        for k in rng.permutation(len(groups)):
            picked = [sequences[i] for i in groups[k]]
            x, lengths = _padded([p for p, _ in picked])
            y, _ = _padded([q.astype(np.float32) for _, q in picked])
            y = y[:, :, 0]
            known = (np.arange(x.shape[1])[None, :] < lengths[:, None]) & (y >= 0)
            back = _turned(x, lengths)
            f, b = _forward(net, "f", x), _forward(net, "b", back)
            h = np.concatenate((f.h, _turned(b.h, lengths)), axis=2)
            p = _sigmoid(h @ net["w"] + net["w0"][0])
            d = ((p - y) * known / max(1, known.sum())).astype(np.float32)
            grads = {key: np.zeros_like(a) for key, a in net.items()}
            grads["w"] += h.reshape(-1, 2 * size).T @ d.reshape(-1)
            grads["w0"] += d.sum()
            dh = d[:, :, None] * net["w"]
            _backward(net, "f", x, f, dh[:, :, :size], grads)
            _backward(net, "b", back, b, _turned(dh[:, :, size:], lengths), grads)
            step += 1
            for key, g in grads.items():
                g = np.clip(g, -1, 1)
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.99 * v[key] + 0.01 * g * g
                net[key] = net[key] - rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)
                net[key] = net[key].astype(np.float32)
    return net


def probabilities(net: Network, pages: Sequence[Sequence[Block]]) -> list[np.ndarray]:
    """Of each block of each page to be main text. Short pages run side by side, long ones a chunk after another."""
    out: list[np.ndarray] = [np.zeros(len(p), np.float32) for p in pages]
    size = net["fh"].shape[0]
    short = sorted((i for i, p in enumerate(pages) if 0 < len(p) <= CHUNK), key=lambda i: len(pages[i]))
    group: list[int] = []
    for k, i in enumerate(short):
        group.append(i)
        if k + 1 == len(short) or (len(group) + 1) * len(pages[short[k + 1]]) > 2 * CHUNK:
            x, lengths = _padded([vectors(pages[j], 0, len(pages[j])) for j in group])
            h = np.concatenate((_forward(net, "f", x).h, _turned(_forward(net, "b", _turned(x, lengths)).h, lengths)), axis=2)
            p = _sigmoid(h @ net["w"] + net["w0"][0])
            for row, j in enumerate(group):
                out[j] = p[row, : lengths[row]]
            group = []
    for i, page in enumerate(pages):
        if len(page) > CHUNK:
            score = np.zeros(len(page), np.float32)
            pieces = range(0, len(page), CHUNK)
            for side, weights, ks in (("f", net["w"][:size], pieces), ("b", net["w"][size:], pieces[::-1])):
                state = None
                for k in ks:
                    x = vectors(page[k : k + CHUNK], k, len(page))[None]
                    run = _forward(net, side, x if side == "f" else x[:, ::-1], state)
                    state = run.end
                    h = run.h[0] if side == "f" else run.h[0, ::-1]
                    score[k : k + CHUNK] += h @ weights
            out[i] = _sigmoid(score + net["w0"][0])
    return out


# Fixed values of the layouts: containers of the main text, and parts of a page with the names that they bear.
_CONTAINERS = (
    "article", "main", "article", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="entry-content"',
    'div class="story-text"', 'div class="article__body"', 'div role="main"', 'div class="text"', "section", "div",
)
_PARTS = {
    "menu": ("nav div ul menu", "nav menu navbar topnav breadcrumb navigation links"),
    "header": ("header div", "header masthead top site logo"),
    "footer": ("footer div", "footer copyright bottom legal imprint"),
    "sidebar": ("aside div section", "sidebar related widget rail recommended trending popular tags"),
    "advert": ("div aside section", "ad ads advert advertisement sponsor sponsored promo banner"),
    "notice": ("div section dialog", "cookie notice consent gdpr alert popup modal newsletter subscribe paywall"),
    "form": ("form div", "form search login contact signup"),
    "comments": ("div section ol ul", "comments comment discussion replies respond reply disqus reader"),
}
_BY_NAME = frozenset("nav menu header footer aside dialog form".split())


def laid_out(rng: random.Random, title: str, paragraphs: Sequence[str], pool: Sequence[str]) -> str:
    """A page with the given main text and parts made of other texts; data-y holds each block's label."""
    cut = lambda most: " ".join(rng.choice(pool).split()[: rng.randrange(1, most)]) or "x"
    safe = entities.escape

    def part(kind: str) -> str:
        tags, names = _PARTS[kind]
        tag = rng.choice(tags.split())
        words = rng.sample(names.split(), rng.randrange(1, 3))
        named = "" if tag in _BY_NAME and rng.random() < 0.5 else f' {rng.choice(["class", "class", "id"])}="{rng.choice("- _").join(words)}"'
        if kind in ("menu", "sidebar") and rng.random() < 0.8:
            inner = "".join(rng.choice(["<li><a href=x>{}</a></li>", "<a href=x>{}</a> ", "<p><a href=x>{}</a>"]).format(safe(cut(5))) for _ in range(rng.randrange(2, 9)))
        elif kind == "form":
            inner = f"<label>{safe(cut(4))}</label><input><p>{safe(cut(20))}<button>{safe(cut(3))}</button><select><option>{safe(cut(3))}<option>{safe(cut(3))}</select>"
        elif kind == "comments":
            say = rng.choice(["<li><div class=author>{}</div><p>{}</p></li>", "<div><b>{}</b><p>{}</p></div>", "<h4>{}</h4><p>{}</p>", "<p>{}</p><p>{}</p>"])
            inner = "".join(say.format(safe(cut(3)), safe(cut(rng.choice([12, 90])))) for _ in range(rng.randrange(1, 6)))
        else:
            sign = "&copy; " if kind == "footer" and rng.random() < 0.6 else ""
            shell = rng.choice(["<p>{}</p>", "<div>{}</div>", "{}", "<h3>{}</h3>"])
            inner = sign + "".join(shell.format(safe(cut(rng.choice([8, 30, 70])))) for _ in range(rng.randrange(1, 4)))
        return f"<{tag}{named} data-y=0>{inner}</{tag}>"

    def parts(kinds: str, chance: float) -> list[str]:
        return [part(k) for k in kinds.split() if rng.random() < chance]

    body = [f"<{rng.choice(['h1', 'h1', 'h2'])}>{safe(title)}</h1>" if rng.random() < 0.9 else ""]
    for p in paragraphs:
        shell = rng.choices(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h3>{}</h3>", "<p><b>{}<br>"], [8, 2, 1, 1, 1, 1, 1])[0]
        words = p.split()
        if len(words) > 6 and rng.random() < 0.2:
            k = rng.randrange(1, len(words) - 2)
            p = " ".join(map(safe, words[:k])) + f" <a href=x>{safe(words[k])}</a> " + " ".join(map(safe, words[k + 1 :]))
        else:
            p = safe(p)
        body.append(shell.format(p))
    inside = parts("advert sidebar form notice", 0.15)
    for x in inside:
        body.insert(rng.randrange(1, len(body) + 1), x)
    body += parts("comments", 0.3)
    main = rng.choice(_CONTAINERS)
    before = parts("menu header notice advert form sidebar", 0.45)
    after = parts("comments comments sidebar footer advert menu form notice", 0.4)
    rng.shuffle(before)
    content = f"<{main} data-y=1>{''.join(body)}</{main.split()[0]}>"
    page = "".join(before) + content + "".join(after)
    if rng.random() < 0.4:
        page = f"<div {rng.choice(['id=wrapper', 'class=page', 'class=container', ''])}>{page}</div>"
    return f"<html><head><title data-y=0>{safe(title)}</title></head><body>{page}</body></html>"


def examples(pages: Sequence[str], how: Training) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, labels) of the sampled pages and of their texts in new layouts."""
    rng, mix = random.Random(how.seed), np.random.default_rng(how.seed)
    read = [blocks(p) for p in pages]
    pool = [b.text for bs in read for b in bs]
    out = []
    for own in read:
        content = [b.text for b in own if b.label == 1]
        made = [own] if content else []
        # where nothing is named, the longest blocks serve as texts for layouts
        content = content or sorted((b.text for b in own), key=lambda t: (-len(t), t))[:8]
        if content:
            most = rng.randrange(2, 25)
            made += [blocks(laid_out(rng, content[0], content[1 : 1 + most], pool)) for _ in range(how.layouts)]
        for page in made:
            page = page[: how.longest]  # of a training example only
            if page:
                x = vectors(page, 0, len(page))
                if mix.random() < 0.4:  # texts say little in some examples: those of other blocks, or stretched
                    x[:, PATH_BITS + OWN_BITS : -4] = mix.permutation(x[:, PATH_BITS + OWN_BITS : -4])
                    x[:, -COUNTS:-4] *= mix.choice([0.3, 1, 2, 4], size=(len(x), 1)).astype(np.float32)
                out.append((x, np.array([b.label for b in page])))
    return out


def train(pages: DataFrame, how: Training = Training()) -> Network | None:
    """Network from a sample of the pages; None where no page has any block."""
    named = F.lower("html").rlike(r"<(article|main)[\s>]")
    usable = pages.select("html", F.xxhash64("html").alias("at")).filter(F.length("html").between(1, how.chars))
    # the smallest hashes of whole texts: the same pages whatever the order of the table, copies once; the texts
    # themselves are read when their hashes are known, so that no more than the sample reaches the driver
    hashes = usable.select((~named).cast("int").alias("other"), "at").distinct().orderBy("other", "at").limit(how.pages).collect()
    chosen = usable.filter(F.col("at").isin([r["at"] for r in hashes])).groupBy("at").agg(F.min("html").alias("html"))
    sample = sorted(chosen.collect(), key=lambda r: r["at"])
    found = examples([r.html for r in sample], how)
    return fit(found, how) if found else None


def main_text(pages: Sequence[Sequence[Block]], net: Network | None) -> list[str]:
    """The blocks of each page that the network takes for main text, joined; nothing without a network."""
    if net is None:
        return ["" for _ in pages]
    chosen = probabilities(net, pages)
    return [" ".join(b.text for b, p in zip(page, ps, strict=True) if p >= 0.5) for page, ps in zip(pages, chosen, strict=True)]


def extract(pages: DataFrame, net: Network | None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts: list[str] = []
            for k in range(0, len(batch), 64):
                texts += main_text([blocks(p) for p in batch["html"].iloc[k : k + 64]], net)
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(read, "page_id long, url string, text string, n_chars long")
