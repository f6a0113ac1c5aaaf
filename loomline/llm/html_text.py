"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the
path of open elements. A bidirectional LSTM in numpy reads, block by block, a vector of
the path (tags, classes, ids and roles, hashed), a vector of the words (hashed) and a few
shape measures, and labels every block as article or not with the whole page in view.

The model is trained here, on pages made from a seed by `made_pages`: it takes a few
seconds, is the same for the same seed, and is kept by the driver.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import free_name, mapped, numbered_columns, slices

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = set("script style noscript template iframe svg canvas head select datalist".split())
#: RAW elements that last to the end of the page where they have no end tag.
TO_END = {"script", "style"}
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Formulas are part of the words around them.
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd menclose semantics annotation".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: An opening tag in a key's set ends an open element of that key.
ENDS = {"p": set("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
        "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = set("ul ol dl table body html div article section".split())

_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")


#: Open elements that a block's path names at most, half of them from the top of the page and half next to the block.
DEEP = 64
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_QUOTE = re.compile(r"""[>"']""")


class _Scanner:
    """The tags of a page one after the other, in time that follows its length whatever is left open in it.

    Past the last `>` nothing is a tag. A quote that is opened where an earlier tag, read
    with its quotes, found no end has none either: such a tag ends at the next `>`.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.vain: set[int] = set()

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) from `at` on; comments and declarations have no name."""
        while m := _OPEN.search(self.page, at):
            if m[1] or m[2]:
                end = self.page.find("-->" if m[1] else ">", m.end())
                return m.start(), len(self.page) if end < 0 else end + (3 if m[1] else 1), "", False, ""
            if m.start() > self.last:
                at = m.end()
                continue
            end = self._end(m.end())
            return m.start(), end + 1, m[4].lower(), bool(m[3]), self.page[m.end():end]
        return None

    def _end(self, at: int) -> int:
        """Where the tag's `>` is, outside of quotes if these have ends."""
        start, seen = at, []
        while (m := _QUOTE.search(self.page, at, self.last + 1)) and m[0] != ">":
            q = m.start()
            if q in self.vain or q >= self.quotes[m[0]]:
                seen.append(q)
                m = None
                break
            seen.append(q)
            at = self.page.find(m[0], q + 1) + 1
        if m:
            return m.start()
        self.vain.update(seen)
        return self.page.find(">", start)


def leaf_blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters in links) of each block with text, in page order.

    References are decoded, white space is one space. Comments, declarations and the
    content of RAW elements are no blocks; one without an end tag, but for those in
    TO_END, is no more than its tag. Tags left open are closed as browsers do. Of more
    than DEEP open elements the path names the first and the last. Time and memory follow
    the length of the page: what is open is found by its place and not by a walk.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    names: list[str] = []
    path: list[str] = []
    parts: list[str] = []
    endless: set[str] = set()
    # Places of the open elements of a name, and of those that bound what an end tag closes.
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    linked, at, page = 0, 0, page or ""
    tags = _Scanner(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((tuple(path) if len(path) <= DEEP else (*path[:DEEP // 2], *path[-DEEP // 2:]), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        for name in names[k:]:
            places[name].pop()
        del names[k:]
        del path[k:]
        while scopes and scopes[-1] >= k:
            scopes.pop()

    while True:
        m = tags.next(at)
        text = page[at:m[0] if m else len(page)]
        if text:
            parts.append(text)
            if places.get("a"):
                linked += len(text.strip())
        if not m:
            break
        _, at, tag, closing, attrs = m
        if not tag:
            continue
        if not closing and tag in RAW:
            if not attrs.endswith("/") and tag not in endless:
                ending = "body" if tag == "head" else tag
                found = re.compile(rf"</{tag}\s*>|<{ending}\b" if tag == "head" else rf"</{tag}\b[^>]*>", re.I).search(page, at, tags.last + 1)
                if found:
                    at = found.end() if found[0].startswith("</") else found.start()
                elif tag in TO_END:
                    at = len(page)
                else:
                    endless.add(tag)
            flush()
            continue
        if tag not in INLINE:
            flush()
        if closing:
            k = places[tag][-1] if places.get(tag) else -1
            if k >= 0 and not (tag in INLINE and scopes and scopes[-1] > k):
                close(k)
            continue
        if tag in VOID:
            continue
        # The innermost element within the scope that this tag ends.
        k = max((places[n][-1] for n, ended in ENDS.items() if tag in ended and places.get(n)), default=-1)
        if k > (scopes[-1] if scopes else -1):
            close(k)
        own = [tag]
        for a in _ATTR.finditer(attrs) if attrs else ():
            own += [f"={x}" for x in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
        if not attrs.rstrip().endswith("/"):
            places.setdefault(tag, []).append(len(names))
            if tag in SCOPES:
                scopes.append(len(names))
            names.append(tag)
            path.append(" ".join(own))
    flush()
    return out


PATHS, WORDS, EMBED_P, EMBED_W, SHAPES, HIDDEN = 8192, 512, 20, 8, 9, 20


@functools.lru_cache(maxsize=20_000)
def _path_ids(path: tuple[str, ...]) -> tuple[int, ...]:
    tokens = {t for part in path for t in part.split(" ")} - {"html", "body"}
    tokens |= {f"last {t}" for t in path[-1].split(" ")} if path else set()
    return tuple(zlib.crc32(t.encode()) % PATHS for t in sorted(tokens)) or (0,)


def _flat(parts) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids end to end, and the length of each."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(chain.from_iterable(parts), np.int64, int(sizes.sum())), sizes


def features(blocks) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Ids of path tokens and of words, and shape measures, of each block."""
    n = len(blocks)
    paths, words, shapes = [], [], np.zeros((n, SHAPES), np.float32)
    for i, (path, text, linked) in enumerate(blocks):
        ws = text.lower().split(" ")
        paths.append(_path_ids(path))
        words.append([zlib.crc32(w.encode()) % WORDS for w in ws])
        last = path[-1].split(" ", 1)[0] if path else ""
        shapes[i] = (np.log1p(len(ws)) / 4, linked / max(1, len(text)), text[-1] in ".!?…", text.count(",") / len(ws), min(len(path), 12) / 6,
                     i / n, (n - i) / n, last in HEADINGS, sum(map(str.isupper, text)) / len(text))
    return _flat(paths), _flat(words), shapes


class Labeller:
    """Weights of the network: hashed embeddings, one LSTM for either direction, one logit for each block."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        d, h = EMBED_P + EMBED_W + SHAPES, HIDDEN
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"ep": (r.standard_normal((PATHS, EMBED_P)) * 0.05).astype(np.float32), "ew": (r.standard_normal((WORDS, EMBED_W)) * 0.1).astype(np.float32),
                  "fx": f(d, 4 * h), "fh": f(h, 4 * h), "fb": np.zeros(4 * h, np.float32), "bx": f(d, 4 * h), "bh": f(h, 4 * h), "bb": np.zeros(4 * h, np.float32),
                  "ox": f(d, 1), "oh": f(2 * h, 1), "ob": np.zeros(1, np.float32)}
        for k in ("fb", "bb"):
            self.w[k][h:2 * h] = 1.0  # gates start by keeping

    def inputs(self, pages):
        """(batch, blocks, d) and the mask; short pages are padded."""
        n, t = len(pages), max(len(p[2]) for p in pages)
        x, mask = np.zeros((n, t, EMBED_P + EMBED_W + SHAPES), np.float32), np.zeros((n, t), np.float32)
        for i, (paths, words, shapes) in enumerate(pages):
            for (flat, sizes), table, a, b in ((paths, "ep", 0, EMBED_P), (words, "ew", EMBED_P, EMBED_P + EMBED_W)):
                x[i, :len(sizes), a:b] = np.add.reduceat(self.w[table][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            x[i, :len(shapes), EMBED_P + EMBED_W:] = shapes
            mask[i, :len(shapes)] = 1
        return x, mask

    def _run(self, x, mask, k, keep):
        """One direction; `keep` collects what the way back needs."""
        n, t, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        zx = x @ self.w[k + "x"] + self.w[k + "b"]
        out = np.zeros((n, t, HIDDEN), np.float32)
        for s in range(t) if k == "f" else range(t - 1, -1, -1):
            z = zx[:, s] + h @ self.w[k + "h"]
            gates = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g, m = np.tanh(z[:, 3 * HIDDEN:]), mask[:, s, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((s, h, c, i, f, o, g, tanh, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[:, s] = h
        return out

    def logits(self, x, mask, keep=None):
        hidden = np.concatenate([self._run(x, mask, k, None if keep is None else keep[k]) for k in "fb"], axis=2)
        return (hidden @ self.w["oh"] + x @ self.w["ox"])[:, :, 0] + self.w["ob"], hidden

    def gradients(self, pages, labels):
        x, mask = self.inputs(pages)
        keep: dict[str, list] = {"f": [], "b": []}
        z, hidden = self.logits(x, mask, keep)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = ((p - labels) * mask / mask.sum())[:, :, None].astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["oh"], g["ox"], g["ob"] = np.einsum("nth,nto->ho", hidden, dz), np.einsum("ntd,nto->do", x, dz), dz.sum(axis=(0, 1))
        dhidden, dx = dz @ self.w["oh"].T, dz @ self.w["ox"].T
        for j, k in enumerate("fb"):
            dh_next = np.zeros((len(pages), HIDDEN), np.float32)
            dc_next = np.zeros_like(dh_next)
            for s, h, c, i, f, o, gg, tanh, m in reversed(keep[k]):
                dh = dhidden[:, s, j * HIDDEN:(j + 1) * HIDDEN] + dh_next
                dc = dc_next * m + m * dh * o * (1 - tanh * tanh)
                d = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), m * dh * tanh * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                g[k + "x"] += x[:, s].T @ d
                g[k + "h"] += h.T @ d
                g[k + "b"] += d.sum(axis=0)
                dx[:, s] += d @ self.w[k + "x"].T
                dh_next = d @ self.w[k + "h"].T + dh * (1 - m)
                dc_next = dc * f + dc_next * (1 - m)
        for k, table, a, b in ((0, "ep", 0, EMBED_P), (1, "ew", EMBED_P, EMBED_P + EMBED_W)):
            ids = np.concatenate([p[k][0] for p in pages])
            each = np.concatenate([np.repeat(dx[i, :len(p[2]), a:b] / p[k][1][:, None], p[k][1], axis=0) for i, p in enumerate(pages)])
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[order], prepend=-1))
            g[table][ids[order][first]] = np.add.reduceat(each[order], first, axis=0)
        return g

    def label(self, pages) -> list[np.ndarray]:
        """For each page of features, which blocks are article. Pages are batched by length."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][2])), key=lambda i: len(pages[i][2]))
        at = 0
        while at < len(order):
            size = max(1, min(256, 40_000 // len(pages[order[min(at + 255, len(order) - 1)]][2])))
            part = order[at:at + size]
            x, mask = self.inputs([pages[i] for i in part])
            z, _ = self.logits(x, mask)
            for i, row in zip(part, z):
                out[i] = row[:len(pages[i][2])] > 0
            at += size
        return out


#: Marks blocks of articles in made pages; taken out before training.
_MARK = "⁠"
_CONTENT = "article post content entry story main body text page single read column wrapper text-body entry-content post-body".split()
_JUNK = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs links tabs pager pagination".split(),
    "head": "header masthead top banner branding site-header logo tagline topbar".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adbox dfp banner-ad".split(),
    "notice": "notice cookie cookies consent alert gdpr message warning popup modal overlay announcement disclaimer".split(),
    "side": "sidebar aside widget related recommended trending popular side rail more share social tags author-box".split(),
    "foot": "footer foot copyright legal bottom site-footer colophon".split(),
    "comment": "comments comment reply discussion responses disqus feedback comment-list comment-body reviews".split(),
    "form": "form newsletter signup subscribe search login contact-form".split(),
}
_PHRASES = {
    "nav": "Home|About|Contact|News|Sports|Next|Previous|Login|Help", "head": "Welcome|Daily|Your source", "ad": "Advertisement|Sponsored|Buy now|Shop|Sale",
    "notice": "We use cookies|Please accept|This site|Notice|Warning|By continuing you agree to our policy", "side": "Related|Read more|Share this|Popular|Tags|Most read",
    "foot": "© 2020|All rights reserved|Privacy|Terms|Imprint", "comment": "Comments|Reply|says|posted|2 comments|I agree", "form": "Subscribe|Email|Send|Search|Your name|Submit|Password",
}


_OWN_NAMES = re.compile(r"""\b(class|id)=(?:"([^"]*)"|([^\s">]+))""")


def _disguised(page: str, r: random.Random) -> str:
    """The page as a template would have it whose names say nothing: other names for classes and ids, plain elements, classes on paragraphs."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda: " ".join("".join(r.choices(letters, k=r.randint(1, 6))) + r.choice(["", f"-{r.randint(1, 9)}", "-" + "".join(r.choices(letters, k=r.randint(1, 4)))]) for _ in range(r.choice([1, 1, 2, 3])))
    names: dict[str, str] = {}
    page = _OWN_NAMES.sub(lambda m: f'{m[1]}="{names.setdefault(m[2] or m[3], name())}"', page)
    if r.random() < 0.7:
        page = re.sub(r"<(/?)(?:nav|header|footer|aside|article|main|section|form)\b", r"<\1div", page)
    x = r.random()
    if x < 0.45:
        page = page.replace("<p>", f'<div class="{name()}">').replace("</p>", "</div>")
    elif x < 0.8:
        page = page.replace("<p>", f'<p class="{name()}">')
    if r.random() < 0.3:
        page = re.sub(r"<(/?)(?:ul|ol)>", "", page).replace("<li><a", "<a").replace("</a></li>", "</a>" + r.choice(["<br>", " ", " | "]))
    return page


def made_pages(n: int, seed: int, disguised: float = 0.5):
    """n pages with labels: (html, one 0 or 1 for each leaf block). A share is disguised, some of these laid out by a table."""
    r = random.Random(seed)
    letters = ["th he an in er re on at en nd ti es or te of ed is it al ar".split(), "la de é è que ment ou ai on eux en tion ç".split(), "sch ein ü und ich der au ge ver en".split(), "ció os as ra ñ do ja ta que mi".split()]

    def words(k: int, kind: list[str]) -> str:
        ws = ["".join(r.choices(kind, k=r.randint(1, 4))) for _ in range(k)]
        for i in range(k):
            x = r.random()
            ws[i] += "." if x < 0.08 else "," if x < 0.14 else ""
        return " ".join(ws).capitalize() + r.choice([".", ".", ".", "", "!"])

    def length() -> int:
        return max(1, int(r.lognormvariate(2.7, 1.2)))

    def named(kind: list[str], tags: list[str]) -> tuple[str, str]:
        tag, x = r.choice(tags), r.random()
        name = r.choice(kind) + r.choice(["", "", "", "-1", "_wrap", "-inner"])
        attr = f' class="{name}"' if x < 0.6 else f' id="{name}"' if x < 0.85 else f' class="c{r.randint(1, 99)} {name}"' if x < 0.95 else ""
        return f"<{tag}{attr}>", f"</{tag}>"

    def junk(kind: str, lang: list[str]) -> str:
        own = {"nav": ["nav", "nav", "div", "ul"], "head": ["header", "header", "div"], "ad": ["div", "div", "aside", "section"], "notice": ["div", "div", "section", "p"],
               "side": ["aside", "aside", "div", "section"], "foot": ["footer", "footer", "div"], "comment": ["section", "div", "div", "ol"], "form": ["form", "form", "div"]}[kind]
        plain = own[0] in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5
        a, b = (f"<{own[0]}>", f"</{own[0]}>") if plain else named(_JUNK[kind], [t for t in own if t not in ("ul", "ol", "p")] or ["div"])
        say = lambda: r.choice(_PHRASES[kind].split("|")) if r.random() < 0.5 else words(r.randint(1, 4), lang)
        inner = ""
        if kind == "nav" or kind in ("foot", "side", "head") and r.random() < 0.5:
            inner += "<ul>" + "".join(f'<li><a href="/x">{say()}</a></li>' for _ in range(r.randint(2, 9))) + "</ul>"
        if kind == "form" or kind == "comment" and r.random() < 0.5:
            inner += ("" if kind == "form" else "<form>") + "".join(f"<label>{say()}</label><input name=q>" for _ in range(r.randint(0, 3))) + f"<p>{words(r.randint(2, 12), lang)}</p><button>{say()}</button>" + ("" if kind == "form" else "</form>")
        if kind == "comment":
            inner = f"<h3>{say()}</h3>" + "".join(f'<{t}{r.choice(["", " class=comment"])}><b>{words(1, lang)}</b> <p>{words(length(), lang)}</p></{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5))) + inner
        if kind in ("ad", "notice", "foot", "side", "head") and (not inner or r.random() < 0.6):
            x = r.random()
            text = f"{say()} {words(min(60, length()), lang)}" if r.random() < 0.7 else say()
            inner += text if x < 0.5 else f"<p>{text}</p>" if x < 0.8 else f"<h3>{say()}</h3><p>{text}</p>"
        return a + inner + b

    def content(lang: list[str]) -> str:
        mark = lambda k: _MARK + words(k, lang)
        x = r.random()
        if x < 0.8:
            text = mark(length())
            if r.random() < 0.15:
                text = f"<b>{text}" + r.choice(["</b>", "<br>", "</b><br>"])
            elif r.random() < 0.2:
                text = f'{text} <a href="/y">{words(r.randint(1, 4), lang)}</a> {words(r.randint(1, 9), lang)}'
            return f"<p>{text}" + ("</p>" if plain else r.choice(["</p>", "</p>", "</p>", ""]))
        if x < 0.88:
            return f"<h2>{mark(r.randint(1, 7))}</h2>"
        if x < 0.93:
            return "<ul>" + "".join(f"<li>{mark(r.randint(2, 14))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if x < 0.96:
            return f"<blockquote><p>{mark(length())}</p></blockquote>"
        return "<table>" + "".join(f"<tr><td>{mark(r.randint(1, 4))}</td><td>{mark(r.randint(1, 4))}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>"

    out = []
    for _ in range(n):
        lang, other = r.choice(letters), r.choice(letters)
        plain = r.random() < disguised
        rows = plain and r.random() < 0.3
        cell = lambda text: f"<td>{text}</td>" if rows else text
        row = lambda text: f"<tr>{text}</tr>" if rows else text
        title = words(r.randint(3, 9), lang)
        page = f"<!DOCTYPE html><html lang=en><head><title>{title}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>"
        before, after = ["notice", "head", "nav", "ad", "side", "form", "notice", "ad"], ["side", "ad", "comment", "form", "nav", "foot", "notice"]
        some = lambda kinds, share, langs: "".join(junk(k, r.choice(langs)) for k in kinds if r.random() < share)
        page += "<table>" if rows else ""
        page += row(cell(some(before[:2], 0.45, [other]))) + ("<tr>" if rows else "") + cell(some(before[2:], 0.45, [other]))
        x = r.random()
        a, b = ("<article>", "</article>") if x < 0.55 else ("<main>", "</main>") if x < 0.65 else ("", "") if x < 0.7 else named(_CONTENT, ["div", "section", "main", "article"])
        if r.random() < 0.3:
            c, d = named(_CONTENT, ["div", "main"])
            a, b = c + a, b + d
        body = a + (f"<h1>{_MARK}{title}</h1>" + (junk(r.choice(["side", "nav"]), other) if r.random() < 0.2 else "") if r.random() < 0.85 else "")
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 8, 12, 20])):
            body += content(lang)
            if r.random() < 0.06:
                body += junk(r.choice(["ad", "side", "form", "notice", "nav", "comment"]), r.choice([lang, other]))
        page += cell(body + (junk("comment", lang) if r.random() < 0.12 else "") + b)
        page += cell(some(after[:2], 0.4, [lang, other])) + ("</tr>" if rows else "") + row(cell(some(after[2:], 0.4, [lang, other]))) + ("</table>" if rows else "")
        page = _disguised(page, r) if plain else page
        page += r.choice(["</body></html>", ""])
        blocks = leaf_blocks(page)
        labels = np.array([_MARK in t for _, t, _ in blocks], np.float32)
        blocks = [(p, " ".join(t.replace(_MARK, "").split()), k) for p, t, k in blocks]
        if blocks and all(t for _, t, _ in blocks):
            out.append((page.replace(_MARK, ""), blocks, labels))
    return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = 2400, epochs: int = 8, seed: int = 11) -> Labeller:
    """The labeller of a seed: Adam over minibatches of pages of like length."""
    made = [(features(b), y) for _, b, y in made_pages(pages, seed)]
    model, rng, step = Labeller(seed), np.random.default_rng(seed), 0
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(x) for k, x in model.w.items()}
    batches = [b for b in np.array_split(np.argsort([len(y) for _, y in made], kind="stable"), max(1, len(made) // 24)) if len(b)]
    total = epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            chosen = [made[i] for i in batches[k]]
            labels = np.zeros((len(chosen), max(len(y) for _, y in chosen)), np.float32)
            for i, (_, y) in enumerate(chosen):
                labels[i, :len(y)] = y
            step += 1
            rate = 0.02 * (1 - step / (total + 1))
            for name, g in model.gradients([f for f, _ in chosen], labels).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                model.w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def extract_all(model: Labeller, pages: list[str | None]) -> list[str]:
    blocks = [leaf_blocks(p) for p in pages]
    keep = model.label([features(b) for b in blocks])
    return [" ".join(t for (_, t, _), k in zip(b, ks) if k) for b, ks in zip(blocks, keep)]


#: Bytes of pages that are labelled at once, which bounds memory.
AT_ONCE = 4 << 20


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Labeller | None = None) -> DataFrame:
    """The columns in `keep`, text and n_chars (code points), one row for each row of `pages`; underscores follow names that are taken.

    A null or empty page has an empty text. Other columns are not read; the columns in
    `keep` may be null, repeated or of any type. Pages may be of any length and depth.
    """
    model = model or trained()
    kept = pages.select(*keep)
    names = [free_name(kept, "text"), free_name(kept, "n_chars")]
    plain, _ = numbered_columns(pages.select(*keep, F.col(html_col)))

    def run(batches):
        for part in (p for batch in batches for p in slices(batch, batch.num_columns - 1, AT_ONCE)):
            texts = extract_all(model, part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*part.schema.names[:-1], "text", "n_chars"])

    out = T.StructType([*plain.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return mapped(plain, run, out).toDF(*keep, *names)


def op8_html_text(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
