"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A tolerant parser cuts a page into leaf blocks: runs of text between block-level tags, with the open elements above
them. Each block has features of its ancestors' tags and class names and of its text; the field has a weight for each
(feature, state) and each pair of neighbouring states, and Viterbi picks the best states of the whole page.

The field is trained here, by gradients of the exact likelihood (forward-backward), on labelled pages: ``labelled_pages``
writes pages of many layouts and knows which of their blocks are the article. Their words are random letters, so
no word of theirs is learnt; class names count by what they say (``CLASS_WORDS``).

Edge cases: null or empty html has the empty text; text outside any element is a block; scripts, styles, comments,
titles and what the end of a cut page leaves open are never text; end tags that HTML lets out are not missed; an unclosed comment or script runs to the end;
pages of any length are decoded whole; repeated rows are decoded alike; an empty table gives an empty result; input
columns other than ``keep`` and the html are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import ship

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object title textarea".split())
#: What an opening tag ends, unless one of its limits comes first.
CLOSES = {"p": "p", "li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}
LIMITS = frozenset("article aside blockquote body div dl fieldset footer form header li main nav ol section table td th ul".split())

#: What the words of class and id names say, by how they begin.
CLASS_WORDS = {
    "ad": ("adv", "adsense", "sponsor", "promo", "banner", "partner", "ad$", "ads$", "adbox", "adslot"),
    "nav": ("nav", "menu", "breadcrumb", "crumb", "pagin", "pager", "toc", "tabs", "skip"),
    "side": ("side", "widget", "rail", "related", "recommend", "popular", "trending", "more$", "readnext"),
    "notice": ("cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "newsletter", "subscri", "paywall", "toast"),
    "foot": ("foot", "copyright", "legal", "bottom", "colophon"),
    "head": ("header", "masthead", "logo", "brand", "topbar", "top$"),
    "share": ("share", "social", "follow", "toolbar", "print"),
    "comment": ("comment", "disqus", "respond", "reply", "replies", "discussion", "review"),
    "form": ("form", "login", "signin", "search", "register", "contact"),
    "main": ("content", "article", "post", "entry", "story", "main", "body", "text", "page"),
}
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|!--|[!?/])""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


def class_kinds(attributes: str) -> tuple[str, ...]:
    """What an element's class, id and role names say, sorted."""
    found = set()
    for m in _NAMES.finditer(attributes):
        name = re.sub(r"([a-z])([A-Z])", r"\1-\2", m[1] or m[2] or m[3] or "").lower()
        for word in _SPLIT.split(name):
            for kind, starts in CLASS_WORDS.items():
                if any(word == s[:-1] if s[-1] == "$" else word.startswith(s) for s in starts):
                    found.add(kind)
                    break
    return tuple(sorted(found))


Path = tuple[tuple[str, tuple[str, ...]], ...]


def leaf_blocks(page: str | None) -> list[tuple[Path, str, int]]:
    """The leaf blocks in page order: (open elements with their class kinds, text, characters of it in links)."""
    out: list[tuple[Path, str, int]] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at, end = 0, False, 0, len(page)

    def text(a: int, b: int) -> None:
        nonlocal linked
        if a < b:
            parts.append(page[a:b])
            if in_link:
                linked += b - a

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            words = (entities.unescape(raw) if "&" in raw else raw).split()
            if words:
                out.append((tuple(stack), " ".join(words), linked))
            parts, linked = [], 0

    while at < end:
        spot = page.find("<", at)
        if spot < 0:
            text(at, end)
            break
        m = _TAG.match(page, spot)
        if m is None:
            m = _LOOSE.match(page, spot)
            if m is None:
                rest = page[spot + 1 : spot + 2]
                if rest.isalpha() or rest in ("/", "!"):  # a tag that the end of the page cuts
                    text(at, spot)
                    break
                text(at, spot + 1)
                at = spot + 1
                continue
        text(at, spot)
        at = m.end()
        if m[0] == "<!--":
            stop = page.find("-->", at)
            at = end if stop < 0 else stop + 3
            continue
        name = m.group(2)
        if name is None:
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = False
            elif name in BLOCKS:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            continue
        if name == "a":
            in_link = True
        elif name == "br":
            parts.append(" ")
        elif name in RAW:
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                at = end if stop is None else stop.end()
        elif name in BLOCKS:
            flush()
            if name in VOID:
                continue
            in_link = False
            if name in CLOSES or name[0] == "h" and name[1:].isdigit():
                also = {name, CLOSES.get(name, "p"), "p"}
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in also:
                        del stack[i:]
                        break
                    if stack[i][0] in LIMITS:
                        break
            elif stack and stack[-1][0] == "p":
                stack.pop()
            kinds = class_kinds(m[3]) if "=" in m[3] else ()
            stack.append((name, kinds))
    flush()
    return out


def path_features(path: Path) -> list[str]:
    out = []
    near = {}
    for depth, (name, kinds) in enumerate(reversed(path)):
        if depth < 2:
            out.append(f"up{depth}:{name}")
        out.append(f"in:{name}")
        for k in kinds:
            out.append(f"class:{k}")
            near.setdefault(k, depth)
        if depth < 2:
            out.extend(f"class{depth}:{k}" for k in kinds)
    for name, _ in reversed(path):  # the innermost element that says anything
        if name in ("nav", "header", "footer", "aside", "form", "article", "main", "menu", "dialog", "button", "label", "select"):
            out.append(f"says:{name}")
            break
    if near:
        out.append("says:class:" + min(near, key=lambda k: (near[k], k)))
    return sorted(set(out))


_SIZES = (1, 3, 6, 11, 21, 41)


def text_features(text: str, linked: int, place: float) -> list[str]:
    n = text.count(" ") + 1
    size = sum(n >= s for s in _SIZES)
    link = min(3, int(3.999 * linked / max(1, len(text)))) if linked else 0
    out = [f"words:{size}", f"links:{link}", f"words-links:{size}-{link}", "bias"]
    if text[-1] in ".!?…:\"”»":
        out.append("sentence")
        out.append(f"sentence:{size}")
    if "©" in text or "opyright" in text or "ights reserved" in text:
        out.append("rights")
    if text.count(",") >= 2:
        out.append("commas")
    if "|" in text or "»" in text or "·" in text:
        out.append("bars")
    out.append("first" if place < 0.1 else "last" if place > 0.9 else "middle")
    return out


def block_features(blocks: list[tuple[Path, str, int]]) -> list[list[str]]:
    n = max(1, len(blocks) - 1)
    return [path_features(p) + text_features(t, k, i / n) for i, (p, t, k) in enumerate(blocks)]


class Field:
    """Weights of two states: 0 boilerplate, 1 article."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[float]], start: list[float]):
        self.weights, self.moves, self.start = weights, moves, start
        self._paths: dict[Path, tuple[float, float]] = {}

    def _score(self, names: list[str]) -> tuple[float, float]:
        found = [self.weights[f] for f in names if f in self.weights]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def decode(self, blocks: list[tuple[Path, str, int]]) -> list[int]:
        """The states of the best path."""
        if not blocks:
            return []
        n, back = max(1, len(blocks) - 1), []
        (m00, m01), (m10, m11) = self.moves
        a, b = self.start
        for i, (path, text, linked) in enumerate(blocks):
            if (p := self._paths.get(path)) is None:
                if len(self._paths) > 50_000:
                    self._paths.clear()
                p = self._paths[path] = self._score(path_features(path))
            t = self._score(text_features(text, linked, i / n))
            if i:
                from0, from1 = a + m00 < b + m10, a + m01 < b + m11
                back.append((from0, from1))
                a, b = (b + m10 if from0 else a + m00), (b + m11 if from1 else a + m01)
            a, b = a + p[0] + t[0], b + p[1] + t[1]
        state = int(b > a)
        states = [state]
        for from0, from1 in reversed(back):
            state = int(from1 if state else from0)
            states.append(state)
        return states[::-1]

    def main_text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        return " ".join(b[1] for b, s in zip(blocks, self.decode(blocks), strict=True) if s)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(pages: list[tuple[str, list[int]]], passes: int = 150, rate: float = 0.3, decay: float = 2e-3) -> Field:
    """A field from (html, state of each leaf block) pages, by adaptive gradients of the penalised likelihood."""
    number: dict[str, int] = {}
    rows = []
    for page, states in pages:
        feats = block_features(leaf_blocks(page))
        if len(feats) != len(states):
            raise ValueError(f"{len(states)} states for {len(feats)} blocks")
        rows.append(([[number.setdefault(f, len(number)) for f in x] for x in feats], states))
    rows = [r for r in rows if r[1]]
    n, longest = len(rows), max(len(s) for _, s in rows)
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), int)
    page_of, at_of, feature = [], [], []
    for i, (feats, states) in enumerate(rows):
        mask[i, : len(states)] = True
        gold[i, : len(states)] = states
        for t, x in enumerate(feats):
            page_of += [i] * len(x)
            at_of += [t] * len(x)
            feature += x
    cell = np.array(page_of) * longest + np.array(at_of)
    feature = np.array(feature)
    w, moves, start = np.zeros((len(number), 2)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full(x.shape, 1e-8) for x in (w, moves, start)]
    one = np.eye(2)[gold] * mask[..., None]
    pairs = mask[:, 1:]
    gold_moves = np.einsum("nti,ntj->ij", one[:, :-1] * pairs[..., None], one[:, 1:])
    for _ in range(passes):
        e = np.stack([np.bincount(cell, w[feature, s], n * longest).reshape(n, longest) for s in (0, 1)], axis=-1)
        f, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        f[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            step = _log_sum(f[:, t - 1, :, None] + moves, 1) + e[:, t]
            f[:, t] = np.where(mask[:, t, None], step, f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _log_sum(moves + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(mask[:, t + 1, None], step, 0)
        total = _log_sum(f[:, -1], 1)
        p = np.exp(f + b - total[:, None, None]) * mask[..., None]
        q = np.exp(f[:, :-1, :, None] + moves + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[..., None, None]
        left = (p - one).reshape(-1, 2)
        grads = [np.stack([np.bincount(feature, left[cell, s], len(number)) for s in (0, 1)], axis=-1) / n + decay * w, (q.sum(axis=(0, 1)) - gold_moves) / n, (p[:, 0] - one[:, 0]).sum(axis=0) / n]
        for x, g, k in zip((w, moves, start), grads, seen, strict=True):
            k += g * g
            x -= rate * g / np.sqrt(k)
    return Field({k: (float(w[i, 0]), float(w[i, 1])) for k, i in number.items()}, moves.tolist(), start.tolist())


def labelled_pages(n: int = 500, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages of many layouts with the state of each of their leaf blocks."""
    rng = random.Random(seed)
    pick = rng.choice

    def word() -> str:
        return "".join(pick("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 9)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(3, 18).capitalize() + pick(("." , ".", ".", "?", "!")) for _ in range(rng.randint(a, b)))

    def page() -> tuple[str, list[int]]:
        out: list[str] = []
        states: list[int] = []

        def leaf(tag: str, text: str, state: int, attributes: str = "", close: bool = True) -> None:
            out.append(f"<{tag}{attributes}>{text}" + (f"</{tag}>" if close else ""))
            states.append(state)

        def links(tag: str, k: int) -> None:
            out.append(f"<{tag}>")
            for _ in range(k):
                leaf("li", f'<a href="/{word()}">{words(1, 3)}</a>', 0)
            out.append(f"</{tag}>")

        def named(kind: str) -> str:
            name = pick([s.rstrip("$") for s in CLASS_WORDS[kind]])
            return pick((f' class="{name}"', f' id="{name}"', f' class="{word()} {name}-{word()}"', f' class="{name}" id="{word()}"'))

        def wrapped(kind: str, body, tags: tuple[str, ...], bare: float = 0.25) -> None:
            tag = pick(tags)
            attributes = "" if tag != "div" and rng.random() < bare else named(kind)
            out.append(f"<{tag}{attributes}>")
            body()
            out.append(f"</{tag}>")

        def menu() -> None:
            wrapped("nav", lambda: links(pick(("ul", "ol")), rng.randint(3, 9)), ("nav", "nav", "div"), 0.7)

        def advert() -> None:
            wrapped("ad", lambda: leaf(pick(("p", "span", "div")), sentences(1, 3), 0) if rng.random() < 0.5 else (out.append(sentences(1, 2)), states.append(0)), ("div", "div", "aside", "section"))

        def side() -> None:
            def body() -> None:
                leaf(pick(("h2", "h3", "h4")), words(1, 4), 0)
                if rng.random() < 0.6:
                    links("ul", rng.randint(2, 7))
                for _ in range(rng.randint(0, 3)):
                    leaf("p", sentences(1, 4), 0)

            wrapped("side", body, ("aside", "aside", "div"), 0.6)

        def notice() -> None:
            wrapped("notice", lambda: (leaf("p", sentences(1, 3), 0), leaf("button", words(1, 2), 0)), ("div", "div", "section", "dialog", "aside"), 0.1)

        def form() -> None:
            def body() -> None:
                leaf("label", words(1, 3), 0)
                if rng.random() < 0.6:
                    leaf("p", sentences(1, 2), 0)
                leaf("button", words(1, 2), 0)

            wrapped("form", body, ("form",), 0.8)

        def head() -> None:
            def body() -> None:
                leaf(pick(("h1", "div", "p", "h2")), pick((words(1, 4), f'<a href="/">{words(1, 3)}</a>')), 0)
                if rng.random() < 0.5:
                    leaf("p", pick((words(3, 8), sentences(1, 1))), 0)

            wrapped("head", body, ("header", "header", "div"), 0.7)

        def foot() -> None:
            def body() -> None:
                if rng.random() < 0.4:
                    links("ul", rng.randint(2, 6))
                text = pick((f"&copy; {word()}.example.org &middot; {sentences(1, 1)}", sentences(1, 3), f"Copyright {rng.randint(1990, 2024)} {words(1, 3)}", words(2, 9)))
                if rng.random() < 0.5:
                    out.append(text)
                    states.append(0)
                else:
                    leaf("p", text, 0)

            wrapped("foot", body, ("footer", "footer", "div"), 0.7)

        def comments() -> None:
            def body() -> None:
                if rng.random() < 0.7:
                    leaf(pick(("h2", "h3", "h4")), words(1, 3), 0)
                shape = pick(("li", "div", "article", "p"))
                for _ in range(rng.randint(1, 8)):
                    if shape == "p":
                        leaf("p", sentences(1, 6), 0)
                        continue
                    out.append(f"<{shape}{named('comment') if rng.random() < 0.5 else ''}>")
                    if rng.random() < 0.5:
                        leaf("p", words(1, 3), 0)
                    for _ in range(rng.randint(1, 3)):
                        leaf("p", sentences(1, 6), 0)
                    out.append(f"</{shape}>")
                if rng.random() < 0.3:
                    form()

            wrapped("comment", body, ("section", "div", "div", "ol", "aside"), 0.0)

        def share() -> None:
            wrapped("share", lambda: links("ul", rng.randint(2, 5)) if rng.random() < 0.6 else leaf("p", words(1, 4), 0), ("div",))

        def article(plain: bool) -> None:
            tag = "div" if plain else pick(("article", "article", "article", "main", "section", "div"))
            attributes = "" if plain or tag in ("article", "main") and rng.random() < 0.7 else named("main")
            shells = rng.randint(0, 2) if rng.random() < 0.4 else 0
            for _ in range(shells):
                out.append(f'<div class="{word()}">' if rng.random() < 0.6 else f"<div{named('main')}>")
            out.append(f"<{tag}{attributes}>")
            if rng.random() < 0.85:
                title = pick((words(2, 12).capitalize(), sentences(1, 1)))
                if rng.random() < 0.1 and not plain:
                    leaf("h1", title, 1)
                    leaf(pick(("p", "h2")), sentences(1, 1), 1)
                else:
                    leaf("h1", title, 1)
            for _ in range(rng.choice((1, 2, 3, 5, 8, 14, 25))):
                kind = rng.random()
                if kind < 0.62:
                    text = sentences(1, 8) if rng.random() < 0.85 else pick((words(1, 6).capitalize() + ".", words(1, 30), " | ".join(words(1, 2) for _ in range(8))))
                    if rng.random() < 0.15:
                        text = text.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
                    leaf("p", text, 1, close=rng.random() < 0.8)
                elif kind < 0.7:
                    leaf("p", f"<b>{sentences(1, 1)}<br>", 1, close=False)
                elif kind < 0.78:
                    leaf(pick(("h2", "h3")), words(1, 7).capitalize(), 1)
                elif kind < 0.84:
                    out.append("<ul>")
                    for _ in range(rng.randint(2, 6)):
                        leaf("li", pick((words(2, 9), sentences(1, 2))), 1)
                    out.append("</ul>")
                elif kind < 0.88:
                    leaf("blockquote", sentences(1, 4), 1)
                elif kind < 0.9:
                    out.append("<table><tr>")
                    for _ in range(rng.randint(2, 6)):
                        leaf("td", words(1, 5), 1)
                    out.append("</tr></table>")
                elif kind < 0.92:
                    leaf("pre", words(4, 20), 1)
                elif not plain:
                    pick((advert, notice, share, form, side, menu, comments))()
            if rng.random() < 0.12 and not plain:
                foot()
            out.append(f"</{tag}>" + "</div>" * shells)

        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>")
        plain = rng.random() < 0.12
        for part, chance in ((notice, 0.2), (head, 0.5), (menu, 0.8), (advert, 0.5), (side, 0.2), (form, 0.15)):
            if rng.random() < chance:
                part()
        article(plain)
        for part, chance in ((share, 0.2), (advert, 0.3), (comments, 0.45), (side, 0.35), (form, 0.15), (notice, 0.15), (foot, 0.8)):
            if rng.random() < chance:
                part()
        out.append("</body></html>")
        return "".join(out), states

    return [page() for _ in range(n)]


def extract(pages: DataFrame, model: Field | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` plus text (the article) and n_chars (its code points), for each row."""
    spark = pages.sparkSession
    ship(spark)
    model = model or train(labelled_pages())
    shared = spark.sparkContext.broadcast((model.weights, model.moves, model.start))
    rows = pages.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(html).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for batch in batches:
            texts = [field.main_text(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_row", "text", "n_chars"])

    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, text string, n_chars bigint"
    return rows.mapInArrow(run, schema).select("_row.*", "text", "n_chars")
