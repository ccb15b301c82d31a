"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between block-level tags, with
the chain of open elements.  Two states, main text or not; emissions are linear in
features of the ancestors (tags, class, id and role names, the nearest telling
ancestor) and of the text (length, links, ends); transitions tie neighbours.  The
weights are fitted by maximum likelihood on the labelled pages of
``html_training`` (forward-backward, on the driver, about 500 small pages), and
Viterbi decodes each page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Elements that start and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul video audio".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text to be shown.
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements whose whole content is left out.
SILENT_TAGS = frozenset("template svg math object canvas".split())
#: A start tag that ends open elements of these kinds, up to the given ones.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_P_ENDERS = BLOCK_TAGS - {"button", "label", "option", "optgroup", "select", "iframe", "html", "head", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "video", "audio"}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[!?/a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NAMES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Tags that tell what an area is for.
TELLING = frozenset("article main nav aside header footer form section menu dialog search".split())


class Node:
    """An element; ``leaf`` is the nearest block tag, ``near`` the nearest element that tells what its area is for, from here on up."""

    __slots__ = ("tag", "names", "hidden", "gold", "parent", "depth", "leaf", "near", "inside")

    def __init__(self, tag: str, attributes: str, parent: Node | None = None):
        self.tag, self.names, self.hidden, self.gold, self.parent = tag, (), False, None, parent
        if "=" in attributes or "hidden" in attributes:
            names = []
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    names += _NAMES.findall(_CAMEL.sub(" ", html.unescape(value)).lower())
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "none" in value and "display" in value):
                    self.hidden = True
                elif name == "data-gold":
                    self.gold = value
            self.names = tuple(dict.fromkeys(names))
        self.depth = parent.depth + 1 if parent else 0
        self.leaf = tag if tag in BLOCK_TAGS else parent.leaf if parent else "none"
        self.near = self if tag in TELLING or self.names else parent.near if parent else None
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)

    def own_features(self) -> list[str]:
        """What this element adds to the features of the blocks below it."""
        out = [f"tag:{self.tag}"] * (self.tag in BLOCK_TAGS) + ["hidden"] * self.hidden
        for name in self.names:
            out += [f"name:{name}", *[f"stem:{name[:k]}" for k in (4, 6) if len(name) > k]]
        return out

    def leaf_features(self) -> list[str]:
        return [f"leaf:{self.leaf}"] + [f"inside:{self.leaf}"] * self.inside

    def near_features(self) -> list[str]:
        out = []
        if self.near is not None:
            out.append(f"near:{self.near.tag}")
            for name in self.near.names:
                out += [f"nearname:{name}"] + [f"nearstem:{name[:4]}"] * (len(name) > 4)
        return out

    def place_features(self) -> list[str]:
        """What the nearest elements tell of the blocks right below."""
        return list(dict.fromkeys(self.leaf_features() + self.near_features()))


def leaf_blocks(page: str) -> list[tuple[str, Node | None, int]]:
    """(text, innermost open element, characters in links) of each block with text, in page order.

    Where an element of a kind is open is known from lists of places, so deep pages take no longer than flat ones.
    """
    out, stack, parts = [], [], []
    places: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []
    linked = silent = 0
    in_link = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, stack[-1] if stack else None, linked))
            parts.clear()
        linked = 0

    def pop_to(index: int):
        nonlocal in_link, silent
        for node in stack[index:]:
            places[node.tag].pop()
            in_link -= node.tag == "a"
            silent -= node.tag in SILENT_TAGS
        del stack[index:]
        while blocks and blocks[-1] >= index:
            blocks.pop()

    at, length = 0, len(page)
    while at < length:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else length
        if stop > at and not silent:
            text = page[at:stop]
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if m[1] or m[4]:
            if block:
                flush()
            # An inline end tag doesn't end a block.
            if places[tag] and (block or not blocks or blocks[-1] < places[tag][-1]):
                pop_to(places[tag][-1])
            continue
        if block:
            flush()
            if tag in _P_ENDERS and blocks and stack[blocks[-1]].tag == "p":
                pop_to(blocks[-1])
            if tag in CLOSES:
                ended, scope = CLOSES[tag]
                edge = max((places[t][-1] for t in scope if places[t]), default=-1)
                inner = [places[t][k] for t in ended if (k := bisect_right(places[t], edge)) < len(places[t])]
                if inner:
                    pop_to(min(inner))
        elif tag == "br":
            parts.append(" ")
        attributes = m[3] or m[6] or ""
        if tag in VOID_TAGS or attributes.endswith("/") and tag in SILENT_TAGS:
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else length
            continue
        places[tag].append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append(Node(tag, attributes, stack[-1] if stack else None))
        in_link += tag == "a"
        silent += tag in SILENT_TAGS
    flush()
    return out


def chain(node: Node | None) -> list[Node]:
    """The node and its ancestors, the outermost first."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out[::-1]


def chain_features(node: Node | None) -> list[str]:
    """What the ancestors tell."""
    if node is None:
        return ["leaf:none"]
    return list(dict.fromkeys([f for n in chain(node) for f in n.own_features()] + node.place_features()))


def text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    size = 0 if words < 3 else 1 if words < 8 else 2 if words < 20 else 3 if words < 50 else 4
    share = linked / max(1, len(text))
    link = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3
    out = [f"size:{size}", f"link:{link}", f"size-link:{size}{link}"]
    if text[-1] in ".!?…”\"'":
        out.append("stop")
    if "©" in text or "copyright" in text[:200].lower():
        out.append("copyright")
    return out


class Crf:
    """Weights of state 1 (main text) against state 0, start and transition scores."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, steps: np.ndarray):
        self.weights, self.start, self.steps = weights, start, steps

    def chain_scores(self, nodes: list[Node | None]) -> list[float]:
        """Scores of chain_features for nodes in page order.

        Each element is entered and left once, whatever its depth, and what the
        nearest telling element adds is summed once for all blocks below it.
        """
        weight, path, count, total, out = self.weights, [], Counter(), 0.0, []
        near: dict[Node | None, float] = {None: 0.0}
        for node in nodes:
            new, x = [], node
            while x is not None and not (x.depth < len(path) and path[x.depth] is x):
                new.append(x)
                x = x.parent
            for old in reversed(path[x.depth + 1 if x is not None else 0 :]):
                for f in old.own_features():
                    count[f] -= 1
                    if not count[f]:
                        total -= weight.get(f, 0.0)
            del path[x.depth + 1 if x is not None else 0 :]
            for one in reversed(new):
                path.append(one)
                for f in one.own_features():
                    count[f] += 1
                    if count[f] == 1:
                        total += weight.get(f, 0.0)
            if node is None:
                out.append(total + weight.get("leaf:none", 0.0))
                continue
            if node.near not in near:
                near[node.near] = sum(weight.get(f, 0.0) for f in dict.fromkeys(node.near_features()))
            out.append(total + near[node.near] + sum(weight.get(f, 0.0) for f in node.leaf_features()))
        return out

    def emissions(self, blocks: list[tuple[str, Node | None, int]]) -> list[float]:
        chains = self.chain_scores([b[1] for b in blocks])
        return [c + sum(self.weights.get(f, 0.0) for f in text_features(text, linked)) for c, (text, _, linked) in zip(chains, blocks)]

    def decode(self, emissions: list[float]) -> list[int]:
        """The likeliest states (Viterbi); ties go to state 0."""
        if not emissions:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        zero, one = float(self.start[0]), float(self.start[1]) + emissions[0]
        back = []
        for e in emissions[1:]:
            to0, to1 = int(one + s10 > zero + s00), int(one + s11 > zero + s01)
            zero, one = max(zero + s00, one + s10), max(zero + s01, one + s11) + e
            back.append((to0, to1))
        state = int(one > zero)
        out = [state]
        for b in reversed(back):
            state = b[state]
            out.append(state)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        found = leaf_blocks(page) if page else []
        states = self.decode(self.emissions(found))
        return "\n\n".join([b[0] for b, s in zip(found, states) if s])


def train(pages: list[str], steps: int = 150, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood on pages whose elements carry data-gold="1" or "0"; the nearest one labels a block."""
    index: dict[str, int] = {}
    rows, columns, sequences = [], [], []
    n = 0
    for page in pages:
        labels = []
        for text, node, linked in leaf_blocks(page):
            gold = next((x.gold for x in reversed(chain(node)) if x.gold is not None), "0")
            labels.append(int(gold == "1"))
            for f in chain_features(node) + text_features(text, linked):
                rows.append(n)
                columns.append(index.setdefault(f, len(index)))
            n += 1
        sequences.append(labels)
    sequences = [s for s in sequences if s]
    longest = max(map(len, sequences))
    place = np.zeros((len(sequences), longest), dtype=np.int64)
    mask = np.zeros((len(sequences), longest), dtype=bool)
    gold = np.zeros((len(sequences), longest), dtype=np.int64)
    at = 0
    for k, s in enumerate(sequences):
        place[k, : len(s)] = np.arange(at, at + len(s))
        mask[k, : len(s)], gold[k, : len(s)] = True, s
        at += len(s)
    rows, columns = np.array(rows), np.array(columns)
    size = len(index)
    pairs = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    first = np.bincount(gold[:, 0], minlength=2)
    truth = np.concatenate((np.bincount(columns, weights=gold[mask][rows], minlength=size), first, seen.ravel()))
    x, moment, power = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)
    for step in range(1, steps + 1):
        e = np.bincount(rows, weights=x[columns], minlength=n)[place] * mask
        start, change = x[size : size + 2], x[size + 2 :].reshape(2, 2)
        score = np.stack((np.zeros_like(e), e), axis=2)
        forward, backward = np.zeros(score.shape), np.zeros(score.shape)
        forward[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + change, axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(change + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        one = np.exp(forward + backward - total[:, None, None])
        two = np.exp(forward[:, :-1, :, None] + change + (score + backward)[:, 1:, None, :] - total[:, None, None, None])
        expected = np.concatenate((np.bincount(columns, weights=one[..., 1][mask][rows], minlength=size), one[:, 0].sum(axis=0), two[pairs].sum(axis=0).ravel()))
        g = (expected - truth) / len(sequences) + ridge * x
        moment = 0.9 * moment + 0.1 * g
        power = 0.99 * power + 0.01 * g * g
        x -= 0.15 * (moment / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
    return Crf({f: float(x[k]) for f, k in index.items()}, x[size : size + 2].copy(), x[size + 2 :].reshape(2, 2).copy())


_TRAINED: list[Crf] = []


def trained() -> Crf:
    if not _TRAINED:
        from .html_training import labelled_pages

        _TRAINED.append(train(labelled_pages()))
    return _TRAINED[0]


def extract(pages: DataFrame, model: Crf | None = None, column: str = "html") -> DataFrame:
    """page_id, url and text for every row of ``pages``; a null or empty page, or one without main text, has an empty text.

    Rows are independent: repeated ids and ties change nothing, an empty table stays
    empty, and other columns are not read.  Pages of any length and depth are read
    whole, in time that grows with their length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches:
            texts = [shared.value.extract(p) for p in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return common.arrow_map(pages.select("page_id", "url", column), run, "page_id bigint, url string, text string")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract(common.table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
