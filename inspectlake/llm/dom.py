"""Pages as trees of blocks: tags, attribute tokens and texts of a batch of pages as arrays."""

import html as entities
import re

import numpy as np
import pyarrow as pa

from inspectlake.llm.arrays import text_bytes

# Elements that begin a block of their own, and what HTML says of others.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements whose text is never shown as text of the page.
UNREAD = frozenset("script style title textarea xmp iframe noembed noframes template noscript svg select button object canvas audio video datalist".split())
HEAD = frozenset("html head title meta link base script style noscript template".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr legend summary".split())
#: Start tags that end an open element of these names, up to one of the last column.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
BARRIERS = frozenset("table td th caption".split())

_TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))"""
    r"""|(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"']?+))*+)(?:>|\Z)"""
    r"""|[!?/][^>]*(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label|aria-hidden|hidden|style|data-part)\b", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TAGS = {t: k for k, t in enumerate(["#text", "#page", *sorted(BLOCKS), "other"])}


def attributes_of(source):
    """(tokens, mark) of a start tag: the words of its names and roles, and the mark of a training page."""
    if not _NAMED.search(source):
        return (), None
    tokens, mark = set(), None
    for name, *values in _ATTRIBUTE.findall(source):
        name, value = name.lower(), entities.unescape("".join(values))
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            tokens.update(w.lower() for w in _WORD.findall(value) if len(w) > 1)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDES.search(value)):
            tokens.add("hidden")
        elif name == "data-part":
            mark = value
    return tuple(sorted(tokens)), mark


class Forest:
    """Block trees of many pages in document order; a node's subtree is the stretch up to ``last``.

    An element with only text is one node; text beside other blocks is a node ``#text`` of
    its own; elements without text are left out.
    """

    def __init__(self):
        self.page, self.parent, self.tag, self.tokens, self.mark, self.text, self.last, self.depth = ([] for _ in range(8))
        self.links, self.elements, self.inputs, self.images = ([] for _ in range(4))
        self.pages = 0

    def _columns(self):
        return self.page, self.parent, self.tag, self.tokens, self.mark, self.text, self.last, self.depth, self.links, self.elements, self.inputs, self.images

    def _add(self, parent, tag, tokens=(), mark=None, text="", links=0):
        at = len(self.tag)
        depth = self.depth[parent] + 1 if parent >= 0 else 0
        for column, value in zip(self._columns(), (self.pages, parent, tag, tokens, mark, text, at, depth, links, 0, 0, 0)):
            column.append(value)
        return at

    def _drop_last(self, into):
        """Leave out the last node; its counts go to ``into``."""
        for counts in (self.elements, self.inputs, self.images):
            n = counts[-1]
            counts[into] += n
        for column in self._columns():
            column.pop()

    def add(self, html):
        """Parse a whole page into nodes."""
        root = self._add(-1, TAGS["#page"])
        stack, names, places = [root], ["#page"], {}
        barriers, unread, parts = [], [], []
        link, links, head = 0, 0, False

        def flush():
            nonlocal links
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self._add(stack[-1], TAGS["#text"], text=text, links=min(links, len(text)))
                parts.clear()
            links = 0

        def close():
            flush()
            node, name = stack.pop(), names.pop()
            places[name].pop()
            if barriers and barriers[-1] == len(stack):
                barriers.pop()
            end = len(self.tag) - 1
            if end == node and not self.text[node]:
                self._drop_last(stack[-1])
            elif end == node + 1 and self.tag[end] == TAGS["#text"]:
                self.text[node], self.links[node] = self.text[end], self.links[end]
                self._drop_last(node)
                self.last[node] = node
            else:
                self.last[node] = end

        def close_through(name):
            while names[-1] != name:
                close()
            close()

        def is_open(name):
            return bool(places.get(name)) and places[name][-1] >= (barriers[-1] if barriers else 0)

        at, n = 0, len(html)
        while at < n:
            found = _TOKEN.search(html, at)
            end = found.start() if found else n
            if end > at and not unread:
                text = html[at:end]
                if "&" in text:
                    text = entities.unescape(text)
                if not head or not text.isspace():
                    head = False
                    parts.append(text)
                    if link:
                        links += len(text)
            if not found:
                break
            at = found.end()
            closing, name, source = found.groups()
            if name is None:
                continue
            name = name.lower()
            if unread:
                # Within an unread element only its own tags count.
                if name == unread[-1]:
                    if closing:
                        unread.pop()
                    elif not source.endswith("/"):
                        unread.append(name)
                continue
            if not closing:
                if name == "head":
                    head = True
                    continue
                if head and name not in HEAD:
                    head = False
                self.elements[stack[-1]] += 1
                if name == "br":
                    parts.append(" ")
                elif name == "img":
                    self.images[stack[-1]] += 1
                elif name in ("input", "select", "textarea", "button"):
                    self.inputs[stack[-1]] += 1
                elif name == "a":
                    link = 1
                if name in RAW:
                    stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
                    at = stop.start() if stop else n
                    unread.append(name)
                    continue
                if name in UNREAD:
                    if not source.endswith("/") or name in ("select", "button", "template", "noscript"):
                        unread.append(name)
                    continue
                if name == "hr":
                    flush()
                    continue
                if (name not in BLOCKS and "-" not in name) or name in VOID:
                    continue
                if name in ("html", "body"):
                    continue
                if name in CLOSES_P and is_open("p"):
                    close_through("p")
                ends, within = ENDS.get(name, ((), ()))
                open_ends = [e for e in ends if places.get(e)]
                if open_ends:
                    nearest = max(open_ends, key=lambda e: places[e][-1])
                    if places[nearest][-1] > max((places[w][-1] for w in within if places.get(w)), default=-1):
                        close_through(nearest)
                flush()
                tokens, mark = attributes_of(source)
                if name in BARRIERS:
                    barriers.append(len(stack))
                places.setdefault(name, []).append(len(stack))
                stack.append(self._add(stack[-1], TAGS.get(name, TAGS["other"]), tokens, mark))
                names.append(name)
            elif name == "a":
                link = 0
            elif name == "head":
                head = False
            elif name == "br":
                parts.append(" ")
            elif is_open(name) or (name in BARRIERS and places.get(name)):
                close_through(name)
            elif name in BLOCKS:
                flush()
        while len(stack) > 1:
            close()
        flush()
        self.last[root] = len(self.tag) - 1
        self.pages += 1

    def arrays(self):
        return Arrays(self)


_CLASSES = {"digit": range(48, 58), "upper": range(65, 91), "lower": range(97, 123), "stop": b".!?", "comma": b",;:", "sign": b"|/>#*+=@&%$"}
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _k + 1

_TAG_GROUPS = {
    "content": "article main", "part": "section div center search", "p": "p", "title": "h1 h2 hgroup", "heading": "h3 h4 h5 h6", "list": "ul ol dl menu dir", "item": "li dt dd",
    "table": "table tbody thead tfoot tr td th caption", "quote": "blockquote pre figure figcaption", "nav": "nav", "aside": "aside", "header": "header", "footer": "footer",
    "form": "form fieldset legend", "box": "dialog details summary address", "loose": "#text", "page": "#page",
}
_GROUP = np.zeros((len(TAGS), len(_TAG_GROUPS)), dtype=np.float32)
for _k, _names in enumerate(_TAG_GROUPS.values()):
    _GROUP[[TAGS[t] for t in _names.split()], _k] = 1
_SIDE = [TAGS[t] for t in ("nav", "aside", "footer", "form", "dialog")]
_CONTENT = [TAGS[t] for t in ("article", "main")]


class Arrays:
    """The nodes of a forest as arrays, and their features."""

    def __init__(self, forest):
        self.forest = forest
        self.n = len(forest.tag)
        self.parent, self.tag, self.last, self.depth, self.page = (np.array(x, dtype=np.int64) for x in (forest.parent, forest.tag, forest.last, forest.depth, forest.page))
        self.chars = np.array([len(t) for t in forest.text], dtype=float)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        #: Nodes by depth, the roots first.
        self.levels = np.split(order, cuts) if self.n else []

    def subtree(self, values):
        """Sums over each node and all below it."""
        total = np.concatenate(([0.0], np.cumsum(values)))
        return total[self.last + 1] - total[:-1]

    def above(self, values, choose, start):
        """``choose`` (np.maximum or np.minimum) of the values of all nodes above each node."""
        out = np.full(self.n, start, dtype=float)
        for level in self.levels[1:]:
            up = self.parent[level]
            out[level] = choose(out[up], values[up])
        return out

    def features(self, score_of):
        """One row of features per node; ``score_of`` gives the tokens' learned scores."""
        f, n = self.forest, self.n
        log = np.log1p
        known = {}
        low, high, mean, some = (np.zeros(n) for _ in range(4))
        for i, tokens in enumerate(f.tokens):
            if tokens:
                if tokens not in known:
                    scores = [score_of(t) for t in tokens]
                    known[tokens] = min(scores), max(scores), sum(scores) / len(scores)
                low[i], high[i], mean[i] = known[tokens]
                some[i] = 1
        raw, offsets = text_bytes(pa.array(f.text, pa.large_string()))
        row = np.repeat(np.arange(n), np.diff(offsets))
        kinds = len(_CLASSES) + 1
        signs = np.bincount(row * kinds + _CLASS[raw], minlength=n * kinds).reshape(n, kinds).astype(float)
        chars = self.subtree(self.chars)
        leaf = (self.chars > 0).astype(float)
        leaves, links, elements = self.subtree(leaf), self.subtree(np.array(f.links, float)), self.subtree(np.array(f.elements, float))
        inputs, images = self.subtree(np.array(f.inputs, float)), self.subtree(np.array(f.images, float))
        headings = self.subtree(np.isin(self.tag, [TAGS[f"h{k}"] for k in range(1, 7)]).astype(float))
        top = self.subtree((self.tag == TAGS["h1"]).astype(float))
        in_p = self.subtree(np.where(self.tag == TAGS["p"], self.chars, 0))
        content, side = np.isin(self.tag, _CONTENT).astype(float), np.isin(self.tag, _SIDE).astype(float)
        has_content, has_side = self.subtree(content) - content, self.subtree(side) - side
        root = np.flatnonzero(self.parent < 0)[self.page]
        whole = np.maximum(1, chars[root])
        begin = np.concatenate(([0.0], np.cumsum(self.chars)))[:-1]
        up = np.maximum(self.parent, 0)
        order = np.argsort(self.parent, kind="stable")
        place = np.empty(n)
        first = np.concatenate(([True], np.diff(self.parent[order]) != 0)) if n else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        place[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        siblings = np.bincount(self.parent + 1, minlength=n + 1)[self.parent + 1].astype(float)
        _, inverse, counts = np.unique(self.parent * len(TAGS) + self.tag, return_inverse=True, return_counts=True)
        before, after = np.zeros(n), np.zeros(n)
        same = self.parent[order][1:] == self.parent[order][:-1]
        before[order[1:][same]], after[order[:-1][same]] = chars[order[:-1][same]], chars[order[1:][same]]
        one = np.maximum(1, chars)
        marks = [self.subtree(signs[:, k]) / one for k in range(1, kinds)]
        deepest = np.zeros(n)
        np.maximum.at(deepest, root, self.depth)
        columns = [
            mean, low, high, some, self.above(low, np.minimum, 0), self.above(high, np.maximum, 0), self.above(content, np.maximum, 0), self.above(side, np.maximum, 0),
            self.depth, self.depth / np.maximum(1, deepest[root]), log(chars), chars / whole, log(leaves), log(chars / np.maximum(1, leaves)), links / one,
            log(chars / (1 + elements)), in_p / one, log(inputs), log(images), log(headings), np.minimum(top, 2), np.minimum(has_content, 3), np.minimum(has_side, 3),
            *marks, (begin - begin[root]) / whole, (begin - begin[root] + chars) / whole, log(place), log(siblings), log(counts[inverse]), chars / np.maximum(1, chars[up]),
            log(before), log(after), log(chars[up] / np.maximum(1, siblings)), links[up] / np.maximum(1, chars[up]), log(chars[up] / np.maximum(1, leaves[up])), log(whole), log(leaves[root]),
        ]
        return np.hstack([np.stack(columns, axis=1).astype(np.float32), _GROUP[self.tag], _GROUP[self.tag[up]]])

    def labels(self):
        """0 out, 1 in, 2 both: what the marks of a training page say of each node."""
        own = np.array([-1 if m is None else int(m == "main") for m in self.forest.mark], dtype=np.int64)
        for level in self.levels[1:]:
            own[level] = np.where(own[level] >= 0, own[level], own[self.parent[level]])
        leaf = self.chars > 0
        inside = self.subtree((leaf & (own == 1)).astype(float))
        mixed = np.where(inside == 0, 0, np.where(inside == self.subtree(leaf.astype(float)), 1, 2))
        return np.where(own >= 0, own, mixed)

    def decode(self, log_odds):
        """The best consistent choice for all nodes: 0 out, 1 in, 2 both.

        Below a node that is out, all is out; below one that is in, nodes are in or out;
        a node is both only above others.  Scores of a tree add up from the leaves.
        """
        score = log_odds.astype(float).copy()
        # Text of its own cannot be both.
        score[self.chars > 0, 2] = -np.inf
        for level in reversed(self.levels[1:]):
            up, own = self.parent[level], score[level]
            np.add.at(score[:, 0], up, own[:, 0])
            np.add.at(score[:, 1], up, own[:, :2].max(axis=1))
            np.add.at(score[:, 2], up, own.max(axis=1))
        chosen = np.zeros(self.n, dtype=np.int64)
        for k, level in enumerate(self.levels):
            free = score[level].argmax(axis=1)
            if k:
                up = chosen[self.parent[level]]
                free = np.where(up == 0, 0, np.where(up == 1, score[level][:, :2].argmax(axis=1), free))
            chosen[level] = free
        return chosen
