"""A small HTML tree with a CSS subset, on the standard library's parser.

Selectors: tag, *, #id, .class, [a], [a=v], [a*=v], [a^=v], [a$=v], [a~=v],
descendant, '>' and lists with commas. Anything else is LOCATOR_INVALID.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from fieldtrace.errors import FieldtraceError

# Elements without content, and attributes that hold lists.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LISTS = {"class", "rel", "rev", "headers", "accesskey", "dropzone"}
_PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:"(?P<q1>[^"]*)"|'(?P<q2>[^']*)'|(?P<q3>[\w./:-]+))\s*)?\]""")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "order")

    def __init__(self, tag, attrs, parent, order):
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list = []  # nodes and texts

    def walk(self):
        open_ = [c for c in reversed(self.children) if isinstance(c, Node)]
        while open_:
            n = open_.pop()
            yield n
            open_ += [c for c in reversed(n.children) if isinstance(c, Node)]

    def texts(self):
        open_ = list(reversed(self.children))
        while open_:
            c = open_.pop()
            if isinstance(c, str):
                yield c
            elif self.tag in ("script", "style", "template") or c.tag not in ("script", "style", "template"):
                open_ += reversed(c.children)

    def text(self, between: str = " ") -> str:
        return between.join(self.texts())

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def get(self, name: str):
        value = self.attrs.get(name)
        return value.split() if value is not None and name in LISTS else value


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None, 0)
        self.at, self.count = self.root, 0

    def handle_starttag(self, tag, attrs):
        self.count += 1
        node = Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)}, self.at, self.count)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:  # a stray end tag closes nothing
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _compound(text: str):
    tests, at = [], 0
    for m in iter(lambda: _PART.match(text, at), None):
        g = m.groupdict()
        if g["tag"] and at:
            raise FieldtraceError("LOCATOR_INVALID", text)
        at = m.end()
        if g["tag"]:
            tag = g["tag"].lower()
            tests.append((lambda n, t=tag: t == "*" or n.tag == t))
        elif g["id"]:
            tests.append((lambda n, v=g["id"]: n.attrs.get("id") == v))
        elif g["cls"]:
            tests.append((lambda n, v=g["cls"]: v in n.attrs.get("class", "").split()))
        else:
            name, op = g["attr"].lower(), g["op"]
            want = next((g[q] for q in ("q1", "q2", "q3") if g[q] is not None), "")
            check = {
                None: lambda v, w: True, "=": lambda v, w: v == w, "*=": lambda v, w: bool(w) and w in v,
                "^=": lambda v, w: bool(w) and v.startswith(w), "$=": lambda v, w: bool(w) and v.endswith(w), "~=": lambda v, w: w in v.split(),
            }[op]
            tests.append((lambda n, a=name, c=check, w=want: a in n.attrs and c(n.attrs[a], w)))
    if at != len(text) or not tests:
        raise FieldtraceError("LOCATOR_INVALID", text)
    return tests


def compile_selector(selector: str):
    """A list of chains; each chain is [(tests, link to the left), ...] from the right."""
    chains = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        words = re.findall(r"(?:\[[^\]]*\]|[^\s>\[])+|>", alternative.strip())
        if re.sub(r"\s", "", "".join(words)) != re.sub(r"\s", "", alternative):
            raise FieldtraceError("LOCATOR_INVALID", selector)
        chain, link = [], " "
        for word in words:
            if word == ">":
                if not chain or link == ">":
                    raise FieldtraceError("LOCATOR_INVALID", selector)
                link = ">"
            else:
                chain.append((_compound(word), link))
                link = " "
        if not chain or link == ">":
            raise FieldtraceError("LOCATOR_INVALID", selector)
        chains.append(chain[::-1])
    return chains


def _fits(node, chain, k=0) -> bool:
    tests, link = chain[k]
    if not all(t(node) for t in tests):
        return False
    if k + 1 == len(chain):
        return True
    up = node.parent
    while up is not None:
        if _fits(up, chain, k + 1):
            return True
        if link == ">":
            return False
        up = up.parent
    return False


def select(root: Node, chains) -> list[Node]:
    """Matching descendants of ``root`` in document order."""
    if isinstance(chains, str):
        chains = compile_selector(chains)
    return [n for n in root.walk() if any(_fits(n, c) for c in chains)]
