"""A tolerant HTML parser in linear time: a tree of elements with the text between them."""

from __future__ import annotations

import html
import re

#: Elements without content, elements whose content is no markup, and elements that begin a new line of text (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Open elements that a start tag closes, up to the nearest of the scope's elements.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
_NO_P_SCOPE = frozenset("button table td th caption html body article section div main".split())
_NOT_IN_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup body html head title".split())
_MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: tag, raw attributes, and children (elements, and decoded text)."""

    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, *names: str) -> str:
        """The values of attributes, joined by a space."""
        found = []
        if self.attributes:
            for name, value in _ATTRIBUTE.findall(self.attributes):
                if name.lower() in names:
                    found.append(html.unescape(value.strip("\"'")))
        return " ".join(found)

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.__class__ is Node]


def parse(text: str) -> Node:
    """The tree of a page; broken markup is repaired as browsers roughly do, never raised."""
    root = Node("#root")
    stack, at, end = [root], 0, len(text)

    def say(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    while at < end:
        found = _MARKUP.search(text, at)
        if not found:
            say(text[at:])
            break
        say(text[at : found.start()])
        start, name = found.start(), found[2]
        if name is None:
            close = text.find("-->", start + 4) if text.startswith("<!--", start) else text.find(">", start)
            at = end if close < 0 else close + (3 if text.startswith("<!--", start) else 1)
            continue
        rest = _REST.match(text, found.end())
        stop = rest.end() if rest else text.find(">", found.end()) + 1
        if not stop:
            at = end
            continue
        tag, attributes = name.lower(), text[found.end() : stop - 1]
        at = stop
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _NOT_IN_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _NO_P_SCOPE:
                    break
        if tag in _CLOSES:
            closed, scope = _CLOSES[tag]
            last = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in closed:
                    last = i
            if last:
                del stack[last:]
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            closing = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(text, at)
            body = text[at : closing.start() if closing else end]
            if tag in ("title", "textarea"):
                body = html.unescape(body)
            if body:
                node.children.append(body)
            if not closing:
                break
            close = text.find(">", closing.end())
            at = end if close < 0 else close + 1
            continue
        stack.append(node)
    return root


def tidy(text: str) -> str:
    """White space as single spaces, trimmed."""
    return _SPACE.sub(" ", text).strip()


def blocks(node: Node, skip, kept=None) -> list[str]:
    """The text blocks below a node in page order, without elements for which ``skip(node)`` holds.

    ``kept(block_owner, text)`` may veto a block; its owner is the element that it stands in.
    """
    out: list[str] = []
    run: list[str] = []

    def flush(owner: Node) -> None:
        text = tidy("".join(run))
        run.clear()
        if text and (kept is None or kept(owner, text)):
            out.append(text)

    # An explicit stack, as trees may be deep: (node, index of the next child).
    stack: list[list] = [[node, 0, node]]
    while stack:
        top = stack[-1]
        owner = top[2]
        if top[1] >= len(top[0].children):
            stack.pop()
            if top[0].tag in BLOCK or not stack:
                flush(owner)
            continue
        child = top[0].children[top[1]]
        top[1] += 1
        if child.__class__ is not Node:
            run.append(child)
        elif child.tag == "br":
            run.append("\n")
        elif not skip(child):
            if child.tag in BLOCK:
                flush(owner)
            stack.append([child, 0, child if child.tag in BLOCK else owner])
        elif child.tag in BLOCK:
            flush(owner)
    return out
