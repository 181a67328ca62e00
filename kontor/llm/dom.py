"""A tolerant page reader: blocks of text, and a page's shape as a tree of slots.

Elements of the same label (tag and class) under one parent are one slot, so a list of
any length has one slot for its items.  Inline elements belong to the block around them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NAME = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_DIGITS = re.compile(r"[0-9]+")
_OPEN_END = re.compile(r"<[/!?a-zA-Z][^>]*\Z", re.S)

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span
    strike strong sub sup time tt u var wbr br img center nobr""".split()
)
CLOSES = {  # an opening tag ends open elements of these kinds, up to the bounds
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
NO_TEXT = frozenset("script style textarea title xmp noembed noframes iframe template svg math object canvas noscript".split())

_CLOSING = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in NO_TEXT}

# Elements and class words of what surrounds an article.
AROUND = frozenset("nav footer aside dialog menu button select head".split())
#: Elements that hold fields, or a whole page.
FORMS = frozenset("form fieldset".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar".split())
AROUND_WORDS = frozenset(
    """nav navbar navigation menu menubar footer sidebar sidebars aside rail ad ads adv advert adverts advertisement
    advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert
    disclaimer reader social share sharing newsletter subscribe subscription signup login popup modal overlay toolbar
    widget widgets search masthead topbar""".split()
)
#: What others wrote or what leads elsewhere, however long it is.
TALK_WORDS = frozenset("comment comments discussion replies responses disqus related recommended breadcrumb breadcrumbs pagination pager teaser".split())
#: A word of a class with one of these says what the element has or lacks ('has-sidebar', 'ad-free'), not what it is.
HAVING, LACKING = frozenset("has have with without no not non show hide".split()), frozenset("free less enabled disabled".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
MAIN = frozenset({"article", "main"})

TALK, OUTSIDE = 1, 2

#: Levels of the shape; deeper elements count to the slot above them.  No text is lost by it.
DEPTH = 60


@dataclass
class Slot:
    label: str
    children: list["Slot"] = field(default_factory=list)
    index: int = -1
    by_label: dict[str, "Slot"] = field(default_factory=dict, repr=False)


@dataclass
class _Element:
    tag: str
    slot: Slot
    around: int
    layout: tuple[int, ...]
    main: bool


@dataclass
class Block:
    slot: Slot
    text: str
    linked: int  # characters in links
    around: int  # OUTSIDE, TALK or 0
    layout: tuple[int, ...]  # numbers of the forms and of the elements with a word of AROUND_WORDS that hold it
    main: bool


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def read_page(source: str) -> tuple[Slot, list[Block]]:
    """Shape and blocks of text of a page, in page order."""
    cut = _OPEN_END.search(source, max(source.rfind("<"), 0))
    if cut and "<!--" not in source[cut.start() : cut.start() + 4]:
        source = source[: cut.start()]  # a page that ends within a tag
    root = Slot("page")
    stack = [_Element("", root, 0, (), False)]
    forms: set[int] = set()
    causes = 0
    blocks: list[Block] = []
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if not parts:
            return
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            top = stack[-1]
            blocks.append(Block(top.slot, text, linked, top.around, top.layout, top.main))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())

    def close(count: int) -> None:
        del stack[len(stack) - count :]

    at, n = 0, len(source)
    while at < n:
        start = source.find("<", at)
        if start < 0:
            add(source[at:])
            break
        add(source[at:start])
        m = _TOKEN.match(source, start)
        if not m:  # a sign, not a tag
            add("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ending, rest = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(links + (-1 if ending else 1), 0)
            continue
        if ending:
            k = len(stack) - 1
            while k and stack[k].tag != tag:
                k -= 1
            if k or tag == "p":
                flush()
                links = 0
            if k:
                del stack[k:]
            continue
        if tag in NO_TEXT:
            end = _CLOSING[tag].search(source, at)
            at = end.end() if end else n
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        while stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in ends:
                    close(len(stack) - k)
        parent = stack[-1]
        label = tag
        given = _attributes(rest) if "=" in rest or "hidden" in rest else {}
        role = given.get("role", "").lower()
        is_main = tag in MAIN or role in MAIN
        main = parent.main or is_main
        around, layout = parent.around, parent.layout
        if is_main and not parent.main:
            if "main" in (tag, role):  # the page's one main part, whatever holds it
                around, layout = around if around == OUTSIDE else 0, ()
            layout = tuple(c for c in layout if c not in forms)
        is_form = tag in FORMS or role == "form"
        names = _names(given) if given and tag not in ("html", "body") and "main" not in (tag, role) else []
        if tag in AROUND or role in AROUND_ROLES or given and _hidden(given) or tag == "header" and not main:
            around = OUTSIDE
        elif not TALK_WORDS.isdisjoint(names):
            around = max(around, TALK)
        named = not AROUND_WORDS.isdisjoint(names) and (not is_main or AROUND_WORDS.issuperset(names))
        if is_form or named or not main and not HEAD_WORDS.isdisjoint(names):
            layout = (*layout, causes)
            if is_form:
                forms.add(causes)
            causes += 1
        if "class" in given:
            label = ".".join([tag, *sorted(given["class"].lower().split())])
        if len(stack) > DEPTH:
            slot = parent.slot
        else:
            if not label.isalpha():
                label = _DIGITS.sub("0", label)
            slot = parent.slot.by_label.get(label)
            if slot is None:
                slot = parent.slot.by_label[label] = Slot(label)
                parent.slot.children.append(slot)
        stack.append(_Element(tag, slot, around, layout, main))
    flush()
    count = 0
    todo = [root]
    while todo:
        slot = todo.pop()
        slot.index, count = count, count + 1
        todo += reversed(slot.children)
    return root, blocks


def _names(given: dict[str, str]) -> list[str]:
    """Words of an element's class and id, without those that it only has or lacks."""
    both = f"{given.get('class', '')} {given.get('id', '')}"
    if len(both) < 2:
        return []
    names = []
    for token in _HUMP.sub(r"\1-\2", both).lower().split():
        parts = _NAME.findall(token)
        if len(parts) < 2 or parts[0] not in HAVING and parts[-1] not in LACKING:
            names += parts
    return names


def _hidden(given: dict[str, str]) -> bool:
    style = given.get("style", "").lower().replace(" ", "")
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style


def dump(slot: Slot) -> str:
    """The shape as text: labels with their children in brackets."""
    return slot.label.translate(_PLAIN) + ("(" + " ".join(map(dump, slot.children)) + ")" if slot.children else "")


_PLAIN = str.maketrans("() ", "___")


def load(text: str) -> Slot:
    """The shape that ``dump`` wrote, with slots numbered in the same order."""
    root = None
    path: list[Slot] = []
    count = 0
    for m in re.finditer(r"[^() ]+|[()]", text):
        if m[0] == "(":
            path.append(last)
        elif m[0] == ")":
            path.pop()
        else:
            last = Slot(m[0], index=count)
            count += 1
            if path:
                path[-1].children.append(last)
            else:
                root = last
    return root


def align(a: Slot, b: Slot) -> dict[int, int]:
    """Simple tree matching: the largest mapping of slots of ``a`` to slots of ``b`` that keeps labels, parents and order."""
    sizes: dict[tuple[int, int], int] = {}

    def weight(x: Slot, y: Slot) -> int:
        if x.label != y.label:
            return 0
        key = (x.index, y.index)
        if key not in sizes:
            sizes[key] = 1 + table(x, y)[-1][-1]
        return sizes[key]

    def table(x: Slot, y: Slot) -> list[list[int]]:
        rows = [[0] * (len(y.children) + 1)]
        for c in x.children:
            row = [0]
            for j, d in enumerate(y.children):
                row.append(max(rows[-1][j + 1], row[j], rows[-1][j] + weight(c, d)))
            rows.append(row)
        return rows

    pairs: dict[int, int] = {}
    todo = [(a, b)] if a.label == b.label else []
    while todo:
        x, y = todo.pop()
        pairs[x.index] = y.index
        rows = table(x, y)
        i, j = len(x.children), len(y.children)
        while i and j:
            w = weight(x.children[i - 1], y.children[j - 1])
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                todo.append((x.children[i], y.children[j]))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return pairs
