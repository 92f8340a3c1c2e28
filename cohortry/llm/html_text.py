"""HTML extraction: a tree with implied tags, visibility rules, and a rendering that keeps the layout."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe noembed noframes object audio video canvas datalist param source track area col colgroup desc defs metadata symbol annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary svg table tbody td text tfoot th thead tr ul caption".split()
)
APART = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
CLOSES_P = (BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption option optgroup legend".split())) | {"table"}
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
#: What an opening tag closes, and how far up it looks.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag looks no farther up than these.
SCOPE = frozenset({"table", "td", "th", "caption", "html", "template"})
#: Spans of cells at most, as the standard has it.
COLSPAN, ROWSPAN = 1000, 65534
#: Padding that aligned columns may add: so many times a table's text and some more; where it would be more, columns are
#: padded to NARROW characters only.  Text is never cut.
PADDING, PADDING_MORE, NARROW = 8, 1 << 16, 40

_opening = re.compile(r"/?[a-zA-Z]")
_name_end = re.compile(r"[\s/>]|\Z")
_attrs = re.compile(r"(?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>")
_marks = re.compile(r"[>\"']")
_attr = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_declared = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
_brace = re.compile(r"[{};]")
_simple = re.compile(r"([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)\Z", re.I)
_space = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    children: list[Node | str] = field(default_factory=list)


#: Tags between which and an opening tag a paragraph isn't closed.
KEEPS_P = (SCOPE | BLOCK) - {"p"}


class _Ends:
    """Where tags of a page end: at the first ``>`` outside quotes, or nowhere."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.marks: list[int] | None = None
        self.name = 0

    def name_end(self, at: int) -> int:
        """The first sign from ``at`` on that ends a name."""
        if self.name < at:
            self.name = _name_end.search(self.html, at).start()
        return self.name

    def after(self, at: int) -> int:
        """The place behind the tag whose attributes begin at ``at``; 0 if it never ends.

        The first tag found to be open makes a table of all signs, so that no later one is looked for again to the page's end.
        """
        if at > self.last:
            return 0
        if self.marks is None:
            if m := _attrs.match(self.html, at):
                return m.end()
            self._table()
        k = bisect_left(self.marks, at)
        return self.ends[k] if k < len(self.marks) else 0

    def _table(self) -> None:
        signs = [(m.start(), m.group()) for m in _marks.finditer(self.html)]
        self.marks = [i for i, _ in signs]
        self.ends = [0] * (len(signs) + 1)
        later: dict[str, int] = {}  # the next quote of each kind
        for k in range(len(signs) - 1, -1, -1):
            at, sign = signs[k]
            if sign == ">":
                self.ends[k] = at + 1
            else:
                self.ends[k] = self.ends[later[sign] + 1] if sign in later else 0
                later[sign] = k


def _next_tag(html: str, ends: _Ends, at: int) -> tuple[int, str, str, int] | None:
    """``(where, name with / if it closes, attributes, place behind)`` of the next tag; comments and declarations have no name."""
    while (i := html.find("<", at)) >= 0:
        start = i + 1
        if html.startswith("!--", start):
            stop = html.find("-->", start + 3)
            return i, "", "", len(html) if stop < 0 else stop + 3
        if start <= ends.last and (m := _opening.match(html, start)) and (stop := ends.after(k := ends.name_end(m.end()))):
            return i, html[start:k], html[k : stop - 1], stop
        if start <= ends.last and html[start] in "!?/":
            return i, "", "", html.find(">", start + 1) + 1 if start < ends.last else len(html)
        at = start
    return None


def tree(html: str) -> tuple[Node, list[str], int]:
    """The page's tree, its style sheets and its depth; missing end tags, html, head, body, tbody and tr are implied.

    Open elements are looked up by name, so time grows with the page's length only, whatever it leaves open or closes in vain.
    """
    root = Node("html", {})
    stack = [root]
    styles: list[str] = []
    deepest = 1
    places: dict[str, list[int]] = {}  # of open elements but the root, by tag
    walls: list[int] = []  # places of those in KEEPS_P

    def push(tag: str, attrs: dict[str, str]) -> None:
        nonlocal deepest
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            if tag in KEEPS_P:
                walls.append(len(stack))
            stack.append(node)
            deepest = max(deepest, len(stack))

    def pop_to(depth: int) -> None:
        while len(stack) > max(1, depth):
            places[stack.pop().tag].pop()
        while walls and walls[-1] >= len(stack):
            walls.pop()

    def last(*tags: str) -> int:
        """The place of the last open element of these tags; 0 if there is none."""
        return max([p[-1] for t in tags if (p := places.get(t))], default=0)

    def text(value: str) -> None:
        if not value:
            return
        blank = not value.strip(" \t\n\r\f")
        if stack[-1].tag == "head" and not blank:
            pop_to(len(stack) - 1)
        if stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and blank:
            return
        stack[-1].children.append(value)

    ends_of_tags = _Ends(html)
    at = 0
    while at < len(html):
        tag = _next_tag(html, ends_of_tags, at)
        if tag is None:
            text(unescape(html[at:]))
            break
        i, name, told, stop = tag
        text(unescape(html[at:i]))
        at, name = stop, name.lower()
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            i = last(name)
            wall = 0 if name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else last(*(SCOPE - {name}))
            if i > wall:
                pop_to(i)
            elif not wall and name == "p":  # an end tag of its own makes an empty paragraph
                push("p", {})
                pop_to(len(stack) - 1)
            elif not wall and name == "br":
                push("br", {})
            continue
        attrs = {k.lower(): unescape(a or b or c or "") for k, a, b, c in _attr.findall(told)}
        if name == "html":
            root.attrs = {**attrs, **root.attrs}
            continue
        if stack[-1].tag == "head" and name not in HEAD_ONLY:
            pop_to(len(stack) - 1)
        if name == "body" and last("body"):
            continue
        ends, scope = IMPLIED_END.get(name, ((), ()))
        while ends and (i := last(*ends)) > last("table", *(scope - ends)):
            pop_to(i)
            if name not in ("tr", "tbody", "thead", "tfoot", "optgroup"):
                break
        if name in CLOSES_P and (i := last("p")) > (walls[-1] if walls else 0):
            pop_to(i)
        if name == "tr" and stack[-1].tag == "table":
            push("tbody", {})
        elif name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if stack[-1].tag == "table":
                push("tbody", {})
            push("tr", {})
        push(name, attrs)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            inside = html[at : end.start()] if end else html[at:]
            at = end.start() if end else len(html)
            if name == "style":
                styles.append(inside)
            elif name == "textarea":
                stack[-1].children.append(unescape(inside))
            pop_to(len(stack) - 1)
            if end:
                at = html.find(">", at) + 1 or len(html)
    return root, styles, deepest


def _blocks(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen; other at-rules' bodies are passed over."""
    at, text = 0, re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)
    open_until: list[bool] = []  # of the at-rules around: whether what is inside holds
    while (m := _brace.search(text, at)) is not None:
        head, at = text[at : m.start()].strip(), m.end()
        if m.group() == "}":
            if open_until:
                open_until.pop()
        elif m.group() == "{":
            if head.startswith("@"):
                name, _, query = head[1:].partition(" ")
                kinds = [q.strip().lower() for q in query.split(",")]
                holds = name.lower() in ("supports", "layer") or (name.lower() == "media" and any(q in ("", "all", "screen", "only screen", "not print") for q in kinds))
                open_until.append(holds and all(open_until))
                continue
            end = text.find("}", at)
            end = len(text) if end < 0 else end
            if all(open_until):
                yield head, text[at:end]
            at = end + 1


def style_rules(styles: list[str]) -> list[tuple[str, frozenset, frozenset, list]]:
    """(tag, ids, classes, declared) of the plain selectors whose rules tell display or visibility, in order.

    ``declared`` are (property, value, weight); a weight orders rules as the cascade does: importance, then specificity, then place.
    """
    out = []
    for sheet in styles:
        for selectors, body in _blocks(sheet):
            told = [(p.lower(), v.lower(), bool(i)) for p, v, i in _declared.findall(body)]
            if not told:
                continue
            for s in selectors.split(","):
                m = _simple.match(s.strip())
                if m and (m.group(1) or m.group(2)):
                    marks = re.findall(r"([.#])([\w-]+)", m.group(2))
                    ids, classes = frozenset(n for k, n in marks if k == "#"), frozenset(n for k, n in marks if k == ".")
                    special = (len(ids), len(classes), bool(m.group(1)), len(out))
                    out.append(((m.group(1) or "").lower(), ids, classes, [(p, v, (i, False, *special)) for p, v, i in told]))
    return out


def shown(node: Node, rules) -> tuple[bool, bool | None]:
    """Whether an element is laid out, and whether it makes its text visible (None: as its parent).

    Some elements show no text; ``hidden`` and closed dialogs are overruled by style rules that tell a display.
    """
    a = node.attrs
    if node.tag in UNSEEN or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False, None
    best: dict[str, tuple] = {}
    if rules:
        own = set(a.get("class", "").split())
        for t, i, c, declared in rules:
            if (not t or t == node.tag) and (not i or (len(i) == 1 and a.get("id") in i)) and c <= own:
                for p, v, weight in declared:
                    if p not in best or weight >= best[p][0]:
                        best[p] = (weight, v)
    for p, v, i in _declared.findall(a.get("style", "")):
        weight = (bool(i), True)
        if p.lower() not in best or weight >= best[p.lower()][0][:2]:
            best[p.lower()] = ((*weight, 0, 0, False, 0), v.lower())
    display = best["display"][1] if "display" in best else "none" if "hidden" in a or (node.tag == "dialog" and "open" not in a) else ""
    seen = best["visibility"][1] if "visibility" in best else ""
    return display != "none", True if seen == "visible" else False if seen in ("hidden", "collapse") else None


class _Lines:
    """Lines of text under construction: white space folds, blocks part lines, apart blocks leave one blank line."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.blank = False

    def add(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *more = text.split("\n")
            self._put(first)
            for line in more:
                self._end(force=True)
                self._put(line)
            return
        folded = _space.sub(" ", text)
        if folded.startswith(" "):
            self.gap = True
        words = folded.strip(" ")
        if words:
            if self.gap and self.now:
                self.now.append(" ")
            self.gap = False
            self._put(words)
            self.gap = folded.endswith(" ")

    def _put(self, text: str) -> None:
        if text:
            if self.blank and self.lines and not self.now:
                self.lines.append("")
            self.blank = False
            self.now.append(text)

    def _end(self, force: bool = False) -> None:
        if self.now or force:
            self.lines.append("".join(self.now).rstrip())
        self.now, self.gap = [], False

    def part(self, apart: bool = False) -> None:
        self._end()
        self.blank = self.blank or apart

    def block(self, lines: list[str]) -> None:
        """Finished lines, as a block of their own."""
        self.part()
        if lines and self.blank and self.lines:
            self.lines.append("")
        if lines:
            self.blank = False
        self.lines += lines

    def done(self) -> list[str]:
        self._end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def render(node: Node, rules, out: _Lines, pre: bool = False, seen: bool = True) -> None:
    """Adds what ``node`` holds to ``out``; text where ``seen`` is false is left out, but what it holds may be visible again."""
    for child in node.children:
        if isinstance(child, str):
            if seen:
                out.add(child, pre)
            continue
        laid_out, told = shown(child, rules)
        if not laid_out:
            continue
        see = seen if told is None else told
        tag = child.tag
        if tag == "br":
            out._end(force=True)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.part(apart=node.tag != "li")
            _items(child, rules, out, pre, see)
            out.part(apart=node.tag != "li")
        elif tag == "table":
            out.part(apart=True)
            out.block(_table(child, rules, pre, see))
            out.part(apart=True)
        elif tag == "img":
            if see:
                out.add(child.attrs.get("alt", ""))
        elif tag == "input":
            if see and child.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                out.add(child.attrs.get("value", ""))
        elif tag == "details" and "open" not in child.attrs:
            out.part()
            for summary in child.children:
                if isinstance(summary, Node) and summary.tag == "summary":
                    render(summary, rules, out, pre, see)
                    break
            out.part()
        elif tag == "dd":
            out.block(["  " + x if x else x for x in _inside(child, rules, pre, see)])
        elif tag in BLOCK:
            out.part(apart=tag in APART)
            render(child, rules, out, pre or tag == "pre", see)
            out.part(apart=tag in APART)
        else:
            render(child, rules, out, pre or tag == "textarea", see)


def _inside(node: Node, rules, pre: bool, seen: bool) -> list[str]:
    inside = _Lines()
    render(node, rules, inside, pre, seen)
    return inside.done()


def _items(node: Node, rules, out: _Lines, pre: bool, seen: bool) -> None:
    """List items with a dash or their number; more lines of an item hang under its text."""
    number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
    for child in node.children:
        if isinstance(child, str):
            if seen:
                out.add(child, pre and bool(child.strip()))
            continue
        laid_out, told = shown(child, rules)
        if not laid_out:
            continue
        see = seen if told is None else told
        if child.tag in ("ul", "ol", "menu", "dir"):
            inside = _Lines()
            _items(child, rules, inside, pre, see)
            lines, mark = inside.done(), "  "
        elif child.tag == "li":
            lines = _inside(child, rules, pre, see)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
        else:
            lines, mark = _inside(Node("li", {}, [child]), rules, pre, seen), "  "
        if lines:
            out.block([(mark if i == 0 else " " * len(mark)) + x if x else x for i, x in enumerate(lines)])


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "")
    return min(max(1, int(value)), most) if re.fullmatch(r"\d{1,9}", value) else 1


def _table(table: Node, rules, pre: bool, seen: bool) -> list[str]:
    """Rows of cells, columns aligned and two spaces apart; cells of several lines stand line by line.

    A cell over several columns or rows stands in the first of them.
    """
    rows: list[dict[int, list[str]]] = []
    lines: list[str] = []
    taken: dict[int, int] = {}  # for columns: rows that cells above still reach over

    def row_of(tr: Node, seen: bool) -> None:
        row: dict[int, list[str]] = {}
        column, over = 0, {}
        for cell in tr.children:
            if isinstance(cell, str):
                if not cell.strip(" \t\n\r\f") or not seen:
                    continue
                text, wide, high = [_space.sub(" ", cell).strip(" ")], 1, 1
            else:
                laid_out, told = shown(cell, rules)
                if not laid_out:
                    continue
                see = seen if told is None else told
                text = _inside(cell if cell.tag in ("td", "th") else Node("td", {}, [cell]), rules, pre, see)
                wide, high = _span(cell, "colspan", COLSPAN), _span(cell, "rowspan", ROWSPAN)
            while taken.get(column, 0):
                column += 1
            row[column] = text
            if high > 1:
                over |= {c: high for c in range(column, column + wide)}
            column += wide
        for c in [c for c in taken if taken[c] <= 1]:
            del taken[c]
        for c in taken:
            taken[c] -= 1
        taken.update({c: n - 1 for c, n in over.items()})
        if any(row.values()):
            rows.append(row)

    def walk(node: Node, seen: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                if seen and child.strip(" \t\n\r\f"):
                    rows.append({0: [_space.sub(" ", child).strip(" ")]})
                continue
            laid_out, told = shown(child, rules)
            if not laid_out:
                continue
            see = seen if told is None else told
            if child.tag == "caption":
                lines.extend(_inside(child, rules, pre, see))
            elif child.tag == "tr":
                row_of(child, see)
            elif child.tag in ("thead", "tbody", "tfoot"):
                taken.clear()  # spans end with their part of the table
                walk(child, see)
            elif got := _inside(Node("td", {}, [child]), rules, pre, seen):
                rows.append({0: got})

    walk(table, seen)
    width: dict[int, int] = {}
    size = count = 0
    for row in rows:
        count += max(map(len, row.values()))
        for c, cell in row.items():
            width[c] = max(width.get(c, 0), *map(len, cell), 0)
            size += sum(map(len, cell))
    if count * sum(width.values()) > PADDING * size + PADDING_MORE:
        width = {c: min(w, NARROW) for c, w in width.items()}
    columns = sorted(c for c in width if width[c])
    for row in rows:
        for k in range(max(map(len, row.values()))):
            cells = [(row[c][k] if k < len(row.get(c, ())) else "").ljust(width[c]) for c in columns]
            lines.append("  ".join(cells).rstrip())
    return lines


def page_text(html: str | None) -> str:
    """All visible text of a page."""
    root, styles, depth = tree(html or "")
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 4 * depth + 1000))  # rendering goes as deep as the page, in plain Python frames
    try:
        out = _Lines()
        laid_out, told = shown(root, rules := style_rules(styles))
        if laid_out:
            render(root, rules, out, seen=told is not False)
        return "\n".join(out.done())
    finally:
        sys.setrecursionlimit(before)


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, text, n_chars, n_lines)`` for every row; no shuffle.

    Null, empty and text-free pages give an empty text with no lines.  Repeated rows and rows without an id are rendered
    like any other; other columns are ignored.  Markup is never rejected: what isn't a tag is text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [page_text(h.as_py()) for h in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                names=[id_col, "text", "n_chars", "n_lines"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return small_batches(pages).select(F.col(id_col), F.col(html_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, text string, n_chars long, n_lines long")
