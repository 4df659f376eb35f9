"""Trees of HTML as browsers build them: implied elements, open formatting elements, tables that push out what isn't theirs.

Follows the tree construction of the public HTML standard, without frames, templates' own documents and scripts. Elements
that an end tag closes out of order are taken apart (adoption agency), formatting that is still open starts anew in the
next block, and text or elements loose in a table move in front of it.
"""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

from .dom import VOID, Node

# --- fixed values: element lists of the standard -----------------------------------------------------------------------

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input li link listing main "
    "marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script section select source style summary table tbody td "
    "template textarea tfoot th thead title tr track ul wbr xmp".split()
)
#: Blocks whose start closes an open paragraph, and whose end closes what is open in them.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol "
    "pre search section summary ul".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta noframes script style template title".split())
SCOPE = frozenset("applet caption html table td th marquee object template foreignobject desc".split())
LIST_SCOPE = SCOPE | {"ol", "ul"}
BUTTON_SCOPE = SCOPE | {"button"}
TABLE_SCOPE = frozenset(("html", "table", "template"))
IMPLIED_ENDS = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
ROW_GROUPS = frozenset(("tbody", "tfoot", "thead"))
CELLS = frozenset(("td", "th"))
#: Elements that end svg and math.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)
#: Elements of svg and math that hold HTML.
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Elements that hold text only; in the first two it may have character references.
TEXT_ONLY = ("title", "textarea", "script", "style", "xmp", "iframe", "noembed", "noframes")
SPACE = " \t\n\f\r"


class TreeBuilder(HTMLParser):
    """Builds a tree from the tokens of the standard library's parser; ``mode`` names the method that takes a start tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.html: Node | None = None
        self.head: Node | None = None
        self.body: Node | None = None
        self.form: Node | None = None
        self.open: list[Node] = []
        self.formatting: list[Node | None] = []  # None: a marker
        self.mode = "before_head"
        self.loose: list[str] = []  # text in a table that isn't placed yet
        self.fostering = False
        self.quirks = True
        self.skip_newline = False
        self.alien: set[int] = set()  # nodes of svg and math, by id (the tree keeps them)

    @property
    def CDATA_CONTENT_ELEMENTS(self):
        """Elements whose content is text, whatever it looks like (the base class asks after it has handled the start)."""
        return () if id(self.now) in self.alien else TEXT_ONLY

    # --- stack and places -------------------------------------------------------------------------------------------

    @property
    def now(self) -> Node:
        return self.open[-1] if self.open else self.root

    def in_scope(self, tags, bounds=SCOPE) -> bool:
        for node in reversed(self.open):
            if node.tag in tags:
                return True
            if node.tag in bounds:
                return False
        return False

    def pop_to(self, tags) -> None:
        while self.open:
            if self.open.pop().tag in tags:
                return

    def clear_to(self, tags) -> None:
        """Closes everything above the nearest of some elements."""
        while len(self.open) > 1 and self.now.tag not in tags:
            self.open.pop()

    def imply_ends(self, but: str = "") -> None:
        while self.now.tag in IMPLIED_ENDS and self.now.tag != but:
            self.open.pop()

    def place(self, target: Node | None = None) -> tuple[Node, int]:
        """Parent and position for what comes next: in front of the table if that can't hold it."""
        target = target or self.now
        if self.fostering and target.tag in ("table", "tr", *ROW_GROUPS):
            at = max((i for i, n in enumerate(self.open) if n.tag == "table"), default=-1)
            if at >= 0:
                table = self.open[at]
                if table.parent is not None:
                    return table.parent, table.parent.children.index(table)
                target = self.open[at - 1]
        return target, len(target.children)

    def put(self, node: Node, target: Node | None = None) -> Node:
        parent, at = self.place(target)
        node.parent = parent
        parent.children.insert(at, node)
        return node

    def insert(self, tag: str, attrs: dict[str, str] | None = None) -> Node:
        node = self.put(Node(tag, dict(attrs or {})))
        self.open.append(node)
        return node

    def insert_void(self, tag: str, attrs: dict[str, str]) -> None:
        self.put(Node(tag, dict(attrs)))

    def write(self, text: str) -> None:
        if not text:
            return
        parent, at = self.place()
        if at and parent.children[at - 1].tag == "#text":
            parent.children[at - 1].data += text
        else:
            self.put(Node("#text", data=text))

    # --- formatting -------------------------------------------------------------------------------------------------

    def open_formatting(self, node: Node) -> None:
        """Notes an open formatting element; of equal ones the last three count."""
        same = []
        for other in reversed(self.formatting):
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                same.append(other)
        if len(same) >= 3:
            self.formatting.remove(same[-1])
        self.formatting.append(node)

    def reopen_formatting(self) -> None:
        at = len(self.formatting)
        while at and self.formatting[at - 1] is not None and self.formatting[at - 1] not in self.open:
            at -= 1
        for i in range(at, len(self.formatting)):
            self.formatting[i] = self.insert(self.formatting[i].tag, self.formatting[i].attrs)

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def formatted(self, tag: str) -> Node | None:
        for node in reversed(self.formatting):
            if node is None:
                return None
            if node.tag == tag:
                return node
        return None

    def forget(self, node: Node) -> None:
        for those in (self.formatting, self.open):
            if node in those:
                those.remove(node)

    def adopt(self, tag: str) -> None:
        """Closes a formatting element that blocks may still be open in (adoption agency)."""
        if self.now.tag == tag and self.now not in self.formatting:
            self.open.pop()
            return
        for _ in range(8):
            element = self.formatted(tag)
            if element is None:
                self.end_other(tag)
                return
            if element not in self.open:
                self.formatting.remove(element)
                return
            if not self.in_scope({tag}):
                return
            at = self.open.index(element)
            block = next((n for n in self.open[at + 1 :] if n.tag in SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.formatting.remove(element)
                return
            ancestor, mark, last = self.open[at - 1], self.formatting.index(element), block
            above = self.open.index(block)
            for step in range(1, len(self.open) + 1):
                above -= 1
                node = self.open[above]
                if node is element:
                    break
                if node in self.formatting and step > 3:
                    mark -= self.formatting.index(node) < mark
                    self.formatting.remove(node)
                if node not in self.formatting:
                    self.open.pop(above)
                    continue
                copy = Node(node.tag, dict(node.attrs))
                self.formatting[self.formatting.index(node)] = copy
                self.open[above] = copy
                if last is block:
                    mark = self.formatting.index(copy) + 1
                last.remove()
                last = copy.append(last) and copy
            last.remove()
            fostering, self.fostering = self.fostering, True
            self.put(last, ancestor)
            self.fostering = fostering
            copy = Node(element.tag, dict(element.attrs))
            for child in block.children:
                copy.append(child)
            block.children = []
            block.append(copy)
            self.formatting.insert(mark, copy)
            self.formatting.remove(element)
            self.open.remove(element)
            self.open.insert(self.open.index(block) + 1, copy)

    # --- tokens -----------------------------------------------------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for name, value in attrs:
            own.setdefault(name, value or "")
        self.settle()
        if self.foreign() and not self.breaks_out(tag, own):
            self.start_foreign(tag, own)
        else:
            getattr(self, self.mode)(tag, own)

    def handle_startendtag(self, tag, attrs):
        was = len(self.open)
        foreign = self.foreign() or tag in ("svg", "math")
        self.handle_starttag(tag, attrs)
        if foreign and len(self.open) > was and self.now.tag == tag:
            self.open.pop()
        elif tag not in VOID and tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)  # the slash means nothing there

    def handle_endtag(self, tag):
        self.settle()
        self.skip_newline = False
        if self.foreign():
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    del self.open[i:]
                    return
                if self.open[i].tag in ("svg", "math"):
                    break
        getattr(self, f"end_{self.mode}")(tag)

    def handle_data(self, data):
        if self.skip_newline:
            self.skip_newline = False
            data = data[1:] if data[:1] == "\n" else data
        data = data.replace("\x00", "")
        if not data:
            return
        if self.foreign():
            self.write(data)
            return
        if self.now.tag in TEXT_ONLY and id(self.now) not in self.alien:
            self.write(unescape(data) if self.now.tag in TEXT_ONLY[:2] else data)
        elif self.mode in ("in_table", "in_body_of_table", "in_row"):
            self.loose.append(data)
        elif self.mode == "in_select" or self.mode == "in_select_of_table":
            self.write(data)
        elif self.mode == "in_columns":
            space = data[: len(data) - len(data.lstrip(SPACE))]
            self.write(space)
            if len(space) < len(data) and self.now.tag == "colgroup":
                self.open.pop()
                self.mode = "in_table"
                self.handle_data(data[len(space) :])
        elif self.mode in ("before_head", "in_head", "after_head"):
            space = data[: len(data) - len(data.lstrip(SPACE))]
            if self.mode != "before_head":
                self.write(space)
            if len(space) < len(data):
                self.start_body()
                self.handle_data(data[len(space) :])
        else:
            self.text_in_body(data)

    def text_in_body(self, data: str) -> None:
        if self.mode == "after_body":
            self.mode = "in_body" if data.strip(SPACE) else "after_body"
        self.reopen_formatting()
        self.write(data)

    def handle_comment(self, data):
        self.settle()
        node = Node("#comment", data=data)
        if self.html is None:
            self.root.append(node)
        elif self.mode == "after_body":
            self.html.append(node)
        else:
            self.put(node)

    def handle_decl(self, decl):
        if self.html is None:
            self.quirks = False
            self.root.append(Node("#doctype", data=decl))

    def handle_pi(self, data):
        self.handle_comment("?" + data)

    def unknown_decl(self, data):
        if self.foreign() and data.startswith("CDATA["):
            self.write(data[6:])
        else:
            self.handle_comment(f"[{data}]")

    def settle(self) -> None:
        """Places text found in a table: space stays, anything else goes in front of the table."""
        if not self.loose:
            return
        text, self.loose = "".join(self.loose), []
        if text.strip(SPACE):
            self.fostering = True
            self.reopen_formatting()
            self.write(text)
            self.fostering = False
        else:
            self.write(text)

    # --- svg and math -----------------------------------------------------------------------------------------------

    def foreign(self) -> bool:
        """Whether the current element is one of svg or math, and none that holds HTML."""
        return id(self.now) in self.alien and self.now.tag not in HOLDS_HTML

    def breaks_out(self, tag: str, attrs: dict) -> bool:
        if tag in BREAKS_OUT or tag == "font" and {"color", "face", "size"} & set(attrs):
            while len(self.open) > 1 and self.foreign():
                self.open.pop()
            return True
        return False

    def start_foreign(self, tag: str, attrs: dict) -> None:
        self.alien.add(id(self.insert(tag, attrs)))

    # --- before the body --------------------------------------------------------------------------------------------

    def start_html(self, attrs: dict) -> None:
        if self.html is None:
            self.html = self.root.append(Node("html"))
            self.open = [self.html]
        for name, value in attrs.items():
            self.html.attrs.setdefault(name, value)

    def start_head(self, attrs: dict) -> None:
        self.start_html({})
        if self.head is None:
            self.head = self.insert("head", attrs)
            self.mode = "in_head"

    def start_body(self, attrs: dict | None = None) -> None:
        self.start_head({})
        if self.body is None:
            del self.open[1:]
            self.body = self.insert("body", attrs)
        self.mode = "in_body"

    def before_head(self, tag, attrs):
        if tag == "html":
            self.start_html(attrs)
        elif tag == "head":
            self.start_head(attrs)
        else:
            self.start_head({})
            self.in_head(tag, attrs)

    def end_before_head(self, tag):
        if tag in ("head", "body", "html", "br"):
            self.start_head({})
            self.end_in_head(tag)

    def in_head(self, tag, attrs):
        if tag == "html":
            self.start_html(attrs)
        elif tag in IN_HEAD:
            self.start_in_head(tag, attrs)
        elif tag == "noscript":
            self.insert(tag, attrs)
        elif tag == "head":
            pass
        else:
            if self.now.tag == "noscript":
                self.open.pop()
            self.open.pop()
            self.mode = "after_head"
            self.after_head(tag, attrs)

    def start_in_head(self, tag, attrs):
        if tag in VOID or tag in ("basefont", "bgsound"):
            self.insert_void(tag, attrs)
            return
        self.insert(tag, attrs)
        if tag == "template":
            self.formatting.append(None)

    def end_in_head(self, tag):
        if tag == "head":
            while self.now is not self.html:
                self.open.pop()
            self.mode = "after_head"
        elif tag in ("script", "style", "title", "noframes", "noscript", "template"):
            if any(n.tag == tag for n in self.open):
                self.pop_to({tag})
                if tag == "template":
                    self.clear_formatting()
        elif tag in ("body", "html", "br"):
            self.start_body()
            self.end_in_body(tag)

    def after_head(self, tag, attrs):
        if tag == "html":
            self.start_html(attrs)
        elif tag == "body":
            self.start_body(attrs)
        elif tag in IN_HEAD:  # still the head's
            self.open.append(self.head)
            self.start_in_head(tag, attrs)
            self.open.remove(self.head)
        elif tag != "head":
            self.start_body()
            self.in_body(tag, attrs)

    def end_after_head(self, tag):
        if tag in ("body", "html", "br"):
            self.start_body()
            self.end_in_body(tag)
        elif self.now.tag == tag:  # a late title, style or script
            self.open.pop()

    # --- body -------------------------------------------------------------------------------------------------------

    def close_p(self) -> None:
        if self.in_scope({"p"}, BUTTON_SCOPE):
            self.imply_ends("p")
            self.pop_to({"p"})

    def close_item(self, tags) -> None:
        for node in reversed(self.open):
            if node.tag in tags:
                self.imply_ends(node.tag)
                self.pop_to({node.tag})
                return
            if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                return

    def in_body(self, tag, attrs):
        if tag == "html":
            self.start_html(attrs)
        elif tag in IN_HEAD:
            self.start_in_head(tag, attrs)
        elif tag == "body":
            for name, value in attrs.items():
                self.body.attrs.setdefault(name, value)
        elif tag in BLOCKS or tag in ("p", "plaintext"):
            self.close_p()
            self.insert(tag, attrs)
            self.skip_newline = tag in ("pre", "listing")
        elif tag in HEADINGS:
            self.close_p()
            if self.now.tag in HEADINGS:
                self.open.pop()
            self.insert(tag, attrs)
        elif tag == "form":
            if self.form is None:
                self.close_p()
                self.form = self.insert(tag, attrs)
        elif tag in ("li", "dd", "dt"):
            self.close_item({"li"} if tag == "li" else {"dd", "dt"})
            self.close_p()
            self.insert(tag, attrs)
        elif tag == "button":
            if self.in_scope({"button"}):
                self.imply_ends()
                self.pop_to({"button"})
            self.reopen_formatting()
            self.insert(tag, attrs)
        elif tag in FORMATTING:
            if tag == "a" and (old := self.formatted("a")) is not None:
                self.adopt("a")
                self.forget(old)
            self.reopen_formatting()
            if tag == "nobr" and self.in_scope({"nobr"}):
                self.adopt("nobr")
                self.reopen_formatting()
            self.open_formatting(self.insert(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self.reopen_formatting()
            self.insert(tag, attrs)
            self.formatting.append(None)
        elif tag == "table":
            if not self.quirks:
                self.close_p()
            self.insert(tag, attrs)
            self.mode = "in_table"
        elif tag in ("param", "source", "track"):
            self.insert_void(tag, attrs)
        elif tag == "hr":
            self.close_p()
            self.insert_void(tag, attrs)
        elif tag == "image":
            self.in_body("img", attrs)
        elif tag in VOID and tag != "col":
            self.reopen_formatting()
            self.insert_void(tag, attrs)
        elif tag in ("svg", "math"):
            self.reopen_formatting()
            self.start_foreign(tag, attrs)
        elif tag == "textarea":
            self.insert(tag, attrs)
            self.skip_newline = True
        elif tag == "xmp":
            self.close_p()
            self.reopen_formatting()
            self.insert(tag, attrs)
        elif tag == "select":
            self.reopen_formatting()
            self.insert(tag, attrs)
            self.mode = "in_select_of_table" if self.mode != "in_body" else "in_select"
        elif tag in ("optgroup", "option"):
            if self.now.tag == "option":
                self.open.pop()
            self.reopen_formatting()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope({"ruby"}):
                self.imply_ends("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        elif tag not in TABLE_PARTS and tag not in ("frame", "frameset", "head"):
            self.reopen_formatting()
            self.insert(tag, attrs)

    def end_in_body(self, tag):
        if tag in ("body", "html"):
            if self.in_scope({"body"}):
                self.mode = "after_body"
        elif tag in BLOCKS or tag == "button":
            if self.in_scope({tag}):
                self.imply_ends()
                self.pop_to({tag})
        elif tag == "form":
            form, self.form = self.form, None
            if form is not None and form in self.open and self.in_scope({"form"}):
                self.imply_ends()
                self.open.remove(form)
        elif tag == "p":
            if not self.in_scope({"p"}, BUTTON_SCOPE):
                self.insert("p")
            self.close_p()
        elif tag in ("li", "dd", "dt"):
            if self.in_scope({tag}, LIST_SCOPE if tag == "li" else SCOPE):
                self.imply_ends(tag)
                self.pop_to({tag})
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply_ends()
                self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope({tag}):
                self.imply_ends()
                self.pop_to({tag})
                self.clear_formatting()
        elif tag == "br":
            self.in_body("br", {})
        elif tag == "template":
            self.end_in_head(tag)
        else:
            self.end_other(tag)

    def end_other(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.imply_ends(tag)
                at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), None)
                if at is not None:
                    del self.open[at:]
                return
            if self.open[i].tag in SPECIAL:
                return

    def after_body(self, tag, attrs):
        self.mode = "in_body"
        self.in_body(tag, attrs)

    def end_after_body(self, tag):
        if tag not in ("body", "html"):
            self.mode = "in_body"
            self.end_in_body(tag)

    # --- tables -----------------------------------------------------------------------------------------------------

    def reset_mode(self) -> None:
        """The mode that the open elements ask for."""
        for node in reversed(self.open):
            mode = {"select": "in_select", "td": "in_cell", "th": "in_cell", "tr": "in_row", "caption": "in_caption", "colgroup": "in_columns", "table": "in_table", "body": "in_body", "head": "in_head"}.get(node.tag)
            mode = "in_body_of_table" if node.tag in ROW_GROUPS else mode
            if mode == "in_select" and any(n.tag == "table" for n in self.open):
                mode = "in_select_of_table"
            if mode:
                self.mode = mode
                return
        self.mode = "in_body" if self.body is not None else "after_head"

    def foster(self, handler, *args) -> None:
        mode, self.fostering = self.mode, True
        handler(*args)
        self.fostering = False
        if self.mode == "in_body":  # nothing but a select or a table changes it
            self.mode = mode

    def in_table(self, tag, attrs):
        if tag == "caption":
            self.clear_to(TABLE_SCOPE)
            self.formatting.append(None)
            self.insert(tag, attrs)
            self.mode = "in_caption"
        elif tag == "colgroup" or tag == "col":
            self.clear_to(TABLE_SCOPE)
            self.insert("colgroup", attrs if tag == "colgroup" else {})
            self.mode = "in_columns"
            if tag == "col":
                self.in_columns(tag, attrs)
        elif tag in ROW_GROUPS:
            self.clear_to(TABLE_SCOPE)
            self.insert(tag, attrs)
            self.mode = "in_body_of_table"
        elif tag in CELLS or tag == "tr":
            self.clear_to(TABLE_SCOPE)
            self.insert("tbody")
            self.mode = "in_body_of_table"
            self.in_body_of_table(tag, attrs)
        elif tag == "table":
            if self.in_scope({"table"}, TABLE_SCOPE):
                self.pop_to({"table"})
                self.reset_mode()
                getattr(self, self.mode)(tag, attrs)
        elif tag in ("style", "script", "template"):
            self.start_in_head(tag, attrs)
        elif tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.insert_void(tag, attrs)
        elif tag == "form":
            if self.form is None:
                self.form = self.put(Node(tag, dict(attrs)))
        else:
            self.foster(self.in_body, tag, attrs)

    def end_in_table(self, tag):
        if tag == "table":
            if self.in_scope({"table"}, TABLE_SCOPE):
                self.pop_to({"table"})
                self.reset_mode()
        elif tag in ("style", "script", "template"):
            self.end_in_head(tag)
        elif tag not in TABLE_PARTS and tag not in ("body", "html"):
            self.foster(self.end_in_body, tag)

    def in_caption(self, tag, attrs):
        if tag in TABLE_PARTS or tag == "table":
            if self.close_caption():
                getattr(self, self.mode)(tag, attrs)
        else:
            self.in_body(tag, attrs)

    def close_caption(self) -> bool:
        if not self.in_scope({"caption"}, TABLE_SCOPE):
            return False
        self.imply_ends()
        self.pop_to({"caption"})
        self.clear_formatting()
        self.mode = "in_table"
        return True

    def end_in_caption(self, tag):
        if tag == "caption":
            self.close_caption()
        elif tag == "table":
            if self.close_caption():
                self.end_in_table(tag)
        elif tag not in TABLE_PARTS and tag not in ("body", "html"):
            self.end_in_body(tag)

    def in_columns(self, tag, attrs):
        if tag == "col":
            self.insert_void(tag, attrs)
        elif tag == "html":
            self.start_html(attrs)
        elif tag == "template":
            self.start_in_head(tag, attrs)
        elif self.now.tag == "colgroup":
            self.open.pop()
            self.mode = "in_table"
            self.in_table(tag, attrs)

    def end_in_columns(self, tag):
        if tag != "col" and self.now.tag == "colgroup":
            self.open.pop()
            self.mode = "in_table"
            if tag != "colgroup":
                self.end_in_table(tag)

    def in_body_of_table(self, tag, attrs):
        if tag == "tr":
            self.clear_to(ROW_GROUPS | {"template", "html"})
            self.insert(tag, attrs)
            self.mode = "in_row"
        elif tag in CELLS:
            self.in_body_of_table("tr", {})
            self.in_row(tag, attrs)
        elif tag in ROW_GROUPS or tag in ("caption", "col", "colgroup"):
            if self.close_group():
                self.in_table(tag, attrs)
        else:
            self.in_table(tag, attrs)

    def close_group(self) -> bool:
        if not self.in_scope(ROW_GROUPS, TABLE_SCOPE):
            return False
        self.clear_to(ROW_GROUPS | {"template", "html"})
        self.open.pop()
        self.mode = "in_table"
        return True

    def end_in_body_of_table(self, tag):
        if tag in ROW_GROUPS:
            if self.in_scope({tag}, TABLE_SCOPE):
                self.close_group()
        elif tag == "table":
            if self.close_group():
                self.end_in_table(tag)
        elif tag not in TABLE_PARTS:
            self.end_in_table(tag)

    def in_row(self, tag, attrs):
        if tag in CELLS:
            self.clear_to({"tr", "template", "html"})
            self.insert(tag, attrs)
            self.mode = "in_cell"
            self.formatting.append(None)
        elif tag in TABLE_PARTS:
            if self.close_row():
                self.in_body_of_table(tag, attrs)
        else:
            self.in_table(tag, attrs)

    def close_row(self) -> bool:
        if not self.in_scope({"tr"}, TABLE_SCOPE):
            return False
        self.clear_to({"tr", "template", "html"})
        self.open.pop()
        self.mode = "in_body_of_table"
        return True

    def end_in_row(self, tag):
        if tag == "tr":
            self.close_row()
        elif tag == "table" or tag in ROW_GROUPS:
            if (tag == "table" or self.in_scope({tag}, TABLE_SCOPE)) and self.close_row():
                self.end_in_body_of_table(tag)
        elif tag not in TABLE_PARTS:
            self.end_in_table(tag)

    def in_cell(self, tag, attrs):
        if tag in TABLE_PARTS:
            if self.in_scope(CELLS, TABLE_SCOPE):
                self.close_cell()
                getattr(self, self.mode)(tag, attrs)
        else:
            self.in_body(tag, attrs)

    def close_cell(self) -> None:
        self.imply_ends()
        self.pop_to(CELLS)
        self.clear_formatting()
        self.mode = "in_row"

    def end_in_cell(self, tag):
        if tag in CELLS:
            if self.in_scope({tag}, TABLE_SCOPE):
                self.imply_ends()
                self.pop_to({tag})
                self.clear_formatting()
                self.mode = "in_row"
        elif tag in ("table", "tr", *ROW_GROUPS):
            if self.in_scope({tag}, TABLE_SCOPE):
                self.close_cell()
                self.end_in_row(tag)
        elif tag not in TABLE_PARTS and tag not in ("body", "html"):
            self.end_in_body(tag)

    # --- select -----------------------------------------------------------------------------------------------------

    def in_select(self, tag, attrs):
        if tag in ("option", "optgroup", "hr"):
            if self.now.tag == "option":
                self.open.pop()
            if tag != "option" and self.now.tag == "optgroup":
                self.open.pop()
            if tag == "hr":
                self.insert_void(tag, attrs)
            else:
                self.insert(tag, attrs)
        elif tag in ("select", "input", "textarea"):
            self.end_in_select("select")
            if tag != "select":
                getattr(self, self.mode)(tag, attrs)
        elif tag in ("script", "template"):
            self.start_in_head(tag, attrs)

    def end_in_select(self, tag):
        if tag == "optgroup":
            if self.now.tag == "option" and len(self.open) > 1 and self.open[-2].tag == "optgroup":
                self.open.pop()
            if self.now.tag == "optgroup":
                self.open.pop()
        elif tag == "option":
            if self.now.tag == "option":
                self.open.pop()
        elif tag == "select":
            if any(n.tag == "select" for n in self.open):
                self.pop_to({"select"})
                self.reset_mode()
        elif tag in ("script", "template"):
            self.end_in_head(tag)

    def in_select_of_table(self, tag, attrs):
        if tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            self.end_in_select("select")
            getattr(self, self.mode)(tag, attrs)
        else:
            self.in_select(tag, attrs)

    def end_in_select_of_table(self, tag):
        if tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            if self.in_scope({tag}, TABLE_SCOPE):
                self.end_in_select("select")
                getattr(self, f"end_{self.mode}")(tag)
        else:
            self.end_in_select(tag)


def build(html: str) -> Node:
    """The tree of a document, with html, head and body. Never fails: what no rule covers is kept as text."""
    builder = TreeBuilder()
    builder.feed(html)
    HTMLParser.close(builder)
    builder.settle()
    if builder.body is None:
        builder.start_body()
    return builder.root
