"""Lexers: string literals of six formats with the statement around them.

Each takes a text and yields (value, src, statement); statements are numbered by first appearance afterwards. They
are scanners of their own, tolerant of broken input, and stop at a deadline instead of hanging.
"""

from __future__ import annotations

import json
import re
import time
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklode.functions import rules as R

Found = Iterator[tuple[str, str, str]]

UNKNOWN = "<unknown statement>"
#: Values this short are never constants.
LEAST_VALUE = 5
DEADLINE_S = 360.0

_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|(\r\n|[\s\S]))")
_NAMED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


class Deadline(Exception):
    """A file took too long."""


def unescape(text: str) -> str:
    """Escapes of script strings; a code point out of range stays as it is, an unknown escape loses its backslash."""

    def of(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            point = int(code, 16)
            return chr(point) if point <= 0x10FFFF else m[0]
        return _NAMED.get(m[4], "" if m[4] in ("\n", "\r\n") else m[4])

    return _ESCAPE.sub(of, text) if "\\" in text else text


_BEFORE_REGEX = set("(,=:[!&|?{};+-*%^~<>")
_OPEN, _CLOSE = "([{", ")]}"
_WORDS_BEFORE_REGEX = re.compile(r"(?:^|[^\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do)\s*$")


def script_tokens(text: str, check: Callable[[], None]) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, head: where the literal begins) of strings ('s'), static template parts ('t'), structure ('p': one character), and ('x') what shows that
    the text is broken: open strings and comments, brackets without their other half."""
    out: list[tuple[str, int, int, int]] = []
    brackets: list[tuple[str, int]] = []
    i, n, last = 0, len(text), ""
    templates: list[tuple[int, int]] = []  # bracket depth at which a template's expression ends, where the template begins
    depth = 0

    def template(at: int, head: int) -> int:
        nonlocal depth
        start = at
        while at < n:
            c = text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                out.append(("t", start, at, head))
                return at + 1
            elif text.startswith("${", at):
                out.append(("t", start, at, head))
                templates.append((depth, head))
                depth += 1
                return at + 2
            else:
                at += 1
        out.append(("x", start, n, head))
        return n

    while i < n:
        if not i % 4096:
            check()
        c = text[i]
        if c in "'\"":
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            if j < n and text[j] == c:
                out.append(("s", i, j + 1, i))
                i, last = j + 1, "a"
            else:
                out.append(("x", i, i + 1, i))
                i += 1
        elif c == "`":
            i, last = template(i + 1, i), "a"
        elif text.startswith("//", i):
            j = text.find("\n", i)
            i = n if j < 0 else j
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            if j < 0:
                out.append(("x", i, n, i))
            i = n if j < 0 else j + 2
        elif c == "/" and (not last or last in _BEFORE_REGEX or _WORDS_BEFORE_REGEX.search(text, max(0, i - 12), i)):
            j, inside = i + 1, False
            while j < n and text[j] != "\n" and (inside or text[j] != "/"):
                if text[j] == "\\":
                    j += 1
                elif text[j] == "[":
                    inside = True
                elif text[j] == "]":
                    inside = False
                j += 1
            i, last = j + 1, "a"
        else:
            if c in _OPEN:
                depth += 1
                brackets.append((_CLOSE[_OPEN.index(c)], i))
            elif c in _CLOSE:
                depth = max(0, depth - 1)
                if c == "}" and templates and depth == templates[-1][0]:
                    pass  # closes an expression of a template
                elif brackets and brackets[-1][0] == c:
                    brackets.pop()
                else:
                    out.append(("x", i, i + 1, i))
                if c == "}" and templates and depth == templates[-1][0]:
                    i, last = template(i + 1, templates.pop()[1]), "a"
                    continue
            if c in "{}[]();,:=":
                out.append(("p", i, i + 1, i))
            if not c.isspace():
                last = c
            i += 1
    return out + [("x", at, at + 1, at) for _, at in brackets]


_KEY_BEFORE = re.compile(r"(?:(?:var|let|const)\s+)?[\w$.\]\['\"-]+\s*(?:[:=]|\|\|=|\?\?=)(?!=)[^,;{}]*$")


def _statement(text: str, start: int, end: int) -> str:
    """The nearest property, assignment or declaration around a literal, else its line, else 200 characters on each side."""
    left = max(text.rfind(c, 0, start) for c in ";{}\n") + 1
    key = _KEY_BEFORE.search(text, max(left, start - 400), start)
    stop = end
    while stop < len(text) and text[stop] not in ",;}\n":
        stop += 1
    if key:
        return text[key.start() : min(stop, end + 200)].strip()
    line0 = text.rfind("\n", 0, start) + 1
    line1 = text.find("\n", end)
    line = text[line0 : len(text) if line1 < 0 else line1].strip()
    return line if len(line) <= 512 else text[max(0, start - 200) : end + 200].strip()


_KINDS = [(kind, re.compile(pattern)) for kind, pattern in R.FALLBACK_RULES]


def fallback_kind(value: str) -> str | None:
    """What shapes.fallback_kind says, of a value in a lexer."""
    v = value.strip()
    for kind, pattern in _KINDS if len(v) >= R.FALLBACK_LEAST_LENGTH else ():
        if ("\n" in v or "\r" in v) and kind != "pem" or not pattern.fullmatch(v):
            continue
        if kind in R.FALLBACK_PATHS:
            if not re.search("[A-Za-z]", v):
                continue
            return None if set(v.split("?", 1)[0].split("/")) & set(R.THIRD_PARTY_FOLDERS) else kind
        if kind not in R.FALLBACK_VARIED or len(set(v)) >= R.FALLBACK_LEAST_VARIED:
            return kind
    return None


def is_style_script(file: str) -> bool:
    """A stylesheet compiled to a script, by its name."""
    name = re.split(r"[\\/]", file)[-1].lower()
    return name == R.STYLE_SCRIPT or name.endswith(R.STYLE_SCRIPT_ENDS)


_QUOTED = r"""(?:"([^"\n]*)"|'([^'\n]*)')"""
#: Literals with what names them: declarations, further declarations, members, properties.
_NAMED_LITERAL = re.compile(
    rf"""(?:(?:var|let|const)\s+(?:[\w$]+\.)?[\w$]+\s*=|,\s*[\w$]+\s*=|[\w$]+\.[\w$]+\s*=|[\w$]+\s*\[\s*(?:"[^"\n]+"|'[^'\n]+')\s*\]\s*=|(?:[\w$][\w$.\-]*|"[^"\n]+"|'[^'\n]+')\s*:)\s*{_QUOTED}"""
)
_LITERAL = re.compile(r"""(?s)"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\$]|\$(?!\{)|\\.)*)`""")
_BODY_BEFORE = re.compile(r"(?:\)|=>)\s*\Z")


def _bodies(text: str) -> list[tuple[int, int]]:
    """Spans of function and statement bodies of a broken script, by its braces alone."""
    out, stack = [], []
    for m in re.finditer("[{}]", text):
        at = m.start()
        if m[0] == "{":
            stack.append((at, bool(_BODY_BEFORE.search(text, max(0, at - 40), at))))
        elif stack:
            start, body = stack.pop()
            if body:
                out.append((start, at))
    return out + [(start, len(text)) for start, body in stack if body]


def _line_of(text: str, start: int, end: int) -> str:
    """The line of a value, or what stands around it in a long one."""
    lo, hi = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    hi = len(text) if hi < 0 else hi
    if hi - lo <= 4 * R.MOST_LINE and len(line := text[lo:hi].strip()) <= R.MOST_LINE:
        return line
    a, b = max(lo, start - R.LINE_AROUND), min(hi, end + R.LINE_AROUND)
    return ("..." * (a > lo) + text[a:b] + "..." * (b < hi))[: R.MOST_LINE]


def from_broken_script(text: str, check: Callable[[], None], every: bool = True, whole: bool = False) -> Found:
    """What patterns find in a script that does not parse: named literals outside of bodies as they are; others only if
    their unescaped value is of a known kind (every false: none of those). whole: no literal is taken as it is."""
    bodies = _bodies(text)
    starts, ends = sorted(a for a, _ in bodies), sorted(b for _, b in bodies)
    inside = lambda at: whole or bisect_left(starts, at) > bisect_left(ends, at)
    for m in _NAMED_LITERAL.finditer(text):
        check()
        value, stmt = (m[1] if m[1] is not None else m[2]).strip(), m[0].lstrip(", \t\r\n")
        if not inside(m.start()):
            yield value, "js-regex", stmt
        elif every and fallback_kind(value := unescape(value)):
            yield value, "js-regex", stmt
    for m in _LITERAL.finditer(text) if every else ():
        check()
        value = unescape(next(g for g in m.groups() if g is not None).strip())
        if fallback_kind(value):
            yield value, "js-regex", _line_of(text, m.start(), m.end())


def from_script(text: str, check: Callable[[], None], file: str = "") -> Found:
    """Literals with the tag js-ast; of a broken script also what patterns find besides, with the tag js-regex."""
    tokens = script_tokens(text, check)
    seen = set()
    for kind, start, end, head in tokens:
        if kind == "s" or kind == "t" and end > start:
            value = unescape(text[start + 1 : end - 1] if kind == "s" else text[start:end])
            seen.add(value)
            yield value, "js-ast", _statement(text, head, end)
    if any(kind == "x" for kind, *_ in tokens):
        yield from (f for f in from_broken_script(text, check, not is_style_script(file)) if f[0] not in seen)


def from_wxs(text: str, check: Callable[[], None]) -> Found:
    """The same of a view script; of a broken one only values of a known kind."""
    tokens = script_tokens(text, check)
    if any(kind == "x" for kind, *_ in tokens):
        yield from ((value, "wxs", stmt) for value, _, stmt in from_broken_script(text, check, whole=True))
        return
    for kind, start, end, head in tokens:
        if kind == "s" or kind == "t" and text[start:end].strip():
            yield unescape(text[start + 1 : end - 1] if kind == "s" else text[start:end]), "wxs", _statement(text, head, end)


def from_json(text: str, check: Callable[[], None]) -> Found:
    """String leaves with their paths, each value once; a text that is not JSON is read up to its first whole value."""
    try:
        data = json.loads(text)
    except (ValueError, RecursionError):
        at = re.search(r"[\[{]", text)
        if not at:
            return
        try:
            data, _ = json.JSONDecoder().raw_decode(text, at.start())
        except (ValueError, RecursionError):
            return
    seen: set[str] = set()
    stack: list[tuple[tuple[str, ...], object]] = [((), data)]
    while stack:
        check()
        path, node = stack.pop()
        if isinstance(node, dict):
            stack += [((*path, str(k)), v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [((*path, str(k)), v) for k, v in reversed(list(enumerate(node)))]
        elif isinstance(node, str) and node not in seen:
            seen.add(node)
            yield node, "json", f"{'/'.join(path)}: {json.dumps(node, ensure_ascii=False)}"


#: In a page's script: comments, quoted text, and the start of a template.
_PAGE_TOKEN = re.compile(r"""(?s)//[^\n]*|/\*.*?(?:\*/|\Z)|"((?:[^"\\]|\\.)*)(?:"|\\?\Z)|'((?:[^'\\]|\\.)*)(?:'|\\?\Z)|(`)""")
_TEMPLATE_PART = re.compile(r"(?s)((?:[^`\\$]|\$(?!\{)|\\.)*)(`|\$\{|\\?\Z)")
_EXPRESSION_TOKEN = re.compile(r"""(?s)//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*(?:"|\\?\Z)|'(?:[^'\\]|\\.)*(?:'|\\?\Z)|([`{}])""")


def _after_expression(text: str, at: int) -> int:
    """Where a template's expression ends that begins at this place."""
    depth = 1
    while depth and (m := _EXPRESSION_TOKEN.search(text, at)):
        at = m.end()
        if m[1] == "`":
            at = _after_template(text, at)[0]
        elif m[1]:
            depth += 1 if m[1] == "{" else -1
    return len(text) if depth else at


def _after_template(text: str, at: int) -> tuple[int, list[str]]:
    parts = []
    while True:
        m = _TEMPLATE_PART.match(text, at)
        parts.append(m[1])
        if m[2] != "${":
            return m.end(), parts
        at = _after_expression(text, m.end())


def page_script_strings(text: str, check: Callable[[], None]) -> Iterator[tuple[str, str]]:
    """(value, line where it starts) of the strings of a page's script; an escaped character stands for itself."""
    plain = lambda s: re.sub(r"(?s)\\(.)", r"\1", s)
    at = 0
    while m := _PAGE_TOKEN.search(text, at):
        check()
        at, values = m.end(), [g for g in m.groups()[:2] if g]
        if m[3]:
            at, values = _after_template(text, at)
        lo, hi = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        stmt = text[lo : len(text) if hi < 0 else hi].strip() or "<script>...</script>"
        yield from ((plain(v), stmt) for v in values if v)


class _Markup(HTMLParser):
    """Attribute values, text nodes and, of pages, strings of scripts. Bound values are left out."""

    def __init__(self, check: Callable[[], None], kind: str):
        super().__init__(convert_charrefs=True)
        self.check, self.kind, self.out, self.open, self.inside, self.script = check, kind, [], [], "", []

    def _add(self, value: str | None, src: str, stmt: str) -> None:
        value = (value or "").strip()
        bound = "{{" in value and "}}" in value or "${" in value and "}" in value if self.kind == "html" else "{{" in value or "}}" in value
        if value and not bound:
            self.out.append((value, f"{self.kind}-{src}", stmt))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.check()
        self.open.append(tag)
        for name, value in attrs:
            self._add(value, "attr", f'<{tag} {name}="{(value or "").strip()}">')
        if self.kind == "html" and tag in ("script", "style"):
            self.inside, self.script = tag, []

    def handle_endtag(self, tag: str) -> None:
        if self.inside == tag:
            if tag == "script":
                for value, stmt in page_script_strings("".join(self.script), self.check):
                    self._add(value, "script", stmt)
            self.inside = ""
        if self.kind == "html":
            del self.open[-1:]
        elif tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.script.append(data)
            return
        text = data.strip()
        tag = self.open[-1] if self.open else ""
        self._add(text, "text", f"<{tag}>{text}</{tag}>" if tag or self.kind == "wxml" else f'text: "{text}"')


def from_html(text: str, check: Callable[[], None]) -> Found:
    page = _Markup(check, "html")
    page.feed(text)
    page.close()
    yield from page.out


_BINDING = re.compile(r"(?s)\{\{.*?(?:\}\}|\Z)")
_BARE_AMPERSAND = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|amp|lt|gt|quot|apos);)")
_VIEW_TAG = re.compile(r"""(?s)<!--.*?(?:-->|\Z)|<(\s*[A-Za-z_][\w.\-]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""")
_VIEW_ATTR = re.compile(r"""([^\s=/"']+)(\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?""")
_ROOT = "__wxml_root__"


def _as_xml(text: str) -> str:
    """View markup as XML: bindings and bare ampersands escaped, attributes without a value given an empty one."""
    text = _BINDING.sub(lambda m: m[0].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"), text)
    text = _BARE_AMPERSAND.sub("&amp;", text)
    return _VIEW_TAG.sub(lambda m: m[0] if m[1] is None else f"<{m[1].strip()}{_VIEW_ATTR.sub(lambda a: a[0] if a[2] else a[1] + '=' + chr(34) * 2, m[2])}>", text)


def _read_xml(text: str, check: Callable[[], None]) -> list[tuple[str, str, str]] | None:
    """(value, src, statement) of attributes and of text before an element's first child; None if it is not well formed."""
    out: list[tuple[str, str, str]] = []
    heads: list[list] = []  # of each open element: tag, place in out, text before its first child
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def close(head: list) -> None:
        tag, _, parts = head
        if parts is not None and (value := "".join(parts).strip()):
            out.append((value, "text", f"<{tag}>{value}</{tag}>"))
        head[2] = None

    def start(tag: str, attrs: dict) -> None:
        check()
        if ":" in tag:
            raise expat.ExpatError("a prefix without a name space")
        if heads:
            close(heads[-1])
        for name, value in attrs.items():
            out.append((value.strip(), "attr", f'<{tag} {name}="{value.strip()}">'))
        heads.append([tag, len(out), []])

    def text_of(data: str) -> None:
        if heads and heads[-1][2] is not None:
            heads[-1][2].append(data)

    parser.StartElementHandler, parser.CharacterDataHandler = start, text_of
    parser.EndElementHandler = lambda tag: close(heads.pop())
    try:
        parser.Parse(text, True)
    except expat.ExpatError:
        return None
    return out


def from_view(text: str, check: Callable[[], None]) -> Found:
    """View markup: read as XML if that can be made of it, with a root of its own if it has several; else as a page is."""
    ready = _as_xml(text)
    found = _read_xml(ready, check)
    if found is None:
        found = _read_xml(f"<{_ROOT}>\n{ready}\n</{_ROOT}>", check)
    if found is None:
        page = _Markup(check, "wxml")
        page.feed(text)
        page.close()
        yield from page.out
        return
    yield from ((value, f"wxml-{src}", stmt) for value, src, stmt in found if value and "{{" not in value and "}}" not in value)


def from_style(text: str, check: Callable[[], None]) -> Found:
    """url(...) and quoted strings; a statement is the lines up to one with a semicolon."""
    text = re.sub(r"/\*[\s\S]*?\*/", "", text)
    part: list[str] = []
    for line in [*text.splitlines(), None]:
        check()
        if line is not None:
            part.append(line)
        if part and (line is None or ";" in line):
            stmt = " ".join(p.strip() for p in part).strip()
            for m in re.finditer(r"url\(\s*(?:'([^']*)'|\"([^\"]*)\"|([^)'\"]*))\s*\)|'([^'\n]*)'|\"([^\"\n]*)\"", stmt):
                value = next((g for g in m.groups() if g is not None), "").strip()
                if value:
                    yield value, "wxss", stmt
            part = []


EXTRACTORS: dict[str, Callable[[str, Callable[[], None]], Found]] = {"json": from_json, "html": from_html, "wxml": from_view, "wxs": from_wxs, "wxss": from_style}


def constants_of(text: str, ext: str, deadline_s: float = DEADLINE_S, file: str = "") -> tuple[list[tuple[str, int, str, str]], str]:
    """((value, sid, src, stmt), ...) distinct, in order of (sid, value, src), and the file's status."""
    until = time.monotonic() + deadline_s

    def check() -> None:
        if time.monotonic() > until:
            raise Deadline

    if ext == "html" and len(text.encode("utf-8", "surrogatepass")) > R.MOST_HTML_BYTES:
        return [], "skipped_too_large"
    ids: dict[str, int] = {}
    found: set[tuple[str, int, str, str]] = set()
    try:
        for value, src, stmt in from_script(text, check, file) if ext == "js" else EXTRACTORS[ext](text, check):
            stmt = stmt.strip() or UNKNOWN
            sid = ids.setdefault(stmt, len(ids))
            if len(value) >= LEAST_VALUE:
                found.add((value, sid, src, stmt))
    except Deadline:
        return [], "timeout"
    except Exception as e:  # one broken file must not fail its task
        return [], f"error:extract:{type(e).__name__}"
    rows = sorted(found, key=lambda r: (r[1], r[0], r[2]))
    return rows, "ok" if rows else "empty"


SCHEMA = "pkg string, file string, status string, value string, sid int, src string, stmt string"


def extract(files: DataFrame, deadline_s: float = DEADLINE_S) -> DataFrame:
    """Constants of files (pkg, file, ext, content binary or string): SCHEMA, with one row without a value for each file's status."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for pkg, file, ext, content in zip(f["pkg"], f["file"], f["ext"], f["content"], strict=True):
                if content is None:
                    rows, status = [], "missing"
                else:
                    text = content if isinstance(content, str) else bytes(content).decode("utf-8", "ignore" if ext == "js" else "replace")
                    rows, status = constants_of(text, ext, deadline_s, file or "")
                out.append((pkg, file, status, None, None, None, None))
                out += [(pkg, file, status, v, sid, src, stmt) for v, sid, src, stmt in rows]
            frame = pd.DataFrame(out, columns=["pkg", "file", "status", "value", "sid", "src", "stmt"])
            yield frame.astype({"sid": "Int32"})

    return files.select("pkg", "file", "ext", "content").mapInPandas(run, SCHEMA)


def content_key() -> Column:
    """The same text for files (file, ext, content) that have the same constants: by extension, by the name of a style script, and by the bytes."""
    name = F.lower(F.regexp_extract("file", r"([^\\/]*)\z", 1))
    style = name.endswith(R.STYLE_SCRIPT_ENDS[0])
    for end in R.STYLE_SCRIPT_ENDS[1:]:
        style = style | name.endswith(end)
    style = F.coalesce(style | (name == R.STYLE_SCRIPT), F.lit(False))
    return F.concat_ws(":", F.coalesce("ext", F.lit("?")), style.cast("string"), F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit("none")))


def one_of_each(files: DataFrame) -> DataFrame:
    """One file of each key (pkg, file, ext, content, key), with the key for its package. Partial aggregates: a content that is everywhere is one row a task."""
    return files.groupBy(F.col("key").alias("pkg")).agg(F.first("file").alias("file"), F.first("ext").alias("ext"), F.first("content").alias("content"))
