"""Symbols and imports of source texts.

Python is parsed with its own syntax trees; the other nine languages by declarations in a text whose comments and strings are blanked, with
blocks matched by braces (Ruby: by 'end'). One worker parses whole files; rows in, rows out.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrygraph.sources.documents import code_of

LANGUAGES = ("python", "typescript", "javascript", "go", "rust", "java", "cpp", "c", "ruby", "kotlin")


@dataclass
class Symbol:
    name: str
    kind: str
    signature: str
    start_line: int
    end_line: int
    docstring: str | None = None
    decorators: list[str] = field(default_factory=list)
    visibility: str = "public"
    is_async: bool = False
    parent_name: str | None = None


@dataclass
class Import:
    raw_statement: str
    module_path: str
    imported_names: list[str] = field(default_factory=list)
    is_relative: bool = False


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    docstring: str | None = None
    errors: list[str] = field(default_factory=list)


def unique(items: list, key) -> list:
    seen, out = set(), []
    for x in items:
        if (k := key(x)) not in seen:
            seen.add(k)
            out.append(x)
    return out


# ---- Python


def python_visibility(name: str) -> str:
    return "private" if name.startswith("_") and not (name.startswith("__") and name.endswith("__")) else "public"


def _module_import(node: ast.ImportFrom) -> str:
    return "." * node.level + (node.module or "")


def parse_python(text: str) -> Parsed:
    out = Parsed()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        out.errors.append(f"Parse error at line {getattr(e, 'lineno', None) or 1}")
        return _python_lines(text, out)
    lines = text.splitlines()
    out.docstring = ast.get_docstring(tree)
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    nodes: list[tuple[ast.AST, str | None]] = []
    while stack:
        node, parent = stack.pop()
        for child in ast.iter_child_nodes(node):
            nodes.append((child, parent))
            stack.append((child, child.name if isinstance(child, ast.ClassDef) else parent))
    nodes.sort(key=lambda x: (getattr(x[0], "lineno", 0), getattr(x[0], "col_offset", 0)))
    for node, parent in nodes:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            is_async = isinstance(node, ast.AsyncFunctionDef)
            returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
            out.symbols.append(Symbol(
                node.name, "method" if parent else "function", f"{'async ' if is_async else ''}def {node.name}({ast.unparse(node.args)}){returns}", node.lineno, node.end_lineno or node.lineno,
                ast.get_docstring(node), ["@" + ast.unparse(d) for d in node.decorator_list], python_visibility(node.name), is_async, parent,
            ))
        elif isinstance(node, ast.ClassDef):
            out.symbols.append(Symbol(node.name, "class", f"class {node.name}", node.lineno, node.end_lineno or node.lineno, ast.get_docstring(node), ["@" + ast.unparse(d) for d in node.decorator_list], python_visibility(node.name), False, parent))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            raw = ast.get_source_segment(text, node) or lines[node.lineno - 1].strip()
            if isinstance(node, ast.Import):
                # the last part of each plain name; of a renamed one, the whole name
                names = [a.name if a.asname else a.name.split(".")[-1] for a in node.names]
                out.imports += [Import(raw, a.name, names, False) for a in node.names[:1]]
            else:
                module = _module_import(node)
                # the module's own last part is listed with the names, unless the import is relative
                lead = [node.module.split(".")[-1]] if node.module and not node.level else []
                names = ["*"] if node.names[0].name == "*" else lead + [a.name for a in node.names]
                out.imports.append(Import(raw, module, names, node.level > 0))
    out.symbols = unique(out.symbols, lambda s: (s.start_line, s.name))
    out.imports = unique(out.imports, lambda i: i.raw_statement)
    return out


def _python_lines(text: str, out: Parsed) -> Parsed:
    """Declarations of a text that doesn't compile, by indentation."""
    lines = text.splitlines()
    open_classes: list[tuple[int, str]] = []
    for k, line in enumerate(lines):
        if m := re.match(r"(\s*)(async\s+)?(def|class)\s+(\w+)\s*(\([^)]*\))?", line):
            indent = len(m[1].expandtabs())
            while open_classes and open_classes[-1][0] >= indent:
                open_classes.pop()
            parent = open_classes[-1][1] if open_classes else None
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= indent), len(lines))
            while end > k + 1 and not lines[end - 1].strip():
                end -= 1
            kind = "class" if m[3] == "class" else "method" if parent else "function"
            signature = f"class {m[4]}" if kind == "class" else f"{'async ' if m[2] else ''}def {m[4]}{m[5] or '()'}"
            out.symbols.append(Symbol(m[4], kind, signature, k + 1, end, None, [], python_visibility(m[4]), bool(m[2]), parent))
            if kind == "class":
                open_classes.append((indent, m[4]))
        elif m := re.match(r"\s*from\s+([.\w]+)\s+import\s+(.+)", line):
            names = [x.strip().split(" ")[0] for x in m[2].strip("()\\ ").split(",") if x.strip()]
            lead = [m[1].split(".")[-1]] if not m[1].startswith(".") else []
            out.imports.append(Import(line.strip(), m[1], ["*"] if names == ["*"] else lead + names, m[1].startswith(".")))
        elif m := re.match(r"\s*import\s+([.\w]+)", line):
            out.imports.append(Import(line.strip(), m[1], [m[1].split(".")[-1]], False))
    return out


# ---- languages with braces

_BLANK = {
    "c-like": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?", re.DOTALL),
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\\n]|\\.)'", re.DOTALL),
    "ruby": re.compile(r"#[^\n]*|\"(?:[^\"\\]|\\.)*\"?|'(?:[^'\\]|\\.)*'?", re.DOTALL),
}


def blanked(text: str, style: str) -> str:
    """The text with comments and the insides of strings as spaces, at the same places."""

    def blank(m: re.Match) -> str:
        s = m[0]
        keep = s[0] in "\"'`" and len(s) > 1
        inner = re.sub(r"[^\n]", " ", s[1:-1] if keep else s)
        return s[0] + inner + s[-1] if keep else inner

    return _BLANK[style].sub(blank, text)


class Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def of(self, at: int) -> int:
        return bisect_right(self.starts, at)


def close_of(text: str, at: int, stop: str = ";") -> int:
    """Place of the brace that closes the block that opens at or after at; of stop, if that comes first outside brackets."""
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth <= 0 and c == "}":
                return i
        elif c == stop and depth == 0:
            return i
    return len(text) - 1


def arguments(text: str, original: str, at: int) -> str:
    """The bracketed list that opens at or after at."""
    start = text.find("(", at)
    if start < 0:
        return ""
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return original[start : i + 1]
    return ""


def comment_before(original: str, at: int, marks: tuple[str, ...], block: bool) -> str | None:
    """The documentation comment that ends on the line above."""
    above = original[:at].rstrip()
    # attributes and modifiers that stand on the declaration's own line are no lines of their own
    if block:
        if above.endswith("*/") and (start := above.rfind("/*")) >= 0 and above.startswith(marks, start):
            return clean_comment(above[start:])
        return None
    found = []
    for line in reversed(above.splitlines()):
        if not line.strip().startswith(marks):
            break
        found.insert(0, line.strip().lstrip("/ ").strip())
    return "\n".join(found) or None


def clean_comment(text: str) -> str:
    lines = [x.strip().lstrip("/*").lstrip() for x in text.splitlines()]
    return re.sub(r"\s*\*/$", "", "\n".join(x for x in lines if x)).strip()


# Per language: style, declarations (kind, pattern with the groups mods and name), kinds that are parents, documentation comments.
_ID = r"(?P<name>[A-Za-z_$][\w$]*)"
_SCRIPT = [
    ("function", rf"(?P<mods>(?:export\s+|default\s+|declare\s+|async\s+)*)function\s*\*?\s*{_ID}\s*(?=[(<])"),
    ("class", rf"(?P<mods>(?:export\s+|default\s+|declare\s+|abstract\s+)*)class\s+{_ID}"),
    ("arrow", rf"(?P<mods>(?:export\s+)?)(?:const|let)\s+{_ID}\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?\([^;{{}}]*?\)\s*(?::[^=;]+?)?=>"),
    ("method", rf"^[ \t]+(?P<mods>(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*)\*?{_ID}\s*(?:<[^>]*>)?\([^;{{}}]*?\)\s*(?::[^={{;]+)?(?=\{{)"),
]
_DECLARATIONS = {
    "javascript": _SCRIPT,
    "typescript": [*_SCRIPT, ("interface", rf"(?P<mods>(?:export\s+|default\s+|declare\s+)*)interface\s+{_ID}"), ("type_alias", rf"(?P<mods>(?:export\s+|declare\s+)*)type\s+{_ID}\s*(?:<[^=]*>)?\s*="), ("enum", rf"(?P<mods>(?:export\s+|declare\s+|const\s+)*)enum\s+{_ID}")],
    "go": [("function", rf"^(?P<mods>)func\s+{_ID}\s*(?=[(\[])"), ("receiver", rf"^func\s*(?P<mods>\([^)]*\))\s*{_ID}\s*(?=\()"), ("go_type", rf"^(?P<mods>)(?:type\s+|\t){_ID}\s+(?=struct\b|interface\b)|^(?P<mods2>)type\s+(?P<name2>[A-Za-z_]\w*)\s+(?!struct\b|interface\b)(?=\S)")],
    "rust": [
        ("function", rf"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*)fn\s+{_ID}"), ("struct", rf"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)struct\s+{_ID}"), ("enum", rf"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)enum\s+{_ID}"),
        ("trait", rf"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?)trait\s+{_ID}"), ("impl", r"^[ \t]*(?P<mods>)impl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+?\s+for\s+)?(?P<name>[A-Za-z_]\w*)"),
        ("constant", rf"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)const\s+{_ID}\s*:"), ("type_alias", rf"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)type\s+{_ID}\s*(?:<[^=]*>)?\s*="), ("module", rf"(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)mod\s+{_ID}"),
    ],
    "java": [
        *((k, rf"(?P<mods>(?:(?:public|private|protected|static|final|abstract|sealed|@\w+(?:\([^)]*\))?)\s+)*){k}\s+{_ID}") for k in ("class", "interface", "enum")),
        ("method", rf"^[ \t]*(?P<mods>(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|@\w+(?:\([^)]*\))?)\s+)*)(?:<[^>]+>\s*)?(?!return\b|new\b|else\b|throw\b)[\w.$]+(?:<[^;{{}}()]*>)?(?:\[\])*\s+{_ID}\s*(?=\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?\s*[{{;])"),
        ("constructor", rf"^[ \t]+(?P<mods>(?:(?:public|private|protected)\s+)*)(?P<name>[A-Z]\w*)\s*(?=\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?\s*\{{)"),
    ],
    "kotlin": [("function", rf"(?P<mods>(?:(?:public|private|protected|internal|override|open|suspend|inline|abstract|operator|infix)\s+)*)fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?{_ID}\s*(?=\()"),
               ("interface", rf"(?P<mods>(?:(?:public|private|protected|internal|sealed|fun)\s+)*)interface\s+{_ID}"), ("class", rf"(?P<mods>(?:(?:public|private|protected|internal|data|open|abstract|sealed|enum|annotation|inner|value)\s+)*)(?:class|object)\s+{_ID}")],
}
_C = [("function", rf"^(?P<mods>[ \t]*(?:[A-Za-z_][\w:<>,*&\s]*?[\s*&]))(?:[A-Za-z_]\w*::)*{_ID}\s*(?=\([^;{{}}]*\)\s*(?:const|noexcept|override|final|\s)*\{{)"), ("struct", rf"(?P<mods>)struct\s+{_ID}(?=\s*(?::[^{{;]*)?\{{)"), ("enum", rf"(?P<mods>)enum\s+(?:class\s+|struct\s+)?{_ID}(?=\s*(?::[^{{;]*)?\{{)")]
_DECLARATIONS["c"] = _C
_DECLARATIONS["cpp"] = [*_C, ("class", rf"(?P<mods>)class\s+{_ID}(?=\s*(?:final\s*)?(?::[^{{;]*)?\{{)"), ("module", rf"(?P<mods>)namespace\s+{_ID}(?=\s*\{{)")]
_COMPILED = {k: [(kind, re.compile(p, re.MULTILINE)) for kind, p in v] for k, v in _DECLARATIONS.items()}
_PARENTS = {"typescript": {"class"}, "javascript": {"class"}, "rust": {"impl"}, "java": {"class", "interface", "enum"}, "kotlin": {"class"}, "cpp": {"class", "struct"}}
_KEYWORDS = frozenset("if for while switch catch return function else do try with new typeof throw case sizeof foreach when match loop synchronized super this constructor_".split())
_IMPORTS = {
    "go": re.compile(r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\n]+)\"\s*$", re.MULTILINE), "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([^;]+);", re.MULTILINE), "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", re.MULTILINE),
    "kotlin": re.compile(r"^\s*import\s+([\w.]+)", re.MULTILINE), "c": re.compile(r"^\s*#\s*include\s*([<\"][^>\"\n]+[>\"])", re.MULTILINE), "ruby": re.compile(r"^\s*require(?:_relative)?[\s(]+[\"']([^\"'\n]+)[\"']", re.MULTILINE),
}
_IMPORTS["cpp"] = _IMPORTS["c"]
_SCRIPT_IMPORTS = (
    re.compile(r"^[ \t]*import\b(?P<clause>[^;'\"(]*?)(?:from\s*)?(?P<module>['\"][^'\"\n]+['\"])[ \t]*;?", re.MULTILINE),
    re.compile(r"^[ \t]*export\b(?P<clause>)[^;'\"=(]*?\bfrom\s*(?P<module>['\"][^'\"\n]+['\"])[ \t]*;?", re.MULTILINE),
    re.compile(r"\brequire\((?P<clause>)\s*(?P<module>['\"`][^'\"`\n]+['\"`])\s*\)"),
    re.compile(r"\bimport\((?P<clause>)\s*(?P<module>['\"`][^'\"`\n]+['\"`])\s*\)"),
)


def _visibility(language: str, name: str, mods: str) -> str:
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "public" if "pub" in mods else "private"
    if language in ("typescript", "java", "kotlin"):
        return "private" if "private" in mods else "protected" if "protected" in mods else "public"
    return "public"


_SIGNATURE = {"class": "class {n}", "interface": "interface {n}", "type_alias": "type {n}", "enum": "enum {n}", "struct": "struct {n}", "trait": "trait {n}", "impl": "impl {n}"}


def _signature(language: str, kind: str, name: str, params: str, returns: str = "") -> str:
    if kind in _SIGNATURE:
        return _SIGNATURE[kind].format(n=name)
    if kind == "method" and language in ("go", "java"):
        return f"func ({name}) method{params}"
    if kind == "function" and language in ("typescript", "javascript", "go", "rust", "kotlin"):
        return f"function {name}{params}"
    if kind == "function" and language in ("c", "cpp"):
        return f"def {name}{params}"
    return f"{name}{params}"


def parse_braces(text: str, language: str) -> Parsed:
    plain = blanked(text, "rust" if language == "rust" else "c-like")
    lines, out = Lines(text), Parsed()
    found: list[tuple[int, int, str, str, str]] = []  # start, end, kind, name, modifiers
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(plain):
            groups = m.groupdict()
            name = groups.get("name") or groups.get("name2") or ""
            if not name or name in _KEYWORDS:
                continue
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            # an arrow function's body may be an expression: it ends at the statement's end
            end = close_of(plain, m.end(), ";") if kind != "go_type" or plain.startswith(("struct", "interface"), m.end()) else plain.find("\n", m.end()) % (len(plain) + 1)
            found.append((at, end, kind, name, groups.get("mods") or ""))
    found.sort()
    for at, end, kind, name, mods in found:
        parent = None
        if kind == "receiver":
            parts = [p.lstrip("*") for p in mods.strip("() ").split()]
            parent = next((p for p in reversed(parts) if p[:1].isupper()), None)
        else:
            around = [f for f in found if f[2] in _PARENTS.get(language, ()) and f[0] < at and f[1] >= end and f is not (at, end, kind, name, mods)]
            parent = around[-1][3] if around else None
        if kind == "method" and language in ("typescript", "javascript") and not parent:
            continue  # a call followed by a block, or a method of an object literal
        if kind == "constructor" and name != parent:
            continue
        real = {"arrow": "function", "receiver": "method", "constructor": "function"}.get(kind, kind)
        if kind == "go_type":
            rest = plain[at:end]
            real = "struct" if re.search(r"\bstruct\b", rest.split("\n", 1)[0]) else "interface" if re.search(r"\binterface\b", rest.split("\n", 1)[0]) else "type_alias"
        params = arguments(plain, text, at + plain[at:].find(name) + len(name)) if real in ("function", "method") else ""
        if kind == "receiver":
            params = arguments(plain, text, plain.find(name, at + len(mods)) + len(name))
        signature = _signature(language, real, name, params)
        if parent and real == "function":
            real = "method"
        if language in ("typescript", "javascript", "java"):
            doc = comment_before(text, at, ("/**",), True)
        elif language == "go":
            doc = comment_before(text, at, ("//",), False)
        elif language == "rust":
            doc = comment_before(text, at, ("///",), False)
        else:
            doc = None
        decorators = re.findall(r"@\w+(?:\([^)]*\))?", mods)
        out.symbols.append(Symbol(name, real, signature, lines.of(at), lines.of(end), doc, decorators, _visibility(language, name, mods), bool(re.search(r"\basync\b", plain[at : at + len(mods) + 40].split("{", 1)[0])), parent))
    out.symbols = unique(out.symbols, lambda s: (s.start_line, s.name))
    out.imports = unique(_imports(text, plain, language), lambda i: i.raw_statement)
    out.docstring = _module_comment(text, language)
    if plain.count("{") != plain.count("}"):
        out.errors.append(f"Parse error at line {lines.of(len(text) - 1)}")
    return out


def _imports(text: str, plain: str, language: str) -> list[Import]:
    if language not in ("typescript", "javascript"):
        found = []
        go_block = [(m.start(), close) for m in re.finditer(r"^import\s*\(", text, re.MULTILINE) if (close := text.find(")", m.end())) >= 0] if language == "go" else []
        for m in _IMPORTS[language].finditer(text):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if plain[start : start + 1].strip() == "":
                continue  # in a comment
            if language == "go" and not m[0].lstrip().startswith("import") and not any(a < m.start() < b for a, b in go_block):
                continue
            module = m[1].strip().strip("\"'`<> ") if language not in ("c", "cpp") else m[1].strip().strip("\"'` ")
            raw = m[0].strip() if language != "go" else re.sub(r"^import\s+", "", m[0].strip())
            found.append(Import(raw, module, [], module.startswith(".")))
        return found
    found = []
    for pattern in _SCRIPT_IMPORTS:
        for m in pattern.finditer(text):
            if not plain[m.start("module")].strip():
                continue  # in a comment
            clause = m["clause"]
            if "*" in clause:
                names = ["*"]
            else:
                clause = re.sub(r"^\s*type\b", "", clause)
                named = re.search(r"\{([^}]*)\}", clause)
                names = [x for x in re.findall(r"[\w$]+", re.sub(r"\{[^}]*\}", "", clause)) if x != "from"]
                names += [re.sub(r"^type\s+", "", x.strip()).split(" ")[0] for x in named[1].split(",") if x.strip()] if named else []
            module = m["module"].strip("\"'` ")
            if module:
                found.append((m.start(), Import(m[0].strip(), module, names, module.startswith("."))))
    return [x for _, x in sorted(found, key=lambda x: x[0])]


def _module_comment(text: str, language: str) -> str | None:
    start = text.lstrip()
    if language in ("typescript", "javascript"):
        m = re.match(r"(?:(?://[^\n]*|/\*(?!\*).*?\*/)\s*)*(/\*\*.*?\*/)", start, re.DOTALL)
        return clean_comment(m[1]) if m else None
    if language == "go":
        lines = []
        for line in start.splitlines():
            if line.startswith("package "):
                break
            if line.strip().startswith("//"):
                lines.append(line.strip().lstrip("/ ").strip())
        return "\n".join(lines) or None
    if language == "rust":
        m = re.match(r"(//!|/\*!)([^\n]*)", start)
        return m[2].strip() if m else None
    return None


def parse_ruby(text: str) -> Parsed:
    """Ruby: blocks by 'end'."""
    plain, out = blanked(text, "ruby"), Parsed()
    open_blocks: list[tuple[str, int]] = []
    opener = re.compile(r"^\s*(def|class|module|if|unless|case|while|until|for|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|case|begin)\b")
    original = text.splitlines()
    for k, line in enumerate(plain.splitlines()):
        if re.match(r"\s*end\b", line):
            if open_blocks:
                _, s = open_blocks.pop()
                if s >= 0:
                    out.symbols[s].end_line = k + 1
            continue
        if m := opener.search(line):
            symbol = -1
            if d := re.match(r"\s*(def|class|module)\s+(?:self\.)?([\w?!=]+)\s*(\([^)]*\))?", line):
                parent = next((out.symbols[s].name for kind, s in reversed(open_blocks) if kind in ("class", "module")), None)
                kind = {"def": "method" if parent else "function", "class": "class", "module": "module"}[d[1]]
                symbol = len(out.symbols)
                out.symbols.append(Symbol(d[2], kind, f"{d[2]}{d[3] or ''}", k + 1, k + 1, None, [], "public", False, parent))
                if d[1] == "def" and re.search(r"\)\s*=\s|;\s*end\s*$", line):
                    continue
            if not re.search(r"\bend\s*$", line):
                open_blocks.append((m[1] or "block", symbol))
    out.imports = unique([Import(m[0].strip(), m[1], [], m[1].startswith(".")) for m in _IMPORTS["ruby"].finditer(text)], lambda i: i.raw_statement)
    out.symbols = unique(out.symbols, lambda s: (s.start_line, s.name))
    if open_blocks:
        out.errors.append(f"Parse error at line {len(original)}")
    return out


def parse_source(language: str | None, text: str | None) -> Parsed:
    """Symbols, imports, documentation and errors of a text; nothing for languages that aren't parsed."""
    if not text or language not in LANGUAGES:
        return Parsed()
    if language == "python":
        return parse_python(text)
    if language == "ruby":
        return parse_ruby(text)
    return parse_braces(text, language)


# ---- operator

_SYMBOL = pa.struct([
    ("name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("docstring", pa.string()), ("decorators", pa.list_(pa.string())), ("visibility", pa.string()), ("is_async", pa.bool_()), ("parent_name", pa.string()),
])
_IMPORT = pa.struct([("raw_statement", pa.string()), ("module_path", pa.string()), ("imported_names", pa.list_(pa.string())), ("is_relative", pa.bool_())])
PARSED = (
    "symbols array<struct<name:string,kind:string,signature:string,start_line:int,end_line:int,docstring:string,decorators:array<string>,visibility:string,is_async:boolean,parent_name:string>>, "
    "imports array<struct<raw_statement:string,module_path:string,imported_names:array<string>,is_relative:boolean>>, docstring string, errors array<string>"
)


def parse(files: DataFrame) -> DataFrame:
    """files (path, language, content_hash, text) -> path, language, content_hash, symbols, imports, docstring, errors, exports. The only step of an index build that runs Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_source(language, code) for language, code in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.record_batch(
                [*b.columns[:3], *b.columns[5:], pa.array([[asdict(s) for s in p.symbols] for p in found], pa.list_(_SYMBOL)), pa.array([[asdict(i) for i in p.imports] for p in found], pa.list_(_IMPORT)),
                 pa.array([p.docstring for p in found], pa.string()), pa.array([p.errors for p in found], pa.list_(pa.string()))],
                names,
            )

    names = ["path", "language", "content_hash", "line_offset", "note", "symbols", "imports", "docstring", "errors"]
    code = code_of(files.select("path", "language", "content_hash", "text")).select("path", "language", "content_hash", "code_language", "code", "line_offset", "note")
    schema = T._parse_datatype_string(f"path string, language string, content_hash string, line_offset int, note string, {PARSED}")
    raw = code.mapInArrow(run, schema)
    shifted = F.transform("symbols", lambda s: s.withField("start_line", s["start_line"] + F.col("line_offset")).withField("end_line", s["end_line"] + F.col("line_offset")))
    out = raw.select("path", "language", "content_hash", shifted.alias("symbols"), "imports", "docstring", F.concat("errors", F.when(F.col("note").isNotNull(), F.array("note")).otherwise(F.array().cast("array<string>"))).alias("errors"))
    exported = F.transform(F.filter("symbols", lambda s: (s["visibility"] == "public") & s["parent_name"].isNull()), lambda s: s["name"])
    return out.withColumn("exports", exported)


def qualified_name(path: Column, parent: Column, name: Column) -> Column:
    module = F.regexp_replace(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), "/", ".")
    return F.concat_ws(".", module, parent, name)


def symbols(parsed: DataFrame) -> DataFrame:
    """The relation symbols."""
    s = parsed.select("path", "language", F.explode("symbols").alias("s")).select("path", "language", "s.*")
    return s.select(
        "path", F.concat_ws("::", "path", "parent_name", "name").alias("id"), "name", qualified_name(F.col("path"), F.col("parent_name"), F.col("name")).alias("qualified_name"), "kind", "signature", "start_line",
        "end_line", "docstring", "decorators", "visibility", "is_async", "language", "parent_name",
    )


def imports(parsed: DataFrame) -> DataFrame:
    """The relation imports. A component's imports are resolved by its script's rules, so its language is given as that of a script."""
    language = F.when(F.col("language") == "vue", "typescript").otherwise(F.col("language"))
    return parsed.select("path", language.alias("language"), F.explode("imports").alias("i")).select("path", "language", "i.*")


