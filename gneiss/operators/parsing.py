"""Symbols, imports and complexity out of source text.

Python is parsed exactly by ``ast``.  For Rust, TypeScript and JavaScript, Go and Java strings and comments are masked,
brackets matched, and declarations of each level recognised by shape once what their braces hold is blanked; macros
and unusual layouts can be missed.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import predicates as P

MAX_BYTES = 500_000
HEADER_BYTES = 512

_MASKED = {
    "rust": r'//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.[^\']*|[^\'\\\n])\'',
    "go": r'//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "java": r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "javascript": r'//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "python": r'#[^\n]*|"""(?:\\.|.)*?(?:"""|\Z)|\'\'\'(?:\\.|.)*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
}
_MASKED["typescript"] = _MASKED["javascript"]
_MASK = {k: re.compile(v, re.S) for k, v in _MASKED.items()}
_BRANCH = {
    "rust": r"\b(?:if|else|while|for|loop)\b|=>|\?(?=[;.,)\s])|&&|\|\|",
    "typescript": r"\b(?:if|else|case|while|for|do|catch)\b|\?(?![.?:])|&&|\|\|",
    "go": r"\b(?:if|case|for)\b|&&|\|\|",
    "java": r"\b(?:if|case|while|for|do|catch)\b|\?|&&|\|\|",
}
_BRANCH["javascript"] = _BRANCH["typescript"]
_BRANCH = {k: re.compile(v) for k, v in _BRANCH.items()}


def mask(source: str, language: str, strings: bool = True) -> str:
    """Comments, and strings unless told otherwise, as blanks; places and lines stay."""
    blank = re.compile(r"[^\n]")

    def cover(m: re.Match[str]) -> str:
        text = m[0]
        comment = text.startswith(("//", "/*")) or (language == "python" and text.startswith("#"))
        return blank.sub(" ", text) if comment or strings else text

    return _MASK[language].sub(cover, source)


def brackets(masked: str) -> dict[int, int]:
    """Place of the partner of each opening bracket."""
    partner: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in re.finditer(r"[][(){}]", masked):
        c = m[0]
        if c in "([{":
            stack.append((c, m.start()))
        elif stack and stack[-1][0] == {")": "(", "]": "[", "}": "{"}[c]:
            partner[stack.pop()[1]] = m.start()
    return partner


class Lines:
    def __init__(self, source: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def __call__(self, at: int) -> int:
        return bisect_right(self.starts, at)


Symbol = tuple[str, str, str, int, int]  # role, name, kind, line, complexity
Import = tuple[str, list[str]]


def python_complexity(node: ast.AST) -> int:
    n = 1
    for x in ast.walk(node):
        if isinstance(x, (ast.If, ast.While, ast.For, ast.AsyncFor)):
            n += 1
            # an else of its own counts, an elif is an If inside
            n += bool(x.orelse) and not (isinstance(x, ast.If) and len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If))
        elif isinstance(x, (ast.ExceptHandler, ast.IfExp)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
    return n


def _python(source: str) -> tuple[list[Symbol], list[Import]]:
    symbols: list[Symbol] = []
    imports: list[Import] = []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], []

    def put(name: str, kind: str, line: int, complexity: int) -> None:
        symbols.append(("definition", name, kind, line, complexity))
        if not name.startswith("_"):
            symbols.append(("export", name, kind, line, complexity))

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            put(node.name, "function", node.lineno, python_complexity(node))
        elif isinstance(node, ast.ClassDef):
            put(node.name, "class", node.lineno, 1)
            for x in node.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and not x.name.startswith("_"):
                    symbols.append(("definition", x.name, "function", x.lineno, python_complexity(x)))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [(a.name, [a.asname or a.name]) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append(("." * node.level + (node.module or ""), [a.name for a in node.names]))
    return symbols, imports


_KINDS = {"fn": "function", "function": "function", "struct": "struct", "enum": "enum", "trait": "trait", "const": "constant", "static": "constant", "type": "type-alias", "mod": "module", "class": "class", "interface": "interface", "record": "class"}
_RUST_ITEM = re.compile(r"(?P<out>\bpub(?:\s*\([^)]*\))?\s+)?(?:\b(?:async|unsafe|default|const(?=\s+(?:async|unsafe|extern|fn)\b)|extern)\b\s+)*\b(?:(?P<word>fn|struct|enum|trait|const|static|type|mod)\s+(?:mut\s+)?(?P<name>[A-Za-z_]\w*)|impl\b)")
_RUST_FIELD = re.compile(r"\s*(?:pub(?:\s*\([^)]*\))?\s+)?([A-Za-z_]\w*)\s*:")
_TS_ITEM = re.compile(r"(?P<out>\bexport\s+(?:default\s+)?)?(?:\b(?:declare|abstract|async)\s+)*\b(?P<word>function|class|interface|type|enum|const|let|var)\b\s*(?:\*\s*)?(?:enum\s+)?(?P<name>[A-Za-z_$][\w$]*)?")
_TS_VALUE = re.compile(r"\s*(?P<name>[A-Za-z_$][\w$]*)\s*!?\s*(?::[^=]*(?:=>[^=]*)*)?(?P<set>=(?!=))?\s*")
_TS_MEMBER = re.compile(r"(?:(?:public|private|protected|static|async|readonly|override|abstract|declare|get|set|accessor)\s+(?![=(:;?!]))*(?:\*\s*)?(?P<name>#?[A-Za-z_$][\w$]*)\s*[?!]?\s*(?:<[^<>]*(?:<[^<>]*>[^<>]*)*>\s*)?(?P<after>\(|[:=;,]|(?=[\n}])|$)")
_GO_ITEM = re.compile(r"^(?:func\s+(?P<of>\([^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)|type\s+(?P<type>[A-Za-z_]\w*)|type\s*(?P<group>\())", re.M)
_JAVA_ITEM = re.compile(r"(?P<out>\bpublic\s+)?(?:(?:abstract|final|static|sealed|private|protected|strictfp)\s+)*\b(?P<word>class|interface|enum|record)\s+(?P<name>[A-Za-z_]\w*)")
_JAVA_METHOD = re.compile(r"(?P<mods>(?:\b(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*)(?:<[^>]*>\s*)?(?<![\w.])(?!(?:return|new|else|throw|public|private|protected|static|final|abstract|synchronized|default|native)\b)[A-Za-z_][\w.<>\[\], ?]*\s+(?P<name>[A-Za-z_]\w*)\s*\(")
_JAVA_FIELD = re.compile(r"(?:^|[;}])\s*(?:@\w+(?:\([^()]*\))?\s+)*(?:(?:public|private|protected|static|final|transient|volatile)\s+)*(?!(?:return|throw|package|import|class|interface|enum|record)\b)[A-Za-z_][\w.]*(?:<[^;{}()=]*>)?(?:\[\])*\s+(?P<name>[A-Za-z_]\w*)\s*(?=[=;,\[])")


class _Source:
    """A text with its strings and comments masked, its brackets matched, and the symbols found in it."""

    def __init__(self, source: str, language: str) -> None:
        self.language = language
        masked = mask(source, language)
        partner = brackets(masked)
        if language == "rust":
            # attributes hold words that declare nothing
            for m in reversed(list(re.finditer(r"#!?\[", masked))):
                if (end := partner.get(m.end() - 1)) is not None:
                    masked = masked[: m.start()] + re.sub(r"[^\n]", " ", masked[m.start() : end + 1]) + masked[end + 1 :]
            partner = brackets(masked)
        self.masked, self.partner, self.line = masked, partner, Lines(source)
        self.symbols: list[Symbol] = []

    def shallow(self, lo: int, hi: int, kinds: str = "{") -> str:
        """The text from lo to hi, places kept, with the insides of these brackets blanked."""
        out, at = [], lo
        for m in re.compile(f"[{re.escape(kinds)}]").finditer(self.masked, lo, hi):
            end = self.partner.get(m.start(), -1)
            if m.start() >= at and end > 0:
                out += [self.masked[at : m.end()], re.sub(r"[^\n]", " ", self.masked[m.end() : end])]
                at = end
        return "".join([*out, self.masked[at:hi]])

    def end(self, at: int, hi: int, stops: str = "{;") -> int:
        """Place of the first of these outside round and square brackets."""
        while at < hi and self.masked[at] not in stops:
            at = self.partner.get(at, at) + 1 if self.masked[at] in "([" else at + 1
        return at

    def add(self, name: str, kind: str, at: int, out: bool, body: tuple[int, int] | None = None, complexity: int = 1) -> None:
        if body is not None:
            complexity = 1 + len(_BRANCH[self.language].findall(self.masked[body[0] : body[1]]))
        self.symbols.append(("definition", name, kind, self.line(at), complexity))
        if out:
            self.symbols.append(("export", name, kind, self.line(at), complexity))

    def parts(self, lo: int, hi: int) -> Iterator[tuple[int, str]]:
        """(place, text) of what commas outside brackets part."""
        text, at = self.shallow(lo, hi, "({["), 0
        for m in re.finditer(r"[^,]+", text):
            lead = len(m[0]) - len(m[0].lstrip())
            if m[0].strip():
                yield lo + m.start() + lead, self.masked[lo + m.start() + lead : lo + m.end()]

    # --- Rust

    def rust(self, lo: int, hi: int) -> None:
        """Items of the file, a module or an impl; what functions and traits hold is theirs."""
        text, at = self.shallow(lo, hi), 0
        while m := _RUST_ITEM.search(text, at):
            stop = self.end(lo + m.end(), hi, ";" if m["word"] in ("const", "static", "type") else "{;")
            body = (stop, self.partner[stop]) if stop in self.partner else None
            at = (body[1] if body else stop) - lo + 1
            if m["word"] is None:
                if body:
                    self.rust(body[0] + 1, body[1])
                continue
            start = lo + m.start() + len(m[0]) - len(m[0].lstrip())
            self.add(m["name"], _KINDS[m["word"]], start, bool(m["out"]), (body or (stop, stop)) if m["word"] == "fn" else None)
            if body and m["word"] == "mod":
                self.rust(body[0] + 1, body[1])
            elif body and m["word"] in ("struct", "enum"):
                for place, part in self.parts(body[0] + 1, body[1]):
                    found = (_RUST_FIELD if m["word"] == "struct" else re.compile(r"\s*([A-Za-z_]\w*)")).match(part)
                    if found:
                        self.add(found[1], "field" if m["word"] == "struct" else "enum-variant", place, False, complexity=0)

    # --- TypeScript and JavaScript

    def _statement(self, text: str, at: int) -> int:
        """End of a statement in shallow text: a semicolon, or a line end that nothing goes on from."""
        for m in re.compile(r";|\n").finditer(text, at):
            before, after = text[at : m.start()].rstrip()[-1:], text[m.end() :].lstrip()[:1]
            if m[0] == ";" or (before not in tuple(",=+-*/&|?:(<") and after not in tuple(".?:&|+*/,=)]")):
                return m.start()
        return len(text)

    def _is_function(self, at: int, hi: int) -> bool:
        value = re.compile(r"\s*(?:async\b\s*)?(?:<[^<>]*>\s*)?").match(self.masked, at).end()
        if re.compile(r"function\b|[A-Za-z_$][\w$]*\s*=>").match(self.masked, value):
            return True
        return self.masked[value : value + 1] == "(" and value in self.partner and re.compile(r"\s*(?::[^;={}]*)?=>").match(self.masked, self.partner[value] + 1, hi) is not None

    def typescript(self) -> None:
        hi = len(self.masked)
        text, at = self.shallow(0, hi, "({["), 0
        while m := _TS_ITEM.search(text, at):
            at = m.end()
            word, name, out = m["word"], m["name"], bool(m["out"])
            before = text[: m.start()].rstrip()
            if before.endswith(tuple("=(,:?&|+-*/<>![.")) or re.search(r"\b(?:return|new|typeof|extends|implements|import)$", before) or name is None:
                continue
            start = m.start()
            if word == "const" and re.search(r"\benum\s+[\w$]*$", m[0]):
                word = "enum"
            if word in ("const", "let", "var"):
                end, place = self._statement(text, m.start("name")), m.start("name")
                for part in text[place:end].split(","):
                    found = _TS_VALUE.match(part)
                    if found:
                        value = place + found.end()
                        function = bool(found["set"]) and self._is_function(value, place + len(part))
                        if out or function:
                            body = (value, place + len(part)) if function else None
                            self.add(found["name"], "function" if function else "constant", place + found.start("name"), out, body)
                    place += len(part) + 1
                at = max(at, end)
                continue
            if word == "type":
                if re.match(r"\s*(?:<|=)", text[m.end() :]):
                    self.add(name, "type-alias", start, out)
                    at = self._statement(text, m.end())
                continue
            opening = text.find("{", m.end())
            if opening not in self.partner or ";" in text[m.end() : opening]:
                continue
            body = (opening, self.partner[opening])
            self.add(name, _KINDS[word], start, out, body if word == "function" else None)
            at = body[1] + 1
            if word == "class":
                self._class(*body)
            elif word == "interface":
                self._members(*body, "interface")
            elif word == "enum":
                for place, part in self.parts(body[0] + 1, body[1]):
                    if found := re.match(r"[A-Za-z_$][\w$]*", part):
                        self.add(found[0], "enum-variant", place, False, complexity=0)
        for m in re.finditer(r"\bexport\s+(?:type\s+)?(?=\{)", text):
            if m.end() in self.partner:
                for place, part in self.parts(m.end() + 1, self.partner[m.end()]):
                    if found := re.match(r"(?:type\s+)?([A-Za-z_$][\w$]*)", part):
                        self.symbols.append(("export", found[1], "function", self.line(place), 1))
        for m in re.finditer(r"\bmodule\.exports[\w$.]*\s*=\s*", text):
            if text[m.end() : m.end() + 1] == "{" and m.end() in self.partner:
                for place, part in self.parts(m.end() + 1, self.partner[m.end()]):
                    if found := re.fullmatch(r"([A-Za-z_$][\w$]*)\s*(?::.*)?", part.strip(), re.S):
                        self.symbols.append(("export", found[1], "function", self.line(place), 1))
            elif found := re.match(r"[A-Za-z_$][\w$]*(?=\s*(?:[;\n]|$))", text[m.end() :]):
                self.symbols.append(("export", found[0], "function", self.line(m.end()), 1))

    def _class(self, lo: int, hi: int) -> None:
        self._members(lo, hi, "class")

    def _members(self, lo: int, hi: int, kind: str) -> None:
        text, at = self.shallow(lo + 1, hi, "({["), 0
        while at < len(text):
            lead = re.compile(r"(?:[\s;,}]|@[\w$.]+(?:\(\s*\))?)*").match(text, at).end()
            m = _TS_MEMBER.match(text, lead)
            if m is None:
                at = self._statement(text, lead) + 1
                continue
            place = lo + 1 + m.start()
            if m["after"] == "(":
                close = self.partner.get(lo + 1 + m.end() - 1, lo + 1 + m.end())
                # a return type can have braces of its own, which a body follows
                rest = re.compile(r"\s*(?::\s*(?:\{\s*\}[\[\]\s]*)?[^;{}\n]*)?[ \t]*").match(text, close - lo).end()
                opening = lo + 1 + rest
                body = (opening, self.partner[opening]) if text[rest : rest + 1] == "{" and opening in self.partner else None
                if kind == "interface":
                    self.add(m["name"], "function", place, False, complexity=0)
                elif body and m["name"] != "constructor" and m["name"][0] != "#":
                    self.add(m["name"], "function", place, False, body)
                at = body[1] - lo if body else self._statement(text, rest) + 1
                continue
            if m["name"][0] != "#":
                self.add(m["name"], "property", place, False, complexity=0)
            at = self._statement(text, m.end("name")) + 1
            if kind == "interface" and "," in text[m.end("name") : at]:
                at = text.index(",", m.end("name")) + 1

    # --- Go and Java

    def go(self) -> None:
        hi = len(self.masked)
        for m in _GO_ITEM.finditer(self.shallow(0, hi)):
            if m["name"]:
                stop = self.end(m.end(), hi, "{\n")
                body = (stop, self.partner[stop]) if stop in self.partner else (stop, stop)
                self.add(m["name"], "function", m.start(), m["name"][0].isupper(), body)
            elif m["type"]:
                self._go_type(m["type"], m.start("type"), m.end())
            elif (end := self.partner.get(m.start("group"))) is not None:
                for x in re.finditer(r"^[ \t]*([A-Za-z_]\w*)\b(?=[^\n])", self.shallow(m.end(), end), re.M):
                    self._go_type(x[1], m.end() + x.start(1), m.end() + x.end(1))

    def _go_type(self, name: str, place: int, at: int) -> None:
        found = re.compile(r"\s*(?:\[[^\]]*\]\s*(?=struct\b|interface\b))?(struct|interface)\s*\{").match(self.masked, at)
        self.add(name, found[1] if found else "type-alias", place, name[0].isupper())
        if found and found.end() - 1 in self.partner:
            lo, hi = found.end(), self.partner[found.end() - 1]
            # a field has a name before its type; what is embedded has none
            shape = r"(?:^|;)[ \t]*([A-Za-z_]\w*)(?:[ \t]*,[ \t]*\w+)*[ \t]+(?=[\w*\[(<{])" if found[1] == "struct" else r"(?:^|;)[ \t]*([A-Za-z_]\w*)[ \t]*\("
            for x in re.finditer(shape, self.shallow(lo, hi), re.M):
                self.add(x[1], "field" if found[1] == "struct" else "function", lo + x.start(1), False, complexity=0)

    def java(self) -> None:
        hi = len(self.masked)
        for m in _JAVA_ITEM.finditer(self.shallow(0, hi)):
            opening = self.end(m.end(), hi)
            body = (opening, self.partner[opening]) if opening in self.partner else None
            self.add(m["name"], _KINDS[m["word"]], m.start(), bool(m["out"]))
            if not body or m["word"] not in ("class", "record"):
                continue
            text = self.shallow(body[0] + 1, body[1])
            lo = body[0] + 1
            for x in _JAVA_METHOD.finditer(text):
                stop = self.end(self.partner.get(lo + x.end() - 1, lo + x.end()), body[1])
                if stop in self.partner or self.masked[stop : stop + 1] == ";":
                    self.add(x["name"], "function", lo + x.start(), "public" in x["mods"].split(), (stop, self.partner.get(stop, stop)))
            for x in _JAVA_FIELD.finditer(self.shallow(lo, body[1], "({[")):
                self.add(x["name"], "field", lo + x.start("name"), False, complexity=0)


def _others(source: str, language: str) -> tuple[list[Symbol], list[Import]]:
    text = _Source(source, language)
    if language == "rust":
        text.rust(0, len(text.masked))
    elif language in ("typescript", "javascript"):
        text.typescript()
    else:
        getattr(text, language)()
    return text.symbols, _imports(source, mask(source, language, strings=False), language, text.symbols)


def _names(text: str) -> list[str]:
    found = []
    for part in text.split(","):
        words = part.strip().split(" as ")
        if name := re.sub(r"^type\s+", "", words[0].strip()):
            found.append(name)
    return found


def _imports(source: str, code: str, language: str, symbols: list[Symbol]) -> list[Import]:
    out: list[Import] = []
    if language == "rust":
        for m in re.finditer(r"\buse\s+([^;]+);", code):
            text = " ".join(m[1].split())
            group = re.search(r"\{(.*)\}", text)
            out.append((text, _names(group[1]) if group else [text.rpartition("::")[2].split(" as ")[0]]))
        out += [(m[1], [m[1]]) for m in re.finditer(r"\bmod\s+([A-Za-z_]\w*)\s*;", code)]
    elif language in ("typescript", "javascript"):
        for m in re.finditer(r"\b(?:import|export)\s+(?:type\s+)?([^;'\"]*?)\s*\bfrom\s*['\"]([^'\"]+)['\"]", code):
            group = re.search(r"\{([^}]*)\}", m[1])
            plain = re.sub(r"\{[^}]*\}", "", m[1])
            # a re-export takes names for others, a namespace all of them
            out.append((m[2], _names(plain) + (_names(group[1]) if group else [])))
        out += [(m[1], []) for m in re.finditer(r"\bimport\s*['\"]([^'\"]+)['\"]", code)]
        out += [(m[1], []) for m in re.finditer(r"(?:^|;)[ \t]*require\(\s*['\"]([^'\"]+)['\"]\s*\)", code, re.M)]
        out += [(m[2], _names(m[1].strip("{} \t"))) for m in re.finditer(r"\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", code)]
    elif language == "go":
        for m in re.finditer(r"^import\s*(?:\(([^)]*)\)|([\w.]+\s+)?\"([^\"]+)\")", code, re.M):
            paths = re.findall(r'"([^"]+)"', m[1]) if m[1] is not None else [m[3]]
            out += [(p, [p.rpartition("/")[2]]) for p in paths]
    else:
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code, re.M):
            package, _, name = m[1].rpartition(".")
            out.append((package, [name]))
    return out


def parse_source(source: str, language: str) -> tuple[list[Symbol], list[Import]]:
    return _python(source) if language == "python" else _others(source, language)


_SCHEMA = "path string, part string, role string, name string, kind string, line long, complexity long, import_from string, names array<string>"


def parse_files(files: DataFrame) -> DataFrame:
    """One row a symbol or import of (path, content) in a known language, no noise and at most ``MAX_BYTES``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, content in zip(b["path"], b["language"], b["content"], strict=True):
                symbols, imports = parse_source(content, language)
                rows += [(path, "symbol", *s, None, None) for s in symbols]
                rows += [(path, "import", None, None, None, None, None, f, n) for f, n in imports]
            out = pd.DataFrame(rows, columns=["path", "part", "role", "name", "kind", "line", "complexity", "import_from", "names"])
            yield out.astype({"line": "Int64", "complexity": "Int64"})

    text = F.make_valid_utf8(F.col("content").cast("string")) if dict(files.dtypes)["content"] == "binary" else F.col("content")
    known = files.select("path", P.parser_language(F.col("path")).alias("language"), text.alias("content"))
    known = known.where(F.col("language").isNotNull() & F.col("content").isNotNull() & ~P.is_noise(F.col("path")) & (F.octet_length("content") <= MAX_BYTES))
    return known.mapInPandas(run, _SCHEMA)


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.where("part = 'symbol'").select("path", "role", "name", "kind", "line", "complexity")


def imports(parsed: DataFrame) -> DataFrame:
    """(path, import_from, name), a row an imported name; an import without names has a null one."""
    return parsed.where("part = 'import'").select("path", "import_from", F.explode_outer("names").alias("name"))


def doc_header(content: str) -> str:
    """The comment lines that a file begins with, within its first bytes."""
    head = content.encode()[:HEADER_BYTES].decode("utf-8", "ignore")
    out, quoted = [], ""
    for line in head.split("\n"):
        text = line.strip()
        if quoted:
            out.append(text.replace(quoted, ""))
            quoted = "" if quoted in text else quoted
        elif text[:3] in ('"""', "'''"):
            out.append(text.replace(text[:3], ""))
            quoted = "" if text.count(text[:3]) > 1 else text[:3]
        elif text.startswith(("//", "#", "/*", "*", "--", "<!--")):
            out.append(text.lstrip("/*#-!<> ").rstrip("*/-> "))
        elif text:
            break
    return "\n".join(out)


def doc_headers(files: DataFrame) -> DataFrame:
    """(path, header) of (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "header": [doc_header(c) for c in b["content"]]})

    return files.select("path", F.substring("content", 1, HEADER_BYTES).alias("content")).where("content is not null").mapInPandas(run, "path string, header string")


def naming_votes(table: DataFrame) -> DataFrame:
    """(kind, style, votes, majority) of exported names by naming style; ties by style."""
    by = table.where("role = 'export'").groupBy("kind", P.case_style(F.col("name")).alias("style")).agg(F.count(F.lit(1)).alias("votes"))
    best = by.groupBy("kind").agg(F.min_by("style", F.struct(-F.col("votes"), "style")).alias("best"))
    return by.join(best, "kind").select("kind", "style", "votes", (F.col("style") == F.col("best")).alias("majority"))


def _most(votes: DataFrame, name: str) -> DataFrame:
    """One row: the key of the most votes (key, n), of equal ones the first by name; unknown without any."""
    total = votes.groupBy("key").agg(F.sum("n").alias("n"))
    return total.agg(F.coalesce(F.min_by("key", F.struct(-F.col("n"), "key")), F.lit("unknown")).alias(name))


def test_conventions(table: DataFrame, uses: DataFrame) -> DataFrame:
    """One row (framework, location, naming) by votes of symbols and imports; unknown where none votes."""
    defined, rust = table.where("role = 'definition'"), F.col("path").endswith(".rs")
    one = F.lit(1).alias("n")
    # an import counts once for its module and once for each name
    module = uses.select("path", "import_from").distinct().select(F.when(F.col("import_from").isin("pytest", "unittest"), "pytest").when(F.col("import_from") == "testing", "go-test").alias("key"), F.lit(5).alias("n"))
    named = uses.select(F.when(F.col("name").isin("describe", "it", "expect", "test", "jest"), "jest").when((F.col("name") == "Test") & F.col("import_from").contains("junit"), "junit").alias("key"), F.when(F.col("name") == "Test", 5).otherwise(1).alias("n"))
    cargo = defined.where(rust & F.col("name").startswith("test_")).select(F.lit("cargo-test").alias("key"), one)
    framework = _most(module.unionByName(named).where("key is not null").unionByName(cargo), "framework")
    path = F.col("path")
    place = F.when(path.contains("__tests__/"), "__tests__").when(path.rlike("(?:^|/)tests/"), "tests/").when(path.rlike("(?:^|/)spec/"), "spec/").when(path.rlike(r"_test\.|\.test\.|\.spec\.|_spec\."), "co-located")
    inline = defined.where(rust & (F.col("name") == "tests") & (F.col("kind") == "module")).select(F.lit("inline").alias("key"), one)
    location = _most(table.select("path").distinct().select(place.alias("key"), one).where("key is not null").unionByName(inline), "location")
    name = F.col("name")
    shape = F.when(name.startswith("test_"), "test_*").when(name.startswith("Test"), "Test*").when(name.endswith("_test"), "*_test").when(name.startswith("should_") | name.startswith("it_"), "should_*")
    naming = _most(defined.where("kind = 'function'").select(shape.alias("key"), one).where("key is not null"), "naming")
    return framework.crossJoin(F.broadcast(location)).crossJoin(F.broadcast(naming))  # one row each
