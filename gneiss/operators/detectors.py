"""Source detectors (D5-D11): each gives (action, path, start_line, end_line, category, reason, confidence).

They run on the executors over (path, content), by language.  Python is judged on its syntax tree, the other languages
on text with strings and comments masked and brackets matched.  Suppressions (D11) are judged by what other files
import, so they are joined to the imports.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions import predicates as P
from gneiss.operators.parsing import Lines, brackets, mask

SCHEMA = "action string, path string, start_line long, end_line long, category string, reason string, confidence double"
Finding = tuple[str, int, int, str, str]  # action, start, end, category, reason
_C_LIKE = ("rust", "typescript", "javascript", "go", "java")


def split_outside(text: str, operator: str) -> list[str]:
    """Parts between operators that no bracket holds."""
    out, depth, last, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        depth += (c in "([{") - (c in ")]}")
        if depth == 0 and text.startswith(operator, i):
            out.append(text[last:i])
            last = i = i + len(operator)
        else:
            i += 1
    return [*out, text[last:]]


def _bare(text: str) -> str:
    text = text.strip()
    while text.startswith("(") and text.endswith(")") and brackets(text).get(0) == len(text) - 1:
        text = text[1:-1].strip()
    return text


def classify_condition(text: str) -> str | None:
    """why a condition has one value always, or None: constant, self-comparison or contradiction."""
    text = _bare(re.sub(r"\s+", " ", text))
    if text in ("true", "True", "1", "!false", "not False", "false", "False", "!true", "not True", "0"):
        return "constant"
    m = re.fullmatch(r"(.+?)\s*(===|!==|==|!=|<=|>=|(?<![=<>-])<(?!<)|(?<![=<>-])>(?!>))\s*(.+)", text)
    if m and len(split_outside(text, "&&")) == len(split_outside(text, "||")) == 1 and _bare(m[1]) == _bare(m[3]) and not re.search(r"[(]|\band\b|\bor\b", m[1]):
        return "self-comparison"
    for operator in ("&&", " and ", "||", " or "):
        parts = [_bare(p) for p in split_outside(text, operator)]
        if len(parts) > 1:
            plain = {p for p in parts if "(" not in p}
            if any(f"!{p}" in plain or f"not {p}" in plain for p in plain):
                return "contradiction"
    return None


def _conditions(code: str, masked: str, language: str, line: Lines) -> Iterator[Finding]:
    partner = brackets(masked)
    for m in re.finditer(r"\bif\b", masked):
        at = m.end()
        if language in ("rust", "go"):
            end = at
            while end < len(masked) and masked[end] != "{":
                end = partner.get(end, end) + 1 if masked[end] in "([" else end + 1
            text = code[at:end].rpartition(";")[2] if language == "go" else code[at:end]
            if language == "rust" and text.lstrip().startswith("let "):
                continue
        else:
            while at < len(masked) and masked[at].isspace():
                at += 1
            if at >= len(masked) or masked[at] != "(" or at not in partner:
                continue
            end = partner[at]
            text = code[at + 1 : end]
        if why := classify_condition(text):
            yield "review", line(m.start()), line(end - 1), "always-true-condition", why


def _empty_handlers(code: str, masked: str, language: str, line: Lines) -> Iterator[Finding]:
    partner = brackets(masked)

    def found(m: re.Match[str], why: str) -> Finding:
        return "review", line(m.start()), line(m.end() - 1), "empty-catch", why

    # an empty body in the source, not only in the masked text: a comment may explain it
    if language in ("typescript", "javascript", "java"):
        for m in re.finditer(r"\bcatch\s*(?:\([^)]*\)\s*)?\{\s*\}", masked):
            if not code[m.start() : m.end()].partition("{")[2][:-1].strip():
                yield found(m, "a caught error is dropped")
        for m in re.finditer(r"\.catch\(\s*(?:\(\s*[\w$]*\s*\)|[\w$]+)\s*=>\s*\{\s*\}\s*\)|\.catch\(\s*function\s*\([^)]*\)\s*\{\s*\}\s*\)", masked):
            if not re.sub(r"[^{]*\{|\}\s*\)$", "", code[m.start() : m.end()], count=2).strip(" \n\t{})"):
                yield found(m, "a rejected promise is dropped")
    elif language == "rust":
        for m in re.finditer(r"\blet\s+_\s*(?::[^=;]+)?=(?!=)\s*", masked):
            end = _statement_end(masked, partner, m.end())
            if not _meant_to_drop(code[m.end() : end]):
                yield "review", line(m.start()), line(end), "empty-catch", "a value is dropped by let _"
        for m in re.finditer(r"\.\s*ok\(\s*\)\s*;", masked):
            start = _statement_start(masked, m.start())
            if re.match(r"(?:let|return|break|const|static|if|match|while)\b|[^=!<>]*(?<![=!<>])=(?![=>])", masked[start : m.start()]):
                continue
            yield "review", line(start), line(m.end() - 1), "empty-catch", "a result is dropped by .ok()"
        for m in re.finditer(r"\bif\s+let\s+Err\([^()]*\)\s*=\s*", masked):
            at = m.end()
            while at < len(masked) and masked[at] not in "{;":
                at = partner.get(at, at) + 1 if masked[at] in "([" else at + 1
            if at in partner and not code[at + 1 : partner[at]].strip():
                yield "review", line(m.start()), line(partner[at]), "empty-catch", "an error is matched and dropped"
    elif language == "go":
        for m in re.finditer(r"\bif\s+(?:[^{;]*;\s*)?err\s*!=\s*nil\s*\{\s*\}", masked):
            if not code[m.start() : m.end()].partition("{")[2][:-1].strip():
                yield found(m, "an error is checked and dropped")
        for m in re.finditer(r"(?:^|[;{])[ \t]*(_\s*(?:,\s*\w+\s*)*=(?!=)\s*)", masked, re.M):
            yield "review", line(m.start(1)), line(_statement_end(masked, partner, m.end(), "\n}") - 1), "empty-catch", "a value is dropped by _ ="


def _statement_end(masked: str, partner: dict[int, int], at: int, stops: str = ";}") -> int:
    """Place of what ends a statement outside brackets."""
    while at < len(masked) and masked[at] not in stops and masked[at] != ";":
        at = partner.get(at, at) + 1
    return min(at, len(masked) - 1) if masked[at : at + 1] == ";" or "\n" not in stops else at


def _statement_start(masked: str, at: int) -> int:
    """Place of the first character of the statement that goes on at ``at``; brackets are skipped as a whole."""
    depth, i = 0, at - 1
    while i >= 0:
        c = masked[i]
        if c in ")]" or (c == "}" and depth):
            depth += 1
        elif c in "([" or (c == "{" and depth):
            if depth == 0:
                break
            depth -= 1
        elif depth == 0 and c in ";{}":
            break
        i -= 1
    i += 1
    while i < at and masked[i].isspace():
        i += 1
    return i


#: Calls whose value is dropped on purpose: warm-up of lazy patterns, spawned tasks, clean-up, guards of locks.
_DROP_STARTS = ("thread::spawn", "tokio::spawn", "task::spawn", "tokio::task::spawn", "std::thread::spawn", "fs::remove_", "std::fs::remove_")
_DROP_ENDS = tuple(f"{c}()" for c in ("_pattern", "_regex", "_patterns", "_regexes")) + tuple(f".{c}(){u}" for c in ("lock", "read", "write") for u in ("", ".unwrap()"))


def _meant_to_drop(value: str) -> bool:
    value = value.strip()
    return value.startswith(_DROP_STARTS) or value.endswith(_DROP_ENDS) or "::Write::flush" in value or ".flush()" in value or re.fullmatch(r"\w+", value, re.A) is not None


def _plain(text: str) -> bool:
    """Whether an expression is a literal or a name."""
    return text in ("true", "false", "null", "undefined") or text[:1] in ("\"", "'", "`") or text[:1].isdigit() or re.fullmatch(r"\w+", text, re.A) is not None


_ASSERTS = {
    "typescript": r"\bexpect\(",
    "rust": r"\b(?P<name>(?:debug_)?assert(?:_eq|_ne)?)!\s*[(\[{]",
    "java": r"\b(?P<name>assertEquals|assertSame|assertTrue|assertFalse|assertNotNull|assertNull)\s*\(",
    "go": r"\b(?:assert|require)\.(?P<name>Equals?|Same|True|False|Nil|NotNil)\(",
}
_ASSERTS["javascript"] = _ASSERTS["typescript"]


def _always(name: str, args: list[str], language: str) -> bool:
    """Whether the assertion of these arguments always passes."""
    if language == "go":
        args = args[1:]  # the first is the test
    first = args[0] if args else ""
    same = len(args) > 1 and args[0] == args[1] and _plain(args[0])
    match name.lower().removeprefix("debug_").removeprefix("assert").lstrip("_"):
        case "":
            return args == ["true"]
        case "true":
            return "true" in args if language == "java" else first == "true"
        case "false":
            return "false" in args if language == "java" else first == "false"
        case "nil" | "null":
            return first in ("nil", "null")
        case "notnil" | "notnull":
            return first.startswith('"') or first in (("true", "false") if language == "go" else ("Boolean.TRUE", "Boolean.FALSE"))
        case _:
            return same


def _tautologies(code: str, masked: str, language: str, line: Lines) -> Iterator[Finding]:
    partner = brackets(masked)

    def arguments(opening: int) -> list[str] | None:
        if opening not in partner:
            return None
        # cut where the masked text has commas, so none in a string counts
        inner, out, at = masked[opening + 1 : partner[opening]], [], opening + 1
        for part in split_outside(inner, ","):
            out.append(code[at : at + len(part)].strip())
            at += len(part) + 1
        return out if out[-1] else out[:-1]

    for m in re.finditer(_ASSERTS[language], masked):
        args, end = arguments(m.end() - 1), partner.get(m.end() - 1, m.end())
        if args is None:
            continue
        if language in ("typescript", "javascript"):
            follows = re.compile(r"\s*\.\s*(?:toBe|toEqual|toStrictEqual)\(").match(masked, end + 1)
            other = arguments(follows.end() - 1) if follows else None
            if other is None or len(args) != 1 or args != other or not _plain(args[0]):
                continue
            end = partner[follows.end() - 1]
        elif not _always(m["name"], args, language):
            continue
        yield "review", line(m.start()), line(end), "tautological-test", "the assertion holds whatever the code does"


_FUNCTION = {
    "typescript": r"\bfunction\s+(?P<name>[\w$]+)\s*\(",
    "rust": r"\bfn\s+(?P<name>\w+)\s*\(",
    "go": r"^func\s+(?:\(\s*(?P<of>\w+)\s+[^)]*\)\s*)?(?P<name>\w+)\s*\(",
    "java": r"(?:^|[;{}])\s*(?:@\w+(?:\([^()]*\))?\s+)*(?P<start>(?:(?:public|private|protected|static|final|synchronized|default|abstract)\s+)*(?:<[^<>]*>\s*)?(?!new\b|return\b|else\b|throw\b)[\w.]+(?:<[^;{}()]*>)?(?:\[\])*)\s+(?P<name>\w+)\s*\(",
}
_FUNCTION["javascript"] = _FUNCTION["typescript"]


def _argument_names(text: str, language: str) -> list[str]:
    parts = [p.strip() for p in split_outside(text, ",") if p.strip()]
    if language in ("typescript", "javascript"):
        return [p.split(":")[0].split("=")[0].strip() for p in parts]
    if language == "rust":
        named = [p.split(":")[0].strip().removeprefix("mut ").strip() for p in parts]
        return [n for n in named if n.removeprefix("&").split()[-1:] != ["self"] or not re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self", n)]
    words = [p.split() for p in parts if "..." not in p]
    if language == "go":
        # unnamed where no part has both a name and a type
        return [w[0] for w in words] if any(len(w) > 1 for w in words) else []
    return [w[-1] for w in words if len(w) > 1]


def _only_call(body: str) -> tuple[str, list[str]] | None:
    """(what is called, arguments) of a body that is one call and no more."""
    body = re.sub(r"^return\b", "", body.strip()).strip()
    body = body[:-1].strip() if body.endswith(";") else body
    partner = brackets(body)
    opening = next((a for a, b in partner.items() if b == len(body) - 1 and body[a] == "("), None)
    if opening is None:
        return None
    called = body[:opening].strip()
    # what it hangs on may have brackets of its own
    bare, at = "", 0
    while at < len(called):
        at, bare = (partner[at] + 1, bare) if at in partner else (at + 1, bare + called[at])
    if not re.fullmatch(r"[A-Za-z_$](?:[\w$.?]|::|\s*\.\s*|<[^<>]*>)*", bare) or bare.endswith((".", "::")):
        return None
    return called, [a.strip() for a in split_outside(body[opening + 1 : -1], ",") if a.strip()]


def _trait_impl(masked: str, partner: dict[int, int], at: int) -> bool:
    """Whether the innermost impl around a place is of a trait."""
    around = [a for a, b in partner.items() if a < at < b and masked[a] == "{"]
    for a in sorted(around, reverse=True):
        head = re.split(r"[;{}]", masked[:a][-1000:])[-1]
        if m := re.search(r"\bimpl\b(.*)", head, re.S):
            return re.search(r"\bfor\b(?!\s*<)", m[1]) is not None
    return False


def _arrows(masked: str, partner: dict[int, int]) -> Iterator[tuple[int, int, str]]:
    """(opening of the parameters, end, body) of arrow functions whose parameters are in brackets."""
    for m in re.finditer(r"\)\s*(?::[^=;(){}]*)?=>\s*", masked):
        opening = next((a for a, b in partner.items() if b == m.start()), None)
        if opening is None or masked[:opening].rstrip().endswith(">"):
            continue
        at = end = m.end()
        if masked[at : at + 1] == "{":
            if at in partner:
                yield opening, partner[at], masked[at + 1 : partner[at]]
            continue
        while end < len(masked) and masked[end] not in ",;)]}\n":
            end = partner.get(end, end) + 1
        yield opening, len(masked[:end].rstrip()) - 1, "" if masked[at:end].lstrip().startswith("return") else masked[at:end]


def _wrappers(code: str, masked: str, language: str, line: Lines, source: str | None = None) -> Iterator[Finding]:
    partner = brackets(masked)
    found: list[tuple[int, int, int, str, int | None, str | None]] = []  # start, opening, end, body, of the body, receiver
    for m in re.finditer(_FUNCTION[language], masked, re.M):
        opening = m.end() - 1
        if opening not in partner or (language == "rust" and _trait_impl(masked, partner, m.start())):
            continue
        brace = masked.find("{", partner[opening])
        if brace < 0 or brace not in partner or ";" in masked[partner[opening] : brace]:
            continue
        start = m.start("start") if language == "java" else m.start()
        found.append((start, opening, partner[brace], masked[brace + 1 : partner[brace]], brace + 1, m["of"] if language == "go" else None))
    if language in ("typescript", "javascript"):
        found += [(opening, opening, end, body, None, None) for opening, end, body in _arrows(masked, partner)]
    for start, opening, end, body, at, receiver in found:
        # a comment in the body, which the source has, is a reason
        if at is not None and source is not None and re.search(r"//|/\*", source[at:end]) and code[at:end] != source[at:end]:
            continue
        names = _argument_names(masked[opening + 1 : partner[opening]], language)
        call = _only_call(body)
        if call is None or call[1] != names:
            continue
        head = re.split(r"\.|::", call[0])[0].strip()
        if {"rust": head in ("self", "Self"), "go": receiver is not None and head == receiver, "java": head in ("this", "super")}.get(language, head == "this"):
            continue
        yield "review", line(start), line(end), "passthrough-wrapper", f"it only calls {call[0]}"


#: A line of a comment that begins so, within 40 characters, is a note.
_NOTES = ("TODO", "FIXME", "NOTE", "HACK", "XXX", "WARNING", "SAFETY", "slop-ignore", "allow(", "SPDX-License")
_CODE = {
    "rust": re.compile(r"^\s*(?:let\s+\w|fn\s+\w+\s*\(|if\s.+\{|for\s.+\{|return\b.*;|\w[\w.:]*\(.*\);|\})"),
    "typescript": re.compile(r"^\s*(?:(?:const|let|var)\s+\w+\s*=|function\s+\w+\s*\(|if\s*\(.+\)\s*\{|for\s*\(|return\b.*;|\w[\w.]*\(.*\);|\})"),
    "go": re.compile(r"^\s*(?:\w+(?:,\s*\w+)*\s*:=|func\s+\w+\s*\(|if\s.+\{|for\s.*\{|return\b|\w[\w.]*\(.*\)$|\})"),
    "java": re.compile(r"^\s*(?:\w[\w<>\[\]]*\s+\w+\s*=.*;|if\s*\(.+\)\s*\{|for\s*\(|return\b.*;|\w[\w.]*\(.*\);|\})"),
}
_CODE["javascript"] = _CODE["typescript"]


def _comment_runs(source: str, language: str) -> Iterator[tuple[int, int, list[str]]]:
    """(first line, last line, lines without their marks) of each comment of whole lines that documents nothing."""
    marker = "#" if language == "python" else "//"
    run: list[str] = []
    for i, text in enumerate([*source.split("\n"), ""], 1):
        bare = text.strip()
        if bare.startswith(marker) and not bare.startswith((marker + "/", marker + "!")):
            run.append(bare[len(marker) :].removeprefix(" "))
        else:
            if run:
                yield i - len(run), i - 1, run
            run = []
    if language != "python":
        line = Lines(source)
        for m in re.finditer(r"^[ \t]*/\*(?![*!])(.*?)\*/[ \t]*$", source, re.S | re.M):
            lines = m[1].split("\n")
            if all(x.lstrip().startswith("*") for x in lines[1:] if x.strip()):
                lines = [lines[0], *(x.lstrip()[1:].removeprefix(" ") for x in lines[1:])]
            yield line(m.start(1)), line(m.end(1)), lines


def _commented_code(source: str, language: str) -> Iterator[Finding]:
    for start, end, run in _comment_runs(source, language):
        some = [x for x in run if x.strip()]
        if len(some) < 3 or any(n in x.lstrip()[:40] for x in run for n in _NOTES):
            continue
        text = textwrap.dedent("\n".join(run))
        if language == "python":
            good = _parses(text)
        else:
            good = sum(bool(_CODE[language].match(x)) for x in some) * 5 >= len(some) * 4 and brackets_balance(text)
        if good:
            yield "delete", start, end, "commented-out-code", f"{len(some)} lines of code in a comment"


def _parses(text: str) -> bool:
    """Whether it is Python with more than names and strings; a return or the like may lack its function."""
    for whole in (text, "def f():\n" + textwrap.indent(text, " ")):
        try:
            tree = ast.parse(whole)
        except (SyntaxError, ValueError, RecursionError):
            continue
        body = tree.body if whole is text else tree.body[0].body
        return any(not isinstance(x, ast.Expr) or isinstance(x.value, (ast.Call, ast.Await, ast.Yield)) for x in body)
    return False


def brackets_balance(text: str) -> bool:
    partner = brackets(text)
    return 2 * len(partner) == len(re.findall(r"[][(){}]", text))


def _python(source: str) -> Iterator[Finding]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = source.split("\n")

    def same(a: ast.expr, b: ast.expr) -> bool:
        return isinstance(a, (ast.Constant, ast.Name)) and ast.dump(a) == ast.dump(b)

    for node in ast.walk(tree):
        if isinstance(node, ast.ExceptHandler) and len(node.body) == 1:
            only = node.body[0]
            dropped = isinstance(only, ast.Pass) or (isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant) and only.value.value is Ellipsis)
            # a comment in the handler explains it
            if dropped and not any("#" in x for x in lines[node.lineno - 1 : only.end_lineno]):
                yield "review", node.lineno, only.end_lineno or node.lineno, "empty-catch", "a caught error is dropped"
        elif isinstance(node, ast.Assert):
            test = node.test
            literal = isinstance(test, ast.Constant) and (test.value is True or isinstance(test.value, (int, str)) and not isinstance(test.value, bool))
            if literal or (isinstance(test, ast.Compare) and same(test.left, test.comparators[0])):
                yield "review", node.lineno, node.end_lineno or node.lineno, "tautological-test", "the assertion holds whatever the code does"
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            a, name = node.args, node.func.attr
            true = name in ("assertTrue", "assertFalse") and a and isinstance(a[0], ast.Constant) and a[0].value is (name == "assertTrue")
            if true or (name in ("assertEqual", "assertEquals", "assertIs", "assertSame") and len(a) > 1 and same(a[0], a[1])):
                yield "review", node.lineno, node.end_lineno or node.lineno, "tautological-test", "the assertion holds whatever the code does"
        elif isinstance(node, ast.If) and (why := classify_condition(ast.unparse(node.test))):
            yield "review", node.lineno, node.test.end_lineno or node.lineno, "always-true-condition", why
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and len(node.body) == 1 and isinstance(node.body[0], (ast.Return, ast.Expr)) and isinstance(node.body[0].value, ast.Call):
            a, call = node.args, node.body[0].value
            names = [x.arg for x in (*a.posonlyargs, *a.args)]
            names = names[1:] if names[:1] in (["self"], ["cls"]) else names
            names += [f"*{a.vararg.arg}"] if a.vararg else ["*"] if a.kwonlyargs else []
            names += [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
            given = [ast.unparse(x) for x in call.args] + [f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in call.keywords]
            called = ast.unparse(call.func)
            # a comment in the body is a reason
            if given == names and not called.startswith("self.") and not any("#" in x for x in lines[node.lineno : node.end_lineno]):
                yield "review", node.lineno, node.end_lineno or node.lineno, "passthrough-wrapper", f"it only calls {called}"


#: Lints that nothing is left to allow for once another file imports the name.
LINTS = frozenset(("dead_code", "unused", "unused_imports", "unused_variables", "unused_assignments", "unused_must_use"))
_ALLOW = re.compile(r"#\[\s*allow\s*\(([^()]*)\)\s*\]")
_ITEM = re.compile(r"\s*(?:pub(?:\s*\([^()]*\))?\s+)?(?:(?:default|async|unsafe|const(?=\s+(?:fn|unsafe|async|extern)\b)|extern(?:\s*\"[^\"]*\")?(?!\s+crate\b))\s+)*(?:fn|struct|enum|mod|const|static(?:\s+mut)?|trait|type|union|extern\s+crate)\s+(\w+)")


def allowed_names(source: str) -> list[tuple[str, str, int, int]]:
    """(name, lints, first line, last line) of each allow attribute of nothing but ``LINTS`` that stands before a named item."""
    masked, line = mask(source, "rust"), Lines(source)
    partner, out = brackets(masked), []
    for m in _ALLOW.finditer(masked):
        lints = [x.strip().removeprefix("clippy::") for x in m[1].split(",") if x.strip()]
        if not lints or not LINTS.issuperset(lints):
            continue
        at = m.end()
        while more := re.compile(r"\s*#(?=\[)").match(masked, at):  # other attributes between
            if more.end() not in partner:
                break
            at = partner[more.end()] + 1
        if item := _ITEM.match(masked, at):
            out.append((item[1], ", ".join(lints), line(m.start()), line(m.end() - 1)))
    return out


def suppressions(files: DataFrame) -> DataFrame:
    """(path, name, lints, start_line, end_line) of the allow attributes of (path, content) in Rust files that are no tests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, lints, s, e) for p, c in zip(b["path"], b["content"], strict=True) for n, lints, s, e in allowed_names(c)]
            yield pd.DataFrame(rows, columns=["path", "name", "lints", "start_line", "end_line"])

    text = F.make_valid_utf8(F.col("content").cast("string")) if dict(files.dtypes)["content"] == "binary" else F.col("content")
    known = files.where(F.col("path").endswith(".rs") & F.col("content").isNotNull() & ~P.is_rust_test_file(F.col("path"))).select("path", text.alias("content"))
    return known.where(F.col("content").contains("allow")).mapInPandas(run, "path string, name string, lints string, start_line long, end_line long")


def stale_suppressions(allowed: DataFrame, imports: DataFrame) -> DataFrame:
    """Allowed names that a file imports from a module that can be theirs, in the columns of findings.

    A module can be a file's if any part of its path but crate, self and super is one of the file's too, or if it has
    no other part.
    """
    module = F.when(F.col("import_from").contains("::"), F.substring_index("import_from", "::", -1)).otherwise("")
    parts = F.split(F.expr("substring(import_from, 1, length(import_from) - if(contains(import_from, '::'), length(last) + 2, 0))"), "::")
    names = imports.where("name is not null and import_from is not null").withColumn("last", module)
    names = names.select("name", F.filter(parts, lambda x: ~x.isin("", "crate", "self", "super")).alias("parts")).distinct()
    fits = (F.size("parts") == 0) | F.exists("parts", lambda x: F.col("path").contains(F.concat(F.lit("/"), x)) | F.col("path").startswith(x))
    found = allowed.join(names, "name").where(fits).select("path", "name", "lints", "start_line", "end_line").distinct()
    why = F.concat("name", F.lit(" is imported elsewhere, so "), "lints", F.lit(" can't arise"))
    return found.select(F.lit("delete").alias("action"), "path", "start_line", "end_line", F.lit("stale-suppression").alias("category"), why.alias("reason"), F.lit(P.CONFIDENCE["stale-suppression"]).alias("confidence"))


def detect(source: str, language: str, rust_test: bool = False) -> list[Finding]:
    out = list(_commented_code(source, language))
    if language == "python":
        return out + list(_python(source))
    code, masked, line = mask(source, language, strings=False), mask(source, language), Lines(source)
    for rule in (_conditions, _tautologies):
        out += rule(code, masked, language, line)
    out += _wrappers(code, masked, language, line, source)
    if not rust_test:
        # the source itself, as an explained empty handler is no finding
        out += _empty_handlers(source, masked, language, line)
    return out


def source_findings(files: DataFrame) -> DataFrame:
    """D5-D10 over (path, content); rows with a null content or of an unknown language give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, rust_test, content in zip(b["path"], b["language"], b["rust_test"], b["content"], strict=True):
                rows += [(a, path, s, e, c, r, P.CONFIDENCE[c]) for a, s, e, c, r in detect(content, language, rust_test)]
            yield pd.DataFrame(rows, columns=["action", "path", "start_line", "end_line", "category", "reason", "confidence"])

    text = F.make_valid_utf8(F.col("content").cast("string")) if dict(files.dtypes)["content"] == "binary" else F.col("content")
    known = files.select("path", P.parser_language(F.col("path")).alias("language"), P.is_rust_test_file(F.col("path")).alias("rust_test"), text.alias("content"))
    return known.where(F.col("language").isNotNull() & F.col("content").isNotNull() & ~P.is_generated(F.col("path"))).mapInPandas(run, SCHEMA)
