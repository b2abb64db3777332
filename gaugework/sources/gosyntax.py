"""Facts from Go source text: a tokenizer, and what can be told from tokens without type checking.

Imports, named types, functions with their lines, complexity, line classes, mutation tokens and shape fingerprints come
from here. Resolved calls and satisfied interfaces need the tool chain and arrive as fact tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.shipping import ship

# Fixed values of the language.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
OPERATORS = ["<<=", ">>=", "&^=", "...", "&&", "||", "<-", "++", "--", "==", "!=", "<=", ">=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "&^"]
TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>`[^`]*`|\"(?:\\.|[^\"\\\n])*\")|(?P<char>'(?:\\.|[^'\\\n])+')"
    r"|(?P<number>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?i?)|(?P<name>[^\W\d]\w*)|(?P<op>" + "|".join(map(re.escape, OPERATORS)) + r"|[^\s\w])|(?P<space>\s+)",
    re.S,
)
GENERATED = re.compile(r"(?m)^// Code generated .* DO NOT EDIT\.$")


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    column: int


def tokens(source: str) -> list[Token]:
    """Tokens and comments in order; lines and columns count from 1, columns in bytes."""
    out, line, start, at = [], 1, 0, 0
    for m in TOKEN.finditer(source):
        text, at = m.group(), m.start()
        if m.lastgroup != "space":
            kind = "keyword" if text in KEYWORDS else m.lastgroup
            out.append(Token(kind, text, line, len(source[start:at].encode()) + 1))
        if n := text.count("\n"):
            line += n
            start = at + text.rfind("\n") + 1
    return out


def line_classes(source: str) -> list[str]:
    """The class of each line: code over comment over blank; a token of several lines covers them all."""
    found = ["blank"] * (source.count("\n") + (not source.endswith("\n") and source != ""))
    for t in tokens(source):
        for k in range(t.line - 1, min(len(found), t.line + t.text.count("\n"))):
            if t.kind != "comment":
                found[k] = "code"
            elif found[k] == "blank":
                found[k] = "comment"
    return found


@dataclass
class Function:
    name: str
    start_line: int
    end_line: int
    has_body: bool
    complexity: int
    body: list[Token] = field(default_factory=list)


def _skip(ts: list[Token], i: int) -> int:
    """The place after the bracket that closes the one at ``i``."""
    pairs, depth = {"(": ")", "{": "}", "[": "]"}, []
    while i < len(ts):
        if ts[i].kind == "op" and ts[i].text in pairs:
            depth.append(pairs[ts[i].text])
        elif depth and ts[i].kind == "op" and ts[i].text == depth[-1]:
            depth.pop()
            if not depth:
                return i + 1
        i += 1
    return i


def receiver_name(ts: list[Token]) -> str:
    """The type of a receiver without pointer, package and parameters; ? if there is none."""
    names, depth = [], 0
    for t in ts:
        depth += (t.text == "[") - (t.text == "]")
        if t.kind == "name" and not depth:
            names.append(t.text)
    return names[-1] if names else "?"


def functions(source: str) -> list[Function]:
    """Declared functions in order; methods are Receiver.Name, complexity is 1 and one for each branch."""
    ts = [t for t in tokens(source) if t.kind != "comment"]
    out, i, depth = [], 0, 0
    while i < len(ts):
        t = ts[i]
        if t.kind == "op" and t.text in "({[":
            i = _skip(ts, i)
            continue
        if t.text != "func" or t.kind != "keyword" or (i and ts[i - 1].line == t.line and ts[i - 1].text not in "};"):
            i += 1
            continue
        k, owner = i + 1, ""
        if k < len(ts) and ts[k].text == "(":
            end = _skip(ts, k)
            owner = receiver_name(ts[k + 1 : end - 1]) + "."
            k = end
        if k >= len(ts) or ts[k].kind != "name":
            i += 1
            continue
        name = owner + ts[k].text
        k += 1
        last = ts[k - 1]
        while k < len(ts):  # type parameters, parameters, results
            if ts[k].text in ("(", "["):
                k = _skip(ts, k)
            elif ts[k].text in ("interface", "struct") and k + 1 < len(ts) and ts[k + 1].text == "{":
                k = _skip(ts, k + 1)
            elif ts[k].text == "{" or ts[k].line > last.line:
                break
            else:
                k += 1
            last = ts[min(k, len(ts)) - 1]
        if k < len(ts) and ts[k].text == "{":
            end = _skip(ts, k)
            body = ts[k:end]
            out.append(Function(name, t.line, ts[end - 1].line, True, complexity(body), body))
            k = end
        else:
            out.append(Function(name, t.line, last.line, False, 1))
        i = k
    del depth
    return out


def branches(body: list[Token]) -> list[str]:
    """Kinds of the nodes that add a path: a default clause adds none, a loop over a range is one loop."""
    return [t.text for t in body if (t.kind == "keyword" and t.text in ("if", "for", "case")) or (t.kind == "op" and t.text in ("&&", "||"))]


def complexity(body: list[Token]) -> int:
    return 1 + len(branches(body))


def imports(source: str) -> list[tuple[str, str, int]]:
    """(path, alias, line) of each import declaration, in order."""
    ts = [t for t in tokens(source) if t.kind != "comment"]
    out = []
    for i, t in enumerate(ts):
        if t.text != "import" or t.kind != "keyword":
            continue
        end = _skip(ts, i + 1) if i + 1 < len(ts) and ts[i + 1].text == "(" else i + 3
        for k in range(i + 1, min(end, len(ts))):
            if ts[k].kind == "string" and (k == i + 1 or ts[i + 1].text == "(" or k == i + 2):
                before = ts[k - 1]
                alias = before.text if before.line == ts[k].line and (before.kind == "name" or before.text in ("_", ".")) else ""
                out.append((ts[k].text[1:-1], alias, ts[k].line))
    return out


def named_types(source: str) -> tuple[int, int]:
    """Declared types: interface literals, and everything else."""
    ts = [t for t in tokens(source) if t.kind != "comment"]
    kinds: list[str] = []
    i = depth = 0
    while i < len(ts):
        if ts[i].kind == "keyword" and ts[i].text == "type" and i + 1 < len(ts):
            group = ts[i + 1].text == "("
            end = _skip(ts, i + 1) if group else len(ts)
            k = i + 2 if group else i + 1
            while k < end and k < len(ts) and ts[k].kind == "name":
                k += 1
                if k < len(ts) and ts[k].text == "[" and k + 1 < len(ts) and ts[k + 1].kind == "name":
                    k = _skip(ts, k)
                if k < len(ts) and ts[k].text == "=":
                    k += 1
                kinds.append("interface" if k < len(ts) and ts[k].text == "interface" else "other")
                line = ts[k].line if k < len(ts) else 0
                while k < end and k < len(ts) and ts[k].text not in (")", ";") and ts[k].line == line:
                    if ts[k].text in ("{", "(", "["):
                        k = _skip(ts, k)
                        line = ts[k - 1].line
                    else:
                        k += 1
                if not group:
                    break
            i = max(end if group else k, i + 1)
            continue
        i += 1
    del depth
    return kinds.count("interface"), kinds.count("other")


def mutable_tokens(source: str) -> list[Token]:
    """Operators between two operands and the constants that a mutation can change."""
    ts = [t for t in tokens(source) if t.kind != "comment"]
    out, signature = [], 0
    for i, t in enumerate(ts):
        if t.kind == "keyword" and t.text == "func":  # a star between a parameter and its type is no product
            signature = i + 1
            while signature < len(ts) and ts[signature].text != "{" and ts[signature].line == t.line:
                signature = _skip(ts, signature) if ts[signature].text in ("(", "[") else signature + 1
        if i < signature:
            continue
        before = ts[i - 1] if i else None
        operand = before is not None and (before.kind in ("name", "number", "string", "char") or before.text in (")", "]", "}"))
        if t.kind == "op" and t.text in ("+", "-", "*", ">", ">=", "<", "<=", "==", "!=", "&&", "||") and operand:
            out.append(t)
        elif (t.kind == "number" and t.text in ("0", "1")) or (t.kind == "name" and t.text in ("true", "false")):
            out.append(t)
    return out


def shape(body: list[Token]) -> tuple[int, list[str]]:
    """Number of nodes and distinct fingerprints of a body's normal form.

    Names and literal values are dropped, operators, keywords, literal kinds and true, false, nil stay. A node is a bracket,
    a statement (tokens of a line between brackets) or a token; its fingerprint hashes those of its children.
    """
    prints: set[str] = set()
    n = 0

    def leaf(t: Token) -> str:
        if t.kind == "name":
            return t.text if t.text in ("true", "false", "nil") else "name"
        return t.kind if t.kind in ("number", "string", "char") else t.text

    def make(label: str, children: list[str]) -> str:
        nonlocal n
        n += 1
        digest = hashlib.sha256("\0".join([label, *children]).encode()).hexdigest()
        prints.add(digest)
        return digest

    def group(i: int, closing: str) -> tuple[list[str], int]:
        statements: list[str] = []
        current: list[str] = []
        line = body[i].line if i < len(body) else 0
        while i < len(body) and body[i].text != closing:
            t = body[i]
            if (t.line > line and current) or t.text == ";":
                if current:
                    statements.append(make("statement", current))
                current = []
            if t.text in ("(", "{", "["):
                inner, i = group(i + 1, {"(": ")", "{": "}", "[": "]"}[t.text])
                current.append(make(t.text, inner))
                line = body[min(i, len(body) - 1)].line
            elif t.text != ";":
                current.append(make(leaf(t), []))
                line = t.line
            i += 1
        if current:
            statements.append(make("statement", current))
        return statements, i

    group(0, "")
    return n, sorted(prints)


def _facts(kind: str, path: str, source: str) -> list[tuple]:
    if kind == "lines":
        return [(path, k, c) for k, c in enumerate(line_classes(source), 1)]
    if kind == "functions":
        classes = line_classes(source)
        rows = []
        for f in functions(source):
            own = classes[f.start_line - 1 : f.end_line]
            rows.append((path, f.name, f.start_line, f.end_line, f.has_body, f.complexity, len(own), own.count("code"), own.count("comment"), own.count("blank")))
        return rows
    if kind == "files":
        classes = line_classes(source)
        head = source.split("\npackage ", 1)[0]
        abstract, concrete = named_types(source)
        return [(path, bool(GENERATED.search(head)), head, len(classes), classes.count("code"), classes.count("comment"), classes.count("blank"), abstract, concrete, any(t.text == "func" for t in tokens(source)))]
    if kind == "imports":
        return [(path, target, alias, line, k) for k, (target, alias, line) in enumerate(imports(source))]
    if kind == "tokens":
        return [(path, t.line, t.column, t.text) for t in mutable_tokens(source)]
    rows = []
    for f in functions(source):
        nodes, prints = shape(f.body)
        rows.append((path, f.name, f.start_line, f.end_line, f.has_body, nodes, prints))
    return rows


SCHEMAS = {
    "lines": "path string, line long, class string",
    "functions": "path string, name string, start_line long, end_line long, has_body boolean, complexity long, total long, code long, comment long, blank long",
    "files": "path string, generated_marker boolean, header string, total long, code long, comment long, blank long, abstract_types long, concrete_types long, has_functions boolean",
    "imports": "path string, target string, alias string, line long, ord long",
    "tokens": "file string, line long, column long, original string",
    "shapes": "file string, name string, start_line long, end_line long, has_body boolean, nodes long, fingerprints array<string>",
}


def extract(files: DataFrame, kind: str) -> DataFrame:
    """Facts of one kind from ``files`` (path, content as text or bytes); a null content is an empty file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(files.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(SCHEMAS[kind]))
    make = partial(_facts, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in make(p, (c or "").replace("\r\n", "\n"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, SCHEMAS[kind])


def module_imports(found: DataFrame, module: str) -> DataFrame:
    """Imports of the module's own packages, each package once per file: of several declarations the last stands.

    The root of the module itself isn't one of its packages.
    """
    prefix = module.rstrip("/") + "/"
    own = found.filter(F.col("target").startswith(prefix)).withColumn("target_package", F.substring("target", F.lit(len(prefix) + 1), F.length("target")))
    return own.groupBy("path", "target_package").agg(F.max_by(F.struct("line", "alias"), "ord").alias("last")).select("path", "target_package", "last.line", "last.alias")
