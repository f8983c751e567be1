"""A light reader of Java sources: methods, statements, expressions, oracles, usages, argument origins and argument values,
as tables. It knows strings, comments and brackets, not the grammar; what it cannot read it leaves out or marks UNKNOWN.
Files are read apart from each other, each in one row of a vectorised function, so the work spreads by file."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Words that start no method (fixed values).
KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "throw", "synchronized", "assert", "case", "super", "this"}
#: Calls that pass their only argument through (fixed values).
WRAPPERS = {"String.valueOf", "Integer.valueOf", "Long.valueOf", "Integer.parseInt", "Long.parseLong", "Double.parseDouble", "Boolean.parseBoolean", "Objects.requireNonNull", "Optional.of"}
KINDS = [("return", "RETURN"), ("throw", "THROW"), ("if", "IF"), ("else", "ELSE"), ("for", "FOR"), ("while", "WHILE"), ("do", "DO"),
    ("switch", "SWITCH"), ("try", "TRY"), ("catch", "CATCH"), ("break", "BREAK"), ("continue", "CONTINUE")]
DEPTH, BRANCHES = 15, 3


def masked(text: str) -> str:
    """The text with comments and the insides of literals blanked, places kept."""
    pattern = r'//[^\n]*|/\*.*?\*/|"""(?:.|\n)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''

    def blank(m):
        s = m[0]
        inner = "".join("\n" if c == "\n" else " " for c in s)
        return s[0] + inner[1:-1] + s[-1] if s[0] in "\"'" and len(s) > 1 else inner

    return re.sub(pattern, blank, text, flags=re.S)


def closing(mask: str, at: int, pair: str = "{}") -> int:
    """The place of the bracket that closes the one at a place; the end of the text if none does."""
    depth = 0
    for k in range(at, len(mask)):
        if mask[k] == pair[0]:
            depth += 1
        elif mask[k] == pair[1]:
            depth -= 1
            if depth == 0:
                return k
    return len(mask)


def split_top(text: str, mask: str, by: str = ",") -> list[str]:
    """Parts of a text at separators outside all brackets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(mask):
        if c in "([{<":
            depth += c != "<"
        elif c in ")]}>":
            depth -= c != ">"
        elif c == by and depth == 0:
            out.append(text[start:k].strip())
            start = k + 1
    tail = text[start:].strip()
    return [*out, tail] if tail or out else []


def scan_types(text: str, mask: str) -> list[tuple[str, str, int, int, list[str]]]:
    """(qualified name, kind, start, end, enum constants) of types; nested ones are joined by a dollar."""
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", mask)
    found = []
    for m in re.finditer(r"\b(class|interface|enum|record)\s+(\w+)[^{;]*\{", mask):
        found.append((m[2], m[1].upper(), m.start(), closing(mask, m.end() - 1), m.end()))
    out = []
    for name, kind, start, end, body in found:
        around = [n for n, _, s, e, _ in found if s < start and end < e]
        full = (package[1] + "." if package else "") + "$".join([*around, name])
        constants = re.findall(r"\b([A-Z][A-Z0-9_]*)\b", re.split(r";", mask[body:end], maxsplit=1)[0]) if kind == "ENUM" else []
        out.append((full, kind, start, end, constants))
    return out


def scan_methods(text: str) -> list[dict]:
    """Methods with bodies: fqn, name, params, annotations, doc, places and lines."""
    mask = masked(text)
    types = scan_types(text, mask)
    out = []
    for m in re.finditer(r"(?<![\w.])(?P<head>(?:@\w+(?:\([^)]*\))?\s+|\b(?:public|protected|private|static|final|abstract|synchronized|default)\s+)*)(?:<[^>{}]*>\s*)?(?P<type>\w[\w.$<>\[\], ?]*?)\s+(?P<name>\w+)\s*\((?P<params>[^(){}]*)\)\s*(?:throws[\w\s.,]+)?\{",
        mask):
        if m["name"] in KEYWORDS or m["type"].strip().split()[-1] in KEYWORDS:
            continue
        owner = max((t for t in types if t[2] < m.start() and m.end() <= t[3]), key=lambda t: t[2], default=None)
        if owner is None:
            continue
        open_ = m.end() - 1
        end = closing(mask, open_)
        params = [p.rsplit(None, 1) for p in split_top(text[m.start("params") : m.end("params")], m["params"]) if p]
        doc = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*$", text[: m.start()], re.S)
        out.append({
            "fqn": f"{owner[0]}.{m['name']}", "name": m["name"], "signature": f"{m['type'].strip()}({','.join(p[0].split()[-1] for p in params if len(p) == 2)})",
            "params": [p[-1] for p in params], "annotations": re.findall(r"@(\w+)", m["head"]), "static": " static " in f" {m['head']} ", "doc": doc[1] if doc else None,
            "start": m.start() + len(m[0]) - len(m[0].lstrip()), "open": open_, "end": end, "line_start": text.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1, "line_end": text.count("\n", 0, end) + 1,
        })
    return out


def statements(text: str, mask: str, start: int, end: int, parent: int = -1, branch: str = "body", out: list | None = None) -> list[dict]:
    """Statements of a block, in order: kind, places, parent ordinal and branch."""
    out = [] if out is None else out
    k = start
    while k < end:
        if mask[k] in " \t\r\n;":
            k += 1
            continue
        if mask[k] == "{":
            close = closing(mask, k)
            statements(text, mask, k + 1, close, parent, branch, out)
            k = close + 1
            continue
        word = re.match(r"\w+", mask[k:end])
        kind = dict(KINDS).get(word[0] if word else "", None)
        own = {"ordinal": len(out), "parent": parent, "branch": branch, "start": k}
        if kind in ("IF", "FOR", "WHILE", "SWITCH", "CATCH"):
            out.append(own)
            paren = mask.find("(", k, end)
            head = closing(mask, paren, "()") + 1 if paren >= 0 else end
            if kind == "FOR" and ":" in mask[paren:head] and ";" not in mask[paren:head]:
                kind = "FOREACH"
            body, last = _body(mask, head, end)
            own |= {"kind": kind, "end": head}
            if kind != "SWITCH":
                statements(text, mask, *body, own["ordinal"], "then", out)
            k = last
            other = re.match(r"\s*else\b", mask[k:end]) if kind == "IF" else None
            if other:
                body, last = _body(mask, k + other.end(), end)
                statements(text, mask, *body, own["ordinal"], "else", out)
                k = last
        elif kind in ("TRY", "DO", "ELSE"):
            out.append(own)
            head = mask.find("{", k, end)
            close = closing(mask, head) if head >= 0 else end
            own |= {"kind": kind, "end": head if head >= 0 else end}
            statements(text, mask, head + 1, close, own["ordinal"], "then", out)
            k = close + 1
            if kind == "DO":
                k = mask.find(";", k, end) + 1 or end
        else:
            stop = _statement_end(mask, k, end)
            code = text[k:stop]
            if kind is None:
                kind = "DECL" if re.match(r"(?:final\s+)?[\w.$<>\[\], ?]+\s+\w+\s*(=|$)", code) and not re.match(r"\w+\s*=", code) else "EXPR"
            out.append(own | {"kind": kind, "end": stop})
            k = stop + 1
    return out


def _statement_end(mask: str, k: int, end: int) -> int:
    depth = 0
    for i in range(k, end):
        if mask[i] in "([{":
            depth += 1
        elif mask[i] in ")]}":
            depth -= 1
        elif mask[i] == ";" and depth <= 0:
            return i
    return end


def _body(mask: str, k: int, end: int) -> tuple[tuple[int, int], int]:
    """((start, end), place after) of a block or single statement."""
    while k < end and mask[k] in " \t\r\n":
        k += 1
    if k < end and mask[k] == "{":
        close = closing(mask, k)
        return (k + 1, close), close + 1
    stop = _statement_end(mask, k, end)
    inner = re.match(r"(if|for|while)\b", mask[k:end])
    if inner:
        paren = mask.find("(", k, end)
        _, stop = _body(mask, closing(mask, paren, "()") + 1, end)
    return (k, stop + 1), stop + 1


def calls(text: str, mask: str, start: int, end: int) -> list[dict]:
    """Calls in a range: scope, name, arguments and places."""
    out = []
    for m in re.finditer(r"(?P<new>\bnew\s+)?(?P<scope>(?:[\w$]+(?:\([^()]*\))?\s*\.\s*)*)(?P<name>[A-Za-z_]\w*)\s*\(", mask[start:end]):
        if m["name"] in KEYWORDS:
            continue
        open_ = start + m.end() - 1
        close = closing(mask, open_, "()")
        out.append({"name": m["name"], "scope": re.sub(r"\s", "",
            text[start + m.start("scope") : start + m.end("scope")]).rstrip("."), "new": bool(m["new"]),
            "args": split_top(text[open_ + 1 : close], mask[open_ + 1 : close]), "start": start + m.start("name"),
            "end": close + 1})
    return out


def is_literal(expr: str) -> bool:
    return bool(re.fullmatch(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])+\'|[-+!]?(?:\d[\d_]*(?:\.\d+)?[lLfFdD]?|0[xX][0-9a-fA-F]+|true|false)|null', expr.strip()))


def origin(expr: str, params: list[str], locals_: set[str], loops: set[str]) -> str:
    """Where an argument comes from."""
    e = expr.strip()
    if is_literal(e):
        return "LITERAL"
    if re.fullmatch(r"\w+", e):
        return "LOOP_VAR" if e in loops else "PARAMETER" if e in params else "LOCAL_VAR" if e in locals_ else "FIELD"
    if re.match(r"new\b", e):
        return "CONSTRUCTOR"
    if re.fullmatch(r"[\w.$]+\[.*\]", e, re.S):
        return "INDEXED_ACCESS"
    if re.fullmatch(r"[A-Z][\w.$]*\.\w+\(.*\)", e, re.S):
        return "FACTORY_CALL"
    if re.fullmatch(r"(?:[\w$]+\.)*\w+\(.*\)", e, re.S):
        return "METHOD_CALL"
    if re.fullmatch(r"[\w$]+(?:\.[\w$]+)+", e):
        return "FIELD_ACCESS"
    return "UNKNOWN"


def resolve(expr: str, text: str, mask: str, method: dict, chain: list[tuple[str, str, dict]], at: int, depth: int = 0) -> tuple[str, str]:
    """(kind, value) of an expression: a constant, a derivation, a union of branches, or why it is unresolved. `chain` has
    (text, mask, method) of callers, innermost last. Later definitions before the place win, assignments over declarations."""
    e = expr.strip()
    deeper = lambda x, where=at: resolve(x, text, mask, method, chain, where, depth + 1)
    if depth > DEPTH:
        return "UNRESOLVED", "DEPTH_LIMIT"
    if is_literal(e):
        return "RESOLVED", e
    em = masked(e)
    if e.startswith("(") and closing(em, 0, "()") == len(e) - 1:
        return deeper(e[1:-1])
    if cast := re.match(r"\(\s*[\w.$<>\[\]]+\s*\)\s*(?=[\w\"'(])", em):
        return deeper(e[cast.end() :])
    if "?" in em and len(parts := split_top(e, em, "?")) == 2 and len(arms := split_top(parts[1], masked(parts[1]), ":")) == 2:
        kind, value = deeper(parts[0])
        if kind == "RESOLVED" and value in ("true", "false"):
            return deeper(arms[0] if value == "true" else arms[1])
        sides = [deeper(a) for a in arms]
        flat = [v for k, x in sides for v in (x.split(" | ") if k == "BRANCH_UNION" else [x])]
        return ("UNRESOLVED", "BRANCH_EXPLOSION") if len(flat) > BRANCHES else ("BRANCH_UNION", " | ".join(flat))
    for ops in ("+-", "*/%"):
        for k in range(len(em) - 1, 0, -1):
            if em[k] in ops and em[k - 1] not in "+-*/%=<>!&|(,eE" and all(em[:k].count(a) == em[:k].count(b) for a,
                b in ("()", "[]", "{}")) and em[k : k + 2] not in ("++", "--") and em[:k].strip():
                (lk, lv), (rk, rv) = deeper(e[:k]), deeper(e[k + 1 :])
                if lk == rk == "RESOLVED" and (out := fold(lv, em[k], rv)) is not None:
                    return "RESOLVED", out
                return "DERIVED", f"{'CONCATENATION' if em[k] == '+' else 'BINARY_OP'}({lv}, {rv})"
    if re.fullmatch(r"\w+", e):
        body = mask[method["open"] : at]
        if loop := re.search(rf"\bfor\s*\([^;:)]*\b{e}\s*=\s*([^;]*);([^;]*);", body):
            open_ = method["open"] + loop.end()
            if at <= _body(mask, closing(mask, method["open"] + loop.start() + loop[0].index("("), "()") + 1, method["end"])[1] or at < open_:
                return "LOOP_VAR", f"{loop[1].strip()} < ... {loop[2].strip()}"
        declared = [m for m in re.finditer(rf"[\w>\]]\s+{e}\s*=(?!=)\s*", body)]
        assigned = [m for m in re.finditer(rf"(?<![\w.>\] ]) *\b{e}\s*=(?!=)\s*", body) if m not in declared]
        if last := (assigned or declared or [None])[-1]:
            start = method["open"] + last.end()
            return deeper(text[start : _statement_end(mask, start, method["end"])], start)
        if e in method["params"]:
            if not chain:
                return "UNRESOLVED", "ENTRY_POINT_REACHED"
            ctext, cmask, caller = chain[-1]
            site = next((c for c in calls(ctext, cmask, caller["open"], caller["end"]) if c["name"] == method["name"]), None)
            i = method["params"].index(e)
            if site is None or i >= len(site["args"]):
                return "UNRESOLVED", "NOT_FOUND"
            kind, value = resolve(site["args"][i], ctext, cmask, caller, chain[:-1], site["start"], depth + 1)
            return "PARAM_FROM_CALLER" if kind != "RESOLVED" else kind, value
        return "UNRESOLVED", "NOT_FOUND"
    if re.match(r"new\b[^({\[]*\(", em) or re.match(r"new\b.*\{", em, re.S) or e.startswith("{"):
        open_ = next(k for k, c in enumerate(em) if c in "({")
        inner = split_top(e[open_ + 1 : closing(em, open_, em[open_] + {"(": ")", "{": "}"}[em[open_]])],
            em[open_ + 1 : closing(em, open_, em[open_] + {"(": ")", "{": "}"}[em[open_]])])
        return "DERIVED", ("ARRAY_LITERAL" if em[open_] == "{" else "OBJECT_CREATION") + f"({', '.join(deeper(x)[1] for x in inner)})"
    if call := re.fullmatch(r"((?:[\w$]+\.)*\w+)\s*\((.*)\)", e, re.S):
        args = split_top(call[2], masked(call[2]))
        if call[1] in WRAPPERS and len(args) == 1:
            return deeper(args[0])
        if call[1].endswith((".invoke", ".forName")) or call[1] in ("Field.get", "Field.set"):
            return "UNRESOLVED", "REFLECTION"
        return "UNRESOLVED", "METHOD_CALL"
    if index := re.fullmatch(r"([\w.$]+)\[(.*)\]", e, re.S):
        return "DERIVED", f"ARRAY_ACCESS({deeper(index[1])[1]}, {deeper(index[2])[1]})"
    if re.fullmatch(r"[\w$]+(?:\.[\w$]+)+", e):
        return "UNRESOLVED", "FIELD_READ"
    return "UNRESOLVED", "COMPLEX_EXPR" if "->" in e else "UNSUPPORTED"


def fold(a: str, op: str, b: str) -> str | None:
    """Joins text and folds numbers, which count as integers; nothing for other operands or a zero divisor."""
    if op == "+" and (a.startswith('"') or b.startswith('"')):
        bare = lambda x: x[1:-1] if x[:1] in "\"'" else x
        return f'"{bare(a)}{bare(b)}"'
    try:
        x, y = (int(float(v.rstrip("lLfFdD").replace("_", ""))) for v in (a, b))
    except ValueError:
        return None
    if op in "/%" and y == 0:
        return None
    q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1) if op in "/%" else 0  # towards zero
    return str({"+": x + y, "-": x - y, "*": x * y, "/": q, "%": x - q * y if op in "/%" else 0}[op])


def oracles(text: str, mask: str, method: dict) -> list[dict]:
    """What a test asserts; an exception caught and looked at counts as one."""
    out, caught = [], []
    none = {"expected": None, "expr": None, "type": None, "match_kind": None, "message": None, "flag": None}
    for m in re.finditer(r"\bcatch\s*\(\s*(?:final\s+)?([\w.$|\s]+?)\s+(\w+)\s*\)\s*\{", mask[method["open"] : method["end"]]):
        open_ = method["open"] + m.end() - 1
        close = closing(mask, open_)
        caught.append((open_, close))
        kind = {"kind": "EXCEPTION", "type": m[1].split(".")[-1].strip()}
        for c in calls(text, mask, open_, close):
            got = f"{m[2]}.getMessage()"
            if c["name"] == "assertEquals" and got in c["args"] and (lit := [a for a in c["args"] if a.startswith('"')]):
                kind |= {"kind": "EXCEPTION_MESSAGE", "match_kind": "EXACT", "message": lit[0][1:-1]}
                break
            if c["name"] == "assertTrue" and c["args"] and (inner := re.fullmatch(re.escape(got) + r'\.contains\("(.*)"\)', c["args"][0])):
                kind |= {"kind": "EXCEPTION_MESSAGE", "match_kind": "CONTAINS", "message": inner[1]}
                break
        out.append(none | kind)
    for c in calls(text, mask, method["open"], method["end"]):
        a, inside = c["args"], any(s < c["start"] < e for s, e in caught)
        if inside and c["name"] in ("assertEquals", "assertTrue", "assertFalse"):
            continue
        if c["name"] == "assertEquals" and len(a) >= 2:
            swap = is_literal(a[1]) and not is_literal(a[0])
            out.append(none | {"kind": "EQUALS", "expected": a[1] if swap else a[0], "expr": a[0] if swap else a[1]})
        elif c["name"] == "assertThrows" and a and a[0].endswith(".class"):
            out.append(none | {"kind": "EXCEPTION", "type": a[0].removesuffix(".class").split(".")[-1]})
        elif c["name"] in ("assertTrue", "assertFalse") and a:
            out.append(none | {"kind": "BOOLEAN", "expr": a[0], "flag": c["name"] == "assertTrue"})
        elif c["name"] in ("assertNull", "assertNotNull") and a:
            out.append(none | {"kind": "NULLABILITY", "expr": a[0], "flag": c["name"] == "assertNotNull"})
        elif c["name"] == "assertThat" and len(a) >= 2:
            if m := re.fullmatch(r'containsString\("(.*)"\)', a[1]):
                out.append(none | {"kind": "CONTAINS", "expected": m[1], "expr": a[0]})
            elif m := re.fullmatch(r"equalTo\((.*)\)", a[1]):
                out.append(none | {"kind": "EQUALS", "expected": m[1], "expr": a[0]})
    return out or [none | {"kind": "NONE"}]


def usages(text: str, mask: str, method: dict, callee: str) -> list[tuple[str, str | None]]:
    """(kind, field) of what a method does with the results of calls of a name."""
    out: set[tuple[str, str | None]] = set()
    for c in calls(text, mask, method["open"], method["end"]):
        if c["name"] != callee:
            continue
        begin = c["start"] - (len(c["scope"]) + 1 if c["scope"] else 0)
        before, after = mask[method["open"] + 1 : begin], mask[c["end"] : method["end"]]
        line = re.split(r"[;{}]", before)[-1].strip()
        if m := re.match(r"\s*\.\s*(\w+)\s*(\()?", after):
            out.add(("METHOD_CALL_ON_RESULT", None) if m[2] else ("FIELD_READ", m[1]))
        elif re.search(r"\breturn$", line):
            out.add(("RETURNED_UNCHANGED", None))
        elif re.search(r"\b(if|while|for)\s*\($|[&|!=<>]=?\s*$", line) and re.search(r"\b(if|while|for)\b", line):
            out.add(("USED_IN_CONDITION" if re.search(r"\bif\b", line) else "USED_IN_LOOP", None))
        elif re.search(r"\w\s*\[\s*$", line):
            out.add(("USED_IN_INDEX_EXPR", None))
        elif m := re.search(r"(?:^|\s)(?:[\w.<>\[\]]+\s+)?((?:this\.)?\w+)\s*=\s*$", line):
            local = re.search(r"[\w>\]]\s+\w+\s*=\s*$", line)
            out.add(("ASSIGNED_TO_LOCAL" if local else "ASSIGNED_TO_FIELD" if m[1].startswith("this.") else "ASSIGNED_TO_LOCAL", None))
            out |= {("FIELD_READ", f) for f, call in re.findall(rf"\b{re.escape(m[1])}\.(\w+)\s*(\()?", after) if not call}
            if re.search(rf"\b{re.escape(m[1])}\.\w+\s*\(", after):
                out.add(("METHOD_CALL_ON_RESULT", None))
        elif re.search(r"[(,]\s*$", line):
            out.add(("PASSED_AS_ARG", None))
        elif not line:
            out.add(("DISCARDED", None))
    return sorted(out, key=str)


def caught_around(mask: str, method: dict, callee: str) -> list[str]:
    """Types caught by a try whose block holds a call of a name."""
    out: set[str] = set()
    for m in re.finditer(r"\btry\b[^{]*\{", mask[method["open"] : method["end"]]):
        open_ = method["open"] + m.end() - 1
        close = closing(mask, open_)
        if re.search(rf"\b{callee}\s*\(", mask[open_:close]):
            at = close + 1
            while c := re.match(r"\s*catch\s*\(\s*(?:final\s+)?([\w.$|\s]+?)\s+\w+\s*\)\s*\{", mask[at:]):
                out |= {t.strip().split(".")[-1] for t in c[1].split("|")}
                at = closing(mask, at + c.end() - 1) + 1
    return sorted(out)


def _table(files: DataFrame, schema: str, rows) -> DataFrame:
    """Rows of each file (file, content) by a function of (file, text, mask, methods)."""

    def read(batches) -> Iterator:
        import pandas as pd

        names = [x.split()[0] for x in re.split(r", (?![^<]*>)", schema)]
        for pdf in batches:
            out = []
            for file, text in zip(pdf["file"], pdf["content"]):
                text = text or ""
                out += rows(file, text, masked(text), scan_methods(text))
            yield pd.DataFrame(out, columns=names, dtype=object)

    return files.select("file", "content").mapInPandas(read, schema)


def methods_table(files: DataFrame) -> DataFrame:
    """Methods with lines, documentation and whether they are annotated as tests."""
    schema = "fqn string, signature string, file string, line_start int, line_end int, javadoc string, is_test boolean, is_static boolean, text string"
    tests = {"Test", "ParameterizedTest", "RepeatedTest", "TestFactory", "TestTemplate"}
    return _table(files, schema, lambda file, text, mask,
        ms: [(m["fqn"], m["signature"], file, m["line_start"], m["line_end"], m["doc"], bool(tests & set(m["annotations"])),
        m["static"], text[m["start"] : m["end"] + 1]) for m in ms])


def types_table(files: DataFrame) -> DataFrame:
    schema = "fqn string, kind string, file string, line_start int, line_end int, enum_constants array<string>"
    return _table(files, schema, lambda file, text, mask,
        ms: [(n, k, file, text.count("\n", 0, s) + 1, text.count("\n", 0, e) + 1, c) for n, k, s, e, c in scan_types(text, mask)])


def statements_table(files: DataFrame) -> DataFrame:
    """Statements with block structure, for control flow."""
    schema = "method string, ordinal int, kind string, parent int, branch string, line_start int, line_end int, text string"

    def rows(file, text, mask, ms):
        line = lambda k: text.count("\n", 0, k) + 1
        return [(m["fqn"], s["ordinal"], s["kind"], s["parent"], s["branch"], line(s["start"]), line(max(s["start"], s["end"] - 1)),
            text[s["start"] : s["end"]].strip()) for m in ms for s in statements(text, mask, m["open"] + 1, m["end"])]

    return _table(files, schema, rows)


def expressions_table(files: DataFrame) -> DataFrame:
    """Parameters, definitions, uses, calls, literals, predicates and return values by statement."""
    schema = "method string, stmt_ordinal int, kind string, name string, text string, line int, col int"

    def rows(file, text, mask, ms):
        out = []
        for m in ms:
            place = lambda k: (text.count("\n", 0, k) + 1, k - text.rfind("\n", 0, k))
            out += [(m["fqn"], -1, "PARAM", p, p, *place(m["start"])) for p in m["params"]]
            names = set(m["params"])
            for s in statements(text, mask, m["open"] + 1, m["end"]):
                code, begin = mask[s["start"] : s["end"]], s["start"]
                defined = None
                if d := re.match(r"(?:for\s*\(\s*)?(?:final\s+)?[\w.$<>\[\], ?]+?\s+(\w+)\s*[=:]", code) if s["kind"] in ("DECL", "FOR", "FOREACH") else None:
                    defined = d[1]
                    names.add(defined)
                    out.append((m["fqn"], s["ordinal"], "LOCAL_DEF", defined, defined, *place(begin + d.start(1))))
                for w in re.finditer(r"(?<![\w.\"])([A-Za-z_]\w*)\b(?!\s*\()", code):
                    if w[1] in names and not (w[1] == defined and d and w.start() == d.start(1)):
                        out.append((m["fqn"], s["ordinal"], "LOCAL_USE", w[1], w[1], *place(begin + w.start())))
                out += [(m["fqn"], s["ordinal"], "CALLSITE", c["name"], text[c["start"] : c["end"]],
                    *place(c["start"])) for c in calls(text, mask, begin, s["end"])]
                out += [(m["fqn"], s["ordinal"], "LITERAL", None, text[begin + w.start() : begin + w.end()],
                    *place(begin + w.start())) for w in re.finditer(r'"[^"\n]*"|\b\d[\w.]*\b', code)]
                out += [(m["fqn"], s["ordinal"], "FIELD_REF", w[1], w[0], *place(begin + w.start())) for w in re.finditer(r"\bthis\.(\w+)\b(?!\s*\()", code)]
                if s["kind"] in ("IF", "FOR", "WHILE", "FOREACH", "SWITCH"):
                    out.append((m["fqn"], s["ordinal"], "BRANCH_PREDICATE", None, text[begin : s["end"]].strip(), *place(begin)))
                if s["kind"] == "RETURN" and code.strip() != "return":
                    out.append((m["fqn"], s["ordinal"], "RETURN_VALUE", None, text[begin + 6 : s["end"]].strip(), *place(begin)))
        return out

    return _table(files, schema, rows)


def oracles_table(files: DataFrame) -> DataFrame:
    """What each method asserts; `priority` orders them, the least is the primary one."""
    from ..schema import ORACLE_PRIORITY

    schema = "test string, kind string, expected string, expr string, type string, match_kind string, message string, flag boolean, priority int"
    return _table(files, schema, lambda file, text, mask,
        ms: [(m["fqn"], o["kind"], o["expected"], o["expr"], o["type"], o["match_kind"], o["message"], o["flag"],
        ORACLE_PRIORITY.index(o["kind"])) for m in ms for o in oracles(text, mask, m)])


def usages_table(files: DataFrame, callee: str) -> DataFrame:
    """(consumer, kind, field) of the results of calls of a name."""
    return _table(files, "consumer string, kind string, field string", lambda file, text, mask,
        ms: [(m["fqn"], k, f) for m in ms for k, f in usages(text, mask, m, callee)])


def catches_table(files: DataFrame, callee: str) -> DataFrame:
    """(consumer, type) of exceptions caught around calls of a name."""
    return _table(files, "consumer string, type string", lambda file, text, mask, ms: [(m["fqn"], t) for m in ms for t in caught_around(mask, m, callee)])


def arguments_table(files: DataFrame, callee: str) -> DataFrame:
    """(method, line, arg_index, text, origin, kind, value) of each argument of calls of a name, resolved within its file."""
    schema = "method string, line int, arg_index int, text string, origin string, kind string, value string"

    def rows(file, text, mask, ms):
        out = []
        for m in ms:
            body = mask[m["open"] : m["end"]]
            locals_ = set(re.findall(r"[\w>\]]\s+(\w+)\s*=(?!=)", body))
            loops = set(re.findall(r"\bfor\s*\(\s*[\w<>\[\] ]+\s+(\w+)\s*[=:]", body))
            chain = [(text, mask, c) for c in ms if c is not m and any(x["name"] == m["name"] for x in calls(text, mask, c["open"], c["end"]))][:1]
            for c in calls(text, mask, m["open"], m["end"]):
                if c["name"] == callee:
                    out += [(m["fqn"], text.count("\n", 0, c["start"]) + 1, i, a, origin(a, m["params"], locals_, loops),
                        *resolve(a, text, mask, m, chain, c["start"])) for i, a in enumerate(c["args"])]
        return out

    return _table(files, schema, rows)


def snippet(text: str, line: int, most: int = 12) -> tuple[str, bool]:
    """(code, cut) around a call's line: backward from it over the statements that define what it uses, its enclosing
    headers, and forward to assertions; gaps are marked. The lines around it if no method holds it."""
    mask = masked(text)
    rows = text.split("\n")
    m = next((m for m in scan_methods(text) if m["line_start"] <= line <= m["line_end"]), None)
    at = lambda k: text.count("\n", 0, k) + 1
    own = statements(text, mask, m["open"] + 1, m["end"]) if m else []
    here = max((k for k, s in enumerate(own) if at(s["start"]) <= line <= at(max(s["start"], s["end"] - 1))), default=None)
    if here is None:
        low = max(1, line - 3)
        return "\n".join(rows[low - 1 : line + 2]), False
    wanted, names = {here}, set(re.findall(r"\b[a-z_]\w*\b", mask[own[here]["start"] : own[here]["end"]]))
    cut = False
    for k in range(here - 1, -1, -1):
        code = mask[own[k]["start"] : own[k]["end"]]
        if (d := re.search(r"\b(\w+)\s*=(?!=)", code)) and d[1] in names:
            if len(wanted) >= most:
                cut = True
                break
            wanted.add(k)
            names |= set(re.findall(r"\b[a-z_]\w*\b", code[d.end() :]))
    up = own[here]["parent"]
    while up >= 0:
        wanted.add(up)
        up = own[up]["parent"]
    for k in range(here + 1, len(own)):
        if re.search(r"\b(assert|expect|verify|assume)\w*\s*\(|\bfail\s*\(", mask[own[k]["start"] : own[k]["end"]]):
            wanted.add(k)
    lines: list[int] = []
    for k in sorted(wanted):
        s = own[k]
        lines += range(at(s["start"]), at(max(s["start"], s["end"] - 1)) + 1)
    out, last = [], None
    for n in sorted(set(lines)):
        if last is not None and n > last + 1:
            out.append("// ...")
        out.append(rows[n - 1])
        last = n
    return "\n".join(out), cut


def snippets_table(files: DataFrame, wanted: DataFrame, most: int = 12) -> DataFrame:
    """(key, code, cut) for rows (key, file, line)."""

    def read(batches) -> Iterator:
        for pdf in batches:
            found = [snippet(t or "", int(n), most) for t, n in zip(pdf["content"], pdf["line"])]
            yield pdf.assign(code=[a for a, _ in found], cut=[b for _, b in found])[["key", "code", "cut"]].astype(object)

    return wanted.join(files, "file").select("key", "content", "line").mapInPandas(read, "key string, code string, cut boolean")


def leak_sweep(answer: DataFrame, elsewhere: DataFrame, output: DataFrame, least: int = 25) -> DataFrame:
    """(file, text): distinctive lines of the answer (text), those that no other source line (text) has, found in output lines
    (file, text). Equality joins on trimmed lines."""
    from pyspark.sql import functions as F

    clean = lambda df: df.withColumn("text", F.trim("text"))
    marks = clean(answer).select("text").where(F.length("text") > least).distinct().join(clean(elsewhere).select("text").distinct(), "text", "left_anti")
    return clean(output).join(marks, "text", "left_semi").select("file", "text").distinct()


def replaced_body(text: str, name: str, body: str) -> str:
    """The source with one method's body replaced."""
    m = next((m for m in scan_methods(text) if m["name"] == name), None)
    if m is None:
        raise ValueError(f"no method {name}")
    return text[: m["open"] + 1] + "\n" + body.rstrip() + "\n" + text[m["end"] :]


def consumer_body(text: str, name: str, callee: str, whole: int = 30) -> str:
    """A caller's body: in full up to `whole` statements, else the statements that call, return, throw or break."""
    mask = masked(text)
    m = next((m for m in scan_methods(text) if m["name"] == name), None)
    if m is None:
        return ""
    own = statements(text, mask, m["open"] + 1, m["end"])
    if len(own) <= whole:
        return text[m["start"] : m["end"] + 1]
    kept = [s for s in own if s["kind"] in ("RETURN", "THROW", "BREAK") or re.search(rf"\b{callee}\s*\(", mask[s["start"] : s["end"]])]
    return "\n// ...\n".join(text[s["start"] : s["end"]].strip() for s in kept)


def test_region(text: str, name: str, whole: int = 20) -> str:
    """A test's body: in full up to `whole` statements, else the last ones."""
    mask = masked(text)
    m = next((m for m in scan_methods(text) if m["name"] == name), None)
    if m is None:
        return ""
    own = statements(text, mask, m["open"] + 1, m["end"])
    if len(own) <= whole:
        return text[m["start"] : m["end"] + 1]
    return "// ...\n" + "\n".join(text[s["start"] : s["end"]].strip() for s in own[-whole:])


def bodies_table(files: DataFrame, callee: str) -> DataFrame:
    """(method, consumer_body, test_region) of methods that call a name."""

    def rows(file, text, mask, ms):
        return [(m["fqn"], consumer_body(text, m["name"], callee),
            test_region(text, m["name"])) for m in ms if any(c["name"] == callee for c in calls(text, mask, m["open"], m["end"]))]

    return _table(files, "method string, consumer_body string, test_region string", rows)
