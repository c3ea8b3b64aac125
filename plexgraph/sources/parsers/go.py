"""Go by a scanner: approximate, but tolerant of any input."""

from __future__ import annotations

import re

from plexgraph.sources.parsers.scan import Lines, bare_arguments, call, closing, masked, symbol

_FUNC = re.compile(r"(?m)^func\s+(?:\(\s*(?:(?P<var>\w+)\s+)?\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(")
_TYPE = re.compile(r"(?m)^(?:type\s+|\t)(?P<name>[A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(?P<kind>struct\s*\{|interface\s*\{|=?\s*[\w.*\[\]]+\s*$)")
_CALL = re.compile(r"(?P<receiver>(?:[A-Za-z_]\w*\.)*)(?P<name>[A-Za-z_]\w*)\(")
_WORDS = set("if for switch select func return go defer range case type struct interface map chan var const import package".split())
_PLAIN = set("any bool byte complex128 complex64 error float32 float64 int int16 int32 int64 int8 rune string uint uint16 uint32 uint64 uint8 uintptr".split())


def parse(content: str) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("symbols", "imports", "calls", "type_refs", "heritage", "exports", "variable_types")}
    text, lines = masked(content, "c"), Lines(content)
    heads: list[tuple[int, int]] = []
    if m := re.search(r"(?m)^package\s+(\w+)", text):
        line = lines.of(m.start())
        out["symbols"].append(symbol(m[1], "module", line, line, content, m[0]))
    for m in re.finditer(r"(?m)^import\s*(?:\(([^)]*)\)|(\w*\s*\"[^\"]*\"))", content):
        for alias, module in re.findall(r"(?m)([\w.]*)\s*\"([^\"]+)\"", m[1] or m[2] or ""):
            out["imports"].append({"module": module, "names": [], "is_relative": False, "alias": alias})
    for m in _TYPE.finditer(text):
        grouped = m[0].startswith("\t")
        if grouped and not re.search(r"(?m)^type\s*\([^)]*$", text[: m.start()].rpartition("\n)")[2]):
            continue
        kind = "class" if m["kind"].startswith("struct") else "interface" if m["kind"].startswith("interface") else "type_alias"
        brace = m.end() - 1 if m["kind"].endswith("{") else -1
        end = closing(text, brace) if brace >= 0 else m.end() - 1
        out["symbols"].append(symbol(m["name"], kind, lines.of(m.start("name")), lines.of(end), content, content[m.start() : brace if brace >= 0 else m.end()]))
        for field in text[brace + 1 : end].split("\n") if brace >= 0 else []:
            if e := re.fullmatch(r"\s*\*?(?:\w+\.)?([A-Z]\w*)\s*(?:`[^`]*`)?\s*", field):
                out["heritage"].append({"class_name": m["name"], "kind": "extends", "parent_name": e[1]})
            elif kind == "class" and (f := re.match(r"\s*(\w+)\s+[*\[\]]*(?:\w+\.)?([A-Z]\w*)", field)):
                out["type_refs"].append({"name": f[2], "kind": "variable", "line": lines.of(brace + 1), "param_name": f[1]})
    for m in _FUNC.finditer(text):
        close = closing(text, m.end() - 1, "()")
        brace = text.find("{", close)
        line_end = text.find("\n", close)
        brace = brace if 0 <= brace < (line_end if line_end >= 0 else len(text)) else -1
        end = closing(text, brace) if brace >= 0 else close
        stop = brace if brace >= 0 else close + 1
        out["symbols"].append(symbol(m["name"], "method" if m["owner"] else "function", lines.of(m.start()), lines.of(end), content, content[m.start() : stop], m["owner"] or ""))
        heads.append((m.start(), m.end()))
        if m["var"]:
            out["variable_types"].append({"var_name": m["var"], "type_name": m["owner"], "line": lines.of(m.start())})
        for name, kind in re.findall(r"(\w+)\s+[*\[\].]*(?:\w+\.)?([A-Za-z_]\w*)", text[m.end() : close]):
            if kind not in _PLAIN and kind not in _WORDS:
                out["type_refs"].append({"name": kind, "kind": "param", "line": lines.of(m.start()), "param_name": name})
                out["variable_types"].append({"var_name": name, "type_name": kind, "line": lines.of(m.start())})
        for kind in re.findall(r"[*\[\]\s(,]*(?:\w+\.)?([A-Za-z_]\w*)", text[close + 1 : stop]):
            if kind not in _PLAIN and kind not in _WORDS:
                out["type_refs"].append({"name": kind, "kind": "return", "line": lines.of(m.start()), "param_name": ""})
    for m in _CALL.finditer(text):
        if m["name"] not in _WORDS and not any(a <= m.start("name") < b for a, b in heads):
            out["calls"].append(call(m["name"], lines.of(m.start("name")), m["receiver"].rstrip("."), bare_arguments(text, m.end() - 1)))
    for m in re.finditer(r"(?:(\w+)\s*:?=\s*)?&?(?:\w+\.)?\b([A-Z]\w*)\{", text):
        out["calls"].append(call(m[2], lines.of(m.start(2))))
        if m[1]:
            out["variable_types"].append({"var_name": m[1], "type_name": m[2], "line": lines.of(m.start())})
    out["exports"] = [s["name"] for s in out["symbols"] if s["name"][:1].isupper()]
    out["calls"].sort(key=lambda c: c["line"])
    return out
