"""TypeScript and JavaScript by a scanner: approximate, but tolerant of any input."""

from __future__ import annotations

import re

from plexgraph.sources.parsers.scan import Lines, bare_arguments, call, closing, masked, symbol

_DECLARATION = re.compile(
    r"(?P<export>\bexport\s+(?:default\s+)?)?(?:\b(?:declare|abstract|async)\s+)*\b(?:"
    r"(?P<class>class)\s+(?P<cname>[A-Za-z_$][\w$]*)(?P<heritage>[^{;]*)\{"
    r"|function\s*\*?\s*(?P<fname>[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\("
    r"|interface\s+(?P<iname>[A-Za-z_$][\w$]*)(?P<iheritage>[^{;]*)\{"
    r"|type\s+(?P<tname>[A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="
    r"|enum\s+(?P<ename>[A-Za-z_$][\w$]*)\s*\{"
    r"|(?:const|let|var)\s+(?P<vname>[A-Za-z_$][\w$]*)\s*(?::[^=;]*)?=\s*(?:async\s*)?(?P<arrow>\([^;{}]*?\)\s*(?::[^=;{]*)?=>|[A-Za-z_$][\w$]*\s*=>|function\b)"
    r")"
)
_METHOD = re.compile(r"(?m)^\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^>(]*>)?\((?P<args>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::[^{;]*)?\{")
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<receiver>(?:[A-Za-z_$][\w$]*\.)*)(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[\w\s,.\[\]|]*>)?\(")
_WORDS = set("if for while switch catch function return typeof super import await async constructor of in new else do try with yield void delete".split())
_PLAIN_TYPES = set("any bigint boolean never null number object string symbol undefined unknown void this Promise Array Record Partial Readonly Map Set".split())
_IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(?P<what>[^'\";]+?)\s+from\s+)?['\"](?P<module>[^'\"]+)['\"]|export\s+(?P<again>\*|\{[^}]*\})\s*(?:as\s+\w+\s+)?from\s+['\"](?P<module2>[^'\"]+)['\"]|(?:const|let|var)\s+(?P<req>[\w$]+|\{[^}]*\})\s*=\s*require\(\s*['\"](?P<module3>[^'\"]+)['\"]|import\(\s*['\"](?P<module4>[^'\"]+)['\"]")


def _names(text: str | None) -> list[str]:
    text = (text or "").strip()
    if not text:
        return []
    if text.startswith("*"):
        return ["*"]
    inside = re.search(r"\{([^}]*)\}", text)
    names = [re.split(r"\s+as\s+|:", n.strip().removeprefix("type "))[0].strip() for n in inside[1].split(",")] if inside else []
    first = re.match(r"[\w$]+", text)
    return ([first[0]] if first else []) + [n for n in names if n]


def parse(content: str) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("symbols", "imports", "calls", "type_refs", "heritage", "exports", "variable_types")}
    text, lines = masked(content, "c"), Lines(content)
    inside: list[tuple[int, int]] = []

    def add(name: str, kind: str, start: int, brace: int, class_name: str = "") -> int:
        end = closing(text, brace) if brace >= 0 else (text.find(";", start) if text.find(";", start) >= 0 else len(text) - 1)
        stop = brace if brace >= 0 else min(end, start + 200)
        first = start + len(text[start:]) - len(text[start:].lstrip())
        out["symbols"].append(symbol(name, kind, lines.of(first), lines.of(max(first, end)), content, content[first:stop], class_name))
        return end

    for m in _DECLARATION.finditer(text):
        start = m.start()
        if m["class"]:
            end = add(m["cname"], "class", start, m.end() - 1)
            for kind, pattern in (("extends", r"\bextends\s+([\w$.]+)"), ("implements", r"\bimplements\s+([\w$.,\s<>]+)")):
                for found in re.findall(pattern, m["heritage"]):
                    for parent in re.sub(r"<[^>]*>", "", found).split(","):
                        if parent.strip():
                            out["heritage"].append({"class_name": m["cname"], "kind": kind, "parent_name": parent.strip().rsplit(".", 1)[-1]})
            for k in _METHOD.finditer(text, m.end(), end):
                if k["name"] not in _WORDS - {"constructor"} and text.count("{", m.end(), k.start("name")) == text.count("}", m.end(), k.start("name")):
                    add(k["name"].lstrip("#"), "method", k.start("name"), k.end() - 1, m["cname"])
                    inside.append((k.start("name"), k.end()))
            name = m["cname"]
        elif m["iname"]:
            add(m["iname"], "interface", start, m.end() - 1)
            for parent in re.findall(r"[\w$.]+", (m["iheritage"] or "").partition("extends")[2]):
                out["heritage"].append({"class_name": m["iname"], "kind": "extends", "parent_name": parent.rsplit(".", 1)[-1]})
            name = m["iname"]
        elif m["ename"]:
            add(m["ename"], "enum", start, m.end() - 1)
            name = m["ename"]
        elif m["tname"]:
            add(m["tname"], "type_alias", start, -1)
            name = m["tname"]
        elif m["fname"]:
            close = closing(text, m.end() - 1, "()")
            add(m["fname"], "function", start, text.find("{", close))
            inside.append((m.start("fname"), m.end()))
            name = m["fname"]
        else:
            body = re.compile(r"\s*\{").match(text, m.end())
            brace = body.end() - 1 if body else text.find("{", m.end()) if m["arrow"] == "function" else -1
            add(m["vname"], "function", start, brace)
            name = m["vname"]
        if m["export"]:
            out["exports"].append(name)
    for m in re.finditer(r"\bexport\s*\{([^}]*)\}(?!\s*from)", text):
        out["exports"] += [re.split(r"\s+as\s+", n.strip())[0] for n in m[1].split(",") if n.strip()]
    for m in re.finditer(r"\bexport\s+default\s+([A-Za-z_$][\w$]*)\s*;|module\.exports\s*=\s*([A-Za-z_$][\w$]*)", text):
        out["exports"].append(m[1] or m[2])
    for m in _IMPORT.finditer(content):
        module = m["module"] or m["module2"] or m["module3"] or m["module4"]
        out["imports"].append({"module": module, "names": _names(m["what"] or m["again"] or m["req"]), "is_relative": module.startswith("."), "alias": ""})
    for m in _CALL.finditer(text):
        if m["name"] in _WORDS or any(a <= m.start("name") < b for a, b in inside):
            continue
        out["calls"].append(call(m["name"], lines.of(m.start("name")), m["receiver"].rstrip("."), bare_arguments(text, m.end() - 1)))
    for m in re.finditer(r"<([A-Z][\w$.]*)[\s/>]", text):
        out["calls"].append(call(m[1].rsplit(".", 1)[-1], lines.of(m.start())))
    for m in re.finditer(r"[{,]\s*([A-Za-z_$][\w$]*)\s*(?=[,}])", text):
        out["calls"].append(call(m[1], lines.of(m.start(1)), weak=True))
    for m in re.finditer(r"([A-Za-z_$][\w$]*)\??\s*:\s*([A-Za-z_$][\w$.]*)", text):
        name = m[2].rsplit(".", 1)[-1]
        if name not in _PLAIN_TYPES and name[:1].isupper():
            out["type_refs"].append({"name": name, "kind": "param" if text[: m.start()].rstrip().endswith(("(", ",")) else "variable", "line": lines.of(m.start()), "param_name": m[1]})
            out["variable_types"].append({"var_name": m[1], "type_name": name, "line": lines.of(m.start())})
    for m in re.finditer(r"\)\s*:\s*([A-Z][\w$]*)", text):
        if m[1] not in _PLAIN_TYPES:
            out["type_refs"].append({"name": m[1], "kind": "return", "line": lines.of(m.start(1)), "param_name": ""})
    for m in re.finditer(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*new\s+([A-Z][\w$]*)", text):
        out["variable_types"].append({"var_name": m[1], "type_name": m[2], "line": lines.of(m.start())})
    out["calls"].sort(key=lambda c: c["line"])
    return out
