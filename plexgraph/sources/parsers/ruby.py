"""Ruby by a scanner over lines: approximate, but tolerant of any input."""

from __future__ import annotations

import re

from plexgraph.sources.parsers.scan import call, masked, symbol

_OPENS = re.compile(r"^\s*(?:if|unless|while|until|for|case|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
_MACROS = re.compile(r"^\s*(attr_(?:accessor|reader|writer)|(?:before|after|around)_[a-z]+)\s+(.*)")
_CALL = re.compile(r"(?P<receiver>(?:[A-Za-z_@][\w@:]*[?!]?\.)*)(?P<name>[a-z_]\w*[?!]?)\s*(?P<open>\()?")
_WORDS = set(
    """alias and begin break case class def defined? do else elsif end ensure extend false for if in include module next nil not or prepend
private protected public raise redo require require_relative rescue retry return self super then true undef unless until when while yield""".split()
)


def parse(content: str) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("symbols", "imports", "calls", "type_refs", "heritage", "exports", "variable_types")}
    plain, real = masked(content, "ruby").split("\n"), content.split("\n")
    stack: list[dict | None] = []
    local: list[set[str]] = [set()]
    for n, line in enumerate(plain, 1):
        text = line.strip()
        owner = next((s for s in reversed(stack) if s and s["kind"] in ("class", "module")), None)
        if m := re.match(r"require(_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]", real[n - 1].strip()):
            out["imports"].append({"module": m[2], "names": [], "is_relative": bool(m[1]), "alias": ""})
            continue
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([A-Z][\w:]*))?", text):
            name = m[2].rsplit("::", 1)[-1]
            s = symbol(name, m[1], n, n, content, text)
            out["symbols"].append(s)
            if m[3]:
                out["heritage"].append({"class_name": name, "kind": "extends", "parent_name": m[3].rsplit("::", 1)[-1]})
            if not re.search(r";\s*end\b", text):
                stack.append(s)
            continue
        if m := re.match(r"def\s+(?:self\.)?([a-zA-Z_]\w*[?!=]?|[+\-*/<>=!\[\]]+)(.*)", text):
            s = symbol(m[1], "method" if owner else "function", n, n, content, text, owner["name"] if owner else "")
            out["symbols"].append(s)
            local.append(set(re.findall(r"[a-z_]\w*", m[2])))
            if not re.search(r"\)\s*=\s|^\s*=\s|;\s*end\b", m[2]):
                stack.append(s)
            continue
        if re.match(r"end\b", text):
            if stack and (s := stack.pop()) is not None:
                s["end_line"] = n
                s["content"] = "\n".join(real[s["start_line"] - 1 : n])
                if s["kind"] in ("method", "function") and len(local) > 1:
                    local.pop()
            continue
        if owner and (m := re.match(r"(include|extend|prepend)\s+([A-Z][\w:]*(?:\s*,\s*[A-Z][\w:]*)*)", text)):
            for parent in m[2].split(","):
                out["heritage"].append({"class_name": owner["name"], "kind": "mixes_in", "parent_name": parent.strip().rsplit("::", 1)[-1]})
            continue
        if owner and (m := _MACROS.match(real[n - 1])):
            owner["decorators"] += [f"{m[1]}:{x}" for x in re.findall(r":(\w+[?!]?)", m[2])]
            continue
        if _OPENS.search(line):
            stack.append(None)
        if m := re.match(r"([a-z_]\w*)\s*=(?!=)\s*(?:([A-Z]\w*)\.new\b)?", text):
            local[-1].add(m[1])
            if m[2]:
                out["variable_types"].append({"var_name": m[1], "type_name": m[2], "line": n})
        for new in re.findall(r"\b([A-Z]\w*)\.new\b", text):
            out["calls"].append(call(new, n))
        for m in _CALL.finditer(line):
            before = line[m.start() - 1] if m.start() else " "
            if m["name"] in _WORDS or before in ":@$.\"'`" or before.isalnum() or line[m.end() : m.end() + 1] == ":" and not m["open"]:
                continue
            if not m["receiver"] and not m["open"] and m["name"] in local[-1]:
                continue
            if re.match(r"\s*=(?![=~])", line[m.end() :]):
                continue
            given = [a.strip() for a in line[m.end() :].split(")")[0].split(",") if re.fullmatch(r"\s*[a-z_]\w*\s*", a)] if m["open"] else []
            out["calls"].append(call(m["name"], n, m["receiver"].rstrip("."), given))
    return out
