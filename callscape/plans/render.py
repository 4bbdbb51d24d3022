"""Results as nested values, and these as a table, JSON or a compact text (toon)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row

_PLAIN_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*$")
_LIKE_OTHER = re.compile(r"(?:true|false|null|[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)$")


def value_of(x: Any) -> Any:
    """A Spark value as plain Python: rows become dicts."""
    if isinstance(x, Row):
        return {k: value_of(v) for k, v in x.asDict().items()}
    return [value_of(v) for v in x] if isinstance(x, list) else x


def rows_of(df: DataFrame, most: int = 100_000) -> list[dict]:
    """The rows of a limited result; more than `most` are an error, as they belong into a table and not on a screen."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: set a limit")
    return [value_of(r) for r in rows]


def by_module(rows: Iterable[dict], module: str = "module", drop: Sequence[str] = ()) -> list[dict]:
    """Rows as modules with entries, modules in the order in which they come first; the file is that of the first row."""
    groups: dict[tuple, dict] = {}
    for r in rows:
        key = (r.get("project"), r[module])
        g = groups.setdefault(key, {"name": r[module], "file": r.get("file") or "", "entries": []})
        g["entries"].append({k: v for k, v in r.items() if k not in {module, "project", *drop}})
    return list(groups.values())


def _text(x: Any, comma: str = ",") -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else repr(x)
    if isinstance(x, int):
        return str(x)
    s = str(x)
    odd = not s or s != s.strip() or _LIKE_OTHER.match(s) or any(c in s for c in (comma, ":", '"', "\\", "\n", "\t", "\r", "[", "]", "{", "}")) or s.startswith("-")
    return json.dumps(s, ensure_ascii=False) if odd else s


def _key(k: str) -> str:
    return k if _PLAIN_KEY.match(k) else json.dumps(k, ensure_ascii=False)


def _flat(x: Any) -> bool:
    return not isinstance(x, (dict, list))


def _lines(key: str, x: Any, indent: int) -> list[str]:
    pad = " " * indent
    if isinstance(x, dict):
        return [f"{pad}{key}:", *_members(x, indent + 2)]
    if not isinstance(x, list):
        return [f"{pad}{key}: {_text(x)}"]
    head = f"{pad}{key}[{len(x)}]"
    if not x or all(map(_flat, x)):
        return [f"{head}: {','.join(map(_text, x))}".rstrip()]
    if all(isinstance(e, dict) and e and e.keys() == x[0].keys() and all(map(_flat, e.values())) for e in x):
        cols = sorted(x[0])
        return [f"{head}{{{','.join(map(_key, cols))}}}:", *(f"{pad}  {','.join(_text(e[c]) for c in cols)}" for e in x)]
    return [f"{head}:", *(line for e in x for line in _item(e, indent + 2))]


def _item(x: Any, indent: int) -> list[str]:
    pad = " " * indent
    if isinstance(x, dict) and x:
        first, *rest = sorted(x)
        # the first member stands on the line of the dash, and what it holds is set in as if that were its line
        top = _lines(_key(first), x[first], indent)
        return [f"{pad}- {top[0].lstrip()}", *top[1:], *(line for k in rest for line in _lines(_key(k), x[k], indent + 2))]
    if isinstance(x, list):
        top = _lines("", x, indent)
        return [f"{pad}- {top[0].lstrip()}", *top[1:]]
    return [f"{pad}- {_text(x)}" if _flat(x) else f"{pad}-"]


def _members(x: dict, indent: int) -> list[str]:
    return [line for k in sorted(x) for line in _lines(_key(k), x[k], indent)]


def toon(x: dict) -> str:
    """A value in token-oriented notation: keys sorted, uniform lists of flat objects as tables."""
    return "\n".join(_members(x, 0))


def as_json(x: dict) -> str:
    return json.dumps(x, indent=2, ensure_ascii=False, default=str)


def _entry(e: dict) -> str:
    name = f"{e['name']}/{e['arity']}" if e.get("name") is not None and e.get("arity") is not None else e.get("name") or e.get("function") or ""
    span = f" L{e['start_line']}:{e['end_line']}" if "start_line" in e and "end_line" in e else f" L{e['line']}" if e.get("line") is not None else ""
    kind = f" [{e['kind']}]" if e.get("kind") else ""
    shown = {"name", "arity", "function", "start_line", "end_line", "line", "kind", "file"}
    rest = ", ".join(f"{k}: {v}" for k, v in e.items() if k not in shown and _flat(v) and v not in (None, ""))
    return f"{name}{span}{kind}" + (f"  {rest}" if rest else "")


def table(title: str, x: dict, noun: str = "result") -> str:
    """Header, blank line, summary or a word on nothing found, then modules with their entries and these' details."""
    items = x.get("items", [])
    lines = [title, ""]
    if not items:
        return "\n".join([*lines, f"No {noun}s found."])
    total = x.get("total_items", len(items))
    lines += [f"Found {total} {noun}{'' if total == 1 else 's'}:", ""]
    for m in items:
        lines.append(f"{m['name']}" + (f" ({m['file'].rsplit('/', 1)[-1]})" if m.get("file") else "") + ":")
        for e in m.get("entries", []):
            lines.append("  " + _entry({k: pretty_type(v) if k == "definition" and v else simplify_structs(v) if isinstance(v, str) else v for k, v in e.items()}).strip())
            for k, v in e.items():
                if isinstance(v, list):
                    lines += [f"    {_detail(k, d, m)}" for d in v]
    return "\n".join(lines)


def _detail(key: str, d: Any, m: dict) -> str:
    """A line of a list under an entry: calls with an arrow for their direction, anything else as an entry."""
    if not isinstance(d, dict):
        return str(d)
    line = d.get("line", d.get("call_line"))
    if key in ("calls", "callers", "targets") and line is not None and d.get("arity") is not None:
        return call_line(d, line, key != "callers", m["name"], m.get("file"))
    return _entry(d)


def function_name(f: dict, module: str | None = None) -> str:
    """name/arity, with the module before it unless that is the one in whose context it stands."""
    return f"{f['name']}/{f['arity']}" if f.get("module") == module else f"{f['module']}.{f['name']}/{f['arity']}"


def function_place(f: dict, file: str | None = None) -> str:
    """`L5:9`, with the file's last part before it unless that is the context's; nothing without lines or file."""
    if f.get("start_line") is None or f.get("end_line") is None or not f.get("file"):
        return ""
    base = f["file"].rsplit("/", 1)[-1]
    span = f"L{f['start_line']}:{f['end_line']}"
    return span if file and base == file.rsplit("/", 1)[-1] else f"{base}:{span}"


def call_line(other: dict, line: int, outgoing: bool, module: str | None = None, file: str | None = None) -> str:
    """A call as seen from one side: arrow, line, the function on the other side, its kind and place."""
    kind = f" [{other['kind']}]" if other.get("kind") else ""
    place = function_place(other, file)
    return f"{'→' if outgoing else '←'} @ L{line} {function_name(other, module)}{kind}" + (f" ({place})" if place else "")


def _closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at `at`; the end of the text if none does."""
    open_ = 0
    for i in range(at, len(text)):
        if text[i] in "([{":
            open_ += 1
        elif text[i] in ")]}":
            open_ -= 1
            if not open_:
                return i
    return len(text)


def _members_of(text: str) -> list[tuple[str, str]]:
    """(name, value) of each `name: value` of a map's inside; commas and colons within brackets belong to values."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] != ",":
            end = _closing(text, end) + 1 if text[end] in "([{" else end + 1
        name, colon, value = text[at:end].partition(":")
        if colon and name.strip() and value.strip():
            out.append((name.strip(), value.strip()))
        at = end + 1
    return out


def with_structs(text: str, shown: Callable[[str, list[tuple[str, str]]], str]) -> str:
    """The text with every map that names its struct as `shown` writes it (of a module and its other members), outermost first."""
    out, at = [], 0
    while (begin := text.find("%{", at)) >= 0:
        end = _closing(text, begin + 1)
        members = _members_of(text[begin + 2 : end])
        if end == len(text) or not members or members[0][0] != "__struct__":
            out.append(text[at : begin + 2])
            at = begin + 2
            continue
        out += [text[at:begin], shown(members[0][1], members[1:])]
        at = end + 1
    return "".join([*out, text[at:]])


def pretty_type(definition: str) -> str:
    """A type with its structs as `%Module{...}`, one field a line; anything else as it is."""

    def lines(module: str, members: list[tuple[str, str]]) -> str:
        inner = ",\n".join(f"  {n}: {t}" for n, t in members)
        return f"%{module}{{\n{inner}\n}}" if inner else f"%{module}{{}}"

    return with_structs(definition, lines)


def simplify_structs(text: str) -> str:
    """Every struct in a type as `%Module{}`."""
    return with_structs(text, lambda module, _: f"%{module}{{}}")


def render(title: str, x: dict, form: str = "table", noun: str = "result") -> str:
    return {"table": lambda: table(title, x, noun), "json": lambda: as_json(x), "toon": lambda: toon(x)}[form]()
