"""A small code graph of our own, of a harbour; and one with structs only."""

from __future__ import annotations


def _clause(kind: str, first: int, last: int, file: str, name: str, arity: int, **more: object) -> dict:
    return {"name": name, "arity": arity, "file": file, "kind": kind, "line": first, "start_line": first, "end_line": last, "pattern": "", "source_sha": "", "ast_sha": "", **more}


def _module(file: str, *clauses: tuple) -> dict:
    """clauses: (kind, name, arity, first line, last line) and maybe further fields."""
    return {f"{name}/{arity}:{first}": _clause(kind, first, last, file, name, arity, **(more[0] if more else {})) for kind, name, arity, first, last, *more in clauses}


def _call(module: str, function: str, line: int, to: str, name: str, arity: int, kind: str = "remote") -> dict:
    return {"caller": {"module": module, "function": function, "file": f"src/{module.rsplit('.', 1)[1].lower()}.ex", "line": line, "column": 4}, "callee": {"module": to, "function": name, "arity": arity}, "type": kind}


def _spec(name: str, arity: int, line: int, inputs: list[str], returns: list[str], kind: str = "spec") -> dict:
    return {"name": name, "arity": arity, "line": line, "kind": kind, "clauses": [{"full": f"{name}({', '.join(inputs)}) :: {' | '.join(returns)}", "input_strings": inputs, "return_strings": returns}]}


GATE, DOCK, CRANE, LEDGER, CLOCK = "Harbor.Gate", "Harbor.Dock", "Harbor.Crane", "Harbor.Ledger", "Tools.Clock"


def harbor() -> dict:
    """Five modules, 16 clauses of 15 functions, 14 calls (one a struct literal), a cycle of two modules and one of three."""
    return {
        "structs": {},
        "function_locations": {
            GATE: _module("src/gate.ex", ("def", "open_bay", 1, 3, 9), ("def", "admit", 2, 11, 24), ("def", "admit", 2, 26, 31), ("defp", "refuse", 1, 33, 36)),
            DOCK: _module("src/dock.ex", ("def", "berth", 2, 4, 18), ("def", "berth_free?", 1, 20, 25), ("defp", "moor", 1, 27, 40)),
            CRANE: _module("src/crane.ex", ("def", "lift", 2, 2, 14, {"ast_sha": "aa11"}), ("def", "lower", 2, 16, 28, {"ast_sha": "aa11"}), ("defp", "jib", 0, 30, 33), ("defp", "spare", 1, 35, 37)),
            LEDGER: _module("src/ledger.ex", ("def", "enter", 3, 6, 15), ("def", "total", 1, 17, 22), ("def", "audit", 0, 24, 70, {"complexity": 12, "max_nesting_depth": 4})),
            CLOCK: _module("src/clock.ex", ("def", "now", 0, 1, 3), ("def", "wait", 1, 5, 9)),
        },
        "calls": [
            _call(GATE, "open_bay", 5, DOCK, "berth_free?", 1), _call(GATE, "open_bay", 7, CLOCK, "now", 0), _call(GATE, "admit/2", 13, DOCK, "berth", 2), _call(GATE, "admit/2", 28, GATE, "refuse", 1, "local"),
            _call(DOCK, "berth", 8, DOCK, "moor", 1, "local"), _call(DOCK, "berth", 12, CRANE, "lift", 2), _call(DOCK, "berth_free?", 22, LEDGER, "total", 1), _call(DOCK, "moor", 30, CLOCK, "wait", 1),
            _call(CRANE, "lift", 5, CRANE, "jib", 0, "local"), _call(CRANE, "lift", 9, LEDGER, "enter", 3), _call(CRANE, "lower", 18, LEDGER, "enter", 3),
            _call(LEDGER, "enter", 8, CLOCK, "now", 0), _call(LEDGER, "audit", 40, DOCK, "berth_free?", 1), _call(LEDGER, "enter", 10, "Harbor.Manifest", "%", 0),
        ],
        "specs": {
            GATE: [_spec("open_bay", 1, 2, ["bay()"], [":ok", "{:error, :full}"]), _spec("admit", 2, 10, ["Ship.t()", "ticket()"], ["{:ok, bay()}"])],
            LEDGER: [_spec("enter", 3, 5, ["Ship.t()", "integer()", "keyword()"], ["Entry.t()", "nil"], "callback")],
        },
        "types": {GATE: [{"name": "bay", "kind": "type", "line": 1, "params": [], "definition": "bay() :: 1..40"}, {"name": "ticket", "kind": "opaque", "line": 2, "params": ["a"], "definition": "ticket(a) :: {a, binary()}"}]},
        "unknown_section": {"ignored": True},
    }


def yard() -> dict:
    field = lambda name, default="nil", required=False: {"field": name, "default": default, "required": required, "inferred_type": None}
    return {
        "structs": {"Yard.Ship": {"fields": [field("name", required=True), field("tonnage", "0"), field("flag", ":none")]}, "Yard.Entry": {"fields": [field("at", required=True), field("amount", "0")]}},
        "function_locations": {},
        "calls": [],
    }
