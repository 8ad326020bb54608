"""Reports and drawings of small collected frames."""

from __future__ import annotations

import base64
import html
import json
import uuid
import zlib
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row

#: Rows of a rendered report.
MOST_ROWS = 10_000


def all_rows(df: DataFrame, most: int = MOST_ROWS) -> list[Row]:
    """Every row; more than most are an error, as none is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def text_table(df: DataFrame, columns: Sequence[str], group: Sequence[str] = (), most: int = MOST_ROWS) -> str:
    """Aligned columns, with a heading for each group."""
    rows = [r.asDict() for r in all_rows(df, most)]
    shown = [c for c in columns if c not in group]
    cells = [[_cell(r[c]) for c in shown] for r in rows]
    width = [max([len(c), *(len(x[i]) for x in cells)]) for i, c in enumerate(shown)]
    lines, before = [], None
    for r, x in sorted(zip(rows, cells, strict=True), key=lambda p: [str(p[0][g]) for g in group]):
        now = tuple(r[g] for g in group)
        if now != before:
            lines += ["", " / ".join(map(str, now))] if group else []
            lines.append("  ".join(c.rjust(w) for c, w in zip(shown, width, strict=True)))
            before = now
        lines.append("  ".join(v.rjust(w) for v, w in zip(x, width, strict=True)))
    return "\n".join(lines).strip("\n")


def _cell(x: Any) -> str:
    return "nan" if x is None or x != x else f"{x:,.3f}" if isinstance(x, float) else str(x)


def html_report(title: str, df: DataFrame, columns: Sequence[str], score: str | None = None, most: int = MOST_ROWS) -> str:
    """A page with a table that can be filtered; the score colours its row."""
    body = []
    for r in all_rows(df, most):
        colour = ""
        if score and r[score] is not None and r[score] == r[score]:
            strength = 0.15 + 0.35 * min(1.0, max(0.0, (abs(r[score]) - 10) / 45))
            colour = f' style="background: rgba({"20,140,60" if r[score] > 0 else "190,40,40"},{strength:.2f})"'
        body.append(f"<tr{colour}>" + "".join(f"<td>{html.escape(_cell(r[c]))}</td>" for c in columns) + "</tr>")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    script = "const q=document.getElementById('q');q.oninput=()=>document.querySelectorAll('tbody tr').forEach(r=>r.hidden=!r.textContent.includes(q.value));"
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><input id='q' placeholder='filter'><table><thead><tr>{head}</tr></thead><tbody>{''.join(body)}</tbody></table><script>{script}</script>"


def delta_summary(counts: dict[str, int], improvements: Iterable[dict], regressions: Iterable[dict]) -> str:
    lines = [", ".join(f"{k}: {counts.get(k, 0)}" for k in ("improvement", "neutral", "regression"))]
    for name, rows in (("Top improvements", improvements), ("Top regressions", regressions)):
        lines += [name, *(f"  {r['metric']} {r['value']:.1f}%" for r in rows)]
    return "\n".join(lines)


def graph_text(edges: Iterable[tuple[str, str]], kind: str = "mermaid", direction: str = "LR") -> str:
    """A drawing of path-named edges, with a box for each inner path."""
    if kind not in ("mermaid", "graphviz"):
        raise ValueError(f"unknown kind {kind}")
    edges = sorted(set(edges))
    names = sorted({n for e in edges for n in e})
    ids = {n: f"n{uuid.uuid5(uuid.NAMESPACE_URL, n).hex}" for n in names}
    tree: dict = {}
    for n in names:
        at = tree
        *path, last = n.split("/")
        for p in path:
            at = at.setdefault(p, {})
            if isinstance(at, str):
                raise ValueError(f"{p} is an endpoint and a parent")
        at[last] = n
    dot = kind == "graphviz"

    def boxes(at: dict, depth: int) -> list[str]:
        pad, out = "  " * depth, []
        for name, inner in at.items():
            if isinstance(inner, str):
                out.append(f'{pad}{ids[inner]} [label="{name}"];' if dot else f"{pad}{ids[inner]}[{name}]")
            elif dot:
                out += [f'{pad}subgraph "cluster_{name}_{depth}" {{', f'{pad}  label = "{name}";', *boxes(inner, depth + 1), f"{pad}}}"]
            else:
                out += [f"{pad}subgraph {name.lower()} [{name}]", *boxes(inner, depth + 1), f"{pad}end"]
        return out

    lines = [f"{'' if dot else '  '}{'  ' if dot else ''}{ids[a]} {'->' if dot else '-->'} {ids[b]}{';' if dot else ''}" for a, b in edges]
    if dot:
        return "\n".join(["digraph G {", f'  rankdir="{direction}";', *boxes(tree, 1), *lines, "}"])
    return "\n".join([f"flowchart {direction}", *boxes(tree, 1), *lines])


# Where drawings can be seen.
VIEWERS = {"ink": "https://mermaid.ink/img/", "live": "https://mermaid.live/edit#pako:", "play": "https://www.mermaidchart.com/play#pako:"}


def drawing_url(graph: str, target: str = "live") -> str:
    """Address that shows a mermaid text: plain for images, deflated state for editors."""
    if target not in VIEWERS:
        raise ValueError(f"unknown target {target}")
    data = graph.encode()
    if target != "ink":
        state = {"code": graph, "mermaid": {"theme": "default"}, "updateDiagram": True, "autoSync": True, "rough": False}
        data = zlib.compress(json.dumps(state).encode(), 9)
    return VIEWERS[target] + base64.b64encode(data).decode()


def pair_order(rounds: int, seed: int) -> list[str]:
    """As many AB as BA rounds, one more AB if odd, shuffled by the seed."""
    import random

    order = ["AB" if i % 2 == 0 else "BA" for i in range(rounds)]
    random.Random(seed).shuffle(order)
    return order


def bench_grid(parameters: dict[str, list], iterations: int = 1, zipped: bool = False, seed: int | None = None) -> list[dict]:
    """Cases of a benchmark: all combinations of parameters, or with zipped the first of each, the second of each and so on; each `iterations` times, shuffled by the seed."""
    import itertools
    import random

    combined = zip(*parameters.values(), strict=True) if zipped else itertools.product(*parameters.values())
    cases = [dict(zip(parameters, values, strict=True)) for values in combined]
    out = [{**c, "iteration": i} for i in range(iterations) for c in cases]
    if seed is not None:
        random.Random(seed).shuffle(out)
    return out
