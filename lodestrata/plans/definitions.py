"""What the columns mean: id (the name of the column), name, short and long text."""

from __future__ import annotations

import os
import re

FIELDS = ("id", "name", "short", "long")

DEFINITIONS: list[tuple[str, str, str, str]] = [
    ("complexity__lines", "Lines", "Lines of a file.", "The newlines of a file and one. An empty file has one line."),
    ("complexity__files", "Files", "Files of a group.", "The files in a component, folder or repository that hold at least one snippet."),
    ("modularity__abstractness", "Abstractness", "Share of abstract types.", "Abstract types by all types of a component, from 0 (all concrete) to 1."),
    ("modularity__instability", "Instability", "How much a component leans on others.", "Efferent by afferent and efferent couplings: 0 if only others depend on it, 1 if it only depends on others."),
    ("modularity__distance_main_sequence", "Distance from the main sequence", "How far abstractness and stability are out of balance.", "The absolute of abstractness plus instability minus 1; 0 is balanced."),
    ("modularity__coupling__afferent", "Afferent couplings", "Files elsewhere that import the component.", "Distinct importing files; many mean that a change here reaches far."),
    ("modularity__coupling__efferent", "Efferent couplings", "Files of the component that import others.", "Distinct importing files; many mean that changes elsewhere reach it."),
    ("modularity__coupling__dependents", "Dependents", "Components that import this one.", "Distinct components with an edge to it."),
    ("modularity__coupling__dependencies", "Dependencies", "Components that this one imports.", "Distinct components with an edge from it."),
    ("graph__betweenness", "Betweenness", "How often it lies between others.", "The shares of shortest paths between other components that lead through it, over all ordered pairs."),
    ("graph__page_rank", "PageRank", "How likely a random walk along imports is there.", "Damping 0.85; where a walk has no way on it goes anywhere. All sum to 1."),
    ("graph__harmonic_centrality", "Harmonic centrality", "How near it is to those that reach it.", "The sum of 1 by distance over all components from which it can be reached."),
    ("graph__residual_closeness", "Residual closeness", "How near it is, near ones counting twice as much per step.", "The sum of 2 to the minus distance over all components from which it can be reached."),
]


def read_definition(text: str) -> tuple[str, str, str, str]:
    """A definition of ``key: value`` lines; values may be quoted, go on in indented lines, or be blocks (``|`` or ``>``).

    Other keys are ignored, a missing one is empty.
    """
    found: dict[str, str] = {}
    for m in re.finditer(r"^(\w+):[ \t]*(.*(?:\n(?:[ \t]+.*|[ \t]*(?=\n[ \t])))*)", text.replace("\r\n", "\n"), re.MULTILINE):
        first, *more = m[2].split("\n")
        first = first.strip()
        if re.fullmatch(r"[|>][+-]?", first):
            value = ("\n" if first[0] == "|" else " ").join(x.strip() for x in more).strip()
        else:
            value = " ".join(x.strip() for x in [first, *more] if x.strip())
            value = value[1:-1].replace("''", "'") if value[:1] == "'" == value[-1:] else value
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), value[1:-1]) if value[:1] == '"' == value[-1:] else value
        found[m[1]] = value
    return tuple(found.get(k, "") for k in FIELDS)


def load_definitions(folder: str) -> list[tuple[str, str, str, str]]:
    """The definitions of all ``.yaml`` and ``.yml`` files under a folder, in the order of their paths."""
    paths = sorted(os.path.join(here, f) for here, _, files in os.walk(folder) for f in files if f.endswith((".yaml", ".yml")))
    out = []
    for p in paths:
        with open(p, encoding="utf-8") as f:
            out.append(read_definition(f.read()))
    return out
