"""Write COVERAGE.md: inventory id -> registered queries. Run as `python -m veil.plans.coverage`."""

from __future__ import annotations

from collections import defaultdict

from veil.plans.registry import load

SECTIONS = {
    "S": "Sources and scans", "K": "Sinks", "P": "Projections, filters, predicates", "J": "Joins and set membership",
    "G": "Aggregations", "W": "Windows and ordered logic", "O": "Sort, limit, top-k", "U": "Set operations",
    "X": "Text similarity and matching", "Y": "Text quality", "M": "Entities and masking", "A": "Answer parsing",
    "B": "Prompts, model stage, loop", "T": "Streaming",
}


def main() -> None:
    by_id: dict[str, list[str]] = defaultdict(list)
    for name, entry in load().items():
        for i in entry.ids:
            by_id[i].append(f"`{name}`" + ("" if entry.oracle else " (rows only)"))
    lines = ["# Coverage", "", "Inventory id and the registered queries that exercise it.", ""]
    for letter, title in SECTIONS.items():
        lines += [f"## {title}", "", "| Id | Queries |", "|---|---|"]
        lines += [f"| {i} | {', '.join(by_id[i])} |" for i in sorted(by_id) if i[0] == letter]
        lines.append("")
    with open("COVERAGE.md", "w") as f:
        f.write("\n".join(lines))


if __name__ == "__main__":
    main()
