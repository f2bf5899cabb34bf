"""An import's report as text. Every frame it collects has at most one row for each kind or name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V

def preflight(existing: DataFrame, where: str, replace: bool) -> str | None:
    """A warning if state already has rows. existing: n_rows, first_day, last_day."""
    n, first, last = existing.first()
    if not n:
        return None
    lines = [f"{where} already holds {n} daily rows ({first} to {last}).", "Importing overwrites every row that the export has for the same kind and day; this cannot be undone."]
    if replace:
        lines.append("Rows inside the imported days that the export does not have will be deleted as well.")
    return "\n".join([*lines, f"Back up {where} first. Nothing has been read or written yet."])


def render(got: dict, path: str) -> str:
    outcomes = {r.outcome: r.n for r in got["outcomes"].collect()}
    span = got["span"].first()
    read = sum(outcomes.values())
    lines = [f"Imported {path}", f"  records   {read} read, {outcomes.get('folded', 0)} kept, {outcomes.get('excluded', 0)} left out, {outcomes.get('skipped', 0)} skipped", f"  days      {span.n_rows} rows, {span.first_day} to {span.last_day}"]
    if not got["closed"]:
        lines.append("  WARNING   the file ends before its closing tag: the counts above are of a part")
    if got["replace_refused"]:
        lines.append("  REFUSED   rows were not deleted, because the file is not whole")
    sections = {
        "Stale rows": [f"{r.kind}: {r.rows} ({', '.join(map(str, r.first_days))}{' ...' if r.rows > len(r.first_days) else ''})" for r in got["stale"].orderBy("kind").collect()],
        "Quarantined names": [f"{r.name}: {r.n} ({r.outcome})" for r in got["quarantine"].orderBy(F.desc("n"), "name").collect()],
        "Units that do not convert": [f"{r.type} in {r.unit}: {r.n}" for r in got["unconvertible"].orderBy(F.desc("n"), "type", "unit").collect()],
        "Impossible values": [f"{r.kind}: {r.records} readings, {r.rows} days, {r.bounds_cleared} bounds cleared (such as {r.sample_value} on {r.sample_day})" for r in got["implausible"].orderBy("kind").collect()],
        "Kinds": _kinds(got),
        "Days of several sources": [f"{r.kind}: {r.days} days, adding up would give {r.mean_ratio:.2f} times the value (at most {r.max_ratio:.2f})" for r in got["multi_source"].orderBy("kind").collect()],
        "Sleep days": [_shift(got["shift"].first())],
    }
    for title, body in sections.items():
        if body:
            lines += ["", title, *(f"  {x}" for x in body)]
    return "\n".join(lines)


def _kinds(got: dict) -> list[str]:
    units, order = {m[0]: m[1] for m in V.METRICS}, {m[0]: i for i, m in enumerate(V.METRICS)}
    both = got["spans"].join(got["overlap"].withColumnRenamed("days", "both"), "kind", "left").collect()
    out = []
    for r in sorted(both, key=lambda r: order[r.kind]):
        line = f"{r.kind}: {r.days} days, {r.min_value:g} to {r.max_value:g} {units[r.kind]}"
        if r.both:
            line += f"; {r.both} overwritten, off by {r.mean_diff:g} on average, {r.max_diff:g} at most ({r.max_day})"
        if units[r.kind] == V.PERCENT and 0 < r.max_value <= 1:
            line += "; looks like fractions, not percent"
        out.append(line)
    return out


def _shift(r) -> str:  # noqa: ANN001
    said = {
        "no-comparable-rows": "no stored nights to compare with",
        "self-comparison": "the stored nights are an earlier import's own",
        "unverified": f"only {r.compared_days} nights to compare: no verdict",
        "agrees": f"{r.compared_days} nights agree with what is stored",
        "mismatch": f"{r.compared_days} nights fit the stored ones better {'a day earlier' if r.best_offset == -1 else 'a day later'}",
    }
    return said[r.verdict]
