"""Reports over small aggregates, which fit the driver."""

from __future__ import annotations

import csv
import html
import io
import json

from pyspark.sql import DataFrame

from corrobora.functions.verdicts import TITLES

RULES = ("exact", "lenient", "binary")
#: Colours of changes.
COLOURS = {"improvement": "#e6ffe6", "regression": "#ffe6e6", "lateral": "#fff5cc"}


def percent(x: float) -> str:
    return f"{x:.1f}%"


def delta(x: float) -> str:
    return f"{x:+.1f}"


def delta_colour(x: float, floor: float = 5) -> str:
    return "#e6ffe6" if x >= floor else "#ffe6e6" if x <= -floor else "#f0f0f0"


def is_noise(row: dict, floor: float) -> bool:
    return all(abs(row[f"{r}_delta"]) < floor for r in RULES)


def _rows(df: DataFrame, order: list[str]) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def comparison(stats: DataFrame, cells: DataFrame, coverage: DataFrame, metadata: dict) -> dict:
    """What the renderers take: providers' statistics, coverage, and the cells that moved."""
    flips = cells.where("direction IN ('improvement', 'regression', 'lateral')")
    return {"metadata": metadata, "coverage": coverage.first().asDict(), "providers": _rows(stats, ["provider"]), "flips": _rows(flips, ["provider", "entry_id"])}


def render_json(result: dict) -> str:
    return json.dumps(result, indent=2, ensure_ascii=False, default=str)


def _facts(result: dict, floor: float) -> list[tuple[str, str]]:
    m, c = result["metadata"], result["coverage"]
    facts = [("Change axes", ", ".join(m.get("change_axes") or [])), ("Ground truth version", m.get("gt_version") or ""), ("Control run at", m.get("control_run_at") or ""), ("Treatment run at", m.get("treatment_run_at") or "")]
    facts += [("Compared cells", f"{c['compared']} of {c['intersection']} intersection ({c['control_only']} control-only, {c['treatment_only']} treatment-only excluded)"), ("Dataset", f"{c['dataset_valid']} valid of {c['dataset_total']}"), ("Noise floor", f"±{floor:g}pp")]
    return [(k, v) for k, v in facts if v]


def render_markdown(result: dict, floor: float = 5) -> str:
    lines = [f"# Compare Results — {result['metadata'].get('generated_at', '')}", "", *(f"{k}: {v}" for k, v in _facts(result, floor)), "", "## Headline accuracy", ""]
    heads = ["Provider", "n", *(f"{side} {r}" if side != "Δ" else f"Δ {r}" for r in RULES for side in ("Control", "Treatment", "Δ"))]
    lines += ["| " + " | ".join(heads) + " |", "|---|" + "---:|" * (len(heads) - 1)]
    for p in result["providers"]:
        cells = [p["provider"] + (" (noise)" if is_noise(p, floor) else ""), str(p["n"])]
        for r in RULES:
            cells += [percent(p[f"{r}_control_pct"]), percent(p[f"{r}_treatment_pct"]), delta(p[f"{r}_delta"])]
        lines.append("| " + " | ".join(cells) + " |")
    lines += ["", "## Flips", ""]
    if not result["flips"]:
        lines.append("_No flips: every cell stayed as it was._")
    else:
        names = ["Provider", "Entry ID", "Claim", "Control", "Treatment", "Ground truth", "Direction"]
        lines += ["| " + " | ".join(names) + " |", "|---" * len(names) + "|"]
        for f in result["flips"]:
            claim = f["claim_text"] if len(f["claim_text"]) <= 60 else f["claim_text"][:60] + "…"
            lines.append("| " + " | ".join([f["provider"], f["entry_id"], claim.replace("|", "\\|"), f["control_verdict"], f["treatment_verdict"], f["ground_truth"], f["direction"]]) + " |")
    return "\n".join([*lines, ""])


def render_html(result: dict, floor: float = 5, title: str = "Compare Results") -> str:
    e = lambda x: html.escape(str(x if x is not None else ""))
    head = "".join(f"<p><b>{e(k)}:</b> {e(v)}</p>" for k, v in _facts(result, floor))
    rows = ""
    for p in result["providers"]:
        rows += f"<tr><td>{e(p['provider'])}</td><td>{p['n']}</td>"
        for r in RULES:
            for side in ("control", "treatment"):
                rows += f"<td>{p[f'{r}_{side}']}/{p['n']} ({percent(p[f'{r}_{side}_pct'])})</td>"
            rows += f'<td style="background:{delta_colour(p[f"{r}_delta"], floor)}">{delta(p[f"{r}_delta"])}</td>'
        rows += "</tr>"
    flips = "".join(
        f'<tr style="background:{COLOURS.get(f["direction"], "#ffffff")}"><td>{e(f["provider"])}</td><td>{e(f["entry_id"])}</td><td><a href="{e(f["source_url"])}" title="{e(f["claim_text"])}">{e(f["claim_text"][:80])}</a></td>'
        f"<td>{e(f['control_verdict'])}</td><td>{e(f['treatment_verdict'])}</td><td>{e(f['ground_truth'])}</td><td>{e(f['direction'])}</td></tr>"
        for f in result["flips"]
    )
    names = "".join(f"<th>{side} {r}</th>" for r in RULES for side in ("Control", "Treatment", "Δ"))
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>{e(title)}</title></head><body><h1>{e(title)}</h1>{head}<h2>Headline accuracy</h2><table><tr><th>Provider</th><th>n</th>{names}</tr>{rows}</table>'
        f"<h2>Flips</h2><table><tr><th>Provider</th><th>Entry ID</th><th>Claim</th><th>Control</th><th>Treatment</th><th>Ground truth</th><th>Direction</th></tr>{flips}</table></body></html>"
    )


RENDERERS = {"json": render_json, "md": render_markdown, "html": render_html}


def render(result: dict, path: str, floor: float = 5) -> str:
    """The report in the form that the path's extension asks for."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if kind not in RENDERERS:
        raise ValueError(f"a report is one of {', '.join('.' + k for k in RENDERERS)}, not {path!r}")
    return render_json(result) if kind == "json" else RENDERERS[kind](result, floor)


def analysis_markdown(metrics: list[dict], best: dict) -> str:
    """Providers ranked by exact accuracy, and the fastest and best calibrated."""
    lines = ["# Analysis", "", "| Provider | n | Exact | Lenient | Binary | Supported vs rest | Avg latency | Calibration |", "|---|" + "---:|" * 7]
    for m in sorted(metrics, key=lambda m: -m["exact_accuracy"]):
        shares = [percent(100 * m[k]) for k in ("exact_accuracy", "lenient_accuracy", "binary_accuracy", "supported_vs_rest_accuracy")]
        lines.append("| " + " | ".join([m["provider"], str(m["valid"]), *shares, f"{m['latency_avg']:.0f} ms", f"{m['calibration']:.1f}"]) + " |")
    return "\n".join([*lines, "", f"Fastest: {best['fastest']}. Best calibrated: {best['best_calibrated']}. Most accurate: {best['most_accurate']}.", ""])


def analysis_json(metrics: list[dict], best: dict, matrix: list[dict]) -> str:
    """The analysis as one tree: providers with their metrics and confusion matrices, and the best ones."""
    tree = {}
    for m in sorted(metrics, key=lambda m: -m["exact_accuracy"]):
        cells: dict[str, dict[str, int]] = {}
        for r in matrix:
            if r["provider"] == m["provider"]:
                cells.setdefault(r["truth"], {})[r["predicted"]] = r["n"]
        tree[m["provider"]] = {k: v for k, v in m.items() if k != "provider"} | {"confusion_matrix": cells}
    return json.dumps({"providers": tree, "best": best, "ranking": list(tree)}, indent=2, ensure_ascii=False, default=str)


def confusion_text(matrix: list[dict], provider: str) -> str:
    """A padded table of truth against prediction."""
    n = {(r["truth"], r["predicted"]): r["n"] for r in matrix if r["provider"] == provider}
    wide = max(map(len, TITLES)) + 2
    lines = [provider, " " * wide + "".join(t.rjust(wide) for t in TITLES)]
    lines += [t.ljust(wide) + "".join(str(n.get((t, p), 0)).rjust(wide) for p in TITLES) for t in TITLES]
    return "\n".join(lines)


def pivot_csv(rows: list[dict]) -> str:
    """All cells quoted, entries in order of their ids."""
    out = io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
    if rows:
        writer.writerow(rows[0])
        writer.writerows([*r.values()] for r in sorted(rows, key=lambda r: r["entry_id"]))
    return out.getvalue()


#: Marks of verdicts in wikitext.
ICONS = {"SUPPORTED": "{{tick}}", "PARTIALLY SUPPORTED": "{{?mark}}", "NOT SUPPORTED": "{{cross}}", "SOURCE UNAVAILABLE": "{{N/A}}"}


def wikitext(units: list[dict], title: str) -> str:
    """A sortable table of a report's units."""
    cell = lambda x: " ".join(str(x if x is not None else "").split()).replace("|", "{{!}}")
    lines = [f"== {title} ==", '{| class="wikitable sortable"', "! # !! Verdict !! Claim !! Comments"]
    for u in units:
        lines += ["|-", f"| {cell(u.get('citation_number'))} || {ICONS.get(u['verdict'], '')} {cell(u['verdict'])} || {cell(u.get('claim_text'))} || {cell(u.get('comments'))}"]
    return "\n".join([*lines, "|}", ""])


def plain_text(units: list[dict], title: str) -> str:
    lines = [title, "=" * len(title)]
    for u in units:
        lines += ["", f"[{u.get('citation_number')}] {u['verdict']}", f"  Claim: {u.get('claim_text')}", *([f"  {u['comments']}"] if u.get("comments") else [])]
    return "\n".join([*lines, ""])
