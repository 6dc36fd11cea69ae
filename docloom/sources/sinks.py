"""Sinks: tables as parquet or CSV on the cluster; small reports as single files from the driver."""

from __future__ import annotations

import csv
import html
import io
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X

#: Rows a single-file report takes at most.
MOST_ROWS = 100_000


def csv_folder(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a single file")
    return rows


def csv_report(df: DataFrame, path: str, most: int = MOST_ROWS) -> None:
    """One CSV with byte-order mark, for spreadsheets; ValueError beyond ``most`` rows."""
    out = io.StringIO()
    writer = csv.writer(out, quoting=csv.QUOTE_MINIMAL, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(_few(df, most))
    Path(path).write_text(out.getvalue(), encoding="utf-8-sig")


def json_report(df: DataFrame, path: str) -> None:
    """The first row as indented JSON."""
    row = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
    Path(path).write_text(json.dumps(json.loads(row.j) if row else {}, indent=2, ensure_ascii=False), encoding="utf-8")


_STYLE = "body{font:15px sans-serif;margin:2em}#pairs{max-height:20em;overflow:auto;padding:0;list-style:none}#pairs li{cursor:pointer;padding:.2em}#both{display:flex;gap:2em}#both div{flex:1;white-space:pre-wrap}.delete{background:#fbd5d5}.insert{background:#d3f3d8}"
_SCRIPT = """
const read = id => JSON.parse(document.getElementById(id).textContent), make = (tag, parent, text) => { const e = parent.appendChild(document.createElement(tag)); e.textContent = text || ''; return e; };
const records = read('records'), at = id => document.getElementById(id), shown = new Set(records.map(r => r.relationship));
const hay = r => [r.label, r.relationship, r.sourcePath, r.targetPath, r.sourceSummary, r.targetSummary].filter(x => x).join(' ').toLowerCase();
function draw() {
  document.querySelectorAll('[data-relationship]').forEach(e => { e.style.display = shown.has(e.dataset.relationship) ? '' : 'none'; });
  const asked = at('search').value.trim().toLowerCase();
  at('pairs').replaceChildren();
  for (const r of records.filter(r => shown.has(r.relationship) && hay(r).includes(asked))) make('li', at('pairs'), r.label + ' (' + r.relationship + ')').onclick = () => show(r);
}
function show(r) {
  for (const side of ['left', 'right']) {
    at(side).replaceChildren();
    for (const t of ((r.diff || {})[side] || [])) make('span', at(side), t.token).className = t.op;
  }
  at('note').textContent = (r.analysis || '') + (r.sourceTruncated || r.targetTruncated || (r.diff || {}).truncated ? ' (texts are cut)' : '');
}
for (const name of [...shown].sort()) {
  const label = make('label', at('toggles')), box = label.appendChild(document.createElement('input'));
  box.type = 'checkbox'; box.checked = true; label.append(' ' + name + ' ');
  box.onchange = () => { box.checked ? shown.add(name) : shown.delete(name); draw(); };
}
at('search').oninput = draw;
draw();
"""


def html_report(title: str, links: DataFrame, arcs: DataFrame, records: DataFrame, path: str, most: int = 5_000) -> None:
    """A page that stands alone: the graph as SVG, a toggle per relationship, a search over pairs, and their token differences.

    ``records`` as ``graph.diff_records`` gives them; without texts no differences are shown.
    """
    from docloom.functions.diff import diff_column
    from docloom.operators.graph import arc_points, chord

    curve = lambda points: " ".join(f"{p.x:.4f},{-p.y:.4f}" for p in points)
    ribs = _few(links.select("relationship", "source_node", "target_node", "width", chord(F.col("source_angle"), F.col("target_angle"), F.col("source_node") == F.col("target_node")).alias("p")), most)
    rims = _few(arcs.select("node", arc_points(F.col("start"), F.col("end")).alias("p")), most)
    data = records
    if {"sourceText", "targetText"} <= {*records.columns}:
        data = records.withColumn("diff", diff_column(F.col("sourceText"), F.col("targetText"))).drop("sourceText", "targetText")
    rows = ",".join(r.j for r in _few(data.select(X.script_safe(F.to_json(F.struct("*"))).alias("j")), most))
    body = [f'<polyline data-relationship="{html.escape(r.relationship)}" points="{curve(r.p)}" stroke="#1f9e89" stroke-opacity=".5" fill="none" stroke-width="{r.width / 400:.4f}"><title>{html.escape(f"{r.source_node} - {r.target_node}: {r.relationship}")}</title></polyline>' for r in ribs]
    body += [f'<polyline points="{curve(r.p)}" stroke="#334155" fill="none" stroke-width=".04"><title>{html.escape(r.node)}</title></polyline>' for r in rims]
    page = f"""<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1><p id="toggles"></p><svg viewBox="-1.5 -1.5 3 3" width="800">{"".join(body)}</svg>
<p><input id="search" placeholder="search pairs"></p><ul id="pairs"></ul><p id="note"></p><div id="both"><div id="left"></div><div id="right"></div></div><script type="application/json" id="records">[{rows}]</script><script>{_SCRIPT}</script></body></html>"""
    Path(path).write_text(page, encoding="utf-8")
