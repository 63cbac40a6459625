"""Handing networks to the eye: segments for a plot, and a page with a force layout."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.graph import LOCAL_EDGES, Graph
from weft.plans.linalg import collected

AXES = ("x", "y", "z")


def segments(graph: Graph, coordinates: DataFrame, *, directed: bool = False) -> DataFrame:
    """``src, dst, x1, y1, (z1,) x2, y2, (z2,) weight`` for each edge; ``coordinates`` are ``id, coords`` of one to three dimensions. One
    dimension is drawn over the ids. Undirected: each pair once."""
    dims = coordinates.agg(F.max(F.size("coords"))).first()[0] or 2
    if dims > 3:
        raise ValueError(f"{dims} dimensions are too many to plot")
    at = F.col("coords") if dims > 1 else F.array(F.col("id").cast("double"), F.col("coords")[0])
    dims = max(dims, 2)
    ends = [coordinates.select(F.col("id").alias(e), *[at[i].alias(f"{AXES[i]}{k}") for i in range(dims)]) for k, e in ((1, "src"), (2, "dst"))]
    own = graph.edge_weights(directed=directed)
    return own.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", *[f"{AXES[i]}{k}" for k in (1, 2) for i in range(dims)], "weight")


def plot(graph: Graph, coordinates: DataFrame, *, directed: bool = False, weighted: bool = False, ax=None, edge_style: dict | None = None, vertex_style: dict | None = None, title: str | None = None, cmap=None):
    """Draw with matplotlib where that is installed; gives the axes. Bounded by ``LOCAL_EDGES``."""
    from matplotlib import pyplot
    from matplotlib.collections import LineCollection
    from mpl_toolkits.mplot3d.art3d import Line3DCollection

    rows = segments(graph, coordinates, directed=directed).limit(LOCAL_EDGES + 1).toPandas()
    if len(rows) > LOCAL_EDGES:
        raise ValueError("too many edges to plot")
    names = [a for a in AXES if f"{a}1" in rows]
    ends = [[tuple(r[[f"{a}{k}" for a in names]]) for k in (1, 2)] for _, r in rows.iterrows()]
    flat = len(names) == 2
    ax = ax or pyplot.figure().add_subplot(projection=None if flat else "3d")
    style = {"colors": "k", "linewidths": 1} | (edge_style or {})
    drawn = (LineCollection if flat else Line3DCollection)(ends, cmap=cmap, **style)
    if weighted:
        drawn.set_array(rows["weight"].to_numpy())
    (ax.add_collection if flat else ax.add_collection3d)(drawn)
    import pandas as pd

    points = pd.DataFrame(collected(coordinates.select("id", "coords").orderBy("id"), "points to plot", LOCAL_EDGES), columns=["id", "coords"])
    xs = list(zip(*points["coords"], strict=True)) if len(points["coords"].iloc[0]) > 1 else [points["id"], [c[0] for c in points["coords"]]]
    ax.scatter(*xs, **({"c": "k", "s": 20} | (vertex_style or {})))
    ax.set_title(title or "")
    return ax


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1>
<svg id="graph" width="{width}" height="{height}" style="border:{border}"></svg>
<script src="https://d3js.org/d3.v7.min.js"></script>
<script type="application/json" id="data">{data}</script>
<script>
const data = JSON.parse(document.getElementById("data").textContent), svg = d3.select("#graph");
const line = svg.selectAll("line").data(data.links).join("line").attr("stroke", "#888").attr("stroke-width", d => 1 + 3 * d.value);
const dot = svg.selectAll("circle").data(data.nodes).join("circle").attr("r", 5)
  .attr("fill", d => d.group !== undefined ? d3.schemeCategory10[d.group % 10] : d3.interpolateViridis(d.color ?? 0.5));
dot.append("title").text(d => d.name);
d3.forceSimulation(data.nodes).force("link", d3.forceLink(data.links).distance(d => 30 + 60 * (1 - d.value)))
  .force("charge", d3.forceManyBody()).force("center", d3.forceCenter({width} / 2, {height} / 2))
  .on("tick", () => {{
    line.attr("x1", d => d.source.x).attr("y1", d => d.source.y).attr("x2", d => d.target.x).attr("y2", d => d.target.y);
    dot.attr("cx", d => d.x).attr("cy", d => d.y);
  }});
</script></body></html>
"""


def _scaled(values: list[float]) -> list[float]:
    low, high = min(values, default=0), max(values, default=0)
    return [(v - low) / (high - low) if high > low else 0.5 for v in values]


def to_html(graph: Graph, path: str, *, directed: bool = False, weighted: bool = False, vertex_ids: list[str] | None = None, vertex_colors: list[float] | None = None, vertex_labels: list | None = None, width: int = 900, height: int = 600, title: str | None = None, svg_border: str = "1px solid black") -> None:
    """Write a page that lays the graph out by forces. Vertices may have names, and either colours (numbers) or labels. Bounded by
    ``LOCAL_EDGES``; names are escaped."""
    if directed:
        raise NotImplementedError("directed pages")
    if vertex_colors is not None and vertex_labels is not None:
        raise ValueError("vertices have colours or labels, not both")
    ids = [r.id for r in collected(graph.vertices.orderBy("id"), "vertices of a page", LOCAL_EDGES)]
    for given in (vertex_ids, vertex_colors, vertex_labels):
        if given is not None and len(given) != len(ids):
            raise ValueError(f"{len(given)} values for {len(ids)} vertices")
    edges = graph.edge_weights(directed=False).where("src <> dst").orderBy("src", "dst")
    edges = collected(edges, "edges of a page", LOCAL_EDGES)
    nodes = [{"name": str(v if vertex_ids is None else vertex_ids[i])} for i, v in enumerate(ids)]
    if vertex_colors is not None:
        for n, c in zip(nodes, _scaled(list(map(float, vertex_colors))), strict=True):
            n["color"] = c
    if vertex_labels is not None:
        kinds = {v: i for i, v in enumerate(sorted(set(vertex_labels)))}
        for n, v in zip(nodes, vertex_labels, strict=True):
            n["group"] = kinds[v]
    at = {v: i for i, v in enumerate(ids)}
    values = _scaled([r.weight for r in edges]) if weighted else [1.0] * len(edges)
    links = [{"source": at[r.src], "target": at[r.dst], "value": v} for r, v in zip(edges, values, strict=True)]
    data = json.dumps({"nodes": nodes, "links": links}).replace("<", "\\u003c")
    with open(path, "w", encoding="utf-8") as f:
        f.write(_PAGE.format(title=html.escape(title or "Graph"), width=int(width), height=int(height), border=html.escape(svg_border, quote=True), data=data))
