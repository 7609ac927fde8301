"""Pages of large graphs: tiles by zoom level, and a page that loads those in view.

On a zoom level the drawing is 2^z by 2^z tiles of 16 by 16 bins. A bin shows how many nodes it holds and its weightiest one; lines are sums of the edges
between bins. On the last level every node is listed by itself. Nothing is left out: every node and every edge between bins is in some bin and line of each level.
A tile is a file ``tiles/z/x/y.json`` with a JSON object a line, written as its rows come, so no tile is held in memory. Files are written through ``pyarrow.fs``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import apart, cut, scratch

BINS = 16

_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Concept graph</title><style>body{margin:0;font:12px sans-serif}canvas{display:block;width:100vw;height:100vh}#say{position:fixed;padding:6px;background:#fffc}</style></head>
<body><div id="say"></div><canvas id="c"></canvas><script>
const LAST=__LAST__, BINS=__BINS__, c=document.getElementById('c'), x=c.getContext('2d'), say=document.getElementById('say'), kept=new Map();
let scale=Math.min(innerWidth,innerHeight), left=0, top_=0, grab=null;
function tile(z,i,j){const k=z+'/'+i+'/'+j;if(!kept.has(k)){kept.set(k,[]);fetch('tiles/'+k+'.json').then(r=>r.ok?r.text():'').then(t=>{kept.set(k,t.split('\\n').filter(s=>s).map(s=>JSON.parse(s)));draw()}).catch(()=>{})}return kept.get(k)}
function draw(){c.width=innerWidth;c.height=innerHeight;const z=Math.max(0,Math.min(LAST,Math.round(Math.log2(scale/512)))),n=2**z;
const a=Math.max(0,Math.floor(-left/scale*n)),b=Math.min(n-1,Math.floor((c.width-left)/scale*n)),p=Math.max(0,Math.floor(-top_/scale*n)),q=Math.min(n-1,Math.floor((c.height-top_)/scale*n)),shown=[];
for(let i=a;i<=b;i++)for(let j=p;j<=q;j++)shown.push(...tile(z,i,j));
x.globalAlpha=.25;for(const r of shown)if(r.k==='e'){x.lineWidth=Math.min(6,.5+Math.log1p(r.w)/2);x.beginPath();x.moveTo(left+r.x*scale,top_+r.y*scale);x.lineTo(left+r.u*scale,top_+r.v*scale);x.stroke()}
x.globalAlpha=1;for(const r of shown)if(r.k==='n'){x.fillStyle=r.c||'#4477aa';x.beginPath();x.arc(left+r.x*scale,top_+r.y*scale,2+Math.log2(1+r.n),0,7);x.fill();x.fillStyle='#222';x.fillText(r.id+(r.n>1?' +'+(r.n-1):''),left+r.x*scale+6,top_+r.y*scale)}
say.textContent='zoom '+z+', '+shown.length+' items'}
c.onwheel=e=>{const f=Math.exp(-e.deltaY/400);left=e.clientX-(e.clientX-left)*f;top_=e.clientY-(e.clientY-top_)*f;scale*=f;draw();e.preventDefault()};
c.onmousedown=e=>grab=[e.clientX-left,e.clientY-top_];c.onmouseup=()=>grab=null;c.onmousemove=e=>{if(grab){left=e.clientX-grab[0];top_=e.clientY-grab[1];draw()}};onresize=draw;draw();
</script></body></html>
"""


def zoom_levels(n: int) -> int:
    """The last zoom level at which a tile has some hundred nodes on average."""
    return max(0, math.ceil(math.log(max(1, n / BINS**2), 4)))


def tile_rows(places: DataFrame, edges: DataFrame, last: int | None = None) -> DataFrame:
    """``(z, tx, ty, kind, id, color, n, x, y, u, v, w)``: what the tiles show, with places between 0 and 1.

    ``places``: ``(id, x, y, weight, color)``; ``edges``: ``(src, dst, weight)``. Kind ``n`` is a bin with ``n`` nodes, of which ``id`` weighs most, and ``e`` the sum ``w`` of the ``n`` edges
    from one bin to another, in either direction, listed in the tiles of both. Edges within a bin aren't drawn, nor those to nodes without a place.
    """
    box = places.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n, low_x, high_x, low_y, high_y = box
    last = zoom_levels(n) if last is None else last
    side = max((high_x or 0) - (low_x or 0), (high_y or 0) - (low_y or 0)) * 1.000001 or 1.0
    unit = cut(places.select("id", "weight", "color", ((F.col("x") - (low_x or 0.0)) / side).alias("x"), ((F.col("y") - (low_y or 0.0)) / side).alias("y")), "unit")
    per = F.pow(F.lit(2.0), F.col("z")) * BINS
    levels = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("z")
    spot = unit.select("*", levels).withColumns({"bx": F.floor(F.col("x") * per), "by": F.floor(F.col("y") * per)})
    own = F.when(F.col("z") == last, F.col("id"))  # on the last level a node is alone
    bins = spot.groupBy("z", "bx", "by", own.alias("own")).agg(
        F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.min(F.struct(-F.col("weight"), "id", "color")).alias("best")
    )
    nodes = bins.select("z", F.floor(F.col("bx") / BINS).alias("tx"), F.floor(F.col("by") / BINS).alias("ty"), F.lit("n").alias("kind"), F.col("best.id").cast("string").alias("id"), F.col("best.color").alias("color"), "n", "x", "y",
                        *[F.lit(None).cast("double").alias(k) for k in "uvw"])
    a, b = (unit.select(F.col("id").alias(end), F.col("x").alias(f"{p}"), F.col("y").alias(f"{q}")) for end, p, q in (("src", "ax", "ay"), ("dst", "cx", "cy")))
    lines = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).join(apart(a), "src").join(apart(b), "dst").select("weight", "ax", "ay", "cx", "cy", levels)
    first, second = (F.struct(F.floor(F.col(p) * per).alias("bx"), F.floor(F.col(q) * per).alias("by")) for p, q in (("ax", "ay"), ("cx", "cy")))
    lines = lines.select("z", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), "weight").where("a <> b").groupBy("z", "a", "b").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    at = lambda c, k: (F.col(f"{c}.{k}") + 0.5) / per
    tiles = F.array_distinct(F.array(*[F.struct(F.floor(F.col(f"{c}.bx") / BINS).alias("tx"), F.floor(F.col(f"{c}.by") / BINS).alias("ty")) for c in "ab"]))
    drawn = lines.select("z", F.inline(tiles), F.lit("e").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("color"), "n",
                         at("a", "bx").alias("x"), at("a", "by").alias("y"), at("b", "bx").alias("u"), at("b", "by").alias("v"), "w")
    return nodes.unionByName(drawn)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _writer(folder: str):
    """Writes each tile of the sorted rows to its file. A task that runs again writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        now, out, done, n = None, None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                tile = (r["z"], r["tx"], r["ty"])
                if tile != now:
                    if out:
                        out.close()
                        done.append((*now, n))
                    files.create_dir(f"{root}/tiles/{tile[0]}/{tile[1]}", recursive=True)
                    now, out, n = tile, files.open_output_stream(f"{root}/tiles/{tile[0]}/{tile[1]}/{tile[2]}.json"), 0
                keys = {"k": r["kind"], "n": r["n"], "x": round(r["x"], 7), "y": round(r["y"], 7)}
                keys |= {"id": r["id"], "c": r["color"]} if r["kind"] == "n" else {"u": round(r["u"], 7), "v": round(r["v"], 7), "w": r["w"]}
                out.write(json.dumps(keys, ensure_ascii=False).encode() + b"\n")
                n += 1
        if out:
            out.close()
            done.append((*now, n))
        columns = zip(*done, strict=True) if done else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["z", "tx", "ty", "items"])

    return write


def write_tiles(places: DataFrame, edges: DataFrame, folder: str, last: int | None = None) -> DataFrame:
    """Write ``index.html`` and the tiles of a layout to a folder that all executors share: ``(z, tx, ty, items)`` of what was written."""
    spark = places.sparkSession
    with scratch(spark) as made:
        rows = tile_rows(places, edges, last)
        levels = zoom_levels(places.count()) if last is None else last
        written = made.keep(cut(rows.repartition("z", "tx", "ty").sortWithinPartitions("z", "tx", "ty", "kind").mapInArrow(_writer(folder), "z int, tx long, ty long, items long"), "tiles"))
    files, root = _file_system(folder)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/index.html") as out:
        out.write(_PAGE.replace("__LAST__", str(levels)).replace("__BINS__", str(BINS)).encode())
    return written
