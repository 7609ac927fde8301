"""Interactive HTML of a styled graph: one self-contained file, written by the driver.

A page that a browser can draw is small, so node and edge tables of more than ``most`` rows raise an error.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

#: Layouts of the modes: background, gravity to the centre, repulsion, spring length, arrows, whether the physics can be tuned.
LAYOUTS = {
    "directed": {"background": "#ffffff", "gravity": 0.015, "repulsion": 900, "spring": 100, "arrows": True, "tune": False},
    "undirected": {"background": "#ffffff", "gravity": 0.015, "repulsion": 310, "spring": 100, "arrows": False, "tune": True},
    "dark": {"background": "#1a1a1a", "gravity": 0.01, "repulsion": 1500, "spring": 400, "arrows": False, "tune": False},
}

_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Concept graph</title>
<style>body{margin:0;background:__BACK__;font:13px sans-serif}#bar{position:fixed;padding:6px}canvas{display:block;width:100%;height:900px}</style></head>
<body><div id="bar"><select id="pick"><option value="">all nodes</option></select> <span id="tune"></span> <span id="say"></span></div><canvas id="c"></canvas>
<script>
const G=__DATA__, L=__LAYOUT__, c=document.getElementById('c'), x=c.getContext('2d'), at={}, say=document.getElementById('say'), pick=document.getElementById('pick');
c.width=c.clientWidth;c.height=900;
G.nodes.forEach((n,i)=>{const a=i*2.4,r=12*Math.sqrt(i);n.x=c.width/2+r*Math.cos(a);n.y=450+r*Math.sin(a);n.u=n.v=0;at[n.id]=n;const o=document.createElement('option');o.value=o.text=n.id;pick.add(o)});
if(L.tune){const r=document.createElement('input');r.type='range';r.min=50;r.max=2000;r.value=L.repulsion;r.oninput=()=>{L.repulsion=+r.value;left=200};document.getElementById('tune').append(r)}
let left=400;pick.onchange=()=>{left=Math.max(left,1)};
const top_=Math.max(1,...G.edges.map(e=>e.value));
function step(){const N=G.nodes;for(const n of N){n.u+=(c.width/2-n.x)*L.gravity;n.v+=(450-n.y)*L.gravity;for(const m of N)if(m!==n){const dx=n.x-m.x,dy=n.y-m.y,d=dx*dx+dy*dy+1;n.u+=L.repulsion*dx/d/10;n.v+=L.repulsion*dy/d/10}}
for(const e of G.edges){const a=at[e.from],b=at[e.to],dx=b.x-a.x,dy=b.y-a.y,d=Math.hypot(dx,dy)||1,f=(d-L.spring)*.004;a.u+=dx/d*f*10;a.v+=dy/d*f*10;b.u-=dx/d*f*10;b.v-=dy/d*f*10}
for(const n of N){n.x+=Math.max(-50,Math.min(50,n.u*=.4));n.y+=Math.max(-50,Math.min(50,n.v*=.4))}}
function near(id){return G.edges.some(e=>(e.from===pick.value&&e.to===id)||(e.to===pick.value&&e.from===id))||id===pick.value}
function draw(){x.fillStyle='__BACK__';x.fillRect(0,0,c.width,900);for(const e of G.edges){const a=at[e.from],b=at[e.to];x.globalAlpha=!pick.value||e.from===pick.value||e.to===pick.value?.6:.05;x.strokeStyle=x.fillStyle=a.color;x.lineWidth=1+11*e.value/top_;x.beginPath();x.moveTo(a.x,a.y);x.lineTo(b.x,b.y);x.stroke();
if(L.arrows){const t=Math.atan2(b.y-a.y,b.x-a.x),r=b.size/3;x.beginPath();x.moveTo(b.x-r*Math.cos(t),b.y-r*Math.sin(t));for(const s of[-.4,.4])x.lineTo(b.x-(r+9)*Math.cos(t+s*.5),b.y-(r+9)*Math.sin(t+s*.5));x.fill()}}
for(const n of G.nodes){x.globalAlpha=!pick.value||near(n.id)?1:.15;x.fillStyle=n.color;x.beginPath();x.arc(n.x,n.y,n.size/3,0,7);x.fill();x.fillStyle='#888';x.fillText(n.id,n.x+n.size/3+2,n.y)}x.globalAlpha=1}
function run(){if(left>0){step();left--;draw()}requestAnimationFrame(run)}run();
c.onmousemove=m=>{const r=c.getBoundingClientRect(),p=(m.clientX-r.left)*c.width/r.width,q=(m.clientY-r.top)*900/r.height;let t='';for(const e of G.edges){const a=at[e.from],b=at[e.to];if(Math.hypot(p-(a.x+b.x)/2,q-(a.y+b.y)/2)<8)t=e.from+' \\u2192 '+e.to+': '+(e.label||'')+' '+(e.title||'')}say.textContent=t};
</script></body></html>
"""


def page(nodes: DataFrame, edges: DataFrame, layout: str = "directed", most: int = 20_000) -> str:
    """HTML of ``(id, group, color, size)`` and ``(src, dst, title, label, value)``."""
    points, lines = nodes.limit(most + 1).collect(), edges.limit(most + 1).collect()
    if max(len(points), len(lines)) > most:
        raise ValueError(f"a page takes at most {most} nodes and edges")
    data = {
        "nodes": [{"id": str(r["id"]), "group": r["group"], "color": r["color"], "size": r["size"]} for r in points],
        "edges": [{"from": str(r["src"]), "to": str(r["dst"]), "title": r["title"], "label": r["label"], "value": r["value"]} for r in lines],
    }
    text = json.dumps(data).replace("</", "<\\/")
    return _PAGE.replace("__BACK__", LAYOUTS[layout]["background"]).replace("__LAYOUT__", json.dumps(LAYOUTS[layout])).replace("__DATA__", text)


def write_page(nodes: DataFrame, edges: DataFrame, path: str, layout: str = "directed") -> None:
    """Write the page to a file of the driver's machine, making its folder."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(page(nodes, edges, layout), encoding="utf-8")
