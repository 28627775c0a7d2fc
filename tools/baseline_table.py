"""Render the 'Our own numbers' table from a bench JSON line and plan shapes.

usage: python tools/baseline_table.py BENCH.json SHAPES.jsonl
"""
import json
import sys

bench = json.loads(open(sys.argv[1]).read().strip().splitlines()[-1])
shapes = {}
for line in open(sys.argv[2]):
    if line.startswith("{"):
        d = json.loads(line)
        shapes[d["query"]] = d
print(f"sf {bench['sf']}, local[{bench.get('cpus', '8')}], PySpark 4.1.2, total {bench['value']} s\n")
print("| query | sec | shuffles | broadcast joins | sort-merge joins | windows | scans |")
print("|---|---:|---:|---:|---:|---:|---:|")
for k, v in bench["queries"].items():
    s = shapes.get(k, {})
    print(f"| `{k}` | {v} | {s.get('shuffles', '–')} | {s.get('bhj', '–')} | {s.get('smj', '–')} | "
          f"{s.get('windows', '–')} | {s.get('scans', '–')} |")
