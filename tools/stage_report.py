"""Summarise stage timings from a Spark event-log directory.

    python tools/stage_report.py <eventlog dir> [last N stages]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            data = zstandard.ZstdDecompressor().stream_reader(fh).read()
        yield from io.StringIO(data.decode("utf-8"))
    elif os.path.basename(path).startswith(("events_", "local-", "app")) or path.endswith(".inprogress"):
        with open(path, encoding="utf-8", errors="replace") as fh:
            yield from fh


def stages(evdir):
    out = {}
    for f in sorted(glob.glob(os.path.join(evdir, "**", "*"), recursive=True)):
        if os.path.isdir(f) or "appstatus" in f:
            continue
        for line in _lines(f):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if e.get("Event") == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                acc = {a["Name"]: a.get("Value") for a in si.get("Accumulables", [])}
                out[si["Stage ID"]] = dict(
                    name=si["Stage Name"][:40], tasks=si["Number of Tasks"],
                    ms=si.get("Completion Time", 0) - si.get("Submission Time", 0),
                    input=acc.get("internal.metrics.input.recordsRead"),
                    shuffle_read=acc.get("internal.metrics.shuffle.read.recordsRead"),
                    shuffle_write=acc.get("internal.metrics.shuffle.write.recordsWritten"))
    return out


if __name__ == "__main__":
    st = stages(sys.argv[1])
    n = int(sys.argv[2]) if len(sys.argv) > 2 else 60
    print(f"{len(st)} stages")
    for k, v in sorted(st.items())[-n:]:
        print(k, v)
