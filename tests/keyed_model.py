"""A step-by-step model of the keyed detections, for comparison with the Spark result.

Rows are dicts with key, sec, file, line and two flags: counted and follow (both may be set).
"""

from collections import defaultdict


def run(rows, need, window_seconds, sequence):
    """Fired rows as (key, sec, file, line, count), rows taken in (sec, file, line) order."""
    history, last, fired = defaultdict(list), {}, []
    for row in sorted(rows, key=lambda r: (r["sec"], r["file"], r["line"])):
        key, now = row["key"], row["sec"]
        trigger = row["follow"] if sequence else row["counted"]
        if not sequence and row["counted"] or sequence and row["counted"] and not row["follow"]:
            history[key].append(now)
        if not trigger:
            continue
        history[key] = [t for t in history[key] if t >= now - window_seconds]
        if len(history[key]) >= need and (key not in last or now - last[key] >= window_seconds):
            last[key] = now
            fired.append((key, now, row["file"], row["line"], len(history[key])))
    return sorted(fired)
