"""The analyses stated on sorted lists (no Spark), as test oracles for random events."""

from __future__ import annotations

from bisect import bisect_right
from datetime import datetime
from itertools import accumulate, groupby


def to_epoch(text):
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp() if text and text[:4].isdigit() and text[4:5] == "-" else 0.0
    except ValueError:
        return 0.0


def text_sorted(events):
    return sorted(events, key=lambda e: (e["timestamp"], e["id"]))


def epoch_sorted(events):
    return sorted(events, key=lambda e: (to_epoch(e["timestamp"]), e["timestamp"], e["id"]))


def windows(items, n):
    return zip(*(items[k:] for k in range(n)), strict=False)


def bursts(events, threshold=0.5):
    rates = ((c["id"], to_epoch(a["timestamp"]), to_epoch(c["timestamp"])) for a, _, c in windows(text_sorted(events), 3))
    return [(i, min(10.0, 3.0 / (t1 - t0) * 2)) for i, t0, t1 in rates if t0 and t1 and t1 > t0 and 3.0 / (t1 - t0) > threshold]


def repetitions(events, first_only=False):
    hits = [five[-1]["id"] for five in windows(text_sorted(events), 5) if all(e["event_type"] == five[0]["event_type"] for e in five)]
    return hits[:1] if first_only else hits


def chains(events):
    """Runs of blocked events of length three or more, reported at the event that
    follows (or at the last one, at the end)."""
    ev = text_sorted(events)
    runs = [(bool(k), len(list(g))) for k, g in groupby(ev, key=lambda e: bool(e.get("blocked")))]
    stops = accumulate(n for _, n in runs)
    return [(ev[min(stop, len(ev) - 1)]["id"], n, stop == len(ev)) for (blocked, n), stop in zip(runs, stops, strict=True) if blocked and n >= 3]


def groups(events, window):
    """(first event, size) of the groups, jumping from anchor to anchor."""
    ev = epoch_sorted(events)
    times, out, at = [to_epoch(e["timestamp"]) for e in ev], [], 0
    while at < len(ev):
        beyond = bisect_right(times, window, lo=at, key=lambda t, t0=times[at]: t - t0)
        out.append((ev[at]["id"], beyond - at))
        at = beyond
    return out


def per_key(fn, events, key="agent_id", **kw):
    return [x for k in sorted({e[key] for e in events}) for x in fn([e for e in events if e[key] == k], **kw)]
