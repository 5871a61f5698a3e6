"""The rules of the order-dependent operators, one line at a time, in plain Python.

Lines are dicts with seq, service, text and us (microseconds), in arrival order.
"""

import re


def by_time(lines):
    return sorted(lines, key=lambda r: (r["us"], r["seq"]))


def head(lines, n):
    seen, out = {}, []
    for r in lines:
        seen[r["service"]] = seen.get(r["service"], 0) + 1
        if seen[r["service"]] <= n:
            out.append(r["seq"])
    return out


def last_n(lines, n):
    return sorted(head(list(reversed(lines)), n))


def every(lines, n, per_service):
    count, out = {}, []
    for r in lines:
        key = r["service"] if per_service else "all"
        count[key] = count.get(key, 0) + 1
        if count[key] % n == 0:
            out.append(r["seq"])
    return out


def gate(lines, opens, closes, initially=False, per_service=False):
    state, out = {}, []
    for r in lines:
        key = r["service"] if per_service else "all"
        text = r["text"]
        is_open = state.get(key, initially)
        if not is_open and text is not None and re.search(opens, text):
            is_open = True
        if is_open:
            out.append(r["seq"])
            if closes and text is not None and re.search(closes, text):
                is_open = False
        state[key] = is_open
    return out


def suppress(lines, most):
    last, reps, out = {}, {}, []
    for r in lines:
        s = r["service"]
        if s in last and last[s] == r["text"]:
            reps[s] += 1
        else:
            reps[s] = 1
        last[s] = r["text"]
        if reps[s] <= most:
            out.append(r["seq"])
    return out


def debounce(lines, window):
    last, out = {}, []
    for r in by_time(lines):
        s = r["service"]
        if not (s in last and last[s][0] == r["text"] and r["us"] - last[s][1] < window):
            out.append(r["seq"])
        last[s] = (r["text"], r["us"])
    return sorted(out)


def offsets(lines):
    at, out = {}, []
    for r in lines:
        s = r["service"]
        out.append((r["seq"], at.get(s, 0)))
        at[s] = at.get(s, 0) + len((r["text"] or "").encode()) + 1
    return out


def join_runs(lines, sep, most):
    out, buf, current, last, first = [], [], "", None, True

    def flush():
        if buf:
            out.append((last["seq"], last["service"], sep.join(buf)))
            buf.clear()

    for r in lines:
        if not first and r["service"] != current and current != "":
            flush()
        first = False
        current, last = r["service"], r
        buf.append(r["text"] or "")
        if len(buf) >= most:
            flush()
    flush()
    return out


def multiline(lines, start, timeout):
    """Shared buffer; the timer starts with the first line and is set again by start lines only."""
    out, buf = [], []
    head, deadline, armed = None, None, True
    for r in lines:
        if deadline is None:
            deadline = r["us"] + timeout
        if armed and r["us"] >= deadline:
            if buf:
                out.append((head["service"] if head else "", "\n".join(buf)))
            buf, armed = [], False
        if r["text"] is not None and re.search(start, r["text"]):
            if buf:
                out.append((head["service"] if head else "", "\n".join(buf)))
            buf, head, deadline, armed = [], r, r["us"] + timeout, True
        buf.append(r["text"] or "")
    if buf:
        out.append((head["service"] if head else "", "\n".join(buf)))
    return out


def bursts(lines, window):
    open_, out = {}, []
    for r in by_time(lines):
        s = r["service"]
        if s in open_ and r["us"] - open_[s][1] > window:
            out.append((s, " | ".join(open_.pop(s)[0])))
        buf = open_[s][0] if s in open_ else []
        buf.append(r["text"] or "")
        open_[s] = (buf, r["us"])
    return out + [(s, " | ".join(b)) for s, (b, _) in open_.items()]


def batches(lines, size, interval=None):
    out, buf, start = [], [], None
    for r in lines:
        if buf and interval is not None and r["us"] >= start + interval:
            out.append(buf)
            buf = []
        if not buf:
            start = r["us"]
        buf.append(r["seq"])
        if len(buf) >= size:
            out.append(buf)
            buf = []
    return out + ([buf] if buf else [])


def pace(lines, rate, per_service=False):
    step, last, out = 1_000_000_000 // rate, {}, []
    for r in lines:
        key = r["service"] if per_service else "all"
        at = r["us"] * 1000
        if key in last:
            at = max(at, last[key] + step)
        last[key] = at
        out.append((r["seq"], at // 1000))
    return out


def reorder(lines, window, extract):
    start = min(r["us"] for r in lines)

    def key(r):
        t = extract(r["text"])
        return ((r["us"] - start) // window, r["us"] if t is None else t, r["seq"])

    return [r["seq"] for r in sorted(lines, key=key)]


def rolling(lines, size):
    return [
        (r["seq"], sum(o["service"] == r["service"] and r["us"] - size <= o["us"] <= r["us"] for o in lines))
        for r in lines
    ]


def norm(text):
    return (text or "").lower().strip()


def dice(a, b):
    a, b = a.encode(), b.encode()
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0

    def grams(x):
        out = {}
        for i in range(len(x) - 1):
            out[x[i : i + 2]] = out.get(x[i : i + 2], 0) + 1
        return out

    ga, gb = grams(a), grams(b)
    shared = sum(min(n, gb.get(g, 0)) for g, n in ga.items())
    return 2 * shared / (len(ga) + len(gb))


def drift(lines, threshold=None):
    seen, out = set(), []
    for r in lines:
        n = norm(r["text"])
        if threshold is None:
            new = n not in seen
        else:
            new = not any(dice(n, k) >= threshold for k in seen)
        seen.add(n)
        out.append((r["seq"], new))
    return out


def drift_other(lines):
    seen, out = set(), []
    for r in lines:
        n = norm(r["text"])
        out.append((r["seq"], not any(k == n and s != r["service"] for k, s in seen)))
        seen.add((n, r["service"]))
    return out
