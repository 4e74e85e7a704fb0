"""Signal and move kernels (PRJ-16, PRJ-19..21, WIN-11, KRN-08..13, MOD-01, MOV-04, AGG-25)."""

from __future__ import annotations

import numpy as np


def trim_start(signal: np.ndarray, threshold: float = 2.4, window: int = 40, most: int = 8000, least: int = 10, elements: int = 3) -> int:
    """Samples to cut at the front: where the first window ends that falls to the
    threshold once a window has had more than ``elements`` samples above it; ``least`` if
    there is none or it reaches into the last ``least`` samples."""
    x = signal[:most]
    usable = len(x) - least
    if usable < window:
        return least
    w = x[least : least + usable // window * window].reshape(-1, window)
    peak = np.maximum.accumulate((w > threshold).sum(1) > elements)
    falls = np.flatnonzero(peak & (w[:, -1] <= threshold))
    end = least + window * (int(falls[0]) + 1) if len(falls) else usable
    return end if end < usable else least


def rna_adapter_end(signal: np.ndarray, size: int = 250, stride: int = 50, begin: int = 1000, least: int = 700, jump: float = 125, alone: float = 150) -> int:
    """Where the (lower) medians of windows rise: five windows in a row of which a later
    one is more than ``jump`` above an earlier one and above ``least``, or more than
    ``alone`` above it. Starts from ``begin`` up to three quarters of the signal; 0 if nowhere."""
    starts = np.arange(begin, 3 * len(signal) // 4, stride)
    if len(starts) < 6:
        return 0
    medians = np.array([np.sort(x)[(len(x) - 1) // 2] for x in (signal[i : i + size] for i in starts.tolist())], float)
    at = np.arange(5, len(starts))[:, None]
    five = at - (at - np.arange(5)) % 5  # windows by their number modulo five: ties go to the first least and the last greatest
    m, row = medians[five], np.arange(len(at))
    low, high = m.argmin(1), 4 - m[:, ::-1].argmax(1)
    rise, top = m[row, high] - m[row, low], m[row, high]
    found = np.flatnonzero((five[row, high] > five[row, low]) & (((top > least) & (rise > jump)) | (rise > alone)))
    return int(starts[5 + found[0]]) if len(found) else 0


def window_stats(signal: np.ndarray, size: int, stride: int) -> list[tuple[int, float, float]]:
    """(start, mean, standard deviation) of sliding windows."""
    starts = range(0, max(0, len(signal) - size) + 1, stride)
    return [(i, float(np.mean(signal[i : i + size])), float(np.std(signal[i : i + size]))) for i in starts if len(signal[i : i + size])]


def flat_intervals(stats: list[tuple[int, float, float]], size: int, most_sd: float, mean_range: tuple[float, float], merge: int) -> list[tuple[int, int]]:
    """Unions of quiet windows of like mean that are at most ``merge`` apart."""
    out: list[list[int]] = []
    for start, mean, sd in stats:
        if sd <= most_sd and mean_range[0] <= mean <= mean_range[1]:
            if out and start <= out[-1][1] + merge:
                out[-1][1] = start + size
            else:
                out.append([start, start + size])
    return [tuple(x) for x in out]


def poly_tail(signal: np.ndarray, anchor: int, samples_per_base: float, size_bases: int = 5, stride: int = 3, most_sd: float = 0.2, mean_range: tuple[float, float] = (-5.0, 5.0), spread: int = 5000, offset: float = 0.0) -> int:
    """Bases of the poly-tail near an anchor: the longest quiet interval around it, of
    equally long ones the one farther from the anchor; -1 if there is none."""
    lo = max(0, anchor - spread)
    part = signal[lo : anchor + spread]
    size = max(1, int(size_bases * samples_per_base))
    found = flat_intervals(window_stats(part, size, stride), size, most_sd, mean_range, size)
    if not found:
        return -1
    far = lambda x: min(abs(x[0] + lo - anchor), abs(x[1] + lo - anchor))
    best = max(found, key=lambda x: (x[1] - x[0], far(x)))
    return max(0, int(np.floor((best[1] - best[0]) / samples_per_base - offset + 0.5)))


def pore_regions(signal: np.ndarray, threshold: float, merge: int, least: int = 1) -> list[tuple[int, int, int, float]]:
    """(start, end, place of the peak, peak) of clusters of samples above a threshold."""
    at = np.flatnonzero(signal > threshold)
    if not len(at):
        return []
    parts = np.split(at, np.flatnonzero(np.diff(at) > merge) + 1)
    out = []
    for p in parts:
        a, b = int(p[0]), int(p[-1]) + 1
        if b - a >= least:
            k = a + int(np.argmax(signal[a:b]))
            out.append((a, b, k, float(signal[k])))
    return out


def split_points(seq: str, qual: np.ndarray, signal: np.ndarray, moves: np.ndarray, stride: int, threshold: float, top: int = 10, low_q: float = 10, reach: int = 5) -> list[int]:
    """Base places where a read may be two: pore regions of the highest peaks that
    bases of low literal mean quality follow."""
    bases = np.cumsum(moves) - 1
    regions = sorted(pore_regions(signal, threshold, merge=10 * stride), key=lambda r: -r[3])[:top]
    out = []
    for a, *_ in sorted(regions):
        k = min(a // stride, len(bases) - 1)
        p = int(bases[k]) + 1 if k >= 0 else 0
        after = qual[p : p + reach]
        if 0 < p < len(seq) and len(after) and float(np.mean(after)) < low_q:
            out.append(p)
    return out


def mux_change_trim(qual: np.ndarray, mux_change: bool = True, least_len: int = 100, least_kept: float = 0.3, least_trim: int = 5) -> int:
    """Length to keep of a read that ended in a change of the pore: up to before the place
    of the least running score from the 3' end (low -1, middle +1, high +10), of
    equal ones the foremost. Untouched if less than ``least_kept`` would stay or less
    than ``least_trim`` would go."""
    n = len(qual)
    if not mux_change or n < least_len:
        return n
    total = np.cumsum(np.where(qual <= 7, -1, np.where(qual <= 12, 1, 10))[::-1])
    if total.min() > -1:
        return n
    keep = n - 2 - int(np.flatnonzero(total == total.min())[-1])
    return keep if np.floor(np.float32(n) * np.float32(least_kept)) <= keep < n - least_trim else n


def trim_mods(mm: str, ml: list[int], seq: str, begin: int, end: int) -> tuple[str, list[int]]:
    """MM and ML of seq[begin:end]."""
    out, probs, at = [], [], 0
    for part in filter(None, mm.split(";")):
        head, *skips = part.split(",")
        base = head[0]
        places = [i for i, b in enumerate(seq) if b == base or base == "N"]
        k, kept, last = -1, [], None
        n_codes = max(1, len(head.rstrip("?.")) - 2) if head[2:3].isalpha() else 1
        inside = [i for i in places if begin <= i < end]
        rank = {p: r for r, p in enumerate(inside)}
        for s in skips:
            k += int(s) + 1
            p = places[k]
            if p in rank:
                kept.append(rank[p] - (last + 1 if last is not None else 0))
                last = rank[p]
                probs.extend(ml[at : at + n_codes])
            at += n_codes
        out.append(head + "".join(f",{x}" for x in kept) + ";")
    return "".join(out), probs


def realign_moves(old: str, new: str, moves: list[int]) -> list[int]:
    """Moves of a changed sequence: places of bases that an alignment pairs stay;
    inserted bases take the next free places between them."""
    at = [i for i, m in enumerate(moves) if m]
    n, m = len(old), len(new)
    d = np.zeros((n + 1, m + 1), int)
    d[:, 0], d[0] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (old[i - 1] != new[j - 1]))
    place: list[int | None] = [None] * m
    i, j = n, m
    while i and j:
        if d[i, j] == d[i - 1, j - 1] + (old[i - 1] != new[j - 1]):
            i, j = i - 1, j - 1
            place[j] = at[i]
        elif d[i, j] == d[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    used = {p for p in place if p is not None}
    last = -1
    for k in range(m):
        if place[k] is None:
            place[k] = next((p for p in range(last + 1, len(moves)) if p not in used), None)
            if place[k] is not None:
                used.add(place[k])
        last = place[k] if place[k] is not None else last
    return [1 if p in used else 0 for p in range(len(moves))]


def stitch(chunks: list[tuple[int, str, str, list[int]]], stride: int) -> tuple[str, str, list[int]]:
    """Joins (offset in samples, bases, qualities, moves) of overlapping chunks: each
    overlap is halved, bases go by their moves."""
    seq, qual, moves = "", "", []
    chunks = sorted(chunks)
    for k, (offset, s, q, m) in enumerate(chunks):
        lo = 0 if k == 0 else (chunks[k - 1][0] + len(chunks[k - 1][3]) * stride - offset) // stride
        hi = len(m) if k == len(chunks) - 1 else (offset + len(m) * stride - chunks[k + 1][0]) // stride
        a = 0 if k == 0 else max(0, lo) - max(0, lo) // 2
        b = len(m) if k == len(chunks) - 1 else len(m) - max(0, hi) // 2
        first, last = sum(m[:a]), sum(m[:b])
        seq, qual, moves = seq + s[first:last], qual + q[first:last], moves + m[a:b]
    return seq, qual, moves


def duplex_consensus(template: str, t_qual: list[int], complement: str, c_qual: list[int], pool: int = 5) -> str:
    """Of two aligned strands (``-`` for gaps) the base of higher quality in each
    column; qualities are the least around; ties go to the template."""
    def floor(q: list[int]) -> list[int]:
        h = pool // 2
        return [min(q[max(0, i - h) : i + h + 1]) for i in range(len(q))]

    a, b = floor(t_qual), floor(c_qual)
    return "".join(t if x >= y else c for t, c, x, y in zip(template, complement, a, b, strict=True)).replace("-", "")
