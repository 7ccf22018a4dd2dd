"""Order-dependent clustering: one pandas fold per group, whose rows are put in order inside the function.

A group (an event, a folder, a page) is the unit of parallelism here; `islands` cuts long events for the one fold whose
rules reach only so far.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (least cosine, seconds, steps): a rule holds if the cosine reaches its bound and either gap is known and within its own.
SERVICE_RULES = ((0.88, 240.0, 10), (0.84, 120.0, 10), (0.82, 120.0, None))
#: Cosines of the integrated rules: alone, with the wide gaps, with the narrow gaps or another orientation.
INTEGRATED = (0.88, 0.84, 0.82)
WIDE_SECONDS, NARROW_SECONDS, STEPS = 240.0, 120.0, 10
SAME_PERSON = 0.55


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-12)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def _seconds(times: pd.Series) -> np.ndarray:
    """Seconds since the epoch, NaN if unknown."""
    t = pd.to_datetime(times)
    return np.where(t.isna(), np.nan, t.astype("datetime64[us]").astype("int64") / 1e6)


def first_fit(emb: np.ndarray, seconds: np.ndarray, steps: np.ndarray, focus: np.ndarray, rules: Sequence[tuple] = SERVICE_RULES, tail: int = 3) -> list[int]:
    """The cluster of each row, in order. A row joins the first cluster whose sharpest member or one of whose last
    `tail` members is similar to it by a rule; else it opens a cluster."""
    unit, out = _unit(emb), []
    members: list[list[int]] = []
    sharpest: list[int] = []
    for i in range(len(unit)):
        # One product against all representatives, in creation order.
        probes = [[sharpest[k], *members[k][-tail:]] for k in range(len(members))]
        home = -1
        if probes:
            flat = np.array([p for row in probes for p in row])
            owner = np.repeat(np.arange(len(probes)), [len(row) for row in probes])
            cosine, gap, jump = unit[flat] @ unit[i], np.abs(seconds[flat] - seconds[i]), np.abs(steps[flat] - steps[i])
            hit = np.zeros(len(flat), bool)
            for least, within, apart in rules:
                near = gap <= within
                if apart is not None:
                    near |= jump <= apart
                hit |= (cosine >= least) & near
            if hit.any():
                home = int(owner[hit].min())
        if home < 0:
            members.append([i])
            sharpest.append(i)
            home = len(members) - 1
        else:
            members[home].append(i)
            if focus[i] > focus[sharpest[home]]:
                sharpest[home] = i
        out.append(home)
    return out


def best_fit(emb: np.ndarray, seconds: np.ndarray, steps: np.ndarray, shape: Sequence[str], quality: Sequence[tuple], zero_gap_unknown: bool = False) -> list[tuple[int, float, str]]:
    """(cluster, score, rule) of each row, in order. Of the clusters that accept a row the one with the highest
    cosine to centroid or representative wins, the earlier of two. quality orders members; the highest represents.
    zero_gap_unknown keeps the older treatment of a gap of exactly zero to the representative as unknown."""
    unit = _unit(emb)
    rep: list[int] = []
    span: list[tuple] = []
    # Sums of members, and the unit vectors of their centroids: one row per cluster, in room that doubles.
    sums, centers = np.zeros((8, unit.shape[1])), np.zeros((8, unit.shape[1]))
    sizes = np.zeros(8, np.int64)
    out: list[tuple[int, float, str]] = []

    def accepted(i: int, k: int, score: float) -> str | None:
        low_t, high_t, low_s, high_s = span[k]
        to_rep = abs(seconds[rep[k]] - seconds[i])
        if zero_gap_unknown and to_rep == 0:
            to_rep = np.nan
        gaps = [g for g in (to_rep, abs(low_t - seconds[i]), abs(high_t - seconds[i])) if not np.isnan(g)]
        jumps = [g for g in (abs(steps[rep[k]] - steps[i]), abs(low_s - steps[i]), abs(high_s - steps[i])) if not np.isnan(g)]
        gap, jump = min(gaps, default=np.inf), min(jumps, default=np.inf)
        if score >= INTEGRATED[0]:
            return "strict"
        if score >= INTEGRATED[1] and (gap <= WIDE_SECONDS or jump <= STEPS):
            return "relaxed"
        if gap <= NARROW_SECONDS or jump <= STEPS or shape[i] != shape[rep[k]]:
            return "relaxed_near"
        return None

    for i in range(len(unit)):
        n = len(rep)
        scores = np.maximum(centers[:n] @ unit[i], unit[rep] @ unit[i]) if n else np.zeros(0)
        near = np.flatnonzero(scores >= INTEGRATED[2])
        near = near[np.argsort(-scores[near], kind="stable")].tolist()
        best = next(((k, float(scores[k]), rule) for k in near if (rule := accepted(i, k, float(scores[k])))), None)
        if best is None:
            best = (n, 1.0, "new_cluster")
            rep.append(i)
            span.append((np.nan, np.nan, np.nan, np.nan))
            if n == len(sums):
                sums, centers, sizes = (np.concatenate((x, np.zeros_like(x))) for x in (sums, centers, sizes))
        k = best[0]
        sums[k] += emb[i]
        sizes[k] += 1
        centers[k] = _unit(sums[k] / sizes[k])
        if quality[i] > quality[rep[k]]:
            rep[k] = i
        t, s = seconds[i], steps[i]
        span[k] = (np.fmin(span[k][0], t), np.fmax(span[k][1], t), np.fmin(span[k][2], s), np.fmax(span[k][3], s))
        out.append(best)
    return out


def running_centroids(emb: np.ndarray, least: float = SAME_PERSON) -> list[int]:
    """The identity of each row, in order: the centroid of highest inner product if it reaches `least`, else a new one."""
    centers, sizes, out = np.zeros((0, emb.shape[1])), [], []
    for e in emb:
        near = centers @ e
        k = int(near.argmax()) if len(near) else -1
        if k >= 0 and near[k] >= least:
            mean = (centers[k] * sizes[k] + e) / (sizes[k] + 1)
            centers[k], sizes[k] = mean / (np.linalg.norm(mean) + 1e-12), sizes[k] + 1
        else:
            k = len(sizes)
            centers, sizes = np.vstack((centers, e[None])), [*sizes, 1]
        out.append(k)
    return out


def bands_of(values: np.ndarray, tolerance: float) -> list[int]:
    """Rows of ascending values; one joins the current band while it is within `tolerance` of the band's running mean."""
    out, mean, n = [], None, 0
    for v in values:
        if mean is not None and abs(v - mean) <= tolerance:
            n += 1
            mean += (v - mean) / n
            out.append(out[-1])
        else:
            mean, n = v, 1
            out.append(out[-1] + 1 if out else 0)
    return out


def thinned(values: Sequence[float], tolerance: float) -> list[float]:
    """Ascending values, each more than `tolerance` above the last one kept."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > tolerance:
            out.append(v)
    return out


def modal_bin(values: Sequence[float], tolerance: float, counts: Sequence[int] | None = None) -> tuple[float, int] | None:
    """(mean to one place, count) of the fullest bin; a bin reaches `tolerance` above its first value; the lower of two.

    A value stands for as many as `counts` says, or for one."""
    order = np.argsort(np.asarray(values, float), kind="stable")
    ordered = np.asarray(values, float)[order]
    times = np.ones(len(ordered), int) if counts is None else np.asarray(counts, int)[order]
    before, best, where = np.concatenate([[0], np.cumsum(times)]), None, (0, 0)
    start = 0
    while start < len(ordered):
        stop = int(np.searchsorted(ordered, ordered[start] + tolerance, "right"))
        n = int(before[stop] - before[start])
        if best is None or n > best:
            best, where = n, (start, stop)
        start = stop
    if best is None:
        return None
    part = slice(*where)
    mean = ordered[part].mean() if counts is None else float(np.dot(ordered[part], times[part]) / best)
    return float(np.floor(mean * 10 + 0.5) / 10), best


def _folded(df: DataFrame, by: str, order: list[str], schema: str, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf.sort_values(order, kind="stable", na_position="first").reset_index(drop=True))

    return df.groupBy(by).applyInPandas(fold, schema)


def _key(df: DataFrame, by: str) -> str:
    return f"{by} {df.schema[by].dataType.simpleString()}"


def first_fit_clusters(photos: DataFrame, by: str, rules: Sequence[tuple] = SERVICE_RULES) -> DataFrame:
    """C01 over photos (by, id, name, ts, seq, emb, focus), in order of time, unknown first, name and id: (by, id, pos, cluster). An event is folded whole."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        cluster = first_fit(_matrix(p.emb), _seconds(p.ts), p.seq.to_numpy(float), p.focus.to_numpy(float), rules)
        return pd.DataFrame({by: p[by], "id": p.id, "pos": range(len(p)), "cluster": cluster})

    return _folded(photos.select(by, "id", "name", "ts", "seq", "emb", "focus"), by, ["ts", "name", "id"], f"{_key(photos, by)}, id long, pos int, cluster int", f)


def best_fit_clusters(photos: DataFrame, by: str, zero_gap_unknown: bool = False) -> DataFrame:
    """C02 over photos (by, id, name, ts, seq, emb, focus, shape), in order of name: (by, id, cluster, score, rule)."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        seconds = _seconds(p.ts)
        quality = [(a, -np.inf if np.isnan(b) else b, n) for a, b, n in zip(p.focus, seconds, p["name"], strict=True)]
        got = best_fit(_matrix(p.emb), seconds, p.seq.to_numpy(float), list(p["shape_"]), quality, zero_gap_unknown)
        return pd.DataFrame({by: p[by], "id": p.id, "cluster": [g[0] for g in got], "score": [g[1] for g in got], "rule": [g[2] for g in got]})

    rows = photos.select(by, "id", "name", "ts", "seq", "emb", "focus", photos["shape"].alias("shape_"))
    return _folded(rows, by, ["name"], f"{_key(photos, by)}, id long, cluster int, score double, rule string", f)


def people(faces: DataFrame, by: str, least: float = SAME_PERSON) -> DataFrame:
    """C03 over faces (by, id, name, emb), in order of name: (by, id, person)."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: p[by], "id": p.id, "person": running_centroids(_matrix(p.emb), least)})

    return _folded(faces.select(by, "id", "name", "emb"), by, ["name"], f"{_key(faces, by)}, id long, person int", f)


#: Shares of the page width where the columns of a staff list begin and end. Fixed values.
STAFF_COLUMNS = {"subject": (0.0, 0.17), "role": (0.17, 0.41), "grade": (0.41, 0.54), "surname": (0.54, 0.73), "given": (0.73, 0.98)}


def page_rows(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Words (page, x0, y0, x1, y1, text) as (page, row, text, subject, role, grade, surname, given).

    Words are banded by height and read by x; a word belongs to the column that holds its middle. Rows with fewer than
    three characters are dropped. The page is as wide as its rightmost word.
    """
    names = list(STAFF_COLUMNS)

    def f(p: pd.DataFrame) -> pd.DataFrame:
        x0, y, x = p.x0.to_numpy(), ((p.y0 + p.y1) / 2).to_numpy(), ((p.x0 + p.x1) / 2).to_numpy()
        order = np.lexsort((x0, y))
        row = np.array(bands_of(y[order].tolist(), tolerance), int)
        again = np.lexsort((x0[order], row))
        order, row = order[again], row[again]
        width, out, page = float(p.x1.max()), [], int(p.page.iloc[0])
        # A table per word and column, then plain lists: a page has many rows of few words.
        column = [((x[order] >= a * width) & (x[order] < b * width)).tolist() for a, b in STAFF_COLUMNS.values()]
        texts = p.text.to_numpy()[order].tolist()
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]).tolist()
        for start, end in zip(starts, [*starts[1:], len(row)], strict=True):
            text = " ".join(" ".join(texts[start:end]).split())
            if len(text.replace(" ", "")) >= 3:
                cells = [" ".join(texts[k] for k in range(start, end) if inside[k]) for inside in column]
                out.append((page, int(row[start]) + 1, text, *cells))
        return pd.DataFrame(out, columns=["page", "row", "text", *names])

    return words.groupBy("page").applyInPandas(f, "page long, row int, text string, " + ", ".join(f"{n} string" for n in names))


def thinned_guides(guides: DataFrame, by: str, value: str, tolerance: float = 0.5) -> DataFrame:
    """O11 and S36 per group: (by, value)."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        kept = thinned(p[value].tolist(), tolerance)
        return pd.DataFrame({by: [p[by].iloc[0]] * len(kept), value: kept})

    return guides.select(by, value).groupBy(by).applyInPandas(f, f"{_key(guides, by)}, {value} double")


def modal_values(rows: DataFrame, by: str, value: str, tolerance: float = 1.5, rows_of: str | None = None) -> DataFrame:
    """A28 per group: (by, value, n). A row stands for as many as its `rows_of` says; a task holds the different values of a group."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        mode, n = modal_bin(p[value].tolist(), tolerance, p["_rows"].tolist())
        return pd.DataFrame({by: [p[by].iloc[0]], value: [mode], "n": [n]})

    counted = rows.where(f"{value} is not null").groupBy(by, F.col(value).cast("double").alias(value)).agg((F.sum(rows_of) if rows_of else F.count("*")).alias("_rows"))
    return counted.groupBy(by).applyInPandas(f, f"{_key(rows, by)}, {value} double, n long")


def reading_order(frames: DataFrame, by: str, snap: float = 10.0) -> DataFrame:
    """Frames (by, frame, left, top) numbered by column, then height; a column reaches `snap` right of its first frame."""

    def f(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["left", "top", "frame"], kind="stable")
        column, start, k = [], None, -1
        for x in p.left:
            if start is None or x - start > snap:
                start, k = x, k + 1
            column.append(k)
        p = p.assign(column=column).sort_values(["column", "top", "frame"], kind="stable")
        return pd.DataFrame({by: p[by], "frame": p.frame, "place": range(1, len(p) + 1)})

    return frames.select(by, "frame", "left", "top").groupBy(by).applyInPandas(f, f"{_key(frames, by)}, frame long, place int")
