"""Joint least-squares fits over pairs of images: rotations and lens (bundle adjustment), exposures and vignetting.

An observation concerns two images, i and j, and depends on a few numbers of each
and on a few that a series shares.  Its part in the normal equations is a small
block, so a round is: observations, packed once into arrays of a pair, meet the
current numbers of their pair, blocks are added up per pair inside each task and
then by key, and each series solves its equations from a row per pair: images are
eliminated one by one, so memory grows with the pairs, not with the square of the
images.  Observations are never brought together.  Steps are those of Levenberg and Marquardt: one that
does not lower the cost is taken back and tried again with more damping.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_batches, stored


#: Images of a series whose equations are solved as one matrix; of more, the others are eliminated first.
CORE = 200


@dataclass(frozen=True)
class Model:
    """``residuals(observations, own_i, own_j, shared, of)`` gives n x r; ``columns`` are what it reads of an observation, ``of`` is each one's row of the numbers.

    ``start`` gives the shared numbers to begin with; an image's own begin at 0.
    ``scale``: residuals beyond it count by their size, not their square (Huber).
    What the observations leave open: ``first_fixed`` keeps the first image's numbers,
    ``mean_held`` is the weight that holds the mean of all images' numbers at 0.
    """

    columns: tuple[str, ...]
    own: int
    start: tuple[float, ...]
    residuals: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    scale: float
    first_fixed: bool = False
    mean_held: float = 0.0

    @property
    def block(self) -> int:
        return 2 * self.own + len(self.start)

    @property
    def sums(self) -> int:
        """Numbers of a pair's row: the matrix, the right side, the cost, and how many residuals."""
        return self.block**2 + self.block + 2


def _weigh(model: Model, obs: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, shared: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Residuals, slopes (n x r x block), robust weights and costs; i, j and shared have a row per pair."""
    rest = model.residuals(obs, i, j, shared, of)
    whole = np.concatenate((i, j, shared), axis=1)
    slopes = np.empty((*rest.shape, whole.shape[1]))
    for k in range(whole.shape[1]):
        step = 1e-6 * np.maximum(1.0, np.abs(whole[:, k]))
        up, down = whole.copy(), whole.copy()
        up[:, k] += step
        down[:, k] -= step
        cut = lambda x: (x[:, : model.own], x[:, model.own : 2 * model.own], x[:, 2 * model.own :], of)
        slopes[..., k] = (model.residuals(obs, *cut(up)) - model.residuals(obs, *cut(down))) / (2 * step)[of, None]
    size = np.abs(rest)
    inner = size <= model.scale
    return rest, slopes, np.where(inner, 1.0, model.scale / np.maximum(size, 1e-300)), np.where(inner, 0.5 * rest**2, model.scale * (size - 0.5 * model.scale))


def _step(model: Model, i: np.ndarray, j: np.ndarray, sums: np.ndarray, own: np.ndarray, damping: float, core: int = CORE) -> tuple[np.ndarray, np.ndarray]:
    """The damped step of all images' numbers and of the shared ones, from the blocks of pairs (i, j).

    Images leave the equations one by one, those with fewest neighbours first; the
    last ``core``, or those that are left when most see one another, are solved
    together with the shared numbers.
    """
    n, o, b = len(own), model.own, model.block
    block, right = sums[:, : b * b].reshape(-1, b, b), sums[:, b * b : b * b + b]
    diagonal, border, r = np.zeros((n, o, o)), np.zeros((n, o, b - 2 * o + 1)), np.zeros((n, o))
    for at, part in ((i, slice(0, o)), (j, slice(o, 2 * o))):
        np.add.at(diagonal, at, block[:, part, part])
        np.add.at(border, (at, slice(None), slice(0, -1)), block[:, part, 2 * o :])
        np.add.at(r, at, right[:, part])
    common, common_r = np.zeros((b - 2 * o + 1,) * 2), np.zeros(b - 2 * o + 1)
    common[:-1, :-1], common_r[:-1] = block[:, 2 * o :, 2 * o :].sum(axis=0), right[:, 2 * o :].sum(axis=0)
    # The mean's term fills the whole matrix; as one more unknown in the border it doesn't.
    held = model.mean_held / own.size
    common[-1, -1], border[..., -1] = -1.0, held
    r += model.mean_held**2 * own.mean() / own.size if model.mean_held else 0.0
    near: list[dict[int, np.ndarray]] = [{} for _ in range(n)]
    for p, q, e in zip(i.tolist(), j.tolist(), block[:, :o, o : 2 * o]):
        if model.first_fixed and not (p and q):
            continue
        near[p][q] = near[p][q] + e if q in near[p] else e
        near[q][p] = near[p][q].T
    if model.first_fixed:
        diagonal[0], border[0], r[0] = np.eye(o), 0.0, 0.0
    k = np.arange(o)
    diagonal[:, k, k] += damping * np.maximum(diagonal[:, k, k] + held**2, 1e-9)
    k = np.arange(len(common) - 1)
    common[k, k] += damping * np.maximum(common[k, k], 1e-9)

    gone, left, alone = [], n, set()
    queue = [(len(x), v) for v, x in enumerate(near)]
    heapq.heapify(queue)
    done = np.zeros(n, dtype=bool)
    while queue and left > core:
        degree, v = heapq.heappop(queue)
        if done[v] or degree != len(near[v]) or v in alone:
            continue
        if degree > left // 4:
            break
        if not degree and len(alone) < core // 2:  # the last of its part, which may have something left open
            alone.add(v)
            continue
        mine = near[v]
        others = list(mine)
        sides = np.concatenate([*(mine[u] for u in others), border[v], r[v][:, None]], axis=1)
        solved = np.linalg.solve(diagonal[v], sides) if degree else np.linalg.pinv(diagonal[v], rcond=1e-10, hermitian=True) @ sides
        to = solved[:, degree * o : -1]
        common -= border[v].T @ to
        common_r -= border[v].T @ solved[:, -1]
        for x, u in enumerate(others):
            back = mine[u].T
            diagonal[u] -= back @ solved[:, x * o : x * o + o]
            border[u] -= back @ to
            r[u] -= back @ solved[:, -1]
            del near[u][v]
            for y in range(x + 1, degree):
                w, e = others[y], back @ solved[:, y * o : y * o + o]
                near[u][w] = near[u][w] - e if w in near[u] else -e
                near[w][u] = near[u][w].T
        for u in others:
            heapq.heappush(queue, (len(near[u]), u))
        gone.append((v, others, solved))
        done[v], left = True, left - 1

    last = np.flatnonzero(~done)
    place, m = {v: x * o for x, v in enumerate(last.tolist())}, len(last) * o
    whole, whole_r = np.zeros((m + len(common),) * 2), np.concatenate((r[last].ravel(), common_r))
    for v, x in place.items():
        whole[x : x + o, x : x + o] = diagonal[v]
        for u, e in near[v].items():
            whole[x : x + o, place[u] : place[u] + o] = e
    whole[:m, m:] = border[last].reshape(m, -1)
    whole[m:, :m], whole[m:, m:] = whole[:m, m:].T, common
    line, size = whole[-1, :-1] / whole[-1, -1], len(whole) - 1
    found = np.linalg.lstsq(whole[:-1, :-1] - np.outer(whole[:-1, -1], line), whole_r[:-1] - whole[:-1, -1] * (whole_r[-1] / whole[-1, -1]), rcond=None)[0]
    extra = (whole_r[-1] - whole[-1, :-1] @ found) / whole[-1, -1]
    step = np.zeros((n, o))
    step[last] = found[:m].reshape(-1, o)
    shared = np.append(found[m:size], extra)
    for v, others, solved in reversed(gone):
        d = len(others) * o
        step[v] = solved[:, -1] - solved[:, d:-1] @ shared
        if d:
            step[v] -= solved[:, :d] @ step[others].ravel()
    return -step, -shared[:-1]


def _next(model: Model, state: dict) -> None:
    """The numbers to try from the best ones known."""
    own, shared = _step(model, state["at_i"], state["at_j"], state["blocks"], state["own"], state["damping"])
    state["try_own"], state["try_shared"] = state["own"] + own, state["shared"] + shared


def fit(obs: DataFrame, series: list[str], model: Model, rounds: int = 30, eps: float = 1e-9) -> DataFrame:
    """series..., state (binary, see ``images`` and ``summary``) of each series.

    ``obs``: series..., i, j (images), and the model's columns.  Rows with a null
    are left out.  A series ends when a step lowers its cost by less than ``eps`` of
    it, or when damping no longer helps; no series waits for another's equations.
    A series' pairs must fit one task, a block of numbers each, with what solving
    fills in between images that see the same ones; its observations need not.
    """
    bounded_batches(obs.sparkSession)
    key = [*series, "i", "j"]
    kinds = {f.name: f.dataType.simpleString() for f in obs.schema}
    named = ", ".join(f"`{c}` {kinds[c]}" for c in key)
    by_series = ", ".join(f"`{c}` {kinds[c]}" for c in series)
    obs = obs.select(*key, *[F.col(c).cast("double").alias(c) for c in model.columns]).dropna().filter("i <> j")
    shared0 = np.array(model.start)

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pair = batch.select(key).to_pandas().groupby(key, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(pair, kind="stable")
            start = np.flatnonzero(np.diff(pair[order], prepend=-1))
            ends = pa.array(np.append(start, len(pair)), pa.int32())
            first = pa.array(order[start])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in key), *(pa.ListArray.from_arrays(ends, batch.column(c).take(pa.array(order))) for c in model.columns)], names=[*key, *model.columns])

    packed = stored(obs.mapInArrow(pack, ", ".join([named, *(f"`{c}` array<double>" for c in model.columns)])))

    def begin(group, pdf):
        nodes = {n: k for k, n in enumerate(sorted(set(pdf["i"]) | set(pdf["j"])))}
        own = np.zeros((len(nodes), model.own))
        state = {"nodes": nodes, "i": pdf["i"].tolist(), "j": pdf["j"].tolist(), "cost": np.inf, "damping": 1e-3, "costs": [], "own": own, "shared": shared0, "try_own": own, "try_shared": shared0}
        return pd.DataFrame({s: [g] for s, g in zip(series, group)} | {"state": [pickle.dumps(state)], "done": [False]})

    state = stored(packed.select(*key).distinct().groupBy(*series).applyInPandas(begin, f"{by_series}, state binary, done boolean"))

    def numbers(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                s = pickle.loads(row["state"])
                own = lambda c: list(s["try_own"][[s["nodes"][x] for x in s[c]]])
                yield pd.DataFrame({c: [row[c]] * len(s["i"]) for c in series} | {"i": s["i"], "j": s["j"], "own_i": own("i"), "own_j": own("j"), "shared": [s["try_shared"]] * len(s["i"])})

    def blocks(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = lambda c: batch.column(c).flatten().to_numpy()
            each = batch.column(model.columns[0]).value_lengths().to_numpy()
            of, start = np.repeat(np.arange(batch.num_rows), each), np.cumsum(each) - each
            rest, slopes, weight, cost = _weigh(model, {c: flat(c) for c in model.columns}, *[flat(c).reshape(batch.num_rows, -1) for c in ("own_i", "own_j", "shared")], of)
            matrix = np.einsum("nrp,nrq->npq", weight[..., None] * slopes, slopes).reshape(len(of), -1)
            right = np.einsum("nr,nrp->np", weight * rest, slopes)
            row = np.column_stack((matrix, right, cost.sum(axis=1), np.full(len(of), rest.shape[1], dtype=float)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), *map(pa.array, np.add.reduceat(row, start).T)], names=[*key, *(f"s{k}" for k in range(model.sums))])

    def improve(group, pdf):
        known = pdf["state"].notna()
        s, new = pickle.loads(pdf["state"][known].iloc[0]), pdf[~known]
        sums = new[[f"s{k}" for k in range(model.sums)]].to_numpy()
        cost = float(sums[:, -2].sum()) + 0.5 * (model.mean_held * s["try_own"].mean()) ** 2
        done = False
        if np.isfinite(cost) and cost < s["cost"]:
            done = s["cost"] - cost <= eps * (cost + 1e-12)
            at = {f"at_{c}": np.array([s["nodes"][x] for x in new[c]]) for c in "ij"}
            s |= at | {"own": s["try_own"], "shared": s["try_shared"], "cost": cost, "blocks": sums, "count": sums[:, -1].sum(), "damping": max(s["damping"] / 5, 1e-12)}
            s["costs"] = [*s["costs"], cost]
        else:
            s["damping"] *= 8
            done = s["damping"] > 1e10 or "blocks" not in s
        if not done:
            _next(model, s)
        else:
            s.pop("blocks", None)
        return pd.DataFrame({c: [g] for c, g in zip(series, group)} | {"state": [pickle.dumps(s)], "done": [done]})

    finished = None
    for _ in range(rounds + 1):
        current = state.mapInPandas(numbers, f"{named}, own_i array<double>, own_j array<double>, shared array<double>")
        sums = packed.join(current, key).mapInArrow(blocks, ", ".join([named, *(f"s{k} double" for k in range(model.sums))]))
        total = sums.groupBy(*key).agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(model.sums)])
        both = total.unionByName(state, allowMissingColumns=True)
        moved = stored(both.groupBy(*series).applyInPandas(improve, f"{by_series}, state binary, done boolean"))
        ready = moved.filter("done")
        finished = ready if finished is None else finished.unionByName(ready)
        state = moved.filter("NOT done")
        if state.isEmpty():
            return finished
    return finished.unionByName(state)


def images(fitted: DataFrame, series: list[str], image: str = "bigint") -> DataFrame:
    """series..., image, own (array): each image's numbers."""
    kinds = {f.name: f.dataType.simpleString() for f in fitted.schema}

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                s = pickle.loads(row["state"])
                out += [(*[row[c] for c in series], n, s["own"][k]) for n, k in s["nodes"].items()]
            yield pd.DataFrame(out, columns=[*series, "image", "own"])

    return fitted.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in series) + f", image {image}, own array<double>")


def summary(fitted: DataFrame, series: list[str]) -> DataFrame:
    """series..., shared (array), costs (of each accepted step, the start first), rms (root mean square of the robust costs, doubled)."""
    kinds = {f.name: f.dataType.simpleString() for f in fitted.schema}

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                s = pickle.loads(row["state"])
                out.append((*[row[c] for c in series], s["shared"], s["costs"], float(np.sqrt(2 * s["cost"] / max(s.get("count", 0), 1))) if s["costs"] else None))
            yield pd.DataFrame(out, columns=[*series, "shared", "costs", "rms"])

    return fitted.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in series) + ", shared array<double>, costs array<double>, rms double")


# --- rotations and lens ---------------------------------------------------------------------------


def rotations(axis: np.ndarray) -> np.ndarray:
    """n x 3 rotation vectors as n x 3 x 3 matrices."""
    angle = np.linalg.norm(axis, axis=1)[:, None, None]
    x, y, z = axis.T
    zero = np.zeros(len(axis))
    cross = np.stack((zero, -z, y, z, zero, -x, -y, x, zero), axis=1).reshape(-1, 3, 3)
    small = angle < 1e-8
    safe = np.where(small, 1.0, angle)
    return np.eye(3) + np.where(small, 1.0, np.sin(safe) / safe) * cross + np.where(small, 0.5, (1 - np.cos(safe)) / safe**2) * (cross @ cross)


def undistorted(x: np.ndarray, y: np.ndarray, unit: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places relative to an image's centre after its radial distortion: r' = a r^4 + b r^3 + c r^2 + (1 - a - b - c) r, with r in units of ``unit`` pixels."""
    a, b, c = terms.T
    r = np.hypot(x, y) / unit
    factor = ((a * r + b) * r + c) * r + 1 - a - b - c
    return x * factor, y * factor


def _reprojection(obs: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, shared: np.ndarray, of: np.ndarray) -> np.ndarray:
    focal, terms = shared[of, 0], shared[of, 1:]
    x, y = undistorted(obs["xi"], obs["yi"], obs["ui"], terms)
    u, v = undistorted(obs["xj"], obs["yj"], obs["uj"], terms)
    turn = (rotations(j).transpose(0, 2, 1) @ rotations(i))[of]
    seen = turn[:, :, 0] * (x / focal)[:, None] + turn[:, :, 1] * (y / focal)[:, None] + turn[:, :, 2]
    depth = np.maximum(seen[:, 2], 1e-6)
    return np.stack((seen[:, 0] / depth * focal - u, seen[:, 1] / depth * focal - v), axis=1)


def bundle(focal: float, scale: float = 2.0) -> Model:
    """Rotation vectors of images, a common focal length in pixels (from ``focal`` on) and radial terms a, b, c (from 0 on).

    Only rotations between images can be seen: the first image keeps its own.

    Observations: xi, yi, xj, yj, the same point in both images, in pixels from the
    images' centres, and ui, uj, half the images' shorter sides.
    """
    return Model(("xi", "yi", "ui", "xj", "yj", "uj"), 3, (float(focal), 0.0, 0.0, 0.0), _reprojection, scale, first_fixed=True)


# --- exposures and vignetting ---------------------------------------------------------------------


def _light(obs: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, shared: np.ndarray, of: np.ndarray) -> np.ndarray:
    b, c = shared[of].T

    def even(value, r2, own):
        return np.log(np.maximum(value, 1e-3)) - np.log(np.clip(1 + b * r2 + c * r2 * r2, 0.2, 5.0)) + own[of, 0]

    return (even(obs["vi"], obs["ri"], i) - even(obs["vj"], obs["rj"], j))[:, None]


def photometric(scale: float = 0.1) -> Model:
    """Log gains of images, and a common falloff 1 + b r^2 + c r^4.

    Logarithms are compared: differences of values would fall if all were made darker.
    Only ratios can be seen: the mean of the log gains is held at 0.
        Observations: vi, vj, the values of one place in both images, and ri, rj, its
    squared distances from their centres, in half the shorter side.
    """
    return Model(("vi", "ri", "vj", "rj"), 1, (0.0, 0.0), _light, scale, mean_held=50.0)


def evened(px: DataFrame, fitted: DataFrame, series: list[str], image: str, value: str = "v", radius: str = "r2") -> DataFrame:
    """``px`` (series..., image, value, squared radius) with its values brought to one exposure and freed of falloff.

    Gains are divided by their mean, so the whole keeps its brightness.
    """
    own = images(fitted, series, dict(px.dtypes)[image]).withColumn("gain", F.exp(F.col("own")[0]))
    mean = own.groupBy(*series).agg(F.avg("gain").alias("mean_gain"))
    light = own.join(mean, series).join(summary(fitted, series).select(*series, "shared"), series)
    light = light.select(*series, F.col("image").alias(image), (F.col("gain") / F.col("mean_gain")).alias("__gain"), "shared")
    fall = F.lit(1.0) + F.col("shared")[0] * F.col(radius) + F.col("shared")[1] * F.col(radius) * F.col(radius)
    out = px.join(light, [*series, image], "left")
    even = F.col(value) * F.col("__gain") / F.greatest(F.lit(0.2), F.least(F.lit(5.0), fall))
    return out.withColumn(value, F.coalesce(even, F.col(value).cast("double"))).drop("__gain", "shared")
