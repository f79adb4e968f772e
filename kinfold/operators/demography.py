"""Population histories as tables: states between timed changes, size trajectories, flows, lineage probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.prefix import last_known, previous


def state_at(events: DataFrame, key: str, time: str, value: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """``events`` with ``state``: the key's last non-null value up to and with this row. A key with very many events is cut in ranges of time."""
    return last_known(events, time, value, "state", (key,), ties)


def epochs(changes: DataFrame, keys: tuple[str, ...] = ("population",)) -> DataFrame:
    """(keys, epoch, start_time, end_time, start_size, end_size, growth_rate) from changes (keys, time, size, growth_rate and, if there, seq).

    A change without a size keeps the size that the population has grown or
    shrunk to by then; one without a growth rate keeps the rate. Times go back
    from 0; of changes at one time the last by ``seq`` holds. Sizes follow from
    running sums of growth since a size was last set.
    """
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    w = Window.partitionBy(*keys).orderBy("time", "_seq")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = changes.withColumn("_seq", seq).withColumn("_rate", F.coalesce(F.last("growth_rate", ignorenulls=True).over(up_to), F.lit(0.0)))
    passed = F.coalesce(F.lag("_rate").over(w) * (F.col("time") - F.lag("time").over(w)), F.lit(0.0))
    rows = rows.withColumn("_passed", passed).withColumn("_sum", F.sum("_passed").over(up_to))
    rows = rows.withColumn("_set", F.last(F.when(F.col("size").isNotNull(), F.struct("size", "_sum")), ignorenulls=True).over(up_to))
    size = F.coalesce(F.col("_set.size"), F.lit(1.0)) * F.exp(F.coalesce(F.col("_set._sum"), F.lit(0.0)) - F.col("_sum"))
    timed = rows.select(*keys, F.col("time").cast("double").alias("start_time"), F.coalesce(F.lead("time").over(w).cast("double"), F.lit(float("inf"))).alias("end_time"), size.alias("start_size"), F.col("_rate").cast("double").alias("growth_rate")).where("start_time < end_time")
    grown = F.when(F.col("growth_rate") == 0, F.col("start_size")).otherwise(F.col("start_size") * F.exp(-F.col("growth_rate") * (F.col("end_time") - F.col("start_time"))))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start_time")) - 1
    return timed.select(*keys, number.alias("epoch"), "start_time", "end_time", "start_size", "growth_rate", grown.alias("end_size"))


def size_trajectory(history: DataFrame, steps: DataFrame) -> DataFrame:
    """(population, step, size) at every step (column ``step``); the epochs of a history are few and are broadcast, past 100,000 rows they are joined by Spark's own choice."""
    few = F.broadcast(history) if history.limit(100_001).count() <= 100_000 else history
    inside = (F.col("step") >= F.col("start_time")) & (F.col("step") < F.col("end_time"))
    return steps.join(few, inside).select("population", "step", (F.col("start_size") * F.exp(-F.col("growth_rate") * (F.col("step") - F.col("start_time")))).alias("size"))


def migration_flows(moves: DataFrame, source: str, dest: str) -> DataFrame:
    """(source, dest, n, share): moves between different places, and their share of all that leave the source."""
    flows = moves.where(F.col(source) != F.col(dest)).groupBy(F.col(source).alias("source"), F.col(dest).alias("dest")).agg(F.count(F.lit(1)).alias("n"))
    out = flows.groupBy("source").agg(F.sum("n").alias("_all"))
    return flows.join(out, "source").select("source", "dest", "n", (F.col("n") / F.col("_all")).alias("share"))


def transitions(events: DataFrame, key: str, time: str, place: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row for each change of place of a key: (key, time, source, dest). A key with very many events is cut in ranges of time."""
    return previous(events, time, place, "_before", (key,), ties).where(F.col("_before") != F.col(place)).select(key, time, F.col("_before").alias("source"), F.col(place).alias("dest"))


def matrix_exponential(a: np.ndarray) -> np.ndarray:
    """exp of a generator by scaling and squaring; its off-diagonal entries are 0 or more, so shifted terms never cancel."""
    shift = max(0.0, float(-a.diagonal().min()))
    b = a + shift * np.eye(len(a))
    halvings = max(0, int(np.ceil(np.log2(max(1e-300, np.abs(b).sum(axis=1).max())))) + 1)
    term = out = np.eye(len(a))
    for k in range(1, 20):
        term = term @ b / (2.0**halvings) / k
        out = out + term
    out = out * np.exp(-shift / 2.0**halvings)
    for _ in range(halvings):
        out = out @ out
    return out


class History:
    """One model's epochs and movements, as numbers; see ``models.histories``."""

    def __init__(self, n: int, epochs, moves):
        self.n, self.moves = n, list(moves) if moves is not None else []
        self.epochs = sorted(epochs, key=lambda e: e["start_time"])
        self.starts = [e["start_time"] for e in self.epochs]

    def at(self, time: float) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, generator of moves) at a time."""
        e = self.epochs[max(k for k, s in enumerate(self.starts) if s <= time)]
        sizes = np.array(e["sizes"], float) * np.exp(-np.array(e["growth"], float) * (time - e["start_time"]))
        q = np.zeros((self.n, self.n))
        for r in e["rates"] if e["rates"] is not None else ():
            q[r["source"], r["dest"]] = r["rate"]
        return sizes, q - np.diag(q.sum(axis=1))

    def moved(self, time: float) -> list[np.ndarray]:
        """A matrix for each movement at a time, in order: where a lineage of each population goes."""
        out = []
        for m in self.moves:
            if m["time"] == time:
                s = np.eye(self.n)
                s[m["source"], m["source"]] = 1 - m["proportion"]
                s[m["source"], m["dest"]] += m["proportion"]
                out.append(s)
        return out

    def places(self, steps, sample_time: float = 0.0) -> dict[float, np.ndarray]:
        """Where lineages that start in each population at ``sample_time`` are at each step, before movements at that very time."""
        wanted = set(steps)
        times = sorted(t for t in wanted | set(self.starts) | {sample_time} if t >= sample_time)
        p, out = np.eye(self.n), {t: np.zeros((self.n, self.n)) for t in wanted if t < sample_time}
        for k, t in enumerate(times):
            if t in wanted:
                out[t] = p
            if t > sample_time:
                for s in self.moved(t):
                    p = p @ s
            if k + 1 < len(times):
                p = p @ matrix_exponential(self.at(t)[1] * (times[k + 1] - t))
        return out

    def pairs(self, steps, lineages, least_size: float = 1.0) -> dict[float, tuple[float, float]]:
        """(coalescence rate, share uncoalesced) of random pairs of the lineages at each step, after movements at that time."""
        p = _pairs_of(lineages)
        wanted, out = set(steps), {}
        times = sorted(wanted | set(self.starts) | {0.0})
        for k, t in enumerate(times):
            for s in self.moved(t):
                p = s.T @ p @ s
            sizes, q = self.at(t)
            pair = PairRates(q, 0.5 / np.maximum(sizes, least_size))
            left = p.sum()
            if t in wanted:
                out[t] = (float(pair.meeting(p) / left) if left > 0 else float("nan"), float(left))
            if k + 1 < len(times):
                p = pair.flow(p, times[k + 1] - t)[0]
        return out

    def mean_time(self, lineages, least_size: float = 1.0, change: float = 0.01, most: int = 100_000, tail: float = 1e-9) -> float:
        """Mean time to coalescence: the integral of the share uncoalesced. It is exact for constant sizes; others are taken as constant while they change by the share ``change``, at most ``most`` times an epoch, beyond which it is an error. Infinite if some pairs never meet."""
        p, total = _pairs_of(lineages), 0.0
        for k, start in enumerate(self.starts):
            for s in self.moved(start):
                p = s.T @ p @ s
            constant, stop = not np.any(self.epochs[k]["growth"]), self.starts[k + 1] if k + 1 < len(self.starts) else float("inf")
            step = stop - start if constant else change / np.abs(self.epochs[k]["growth"]).max()
            b = start
            for _ in range(most):
                a, b = b, min(stop, b + step)
                if a == stop or p.sum() <= tail:
                    break
                sizes, q = self.at(a if constant else (a + b) / 2)
                pair = PairRates(q, 0.5 / np.maximum(sizes, least_size))
                if not np.isfinite(b):
                    return total + pair.total(p, tail)
                p, spent = pair.flow(p, b - a)
                total += spent
            else:
                if b < stop and p.sum() > tail:
                    raise ValueError(f"pairs are left after {most} steps from time {start}: take a larger change or more steps")
        return float("inf") if p.sum() > tail else total


def _pairs_of(lineages) -> np.ndarray:
    """Shares of the pairs of lineages by the populations of both."""
    count = np.array(lineages, float)
    p = np.outer(count, count) - np.diag(count)
    return p / p.sum()


class PairRates:
    """How pairs of lineages move and meet: a pair's states are an n x n matrix of shares, p.

    Both lineages move on their own, so p changes by ``q.T @ p + p @ q`` and loses its
    diagonal at the rates of meeting: no matrix of n^2 x n^2 is needed. Up to
    ``DENSE`` populations it is made all the same, and its exponential is exact;
    beyond that the flow is a sum of Poisson-weighted steps (uniformisation),
    and the whole time of the last epoch the solution of a sparse system by Krylov vectors.
    """

    DENSE = 6
    TERMS = 200.0  # mean number of steps in one sum: far from where exp(-x) is 0

    def __init__(self, q: np.ndarray, meet: np.ndarray):
        self.q, self.meet, self.n = q, meet, len(meet)

    def meeting(self, p: np.ndarray) -> float:
        return float(p.diagonal() @ self.meet)

    def change(self, p: np.ndarray) -> np.ndarray:
        """The derivative of p in time."""
        out = self.q.T @ p + p @ self.q
        out[np.diag_indices(self.n)] -= self.meet * p.diagonal()
        return out

    def _whole(self) -> np.ndarray:
        one = np.eye(self.n)
        return np.kron(self.q, one) + np.kron(one, self.q) - np.diag(np.diag(self.meet).ravel())

    def flow(self, p: np.ndarray, time: float) -> tuple[np.ndarray, float]:
        """(p after ``time``, the integral of its sum on the way)."""
        if self.n <= self.DENSE:
            g, m = self._whole(), self.n**2
            both = matrix_exponential(np.block([[g, np.eye(m)], [np.zeros((m, 2 * m))]]) * time)
            return (p.ravel() @ both[:m, :m]).reshape(p.shape), float((p.ravel() @ both[:m, m:]).sum())
        rate = float((-2 * self.q.diagonal() + self.meet).max())
        if rate <= 0:
            return p, float(p.sum()) * time
        pieces, spent = max(1, int(np.ceil(rate * time / self.TERMS))), 0.0
        mean = rate * time / pieces
        for _ in range(pieces):
            weight = passed = np.exp(-mean)
            v, out, k = p, weight * p, 0
            spent += max(0.0, 1 - passed) / rate * float(v.sum())
            while k < mean or 1 - passed > 1e-15 and weight > 1e-18:
                k += 1
                v = v + self.change(v) / rate
                weight *= mean / k
                passed += weight
                out = out + weight * v
                spent += max(0.0, 1 - passed) / rate * float(v.sum())
            p = out
            if p.sum() < 1e-300:
                break
        return p, spent

    def total(self, p: np.ndarray, tail: float = 1e-9) -> float:
        """The integral of p's sum for ever: infinite if a share above ``tail`` may come to where pairs never meet."""
        linked = np.eye(self.n, dtype=int) | (self.q > 0)
        for _ in range(self.n.bit_length() + 1):
            linked = (linked @ linked > 0).astype(int)
        meets = linked @ linked.T > 0
        for a, b in zip(*np.nonzero(p > 0), strict=True):
            if p[a, b] > tail and not meets[np.ix_(linked[a] > 0, linked[b] > 0)].all():
                return float("inf")
        if self.n <= self.DENSE:
            return float(np.linalg.lstsq(self._whole().T, -p.ravel(), rcond=None)[0].sum())
        loss = self.q.diagonal()[:, None] + self.q.diagonal() - np.diag(self.meet)
        loss = np.where(loss < 0, loss, -1.0)
        return float((krylov(lambda y: self.change(y / loss), -p) / loss).sum())


def krylov(apply, wanted: np.ndarray, tolerance: float = 1e-11, vectors: int = 100, rounds: int = 100) -> np.ndarray:
    """x with ``apply(x)`` = ``wanted``, by restarted GMRES; an error if it doesn't converge."""
    x, size = np.zeros_like(wanted), np.linalg.norm(wanted)
    for _ in range(rounds):
        rest = wanted - apply(x)
        far = np.linalg.norm(rest)
        if far <= tolerance * size:
            return x
        basis, h = [rest / far], np.zeros((vectors + 1, vectors))
        for k in range(vectors):
            v = apply(basis[k])
            for _ in range(2):  # twice, against rounding
                for j, b in enumerate(basis):
                    c = float((b * v).sum())
                    h[j, k] += c
                    v = v - c * b
            h[k + 1, k] = np.linalg.norm(v)
            if h[k + 1, k] <= 1e-14 * abs(h[: k + 1, k]).max():
                break
            basis.append(v / h[k + 1, k])
        aim = np.zeros(k + 2)
        aim[0] = far
        y = np.linalg.lstsq(h[: k + 2, : k + 1], aim, rcond=None)[0]
        x = x + sum(c * b for c, b in zip(y, basis, strict=False))
    if np.linalg.norm(wanted - apply(x)) > 1e-8 * size:
        raise ArithmeticError("mean times did not converge")
    return x


def _each_history(rows: DataFrame, schema: str, make) -> DataFrame:
    """``make(row, history)`` for each row of models and their histories: one row a model, spread over all tasks."""

    def run(frames):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            out = [x for row in frame.to_dict("records") for x in make(row, History(row["n"], row["epochs"], row["moves"]))]
            yield pd.DataFrame(out, columns=names)

    return rows.repartition("model").mapInPandas(run, schema)


def lineage_probabilities(histories: DataFrame, steps: list[float], sample_time: float = 0.0) -> DataFrame:
    """(model, step, start, dest, probability): where a lineage is at each step that was sampled in ``start`` at ``sample_time``; 0 before that."""

    def make(row, history):
        for t, p in history.places(steps, sample_time).items():
            for a in range(history.n):
                for b in range(history.n):
                    yield row["model"], t, a, b, p[a, b]

    return _each_history(histories, "model long, step double, start int, dest int, probability double", make)


def possible_locations(histories: DataFrame, samples: DataFrame) -> DataFrame:
    """(model, start_time, end_time, populations): where lineages of samples (model, population, time) may be, over the longest stretches for which it is the same."""
    held = samples.groupBy("model").agg(F.collect_set(F.struct("population", "time")).alias("samples"))

    def make(row, history):
        taken = [(s["population"], s["time"]) for s in row["samples"]]
        cuts = sorted(set(history.starts) | {t for _, t in taken})
        spans = []
        for k, t in enumerate(cuts):
            end = cuts[k + 1] if k + 1 < len(cuts) else float("inf")
            inside = t + 1 if end == float("inf") else (t + end) / 2
            found = set()
            for time in {s for _, s in taken if s <= t}:
                p = history.places([inside], time)[inside]
                found |= {b for a, at in taken if at == time for b in range(history.n) if p[a, b] > 0}
            if spans and spans[-1][2] == found:
                spans[-1][1] = end
            else:
                spans.append([t, end, found])
        for a, b, found in spans:
            yield row["model"], a, b, sorted(found)

    return _each_history(histories.join(held, "model"), "model long, start_time double, end_time double, populations array<int>", make)


def coalescence_rates(histories: DataFrame, steps: list[float], lineages: list[float], least_size: float = 1.0) -> DataFrame:
    """(model, step, rate, uncoalesced): of random pairs of samples taken at time 0, so many from each population."""

    def make(row, history):
        for t, (rate, left) in history.pairs(steps, lineages, least_size).items():
            yield row["model"], t, rate, left

    return _each_history(histories, "model long, step double, rate double, uncoalesced double", make)


def mean_coalescence_times(histories: DataFrame, lineages: list[float], least_size: float = 1.0) -> DataFrame:
    """(model, mean_time) of random pairs of samples taken at time 0."""
    return _each_history(histories, "model long, mean_time double", lambda row, history: [(row["model"], history.mean_time(lineages, least_size))])
