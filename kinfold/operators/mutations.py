"""Mutations at finite sites: models as transition matrices, parents of mutations, states along the tree.

A mutation's outcome depends on the state above it. Instead of walking each site
in order of time, every mutation draws one number and from it a map from any
state above to the state below; maps are composed with those of their parents
by path doubling, so a chain of d mutations takes log d joins and no loop over rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators import amino_tables
from kinfold.operators.ancestry import uniform
from kinfold.operators.prefix import last_known, numbered, running_sum
from kinfold.tables import drop_written, written


@dataclass(frozen=True)
class Model:
    """Alleles, the distribution of the state at the root, and a row of probabilities for each state above."""

    alleles: tuple[str, ...]
    root: np.ndarray
    matrix: np.ndarray

    def __post_init__(self):
        n = len(self.alleles)
        if n < 2 or len(set(self.alleles)) < n:
            raise ValueError("a model needs two different alleles or more")
        if self.root.shape != (n,) or self.matrix.shape != (n, n):
            raise ValueError("shapes of alleles, root and matrix differ")
        if (self.root < 0).any() or (self.matrix < 0).any() or not np.allclose(self.root.sum(), 1) or not np.allclose(self.matrix.sum(axis=1), 1):
            raise ValueError("root and rows of the matrix must be probabilities")


def matrix_model(alleles, root, matrix) -> Model:
    return Model(tuple(alleles), np.array(root, float), np.array(matrix, float))


def binary(state_independent: bool = False) -> Model:
    return matrix_model("01", [1, 0], [[0.5, 0.5], [0.5, 0.5]] if state_independent else [[0, 1], [1, 0]])


def jukes_cantor_model(state_independent: bool = False) -> Model:
    return matrix_model("ACGT", [0.25] * 4, np.full((4, 4), 0.25) if state_independent else (1 - np.eye(4)) / 3)


def _from_rates(rates: np.ndarray, root, alleles="ACGT", silent=None) -> Model:
    """Rates of change as probabilities: the fastest state always changes, others stay for the rest. ``silent`` rates of change to the same state count as changes."""
    rates = rates * (1 - np.eye(len(rates))) + (0 if silent is None else np.diag(silent))
    matrix = rates / rates.sum(axis=1).max()
    return matrix_model(alleles, root, matrix + np.diag(np.maximum(0, 1 - matrix.sum(axis=1))))


_PURINE = np.array([True, False, True, False])


def hky(kappa: float, frequencies=(0.25,) * 4, root=None, state_independent: bool = False) -> Model:
    """Transitions (A-G, C-T) ``kappa`` times as fast as transversions, all by the frequency of what they lead to."""
    f = np.array(frequencies, float)
    rates = np.where(_PURINE[:, None] == _PURINE, kappa, 1.0) * f
    return _from_rates(rates, f if root is None else root, silent=kappa * f if state_independent else None)


def f84(kappa: float, frequencies=(0.25,) * 4, root=None, state_independent: bool = False) -> Model:
    """Transversions by the frequency of what they lead to; transitions faster by 1 + (kappa - 1) / (frequency of both purines, or of both pyrimidines)."""
    f = np.array(frequencies, float)
    faster = 1 + (kappa - 1) / np.where(_PURINE, f[_PURINE].sum(), f[~_PURINE].sum())
    rates = np.where(_PURINE[:, None] == _PURINE, faster, 1.0) * f
    return _from_rates(rates, f if root is None else root, silent=faster * f if state_independent else None)


def gtr(relative_rates, frequencies=(0.25,) * 4, root=None, state_independent: bool = False) -> Model:
    """Six symmetric rates AC, AG, AT, CG, CT, GT by the frequency of what they lead to."""
    f = np.array(frequencies, float)
    rates = np.zeros((4, 4))
    rates[np.triu_indices(4, 1)] = relative_rates
    return _from_rates((rates + rates.T) * f, f if root is None else root, silent=f if state_independent else None)


#: The one-letter codes of the amino acids.
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"


def amino_acids(exchange, frequencies, root=None) -> Model:
    """A model of the twenty amino acids from symmetric exchange rates (20 x 20, or the 190 above the diagonal) and frequencies, such as published score tables give."""
    rates = np.array(exchange, float)
    if rates.ndim == 1:
        full = np.zeros((20, 20))
        full[np.triu_indices(20, 1)] = rates
        rates = full + full.T
    f = np.array(frequencies, float)
    return _from_rates(rates * f, f if root is None else root, AMINO_ACIDS)


def _scored(rates: str, frequencies: str) -> Model:
    """A model from the lines of a table below its diagonal, and frequencies."""
    full = np.zeros((20, 20))
    for i, line in enumerate(rates.split("\n")[1:-1], 1):
        full[i, :i] = line.split()
    return amino_acids(full + full.T, frequencies.split())


def blosum62() -> Model:
    """Amino acids by the exchange rates of BLOSUM62."""
    return _scored(amino_tables.BLOSUM62_RATES, amino_tables.BLOSUM62_FREQUENCIES)


def pam() -> Model:
    """Amino acids by the exchange rates of Dayhoff's PAM."""
    return _scored(amino_tables.PAM_RATES, amino_tables.PAM_FREQUENCIES)


def microsatellite(s: float, u: float, v: float, p: float, m: float, low: int, high: int, root=None) -> Model:
    """Repeat counts ``low`` to ``high``: change at a rate that rises by ``s`` a repeat, up with probability ``u`` less ``v`` for each repeat, by one step with probability ``p``, else by a geometric number of steps (``m``) cut at the ends. The root is stationary unless given."""
    if not (0 <= low <= high and 0 < u < 1 and s > -1 / (high - low + 1)):
        raise ValueError("0 <= low <= high, 0 < u < 1 and s > -1/(high-low+1) must hold")
    if not (0 <= p <= 1 and 0 < m <= 1):
        raise ValueError("0 <= p <= 1 and 0 < m <= 1 must hold")
    n = high - low + 1
    i, j = np.indices((n, n))
    up, far = j > i, np.abs(j - i)
    room = np.where(up, n - 1 - i, i)
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = m * (1 - m) ** (far - 1.0) / (1 - (1 - m) ** room.astype(float))
    upward = np.clip(u - v * i, 0, 1)
    rates = (1 + s * i) * np.where(up, upward, 1 - upward) * (p * (far == 1) + (1 - p) * np.where(far > 0, steps, 0))
    model = _from_rates(np.where(far > 0, rates, 0), [1 / n] * n, tuple(map(str, range(low, high + 1))))
    if root is None:
        values, vectors = np.linalg.eig(model.matrix.T)
        still = np.real(vectors[:, np.argmin(np.abs(values - 1))])
        root = np.abs(still) / np.abs(still).sum()
    return matrix_model(model.alleles, root, model.matrix)


def single_step(low: int, high: int) -> Model:
    """Repeat counts that grow or shrink by one, both alike; at the ends half of the changes are silent."""
    return microsatellite(0, 0.5, 0, 0, 1, low, high)


def two_phase(p: float, m: float, low: int, high: int) -> Model:
    """One step with probability ``p``, else a geometric number of steps."""
    if not (0 < p < 1 and 0 < m < 1):
        raise ValueError("p and m must lie between 0 and 1")
    return microsatellite(0, 0.5, 0, p, m, low, high)


def linear_bias(m: float, u: float, v: float, low: int, high: int) -> Model:
    """Equal rates, geometric steps, and a bias against growth that is linear in the count."""
    if not (0 < m < 1 and 0 < u < 1):
        raise ValueError("m and u must lie between 0 and 1")
    return microsatellite(0, u, v, 0, m, low, high)


#: Models that need no parameter, by name.
NAMED = {"binary": binary, "jc69": jukes_cantor_model, "blosum62": blosum62, "pam": pam}


def model_named(name: str | Model | None) -> Model:
    """A model by its name, itself if it is one, by default that of Jukes and Cantor."""
    if isinstance(name, Model):
        return name
    if name is not None and name.lower() not in NAMED:
        raise ValueError(f"no mutation model {name!r}; there are {sorted(NAMED)}")
    return NAMED["jc69" if name is None else name.lower()]()


def model_rows(model: Model) -> list[tuple[str, str, float]]:
    """(state above, state below, probability) of a model's matrix."""
    return [(a, b, float(model.matrix[i, j])) for i, a in enumerate(model.alleles) for j, b in enumerate(model.alleles)]


def discrete_sites(mutations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``mutations`` with positions cut to whole numbers, and sites numbered by position; a site may hold many mutations."""
    whole = mutations.withColumn("position", F.floor("position"))
    sites = whole.select(*by, "position").distinct()
    return whole.drop("site").join(numbered(sites, "position", "site", by), [*by, "position"])


def parent_mutations(mutations: DataFrame, tour: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mutation, parent): of the same site, the youngest older mutation on the mutation's own branch or on one above; null if none.

    ``mutations`` has (by, mutation, site, node, time), ``tour`` (by, node, enter,
    leave). A mutation's time must lie on its branch; of equal times on a branch
    the one with the larger id is the younger. A site's mutations are ranges of the
    tour, one within another or apart: running along the site, the number of open
    ranges is a mutation's depth, and its parent is the last one before it that is
    one less deep.
    """
    found = mutations.select(*by, "site", "mutation", "node", (-F.col("time")).alias("_age")).join(tour.select(*by, "node", "enter", "leave"), [*by, "node"], "left")
    alone = F.when(F.col("enter").isNull(), F.col("node"))  # not part of any tree
    placed = found.select(*by, "site", "mutation", "_age", alone.alias("_alone"), F.coalesce("enter", F.lit(0)).alias("enter"), F.coalesce("leave", F.lit(1)).alias("leave"))
    axis = (*by, "site", "_alone")
    ends = F.array(F.struct(F.col("enter").alias("at"), F.lit(1).alias("_in"), F.lit(1).cast("long").alias("d")), F.struct(F.col("leave").alias("at"), F.lit(0).alias("_in"), F.lit(-1).cast("long").alias("d")))
    events = placed.select(*axis, "mutation", "_age", F.explode(ends).alias("x")).select(*axis, "mutation", "_age", "x.*")
    deep = written(running_sum(events, "at", "d", "_depth", axis, ("_in", "_age", "mutation")).where("_in = 1"), "depths")
    none = F.lit(None).cast(mutations.schema["mutation"].dataType)
    known = deep.select(*axis, F.col("_depth").alias("_level"), "at", "_age", "mutation", F.col("mutation").alias("_known"))
    asks = deep.select(*axis, (F.col("_depth") - 1).alias("_level"), "at", "_age", "mutation", none.alias("_known"))
    met = last_known(known.unionByName(asks), "at", "_known", "parent", (*axis, "_level"), ("_age", "mutation"))
    return met.where("_known IS NULL").select(*by, "mutation", "parent")


def _drawn(weights: np.ndarray, draw: Column) -> Column:
    """Index of the state whose share of (0, 1) holds ``draw``."""
    bounds = F.array(*[F.lit(float(x)) for x in np.cumsum(weights)[:-1]])
    return F.size(F.filter(bounds, lambda b: b <= draw))


def with_states(mutations: DataFrame, parents: DataFrame, model: Model, by: tuple[str, ...] = (), seed: int = 1, keep_silent: bool = False) -> DataFrame:
    """``mutations`` with ``ancestral_state`` of the site, ``parent_state`` and ``derived_state``.

    Mutations that leave the state as it was are dropped unless ``keep_silent``.
    """
    keys = list(by)
    draw = uniform(F.lit(seed), F.lit("state"), *keys, "mutation")
    outcome = F.array(*[_drawn(row, draw) for row in model.matrix])
    rows = parents.withColumns({"own": outcome, "path": outcome, "up": F.col("parent")})
    while True:
        rows = written(rows, "states")
        if rows.where("up IS NOT NULL").isEmpty():
            break
        above = rows.select(*keys, F.col("mutation").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        composed = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.transform("_path", lambda s: F.get(F.col("path"), s)))
        rows = rows.join(above, [*keys, "up"], "left").select(*keys, "mutation", "parent", "own", composed.alias("path"), F.col("_up").alias("up"))
    letters = F.array(*map(F.lit, model.alleles))
    upper = rows.select(*keys, F.col("mutation").alias("parent"), F.col("path").alias("_above"))
    root = _drawn(model.root, uniform(F.lit(seed), F.lit("root"), *keys, "site"))
    found = mutations.join(rows.join(upper, [*keys, "parent"], "left"), [*keys, "mutation"]).withColumn("_root", root)
    before = F.when(F.col("_above").isNull(), F.col("_root")).otherwise(F.get("_above", F.col("_root")))
    stated = found.withColumns({"ancestral_state": F.get(letters, F.col("_root")), "parent_state": F.get(letters, before), "derived_state": F.get(letters, F.get(F.col("own"), before))})
    stated = stated if keep_silent else stated.where("parent_state <> derived_state")
    return stated.select(*mutations.columns, "ancestral_state", "parent_state", "derived_state")


def infinite_alleles(mutations: DataFrame, by: tuple[str, ...] = (), start: int = 0) -> DataFrame:
    """``mutations`` with a ``derived_state`` that no other mutation has: a count within ``by``, oldest first; ``start`` is the state of all roots."""
    aged = numbered(mutations.withColumn("_age", -F.col("time")), "_age", "_n", by, ("mutation",)).drop("_age")
    return aged.withColumns({"ancestral_state": F.lit(str(start)), "derived_state": (F.col("_n") + 1 + start).cast("string")}).drop("_n")


def chained_labels(mutations: DataFrame, parents: DataFrame, by: tuple[str, ...] = (), label: str = "mutation") -> DataFrame:
    """``mutations`` with ``derived_state``: the ``label`` of all mutations on the path from the root, oldest first, joined by commas.

    Paths are put together by doubling. ``mutations`` and ``parents`` (by, mutation,
    parent) hold each mutation once; a parent that is not there ends the path.
    """
    keys = list(by)
    own = mutations.select(*keys, "mutation", F.col(label).cast("string").alias("label"))
    now = written(parents.select(*keys, "mutation", F.col("parent").alias("up")).join(own, [*keys, "mutation"]), "labels")
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select(*keys, F.col("mutation").alias("up"), F.col("label").alias("_label"), F.col("up").alias("_up"))
        after = written(now.join(above, [*keys, "up"], "left").select(*keys, "mutation", F.col("_up").alias("up"), F.concat_ws(",", "_label", "label").alias("label")), "labels")
        drop_written(now)
        now = after
    return mutations.join(now.select(*keys, "mutation", F.col("label").alias("derived_state")), [*keys, "mutation"])


def stacked_labels(mutations: DataFrame, parents: DataFrame, mutation_type: int, next_id: int = 0, generation: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """``mutations`` (by, mutation, site, time, ...) with stacked alleles: ``id``, ``ancestral_state``, ``derived_state``, ``origins``.

    Ids count from ``next_id`` along the sites of ``by``, at a site from the oldest
    mutation on; of equal times the smaller mutation comes first. The state at the
    root is empty, the derived state the ids of all mutations from the root on,
    joined by commas. ``origins`` has (type, coefficient, population, generation,
    nucleotide) for each of them: the type given, 0, -1, ``generation`` less the whole
    part of the mutation's time, and -1. Null times or sites are refused.
    """
    if mutation_type < 0 or next_id < 0:
        raise ValueError("the type and the next id must not be below 0")
    refused = F.raise_error(F.lit("a mutation without a site or a time")).cast("double")
    aged = mutations.withColumn("_age", F.when(F.col("site").isNull() | F.col("time").isNull(), refused).otherwise(-F.col("time")))
    counted = numbered(aged, "site", "_n", by, ("_age", "mutation")).withColumn("id", F.col("_n") + F.lit(next_id).cast("long"))
    born = F.lit(generation).cast("long") - F.col("time").cast("long")
    counted = written(counted.withColumn("_own", F.concat_ws(":", "id", born)).drop("_n", "_age"), "ids")
    chains = F.split("derived_state", ",")
    part = lambda x, n: F.get(F.split(x, ":"), F.lit(n))
    origin = lambda x: F.struct(F.lit(mutation_type).alias("type"), F.lit(0.0).cast("float").alias("coefficient"), F.lit(-1).alias("population"), part(x, 1).cast("int").alias("generation"), F.lit(-1).cast("byte").alias("nucleotide"))
    found = chained_labels(counted, parents, by, "_own").drop("_own").withColumn("origins", F.transform(chains, origin))
    return found.withColumns({"ancestral_state": F.lit(""), "derived_state": F.array_join(F.transform(chains, lambda x: part(x, 0)), ",")})


def packed_origins(origins: str = "origins") -> Column:
    """``origins`` as bytes, 17 for each: type, coefficient (always 0), population and generation in four little-endian bytes each, and the nucleotide in one."""

    def little(x: Column) -> Column:
        digits = F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
        return F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])

    one = lambda o: F.concat(little(o["type"]), F.lit("0" * 8), little(o["population"]), little(o["generation"]), F.lpad(F.hex(o["nucleotide"].cast("long").bitwiseAND(F.lit(0xFF))), 2, "0"))
    return F.unhex(F.array_join(F.transform(origins, one), ""))
