"""Graph runs and sweeps: select, screen, drop, transform, fit.

One run reads its matrix once.  A sweep is a table of settings; each row is one
task, so settings are fitted in parallel over the executors.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import ids
from ...recovery import keep
from .. import matrix, transforms
from . import dagma, pc, priors
from .random_features import RandomFeatureTest
from .tests import FisherZ, KernelTest, correlation

#: Complete rows that a method without a form in sums takes into memory: the exact kernel test (quadratic in them) and count families.
MOST_KERNEL_ROWS = 5_000
MOST_ROWS = 200_000

EDGE_SCHEMA = "node1 string, endpoint1 string, node2 string, endpoint2 string, edge_text string, source string, target string, weight double, abs_weight double"


@dataclass(frozen=True)
class Spec:
    method: str = "pc"
    alpha: float = 0.05
    test: str = "fisherz"
    stable: bool = True
    transform: str = "none"
    standardise: bool = True
    background: str = "none"
    max_depth: int = -1
    min_unique: int = 2
    min_std: float = 1e-8
    family: str = "gaussian"
    lambda1: float = 0.03
    threshold: float = 0.3
    stages: int = 5
    warm: int = 30000
    last: int = 60000
    binarise_above: float = 0.0


def select_columns(names: list[str], mode: str = "log1p") -> list[str]:
    """Expression in one scale and the signals; libraries are no variables."""
    ending = "_log1p" if mode == "log1p" else "_raw_counts"
    return [n for n in names if (n.startswith("expr__") and n.endswith(ending)) or ("__H3" in n and not n.startswith(("expr__", "libsize__")))]


def families_of(names: list[str], preset: str) -> list[str]:
    gene, peak = dagma.PRESETS[preset]
    return [gene if n.startswith("expr__") else peak for n in names]


def quant_mode_of(preset: str) -> str:
    """Scale a preset needs: counts if it has a count family, else log1p."""
    return "raw_counts" if "nb2" in dagma.PRESETS[preset] else "log1p"


def screened(long: DataFrame, spec: Spec) -> tuple[list[str], DataFrame]:
    """Variables that stay, in order of name, and all with their reason."""
    table = matrix.drop_constant(long, spec.min_unique, spec.min_std)
    rows = table.collect()
    return sorted(r.variable for r in rows if r.drop_reason is None), table


def _texts(edges: list[tuple[int, str, int, str]], names: list[str]) -> list[dict]:
    left, right = {"TAIL": "-", "ARROW": "<", "CIRCLE": "o"}, {"TAIL": "-", "ARROW": ">", "CIRCLE": "o"}
    out = []
    for x, ex, y, ey in edges:
        source = names[x] if (ex, ey) == ("TAIL", "ARROW") else names[y] if (ex, ey) == ("ARROW", "TAIL") else None
        target = None if source is None else names[y] if source == names[x] else names[x]
        out.append({"node1": names[x], "endpoint1": ex, "node2": names[y], "endpoint2": ey, "edge_text": f"{names[x]} {left[ex]}-{right[ey]} {names[y]}", "source": source, "target": target, "weight": None, "abs_weight": None})
    return out


def fit_array(x: np.ndarray, names: list[str], spec: Spec, forbidden: set[tuple[int, int]], offsets: np.ndarray | None = None, test=None) -> list[dict]:
    """Edges found in a matrix of complete rows."""
    if spec.method == "dagma":
        families = families_of(names, spec.family)
        y = x.copy()
        for j, f in enumerate(families):
            if f == "bernoulli":
                y[:, j] = x[:, j] > spec.binarise_above
            elif f == "gaussian" and spec.standardise:
                sd = x[:, j].std(ddof=1)
                y[:, j] = (x[:, j] - x[:, j].mean()) / (sd if sd > 0 else 1)
        model = dagma.Dagma(families, offsets, spec.lambda1, spec.threshold, spec.stages, spec.warm, spec.last)
        return dagma.edge_records(model.fit(y, forbidden), names)
    if test is None:
        test = FisherZ(np.corrcoef(x.T), len(x)) if spec.test == "fisherz" else KernelTest(x)
    if spec.method == "pc":
        return _texts(pc.pc(len(names), test, spec.alpha, spec.max_depth, forbidden, spec.stable), names)
    if spec.method == "fci":
        return _texts(pc.fci(len(names), test, spec.alpha, spec.max_depth, forbidden), names)
    raise ValueError(f"unknown method {spec.method!r}")


def run(long: DataFrame, spec: Spec, columns: list[str] | None = None, row: str = "row") -> tuple[DataFrame, dict]:
    """Edges and a summary of one search over (row, variable, value).

    Fisher's z and the test by random features (``rcit``) are computed from sums over
    all rows by Spark; other methods take the complete rows of the chosen variables
    into memory, and more of them than ``MOST_KERNEL_ROWS`` or ``MOST_ROWS`` are an error.
    """
    spark = long.sparkSession
    all_names = columns or select_columns(sorted(r.variable for r in long.select("variable").distinct().collect()), "raw_counts" if spec.method == "dagma" and quant_mode_of(spec.family) == "raw_counts" else "log1p")
    # stored once: the screen, ranks and spreads each read it
    own = keep(long.select(row, "variable", "value").where(F.col("variable").isin(*all_names)), "long")
    names, reasons = screened(own, spec)
    dropped = {r.variable: r.drop_reason for r in reasons.where("drop_reason is not null").collect()}
    if len(names) < 2:
        raise ValueError("fewer than two variables are left")
    own = keep(transforms.complete_rows(own.where(F.col("variable").isin(*names)), len(names), row), "complete")
    if spec.method != "dagma":
        own = transforms.prepare(own, spec.transform, spec.standardise)
    wide = matrix.to_wide(own, row, names).na.drop(subset=names)
    rule_table = priors.rules(spark.createDataFrame([(n,) for n in names], "node string"), spec.background)
    forbidden = priors.forbidden(rule_table, names)
    if spec.method in ("pc", "fci") and spec.test == "fisherz":
        corr, n = correlation(wide, names)
        edges = fit_array(np.zeros((0, len(names))), names, spec, forbidden, test=FisherZ(corr, n))
    elif spec.method in ("pc", "fci") and spec.test == "rcit":
        test = RandomFeatureTest(keep(wide, "wide"), names)
        n, edges = test.n, fit_array(np.zeros((0, len(names))), names, spec, forbidden, test=test)
    elif spec.method == "dagma" and spec.family == "gaussian" and spec.standardise:
        # moments are enough, so rows stay where they are
        corr, n = correlation(wide, names)
        model = dagma.Dagma(["gaussian"] * len(names), None, spec.lambda1, spec.threshold, spec.stages, spec.warm, spec.last)
        edges = dagma.edge_records(model.fit_moments(corr * (max(1, n - 1) / max(1, n)), forbidden), names)
    else:
        most = MOST_ROWS if spec.method == "dagma" else MOST_KERNEL_ROWS
        if wide.count() > most:
            raise ValueError(f"more than {most} rows: choose fewer, or a test that works on sums (fisherz, rcit)")
        x = wide.orderBy(row).select(*(F.col(f"`{c}`").cast("double") for c in names)).toPandas().to_numpy()
        n, offsets = len(x), None
        if spec.method == "dagma" and "nb2" in dagma.PRESETS[spec.family]:
            offsets = _offsets(long, names, row, wide)
        edges = fit_array(x, names, spec, forbidden, offsets)
    rows = [tuple(e[c.split()[0]] for c in EDGE_SCHEMA.split(", ")) for e in edges]
    summary = {"method": spec.method, "variables": names, "dropped": dropped, "rows": n, "edges": len(rows), "forbidden": len(forbidden), "spec": asdict(spec)}
    return spark.createDataFrame(rows, EDGE_SCHEMA), summary


def _offsets(long: DataFrame, names: list[str], row: str, wide: DataFrame) -> np.ndarray:
    """log(max(library, 1)) of each row and variable, 0 where there is no library column."""
    own = {n: "libsize__rna" if n.startswith("expr__") else "libsize__" + n.rsplit("__", 1)[-1] for n in names}
    libs = sorted(set(own.values()))
    table = matrix.to_wide(long.where(F.col("variable").isin(*libs)), row, libs)
    got = wide.select(row).join(table, row, "left").orderBy(row).toPandas()
    return np.stack([np.log(np.maximum(pd.to_numeric(got[own[n]]).fillna(1.0).to_numpy(), 1.0)) for n in names], 1)


def sweep(x: DataFrame, columns: list[str], specs: list[Spec], forbidden_mode: bool = True) -> DataFrame:
    """One task a setting over the same complete matrix; edges with the setting's name and number.

    ``x`` is wide and holds the chosen variables only; it is sent to every task,
    which suits the hundreds of rows of one gene's matrix.
    """
    spark = x.sparkSession
    data = x.select(*(F.col(f"`{c}`").cast("double") for c in columns)).toPandas().to_numpy()
    shared = spark.sparkContext.broadcast(data)
    rules = {s.background: priors.forbidden(priors.rules(spark.createDataFrame([(n,) for n in columns], "node string"), s.background), columns) for s in specs} if forbidden_mode else {}
    rows = [(k, run_name(s), json.dumps(asdict(s))) for k, s in enumerate(specs)]
    table = spark.createDataFrame(rows, "run int, name string, spec string").repartition(max(1, len(rows)), "run")

    def one(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in df.itertuples():
            spec = Spec(**json.loads(r.spec))
            for e in fit_array(shared.value, columns, spec, rules.get(spec.background, set())):
                out.append({"run": r.run, "name": r.name, **e})
        return pd.DataFrame(out, columns=["run", "name", *(c.split()[0] for c in EDGE_SCHEMA.split(", "))])

    return table.groupBy("run").applyInPandas(one, "run int, name string, " + EDGE_SCHEMA)


def depth_grid(methods: list[str], depths: list[int], base: Spec = Spec()) -> list[Spec]:
    if "dagma" in methods:
        raise ValueError("dagma has no depth; use dagma_grid")
    return [replace(base, method=m, max_depth=d) for m in methods for d in depths]


def dagma_grid(presets: list[str], lambdas: list[float], thresholds: list[float], stages: list[int], base: Spec = Spec()) -> list[Spec]:
    return [replace(base, method="dagma", family=f, lambda1=a, threshold=t, stages=s) for f in presets for a in lambdas for t in thresholds for s in stages]


def run_name(spec: Spec) -> str:
    """Folder name of a run."""
    if spec.method == "dagma":
        return ids.sanitize(f"dagma_{spec.family}_l{spec.lambda1:g}_t{spec.threshold:g}_T{spec.stages}")
    return ids.sanitize(f"{spec.method}_{spec.test}_a{spec.alpha:g}_depth{'all' if spec.max_depth < 0 else spec.max_depth}_{spec.background}")
