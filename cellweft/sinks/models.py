"""Fitted models as ``.npz`` files: plain arrays with names, no pickles."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from ..operators.latent import Model


def write_model(model: Model, modalities: list[str], path: str | Path) -> None:
    """The weights of a latent model and the modalities it was fitted on, in order."""
    with open(path, "wb") as out:
        np.savez(out, modalities=np.array(modalities, dtype=str), **{f"p_{k}": v for k, v in model.p.items()})


def read_model(path: str | Path) -> tuple[Model, list[str]]:
    with np.load(path, allow_pickle=False) as data:
        return Model({k.removeprefix("p_"): data[k] for k in data.files if k != "modalities"}), data["modalities"].tolist()
