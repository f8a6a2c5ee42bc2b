"""Schemas of the frames and parameter records of the algorithms."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np

PIXELS = (
    "image_id BIGINT, pid BIGINT, row INT, col INT, c1 DOUBLE, c2 DOUBLE, c3 DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE, "
    "nx DOUBLE, ny DOUBLE, nz DOUBLE, label INT"
)
LABELS = "image_id BIGINT, pid BIGINT, label INT"
COLOUR, POSITION, NORMAL = ("c1", "c2", "c3"), ("x", "y", "z"), ("nx", "ny", "nz")
CHANNELS = (*COLOUR, *POSITION, *NORMAL)


@dataclass(frozen=True)
class Camera:
    """Depth and colour camera of the public data set, and how they stand to each other."""

    # Fixed values of the data set's calibration.
    cx: float = 313.04475870804731
    cy: float = 238.44389626620386
    fx: float = 582.62448167737955
    fy: float = 582.69103270988637
    k_d: tuple[float, ...] = (-0.099897236553084481, 0.39065324602765344, -0.51031725053400578)
    p_d: tuple[float, ...] = (0.0019290592870229277, -0.0019422022475975055)
    f_rgb: tuple[float, ...] = (518.85790117450188, 519.46961112127485)
    c_rgb: tuple[float, ...] = (325.58244941119034, 253.73616633400465)
    k_rgb: tuple[float, ...] = (0.20796615318809061, -0.58613825163911781, 0.49856986684705107)
    p_rgb: tuple[float, ...] = (0.00072231363135888329, 0.0010479627195765181)
    translation: tuple[float, ...] = (0.025031875059141302, -0.00029342312935846411, 0.00066238747008330102)
    turned: tuple[float, ...] = (
        0.99997798940829263, 0.0050518419386157446, 0.0043011152014118693,
        -0.0050359919480810989, 0.99998051861143999, -0.0036879781309514218,
        -0.0043196624923060242, 0.0036662365748484798, 0.99998394948385538,
    )
    depth_params: tuple[float, ...] = (351.3, 1092.5)
    max_depth: float = 10.0

    def rotation(self) -> np.ndarray:
        """Rows of the rotation: the inverse of minus ``turned``, which has the columns of the transpose one after the other."""
        return np.linalg.inv(-np.array(self.turned).reshape(3, 3))


@dataclass(frozen=True)
class GraphConfig:
    """Graph-based merging; ``scale_k`` is a threshold constant, not a number of segments."""

    scale_k: float = 1.0
    min_size: int = 200
    update_sizes: bool = False
    #: Edges (image_id, src, dst, w_rgb, w_xyz, w_n) of a pixel frame, in place of the built-in weights.
    weigh: Callable | None = field(default=None, compare=False)


@dataclass(frozen=True)
class SpectralConfig:
    """Nystrom spectral clustering with a sweep over the weight of positions."""

    lambdas: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1)
    nev: int = 5
    proportion: float = 0.01
    k: int = 25
    prune_below: int = 350
    lab_mode: str = "reference"
    return_pruned: bool = False
    seed: int = 0
    #: Affinity of rows to landmarks, and which sizes of regions to delete, in place of the built-in ones.
    affinity: Callable | None = field(default=None, compare=False)
    delete: Callable[[int], bool] | None = field(default=None, compare=False)
    #: Cost of giving a deleted region of n pixels the label of a neighbour of m; by default the largest neighbour's.
    replace: Callable[[int, int], float] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if not 0 <= self.proportion <= 1:
            raise ValueError("Invalid Proportion")


@dataclass(frozen=True)
class MixtureConfig:
    """Joint colour, position and normal mixture fitted by EM."""

    k: int = 8
    max_iterations: int = 500
    min_iterations: int = 14
    merge_regions: bool = False
    seed: int = 0


@dataclass(frozen=True)
class WatsonConfig:
    """Watson mixture of normals, started by diametrical clustering."""

    k: int = 4
    k_init: int = 6
    iterations: int = 300
    seed: int = 0


@dataclass(frozen=True)
class DiametricalConfig:
    k: int = 4
    threshold: float = 0.001
    max_iterations: int = 200
    seed: int = 0


@dataclass(frozen=True)
class MergeConfig:
    """Planar region merging."""

    kappa: float = 5.0
    thd: float = 3.0
    thb: float = 0.2
    inliers: float = 0.9
    distance: float = 0.02
    small_area: int = 5
    seed: int = 0


def params(config) -> dict[str, str]:
    """A parameter record as a map of strings, for the result store."""
    return {k: str(v) for k, v in asdict(config).items() if not callable(v) and v is not None}


def config_of(kind: type, values: dict[str, str]):
    """The record that ``params`` wrote as a map of strings."""
    return kind(**{k: ast.literal_eval(v) if k != "lab_mode" else v for k, v in values.items()})
