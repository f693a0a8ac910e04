"""Run configuration: dataclasses, their rules, and the loading of setups."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from .operators.inference import ENGINES, engine_of
from .operators.suppression import METHODS

MODES = ("sahi", "asahi", "asahi_rect", "none")
STRATEGIES = ("kfold_holdout", "fixed_ratios")


@dataclass(frozen=True)
class Slicing:
    mode: str = "sahi"
    tile_size: tuple[int, int] = (640, 640)
    overlap_ratio: float = 0.15


@dataclass(frozen=True)
class Folds:
    n_folds: int = 5
    seed: int = 42
    val_ratio: float = 0.15
    test_ratio: float | None = None
    split_strategy: str = "kfold_holdout"
    ioa_threshold: float = 0.2
    empty_tile_ratio: float = 0.1


@dataclass(frozen=True)
class Inference:
    suppression: str = "nms"
    conf_threshold: float = 0.5
    iou_threshold: float = 0.5
    batch_size: int = 32


@dataclass(frozen=True)
class Setup:
    index: int
    input_path: str
    output_path: str
    slicing: Slicing = Slicing()
    folds: Folds = Folds()
    inference: Inference = Inference()
    models: tuple[str, ...] = field(default=())

    @property
    def name(self) -> str:
        return PurePosixPath(self.output_path).name

    def problems(self) -> list[str]:
        """What is wrong with the setup; empty if nothing is."""
        s, f, i = self.slicing, self.folds, self.inference
        inside = lambda x: x is not None and 0 < x < 1
        rules = {
            f"slicing.mode: one of {', '.join(MODES)}": s.mode in MODES,
            "slicing.tile_size: width and height, both above 0": len(s.tile_size) == 2 and min(s.tile_size) > 0,
            "slicing.overlap_ratio: a share, neither none nor all": s.mode == "none" or inside(s.overlap_ratio),
            "crossfolds.n_folds: two at least": f.n_folds >= 2,
            "crossfolds.val_ratio: a share, neither none nor all": inside(f.val_ratio),
            f"crossfolds.split_strategy: one of {', '.join(STRATEGIES)}": f.split_strategy in STRATEGIES,
            "crossfolds.test_ratio: a share, neither none nor all": f.split_strategy != "fixed_ratios" or inside(f.test_ratio),
            "crossfolds.val_ratio, crossfolds.test_ratio: less than all together": f.split_strategy != "fixed_ratios" or f.val_ratio + (f.test_ratio or 0) < 1,
            "crossfolds.ioa_threshold: a share, not none": 0 < f.ioa_threshold <= 1,
            "crossfolds.empty_tile_ratio: a share": 0 <= f.empty_tile_ratio <= 1,
            f"inference.suppression: one of {', '.join(METHODS)}": i.suppression in METHODS,
            "inference.conf_threshold: a share, not none": 0 < i.conf_threshold <= 1,
            "inference.iou_threshold: a share, not none": 0 < i.iou_threshold <= 1,
            "inference.batch_size: one at least": i.batch_size >= 1,
        }
        return [text for text, good in rules.items() if not good]


def setup(block: dict, index: int) -> Setup:
    """A setup from a configuration block; ValueError names every broken rule."""
    made = lambda kind, part: kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in (block.get(part) or {}).items()})
    data = block["dataset"]
    out = Setup(block.get("index", index), data["input_path"], data["output_path"], made(Slicing, "slicing"), made(Folds, "crossfolds"), made(Inference, "inference"), tuple(block.get("models", ())))
    if found := out.problems():
        raise ValueError(f"setup {out.index}: " + "; ".join(found))
    return out


def setups(config: dict, read) -> list[Setup]:
    """Setups of a configuration: those of setups_to_run (all if absent) from the catalogue, whose entries name files that read() loads as dicts; or
    the inline list processes."""
    if "setups" in config:
        catalogue = {s["name"]: s for s in config["setups"]}
        wanted = config.get("setups_to_run") or list(catalogue)
        if unknown := [n for n in wanted if n not in catalogue]:
            raise ValueError(f"unknown setups {', '.join(unknown)}; known: {', '.join(sorted(catalogue))}")
        blocks = [{**(read(catalogue[n]["config"]) or {}), "index": i} for i, n in enumerate(wanted, 1)]
    elif "processes" in config:
        blocks = config["processes"]
    else:
        raise ValueError("a configuration has setups or processes")
    return [setup(b, i) for i, b in enumerate(blocks, 1)]


def wanted(values: list[str] | None) -> list[str] | None:
    """Repeated and comma-joined options as one list; None if there are none."""
    return [x.strip() for v in values for x in v.split(",") if x.strip()] if values else None


def chosen(names: list[str], want: list[str] | None) -> list[str]:
    """Names that are wanted, in any case; all if nothing is said. ValueError names what is unknown."""
    if want is None:
        return names
    low = {n.lower(): n for n in names}
    if unknown := [w for w in want if w.lower() not in low]:
        raise ValueError(f"unknown {', '.join(unknown)}; known: {', '.join(names)}")
    return [low[w.lower()] for w in want]


def canonical_model(name: str) -> str:
    """The name that results have; a bare YOLO could be any of its variants."""
    own = name.strip()
    upper = own.upper()
    if upper == "YOLO":
        raise ValueError("YOLO is ambiguous; name the variant")
    return {"DETR": "DETR", "FASTER": "Faster", "FASTERRCNN": "Faster"}.get(upper, upper if upper.startswith("YOLO") else own)


def result_label(setup_name: str, model: str) -> str:
    return f"{setup_name.upper()}_{model}"


__all__ = ["ENGINES", "Folds", "Inference", "Setup", "Slicing", "canonical_model", "chosen", "engine_of", "result_label", "setup", "setups", "wanted"]
