"""Calling parameters and their presets; sequences are in the order deletion, insertion, duplication, inversion."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values, as are the defaults and the presets below.
TYPES = ("DEL", "INS", "DUP", "INV")
GENOTYPE_RATIO = {0: 0.8, 1: 0.75, 2: 0.8, 3: 0.8}


@dataclass(frozen=True)
class Params:
    """Everything that the operators can be tuned with."""

    min_sv_len: int = 30
    min_mapq: int = 20
    min_template: int = 500
    merge_distance: int = 500
    merge_portion: float = 0.2
    window: int = 100
    ins_clip_tolerance: int = 10
    max_cluster: int = 1000
    cluster_reach: int = 20_000
    precise_sd: float = 3.0
    precise_templates: int = 5
    omni_a: tuple = (800, 200)
    omni_b: tuple = (800, 200)
    omni_edges: int = 8
    omni_relevant: int = 20
    omni_ratio: float = 0.1
    # clustering
    pos_ratio: tuple = (1.5, 0.5, 0.2, 0.1)
    force: tuple = (50, 150, 0, 100)
    length_ratio: tuple = (0.3, 0.1, 0.1, 0.1)
    length_min: tuple = (10, 20, 0, 0)
    near: tuple = (-1, -1, -1, -1)
    force2: tuple = (10, 50, 500, 100)
    length_ratio2: tuple = (0.5, 0.3, 0.1, 0.5)
    hp_same: tuple = (0.8, 0.8, 0.4, 1.0)
    hp_diff: tuple = (1.4, 1.5, 1.4, 1.3)
    # filter tiers: least templates as base + multiple of coverage, least length score
    base1: tuple = (1, 1, 0, 2)
    base2: tuple = (0, 0, 1, 1)
    multi1: tuple = (0.28, 0.19, 0.23, 0.0)
    multi2: tuple = (0.16, 0.14, 0.12, 0.18)
    score1: tuple = (70, 60, 90, 98)
    score2: tuple = (95, 90, 96, 0)
    # haplotype-aware cut-offs
    hp_ratio: tuple = (0.8, 0.7, 0.2, 0.5)
    homo_ratio: tuple = (0.8, 0.75, 0.9, 0.65)
    homo_minus: tuple = (0.0, 0.05, 0.0, 0.7)
    homo_minus_ratio: tuple = (0.2, 0.25, 0.6, 0.2)
    other_minus: tuple = (0.0, 0.0, 0.0, 0.0)
    other_minus_ratio: tuple = (-0.05, 0.3, 0.0, 0.4)
    low_plus: tuple = (0.0, 0.0, 0.0, 0.0)
    low_plus_ratio: tuple = (0.25, 0.25, 0.9, 0.0)
    # rules of the filter: keep everything, keep what has two templates, greatest spread of begins (-1: any), weigh templates by quality
    no_filter: bool = False
    filter_2st: bool = False
    min_pos_sd: tuple = (-1, -1, -1, -1)
    calc_pos_sd: bool = False
    weight_filter: bool = False


ONT = Params()
CLR = replace(
    ONT, pos_ratio=(1.5, 1.2, 0.2, 0.1), force=(50, 10, 0, 100), length_ratio=(0.3, 0.3, 0.1, 0.1), length_min=(60, 0, 0, 0),
    base1=(1, 2, 4, 2), base2=(0, 0, 0, 1), multi1=(0.13, 0.12, 0.13, 0.0), multi2=(0.12, 0.5, 0.1, 0.18), score1=(65, 50, 85, 98), score2=(95, 95, 99, 0),
)
CCS = replace(
    ONT, pos_ratio=(2.0, 2.5, 0.2, 0.1), force=(100, 200, 0, 100), length_ratio=(0.5, 0.5, 0.1, 0.1), length_min=(10, 50, 0, 0),
    base1=(0, 0, 4, 2), base2=(0, 0, 0, 1), multi1=(0.31, 0.33, 0.13, 0.0), multi2=(0.1, 0.13, 0.1, 0.18), score1=(55, 55, 85, 98), score2=(95, 95, 99, 0),
)

# What the fields of a custom parameter string stand for.
CLUSTER_FIELDS = ("force", "pos_ratio", "length_min", "length_ratio", "near", "force2", "length_ratio2")
WHOLE = ("force", "length_min", "near", "force2")
FILTER_FIELDS = ("base1", "multi1", "score1", "base2", "multi2", "score2")


def with_custom(p: Params, sv_type: int, text: str, fields: tuple[str, ...], lengths: tuple[int, ...]) -> Params:
    """``p`` with one type's parameters from a comma-separated string; ``*`` keeps a value, another count of fields is an error."""
    parts = text.split(",")
    if len(parts) not in lengths:
        raise ValueError(f"expected {' or '.join(map(str, lengths))} fields, got {len(parts)}: {text!r}")
    new = {}
    for name, part in zip(fields, parts, strict=False):
        if not part.startswith("*"):
            values = list(getattr(p, name))
            values[sv_type] = int(float(part)) if name in WHOLE else float(part)
            new[name] = tuple(values)
    return replace(p, **new)


def with_cluster(p: Params, sv_type: int, text: str) -> Params:
    """Four fields are the first layer's, and so are four of five: both turn the second layer off."""
    if text.count(",") in (3, 4):
        near = tuple(-1 if t == sv_type else v for t, v in enumerate(p.near))
        return replace(with_custom(p, sv_type, text, CLUSTER_FIELDS[:4], (4, 5)), near=near)
    return with_custom(p, sv_type, text, CLUSTER_FIELDS, (4, 5, 7))


def with_filter(p: Params, sv_type: int, text: str) -> Params:
    return with_custom(p, sv_type, text, FILTER_FIELDS, (6,))
