"""Versions of the four components, presets that combine them, and the paths of their stages."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..operators.search import Search


@dataclass(frozen=True)
class Norm:
    alias_min_count: int = 25
    alias_min_ratio: float = 0.5
    alias_max_unaligned: int = 4


@dataclass(frozen=True)
class Block:
    search: Search = Search()
    region_split: bool = True
    region_min_share: float = 0.002
    region_min_last_ratio: float = 0.6
    region_min_cross: int = 10
    keep_nonevals: float = 1.0
    dup_distractors: int = 1
    prune_keep: float = 0.0
    search_from: str = ""  # a version whose search is taken over


@dataclass(frozen=True)
class Feat:
    align: bool = False
    number_gap: bool = False
    distinct: bool = False
    keep_numbers: bool = False
    twin_flag: bool = False
    target_names: bool = False
    extra: tuple[str, ...] = ()
    extra_context: bool = False


@dataclass(frozen=True)
class Match:
    stages: int = 2
    folds: int = 3
    rules: tuple[str, ...] = ("threshold", "expected", "gated")
    rate: float = 0.05
    pred_margin: float = 0.0
    support: bool = False
    fit_rest: bool = False
    distractor_weight: float = 1.0
    entity_weight: bool = False
    eval_dup: bool = False
    covshift: bool = False
    monotone_min_corr: float = 0.0
    self_train: tuple[float, ...] = ()
    train_countries: tuple[str, ...] = ()
    blend_of: tuple[str, ...] = ()
    frozen_from: str = ""
    algo: str = "gbt"


# The parameters that a version's name stands for. Learners: gbt, deep (trees of depth 8), forest (the
# second tree family) and mlp; pyspark.ml has no others. A frozen matcher names block, features and matcher of its source.
NORM = {"NORM-v2": Norm()}
_WIDE = Search(k=30, k_noaddr=5)
BLOCK = {
    "BLK-v1": Block(Search(k=30, k_noaddr=0, char_grams=False, joined_name=False), region_split=False),
    "BLK-v2": Block(_WIDE, region_split=False),
    "BLK-v3": Block(replace(_WIDE, max_df_frac=0.0, min_df_cap=3000), region_split=False),
    "BLK-v4": Block(_WIDE, region_min_last_ratio=0.0),
    "BLK-v4b": Block(_WIDE),
    "BLK-v4b@20": Block(Search()),
    "BLK-v4b@40": Block(Search(k=40)),
    "BLK-v4b@40n20": Block(Search(k=40, k_noaddr=20)),
    "BLK-v4b@20-tlu40": Block(Search(), keep_nonevals=0.4),
    "BLK-v4b@40-tlu40": Block(Search(k=40), keep_nonevals=0.4),
    "BLK-v4b@20-dup2": Block(Search(), dup_distractors=2),
    "BLK-v5-tlu40": Block(Search(), keep_nonevals=0.4, prune_keep=0.995, search_from="BLK-v4b@20-tlu40"),
}
_FOUR = Feat(align=True, number_gap=True, distinct=True, target_names=True)
FEAT = {
    "FEAT-v1": Feat(),
    "FEAT-v2": Feat(align=True),
    "FEAT-v3": Feat(align=True, number_gap=True),
    "FEAT-v4": _FOUR,
    "FEAT-v5": replace(_FOUR, keep_numbers=True, twin_flag=True),
    "FEAT-v6": replace(_FOUR, extra=("ce1",)),
    "FEAT-v7": replace(_FOUR, extra=("ce2",)),
    "FEAT-v8": replace(_FOUR, extra=("ce2",), extra_context=True),
    "FEAT-v9": replace(_FOUR, extra=("ce1", "ce2"), extra_context=True),
    "FEAT-v10": replace(_FOUR, extra=("ce1", "ce2", "ce3"), extra_context=True),
}
_SIX = Match(rate=0.1, fit_rest=True)
MATCH = {
    "MATCH-v1": Match(stages=1, rules=("threshold",)),
    "MATCH-v2": Match(),
    "MATCH-v3": Match(support=True),
    "MATCH-v4": Match(pred_margin=10.0),
    "MATCH-v5": Match(rate=0.1),
    "MATCH-v6": _SIX,
    "MATCH-v2-frozen": Match(frozen_from="BLK-v4b@20__FEAT-v2__MATCH-v2"),
    "MATCH-v6-frozen-tlu": replace(_SIX, frozen_from="BLK-v4b@20-tlu40__FEAT-v4__MATCH-v6"),
    "MATCH-v8": replace(_SIX, algo="forest"),
    "MATCH-v9": Match(fit_rest=True, blend_of=("MATCH-v6", "MATCH-v8")),
    "MATCH-v10": replace(_SIX, distractor_weight=2.0, eval_dup=True),
    "MATCH-v13": Match(fit_rest=True, algo="mlp"),
    "MATCH-v14": Match(fit_rest=True, blend_of=("MATCH-v6", "MATCH-v13")),
    "MATCH-v15": replace(_SIX, algo="deep"),
    "MATCH-v16": Match(fit_rest=True, blend_of=("MATCH-v6", "MATCH-v15")),
    "MATCH-v17": replace(_SIX, entity_weight=True),
    "MATCH-v18": Match(fit_rest=True, blend_of=("MATCH-v6", "MATCH-v13", "MATCH-v15")),
    "MATCH-v19-us": replace(_SIX, train_countries=("US",)),
    "MATCH-v19-in": replace(_SIX, train_countries=("India",)),
    "MATCH-v20-us": replace(_SIX, train_countries=("US",), self_train=(0.9, 0.1)),
    "MATCH-v20": replace(_SIX, self_train=(0.9, 0.1)),
    "MATCH-v22-us": replace(_SIX, train_countries=("US",), covshift=True),
    "MATCH-v22-in": replace(_SIX, train_countries=("India",), covshift=True),
    "MATCH-v22": replace(_SIX, covshift=True),
    "MATCH-v23-us": replace(_SIX, algo="forest", train_countries=("US",)),
    "MATCH-v23-in": replace(_SIX, algo="forest", train_countries=("India",)),
    "MATCH-v24-us": Match(fit_rest=True, train_countries=("US",), blend_of=("MATCH-v19-us", "MATCH-v23-us")),
    "MATCH-v24-in": Match(fit_rest=True, train_countries=("India",), blend_of=("MATCH-v19-in", "MATCH-v23-in")),
}


@dataclass(frozen=True)
class Versions:
    norm: str = "NORM-v2"
    block: str = "BLK-v4b@20"
    feat: str = "FEAT-v2"
    match: str = "MATCH-v2"

    def key(self, stage: str) -> str:
        """A stage's cache key holds the versions of all it depends on, and no others."""
        parts = {"prep": (self.norm,), "block": (self.norm, self.block), "features": (self.norm, self.block, self.feat), "scores": (self.norm, self.block, self.feat, self.match)}[stage]
        return f"{stage}/{'__'.join(parts)}"


def _presets() -> dict[str, Versions]:
    named = {
        "M-v1": ("BLK-v4b@20", "FEAT-v1", "MATCH-v1"),
        "M-v2": ("BLK-v4b@20", "FEAT-v2", "MATCH-v1"),
        "M-v3": ("BLK-v4b@20", "FEAT-v2", "MATCH-v2"),
        "M-v4": ("BLK-v4b@20", "FEAT-v3", "MATCH-v3"),
        "M-v5": ("BLK-v4b@20-tlu40", "FEAT-v3", "MATCH-v6"),
        "M-v6": ("BLK-v4b@20-tlu40", "FEAT-v4", "MATCH-v6"),
        "M-v7": ("BLK-v4b@20-dup2", "FEAT-v4", "MATCH-v6"),
        "M-v8": ("BLK-v4b@20-dup2", "FEAT-v4", "MATCH-v8"),
        "M-v9": ("BLK-v4b@20-dup2", "FEAT-v4", "MATCH-v9"),
        "M-v10": ("BLK-v4b@20-tlu40", "FEAT-v4", "MATCH-v10"),
        "M-v11": ("BLK-v5-tlu40", "FEAT-v4", "MATCH-v6"),
        "M-v12": ("BLK-v5-tlu40", "FEAT-v4", "MATCH-v10"),
        "M-v21": ("BLK-v5-tlu40", "FEAT-v5", "MATCH-v6"),
    }
    for n in ("13", "14", "15", "16", "17", "18", "19-us", "19-in", "20-us", "20", "22-us", "22-in", "22", "23-us", "23-in", "24-us", "24-in"):
        named[f"M-v{n}"] = ("BLK-v5-tlu40", "FEAT-v4", f"MATCH-v{n}")
    for n in range(25, 30):
        named[f"M-v{n}"] = ("BLK-v5-tlu40", f"FEAT-v{n - 19}", "MATCH-v6")
    return {k: Versions("NORM-v2", *v) for k, v in named.items()}


PRESETS = _presets()
DEFAULT_PRESET = "M-v3"
# End of fixed values.


def resolve(preset: str | None = None, **over: str) -> Versions:
    """A preset with single versions replaced; unknown names raise."""
    v = replace(PRESETS[preset] if preset else Versions(), **{k: x for k, x in over.items() if x})
    for name, table in ((v.norm, NORM), (v.block, BLOCK), (v.feat, FEAT), (v.match, MATCH)):
        if name not in table:
            raise KeyError(f"unknown version {name}")
    return v


def without_country(match: Match, countries: list[str], left: str) -> Match:
    """The same matcher, fitted on all countries but one."""
    return replace(match, train_countries=tuple(c for c in countries if c != left))
