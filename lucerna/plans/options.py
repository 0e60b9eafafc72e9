"""Options of the pipelines, with the defaults of the original: given no options at all, compression is off."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from lucerna.operators.crush import CrushOptions
from lucerna.operators.diffs import DiffOptions
from lucerna.operators.logs import LogOptions
from lucerna.operators.search import SearchOptions


@dataclass(frozen=True)
class Toggles:
    smart_crusher: bool = True
    kompress: bool = True
    search: bool = True
    log: bool = True
    diff: bool = True

    @classmethod
    def partial(cls, **given: bool) -> Toggles:
        """Toggles as the pipeline reads a partial record: what isn't named is off."""
        return cls(**{f.name: bool(given.get(f.name)) for f in fields(cls)})


@dataclass(frozen=True)
class Options:
    enabled: bool = True
    min_tokens_to_compress: int = 200
    live_zone_only: bool = True
    verbose: bool = False
    cache_align: bool = True
    real_time: bool = True
    store: bool = True
    compressors: Toggles = field(default_factory=Toggles)
    crush: CrushOptions = field(default_factory=CrushOptions)
    log: LogOptions = field(default_factory=LogOptions)
    search: SearchOptions = field(default_factory=SearchOptions)
    diff: DiffOptions = field(default_factory=DiffOptions)

    @classmethod
    def parse(cls, given: dict | None) -> Options:
        """Options from a plain record; none at all means not enabled, missing keys take their defaults."""
        if given is None:
            return cls(enabled=False)
        params = given.get("compressor_params") or {}
        made = {"crush": CrushOptions(**params.get("smart_crusher", {})), "log": LogOptions(**params.get("log", {})), "search": SearchOptions(**params.get("search", {})), "diff": DiffOptions(**params.get("diff", {}))}
        toggles = Toggles(**{f.name: bool(v) for f in fields(Toggles) if (v := (given.get("compressors") or {}).get(f.name, True)) is not None})
        plain = {k: given[k] for k in ("enabled", "min_tokens_to_compress", "live_zone_only", "verbose", "cache_align", "real_time", "store") if given.get(k) is not None}
        return cls(**plain, **made, compressors=toggles)
