"""The preprocessing sequence as one plan; bad channels and components are its only barriers."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from ..operators import epochs, ica, spatial
from ..operators.filtering import eeg_filter


@dataclass
class Preprocessed:
    samples: DataFrame
    log: list[tuple[str, str, datetime]] = field(default_factory=list)
    bad: list[str] = field(default_factory=list)


def preprocess(samples: DataFrame, sr: float, lowcut: float | None = 1, highcut: float | None = 40, notch: float | None = None, positions: DataFrame | None = None, reference: str | None = "average", run_ica: bool = False, events: DataFrame | None = None, epoch: bool = False, limits: tuple[float, float] = (-0.2, 0.8), reject_uv: float | None = None) -> Preprocessed:
    """filter, bad channels, interpolation, re-reference, components, epochs, rejection; the log has each step, its parameters and when it was planned."""
    if epoch and events is None:
        raise ValueError("epoching needs events")
    out = Preprocessed(samples)

    def step(name: str, params: str, x: DataFrame) -> None:
        out.samples = x
        out.log.append((name, params, datetime.now(timezone.utc)))

    if lowcut or highcut or notch:
        step("filter", f"{lowcut}-{highcut} Hz, notch {notch}", eeg_filter(out.samples, sr, lowcut, highcut, notch))
    out.bad = [r["channel"] for r in spatial.bad_channels(out.samples).where("is_bad").collect()]
    out.log.append(("bad_channels", ", ".join(out.bad), datetime.now(timezone.utc)))
    if out.bad and positions is not None:
        step("interpolate", "spline", spatial.interpolate(out.samples, out.bad, positions))
    if reference:
        step("rereference", reference, spatial.rereference(out.samples, reference, positions=positions))
    if run_ica:
        model = ica.fit(out.samples, method="jade")
        gone = [r["component"] for r in ica.detect(out.samples, model).where("type = 'artifact'").collect()]
        step("ica", f"removed {gone}", ica.remove(out.samples, model, gone))
    if epoch:
        step("epoch", str(limits), epochs.epoch_events(out.samples, events, sr, limits)[0])
        if reject_uv:
            step("reject", f"{reject_uv} uV", epochs.reject_artifacts(out.samples, threshold_uv=reject_uv)[0])
    return out
