"""The file router: by size, which profile reads a file."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from millrace.config import LARGE, SMALL, Settings


def file_size_mb(path: str | Path) -> float:
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no such file: {path}")
    if not path.is_file():
        raise ValueError(f"not a file: {path}")
    return path.stat().st_size / 2**20


def choose_engine(path: str | Path, settings: Settings | None = None) -> tuple[str, float]:
    """(profile, MiB): small up to the threshold, that included."""
    size = file_size_mb(path)
    return (SMALL if size <= (settings or Settings()).small_file_mb else LARGE), size


def normalize_engine(decision: object) -> str:
    """The profile named by a decision: the name, a dict under engine or selected_engine, or a sequence that holds it."""
    if isinstance(decision, dict):
        named = [decision.get("engine"), decision.get("selected_engine")]
    elif isinstance(decision, (tuple, list)):
        named = list(decision)
    else:
        named = [decision]
    for value in named:
        if isinstance(value, str) and value in (SMALL, LARGE):
            return value
    raise RuntimeError(f"no engine in {decision!r}")


@dataclass(frozen=True)
class Route:
    path: Path
    file_size_mb: float
    engine: str
    reason: str


def resolve_route(path: str | Path, settings: Settings | None = None, decide=choose_engine) -> Route:
    """The route of an input, after checking the decision against the threshold once more."""
    settings, path = settings or Settings(), Path(path).resolve()
    size = file_size_mb(path)
    engine = normalize_engine(decide(path, settings))
    if engine != (SMALL if size <= settings.small_file_mb else LARGE):
        raise RuntimeError(f"the router chose {engine} for {size:,.2f} MB at a threshold of {settings.small_file_mb} MB")
    sign = "<=" if engine == SMALL else ">"
    return Route(path, size, engine, f"file size {sign} configured threshold")
