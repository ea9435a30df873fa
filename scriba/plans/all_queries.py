"""All queries; importing the modules registers them."""

from scriba.plans import catalogues, jobs, lists, roundtrips, scalars, scoring, signals, stores, streams, subtitles  # noqa: F401
from scriba.plans.registry import ORACLES, QUERIES  # noqa: F401
