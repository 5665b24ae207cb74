"""All registered queries."""

from colloquy.plans import (  # noqa: F401
    alignment,
    audit,
    formatting,
    governance,
    messages,
    models,
    pages,
    releases,
    rewards,
    runs,
    sampling,
    streams,
    supervised,
)
from colloquy.plans.registry import PLANS

__all__ = ["PLANS"]
