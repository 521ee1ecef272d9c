"""Settings from the environment; a value that can't be read gives the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from lodestack.operators.catalogue import MILESTONES


def _number(env: Mapping[str, str], name: str, default: int) -> int:
    try:
        return int(env.get(name, default))
    except ValueError:
        return default


@dataclass(frozen=True)
class Config:
    interval_hours: int = 24
    milestones: tuple[int, ...] = MILESTONES
    top_k: int = 50
    summary_days: int = 7

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Config:
        try:
            milestones = tuple(int(x) for x in env["ENGINE_MILESTONES"].split(",") if x.strip()) or MILESTONES
        except (KeyError, ValueError):
            milestones = MILESTONES
        return cls(_number(env, "ENGINE_INTERVAL_HOURS", 24), milestones, _number(env, "ENGINE_TOP_K", 50), _number(env, "ENGINE_SUMMARY_DAYS", 7))
