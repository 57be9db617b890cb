"""Declarative pipelines: declare datasets as functions, validate the graph, write its manifest, run it."""

from .analysis import Plan, analyse
from .events import Event, State
from .manifest import fingerprint, manifest, parse, render
from .model import AutoCdc, Dataset, Flow, InvalidPipeline, Kind, Pipeline, Problem
from .runner import RunFailed, Runner, seed, watch

__all__ = ["AutoCdc", "Dataset", "Event", "Flow", "InvalidPipeline", "Kind", "Pipeline", "Plan", "Problem", "RunFailed", "Runner", "State", "analyse", "fingerprint", "manifest", "parse", "render", "seed", "watch"]
