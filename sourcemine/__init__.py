"""Batch mining of source corpora into prompts, answers and harnesses, on Spark."""

from sourcemine.plans.discovery import retrieve_function_candidates, retrieve_method_candidates
from sourcemine.plans.harness_run import RunResult, run
from sourcemine.sources.files import decode
from sourcemine.sources.tree import list_tree, read_tree

__all__ = [
    "RunResult",
    "decode",
    "list_tree",
    "read_tree",
    "retrieve_function_candidates",
    "retrieve_method_candidates",
    "run",
]
