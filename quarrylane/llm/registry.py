"""The query modules of this subpackage, each with QUERIES and ORACLE."""

import importlib

MODULES = ["filers", "pairs", "stable_sample", "packing", "mixing", "pages"]


def query_modules() -> list:
    return [importlib.import_module(f"quarrylane.llm.{m}") for m in MODULES]
