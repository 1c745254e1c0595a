"""Registry of the queries of this subpackage."""
import importlib

NAMES: list[str] = ["lookalike_queries", "pieces_queries", "leak_queries", "pii_queries", "defects_queries", "sentences_queries", "mixture_queries"]


def modules() -> list:
    return [importlib.import_module(f"verdigris.llm.{name}") for name in NAMES]
