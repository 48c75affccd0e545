"""Siltstone: structured extraction and text dataflow on PySpark.

What users need stands here; a name's module is loaded when it is first asked for, so that workers load no more than
they use.
"""

from importlib import import_module

_HOMES = {
    "siltstone.extraction": ["Extraction", "ExtractionConfig", "audited", "extract", "typed"],
    "siltstone.functions.chunking": ["chunk"],
    "siltstone.operators.corrections": ["ISSUES"],
    "siltstone.plans.quota": ["Quota", "parse_quota"],
    "siltstone.plans.units": ["Unit", "decompose"],
    "siltstone.sources.documents": ["read_documents", "read_text_files", "write_results"],
    "siltstone.sources.runner": ["Runner", "ScriptedRunner", "ask", "judged", "scripted"],
}
_NAMES = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(f"siltstone has no {name}")
    return getattr(import_module(_NAMES[name]), name)
