"""An incremental fact engine on Spark: components are DataFrames, rules are functions from DataFrames to DataFrames."""

from importlib import import_module

#: Where the public names are; loaded when first used, so that workers of one operator don't load the engine.
_PLACES = {
    "engine": ("Despawn", "Engine", "Remove", "Spawn", "System", "Write", "system"),
    "model": ("Component", "FactError", "Inverse", "Plugin", "Shape"),
    "plans.query": ("And", "Entity", "Eq", "Gte", "In", "Maybe", "Meta", "Mut", "Named", "Not", "Optional", "Or", "Query", "Read", "Tracked", "With", "Without"),
    "sources.tables": ("from_table", "kind_entity"),
    "streaming.ingest": ("ingest",),
}
__all__ = sorted(name for names in _PLACES.values() for name in names)


def __getattr__(name: str):
    for module, names in _PLACES.items():
        if name in names:
            return getattr(import_module(f"{__name__}.{module}"), name)
    raise AttributeError(name)
