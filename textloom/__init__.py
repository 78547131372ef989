"""textloom: a text-corpus quality engine built on the DataFrame API of Apache Spark."""

__version__ = "0.1.0"


def __getattr__(name: str):
    """The public interface, imported when it is first used: executors need none of it."""
    import importlib

    homes = {
        "textloom.models": ("Chunk", "Document", "Finding", "Location", "Report", "Severity"),
        "textloom.plans.analyzers": ("AnalyzerResult",),
        "textloom.config": ("Config",),
        "textloom.engine": ("analyze_chunks", "analyze_path", "analyze_paths"),
        "textloom.scoring": ("compute_health",),
    }
    for home, names in homes.items():
        if name in names:
            return getattr(importlib.import_module(home), name)
    raise AttributeError(name)
