"""The registered queries, grouped by subject."""

from importlib import import_module

MODULES = (
    "council_tax", "repairs", "social_care", "dashboard", "properties", "quality", "linkage", "governance", "storage", "streams",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
