"""One object over a store: page writes that find their edges, recall, search and recipes, as named tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators.store import edges_for, open_store
from marlstone.streaming.feeds import enabled_recipes, on_page_write


class Knowledge:
    """A store with its write hooks and tools.

    ``tools`` has functions by name, ``register`` passes each on to a host. With ``graph`` off, pages are
    written without looking for edges. ``recipes`` are the enabled ones of a folder.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, backend: str | None = None, graph: bool = True, recipes: list[str] = (), recipe_folder: str | None = None):
        self.store = open_store(spark, path, backend)
        self.graph = graph
        self.recipes = enabled_recipes(recipe_folder, recipes) if recipe_folder else []
        self.hooks: list[Callable[[DataFrame], None]] = []
        self.tools = {"recall": self.store.recall, "search": self.store.search, "links": lambda slug, direction="both": edges_for(self.store.edges(), slug, direction), "remember": self.store.upsert_facts}

    def on_write(self, hook: Callable[[DataFrame], None]) -> None:
        """``hook`` gets every DataFrame of pages after it was written."""
        self.hooks.append(hook)

    def write(self, pages: DataFrame) -> None:
        """Pages (slug, content, and page_type for their edges)."""
        if self.graph:
            on_page_write(self.store, pages)
        else:
            self.store.upsert_pages(pages.drop("page_type"))
        for hook in self.hooks:
            hook(pages)

    def register(self, host: Callable[[str, Callable], None], prefix: str = "store") -> None:
        """Calls ``host(name, function)`` for each tool."""
        for name, tool in self.tools.items():
            host(f"{prefix}.{name}", tool)

    def close(self) -> None:
        self.store.close()
