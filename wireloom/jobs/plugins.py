"""Named user functions over the library's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Plugins:
    """A registry of functions (tables, *args) -> DataFrame with descriptions, found by name, case ignored, or by number."""

    def __init__(self) -> None:
        self._found: dict[str, tuple[str, Callable[..., DataFrame]]] = {}

    def register(self, name: str, description: str = "") -> Callable:
        def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self._found[name.lower()] = (description, fn)
            return fn

        return add

    def listing(self) -> list[tuple[int, str, str]]:
        return [(i, name, d) for i, (name, (d, _)) in enumerate(self._found.items())]

    def run(self, which: str | int, tables: dict[str, DataFrame], *args: object) -> DataFrame:
        names = list(self._found)
        number = int(which) if str(which).isdigit() else -1
        name = names[number] if 0 <= number < len(names) else str(which).lower()
        if name not in self._found:
            raise KeyError(f"no plugin named {which}")
        return self._found[name][1](tables, *args)


PLUGINS = Plugins()


@PLUGINS.register("find_scripts", "external script sources of every page")
def find_scripts(tables: dict[str, DataFrame]) -> DataFrame:
    from ..operators.objects import extract_tag_sources

    return extract_tag_sources(tables["texts"], "script", "src")


@PLUGINS.register("print_body", "plain bodies by conversation")
def print_body(tables: dict[str, DataFrame], conv_id: int | None = None) -> DataFrame:
    from pyspark.sql import functions as F

    from ..operators.objects import plaintext_body

    rows = tables["conversations"] if conv_id is None else tables["conversations"].where(F.col("id") == conv_id)
    return rows.select("capture", "id", plaintext_body(F.col("res_body"), F.col("magic_ext")).alias("body"))
