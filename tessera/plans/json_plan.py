"""Plans as JSON: a list with one root call, ``{"function": ..., "args": [...], "call": {"method": ..., "args": [...], "call": ...}}``.

Arguments may be such calls themselves. Only names in the allow-lists can be called; nothing is looked up by an arbitrary name.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import SparkSession

from .. import functions as fn
from .. import sinks
from ..functions.aggregates import Agg, Ranking, Window
from ..functions.expr import Expr
from ..operators import joins
from ..operators.frame import Frame, Grouped
from ..sources import files, memory


class PlanError(ValueError):
    pass


class Start:
    """``data_frame()``: what a plan begins with."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def read(self, source) -> Frame:
        return source(self.spark)

    extract = from_ = read


def _source(function):
    return lambda *args, **kwargs: lambda spark: function(spark, *args, **kwargs)


SOURCES = {n: _source(f) for n, f in {
    "from_array": memory.from_array, "from_rows": memory.from_rows, "from_csv": files.from_csv, "from_json": files.from_json, "from_parquet": files.from_parquet,
    "from_text": files.from_text, "from_xml": files.from_xml, "files": files.files, "from_path_partitions": files.from_path_partitions,
    "from_sequence_number": memory.from_sequence_number, "from_sequence_date_period": memory.from_sequence_date_period,
    "from_sequence_date_period_recurrences": memory.from_sequence_date_period_recurrences,
}.items()}
SINKS = {n: getattr(sinks, n) for n in ("to_csv", "to_json", "to_parquet", "to_text", "to_xml", "to_output", "to_branch")}
_RENAMED = {"sum": "sum_", "min": "min_", "max": "max_", "all": "all_", "any": "any_", "not": "not_", "round": "round_", "hash": "hash_"}
FUNCTIONS = {n: getattr(fn, _RENAMED.get(n, n)) for n in (
    "ref", "col", "entry", "refs", "lit", "exists", "when", "optional", "all", "any", "not", "array_get", "array_get_collection", "array_get_collection_first", "array_exists",
    "array_merge", "array_merge_collection", "array_key_rename", "array_keys_style_convert", "array_sort", "array_reverse", "array_expand", "array_unpack", "now", "between",
    "to_date_time", "to_date", "date_time_format", "split", "combine", "concat", "hash", "cast", "size", "uuid_v4", "uuid_v7", "ulid", "lower", "capitalize", "upper",
    "to_timezone", "regex_replace", "regex_match_all", "regex_match", "regex", "regex_all", "sprintf", "sanitize", "round", "number_format", "rank", "dens_rank",
    "dense_rank", "average", "collect", "collect_unique", "window", "sum", "first", "last", "max", "min", "count", "row_number", "list_ref", "structure_ref", "random_string",
)} | {"join_on": joins.join_on, "equal": joins.equal, "identical": joins.identical, "compare_all": joins.compare_all, "compare_any": joins.compare_any}
ENTRY_POINTS = ("data_frame", "df")

#: Methods that a plan may call, by type. Verbs that take or return Python objects are left out.
METHODS = {
    Start: {"read", "extract", "from_"},
    Frame: {
        "select", "drop", "with_entry", "with_entries", "rename", "rename_all", "rename_all_lower_case", "rename_all_upper_case", "rename_all_upper_case_first", "rename_all_upper_case_word",
        "rename_all_style", "reorder_entries", "auto_cast", "filter", "filters", "filter_partitions", "until", "limit", "offset", "sort_by", "drop_duplicates", "unique", "group_by", "aggregate",
        "join", "cross_join", "collect", "batch_size", "cache", "partition_by", "drop_partitions", "mode", "save_mode", "on_error", "write", "load", "void",
    },
    Grouped: {"pivot", "aggregate"},
    Agg: {"alias", "as_", "over"}, Ranking: {"over"}, Window: {"partition_by", "order_by"},
    Expr: {n for n in dir(Expr) if not n.startswith("_") and n not in ("resolve", "predicate", "method")},
}


def _snake(name: str) -> str:
    out = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
    return {"as": "as_", "from": "from_"}.get(out, out)


class Builder:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def build(self, plan: list) -> Frame:
        if not isinstance(plan, list) or len(plan) != 1:
            raise PlanError("a plan has exactly one root")
        root = plan[0]
        if not isinstance(root, dict) or root.get("function") not in ENTRY_POINTS:
            raise PlanError(f"a plan begins with {' or '.join(ENTRY_POINTS)}")
        out = self._calls(Start(self.spark), root.get("call"))
        if not isinstance(out, Frame):
            raise PlanError("the plan does not end in a frame")
        return out

    def value(self, x: Any) -> Any:
        if isinstance(x, dict) and "function" in x:
            name = _snake(x["function"])
            made = FUNCTIONS.get(name) or SOURCES.get(name) or SINKS.get(name)
            if name in ENTRY_POINTS:
                return self._calls(Start(self.spark), x.get("call"))
            if made is None:
                raise PlanError(f"unknown function {x['function']}")
            return self._calls(self._apply(made, x.get("args", [])), x.get("call"))
        if isinstance(x, dict):
            return {k: self.value(v) for k, v in x.items()}
        return [self.value(v) for v in x] if isinstance(x, list) else x

    def _apply(self, function, args: list | dict) -> Any:
        if isinstance(args, dict):
            return function(**{_snake(k): self.value(v) for k, v in args.items()})
        return function(*[self.value(a) for a in args])

    def _calls(self, target: Any, call: dict | None) -> Any:
        while call:
            name = _snake(call["method"])
            allowed = next((m for t, m in METHODS.items() if isinstance(target, t)), set())
            if name not in allowed:
                raise PlanError(f"{type(target).__name__} has no method {call['method']}")
            target = self._apply(getattr(target, name), call.get("args", []))
            call = call.get("call")
        return target


def from_array(spark: SparkSession, plan: list) -> Frame:
    return Builder(spark).build(plan)


def from_json(spark: SparkSession, text: str) -> Frame:
    try:
        plan = json.loads(text)
    except ValueError as e:
        raise PlanError(f"not JSON: {e}") from e
    return from_array(spark, plan)
