"""The seven relations of a code graph: columns, keys and defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


@dataclass(frozen=True)
class Relation:
    name: str
    key: tuple[str, ...]
    columns: dict[str, T.DataType]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, t) for c, t in self.columns.items()])


def _relation(name: str, key: str, values: str, whole: str = "", boolean: str = "") -> Relation:
    cols = [*key.split(), *values.split()]
    kinds = {**dict.fromkeys(whole.split(), _L), **dict.fromkeys(boolean.split(), _B)}
    return Relation(name, tuple(key.split()), {c: kinds.get(c, _S) for c in cols})


RELATIONS: dict[str, Relation] = {
    r.name: r
    for r in (
        _relation("modules", "project name", "file source"),
        _relation("functions", "project module name arity", "return_type args source", "arity"),
        _relation("calls", "project caller_module caller_function callee_module callee_function callee_arity file line column", "call_type caller_kind callee_args", "callee_arity line column"),
        _relation("struct_fields", "project module field", "default_value required inferred_type", "", "required"),
        _relation("function_locations", "project module name arity line", "file source_file_absolute column kind start_line end_line pattern guard source_sha ast_sha complexity max_nesting_depth generated_by macro_source", "arity line column start_line end_line complexity max_nesting_depth"),
        _relation("specs", "project module name arity", "kind line inputs_string return_string full", "arity line"),
        _relation("types", "project module name", "kind params line definition", "line"),
    )
}


@dataclass
class Graph:
    """The relations as DataFrames; each has at least the columns of its Relation."""

    modules: DataFrame
    functions: DataFrame
    calls: DataFrame
    struct_fields: DataFrame
    function_locations: DataFrame
    specs: DataFrame
    types: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(**{n: spark.createDataFrame([], r.struct) for n, r in RELATIONS.items()})

    def relations(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register(self, prefix: str = "") -> None:
        """A temporary view of each relation, for SQL."""
        for name, df in self.relations().items():
            df.createOrReplaceTempView(prefix + name)
