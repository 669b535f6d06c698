"""Columnar tables on Spark: positional selection, expressions with NumPy semantics, reductions, cutflows, conversion."""

from .functions.expr import QueryError, col
from .operators.frame import Frame
from .operators.table import Table, View, from_memory, table_of, union
from .operators.table import open_table as open  # noqa: A004
from .sources.formats import append, appender, compact, concat, convert, create, from_feather, from_hdf, from_json, from_npz, from_parquet, from_root, info, recreate, schema, store, update

__all__ = ["Frame", "QueryError", "Table", "View", "append", "appender", "col", "compact", "concat", "convert", "create", "from_feather", "from_hdf", "from_json", "from_memory", "from_npz", "from_parquet", "from_root", "info", "open", "recreate", "schema", "store", "table_of", "union", "update"]
