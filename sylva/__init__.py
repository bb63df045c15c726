"""Selection, diff and synchronisation of path inventories and keyed snapshots
as Spark DataFrames."""

__version__ = "0.1.0"
