"""Writing the tables of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: outer white space is part of a value
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_WRITERS = {"csv": _CSV, "parquet": {}, "orc": {}, "json": {}}


def run_path(root: str, run_id: str, name: str) -> str:
    """Folder of one table of one run; runs never share a folder."""
    for part in (run_id, name):
        if not part or "/" in part or part in (".", ".."):
            raise ValueError(f"not a plain name: {part!r}")
    return f"{root.rstrip('/')}/run_id={run_id}/{name}"


def write_run(df: DataFrame, root: str, run_id: str, name: str, fmt: str = "parquet") -> str:
    """Write a table of a run, replacing an earlier one of the same name, and return its path."""
    if fmt not in _WRITERS:
        raise ValueError(f"unsupported format: {fmt}")
    path = run_path(root, run_id, name)
    df.write.mode("overwrite").options(**_WRITERS[fmt]).format(fmt).save(path)
    return path
