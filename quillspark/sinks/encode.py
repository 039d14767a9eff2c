"""Results as JSON, NDJSON, CSV, aligned tables and TOON; plus the file sinks that write them in parallel."""

from __future__ import annotations

import csv
import io
import json
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.native import csv_cell, toon_cell

FORMATS = ("json", "ndjson", "csv", "table", "toon", "text")


def resolve_format(flag: str | None, configured: str | None, terminal: bool, default_text: bool = False) -> str:
    """Flag, then setting, then a table on a terminal and JSON elsewhere; one command prints text by default."""
    for x in (flag, configured):
        if x:
            if x not in FORMATS:
                raise ValueError(f"unknown format {x}")
            return x
    return "text" if default_text else "table" if terminal else "json"


def plain(value: Any) -> Any:
    """Rows, dates and floats as JSON knows them: integral floats lose their point."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    if value is None or isinstance(value, (str, int, bool)):
        return value
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def _escaped(s: str) -> str:
    for c in "<>&  ":
        s = s.replace(c, f"\\u{ord(c):04x}")
    return s


def to_json(data: Any, meta: dict | None = None) -> str:
    """{data, meta} with two spaces and escaped angle brackets."""
    return _escaped(json.dumps({"data": plain(data), "meta": plain(meta or {})}, ensure_ascii=False, indent=2)) + "\n"


def to_ndjson(records: list) -> str:
    return "".join(_escaped(json.dumps(plain(r), ensure_ascii=False, separators=(",", ":"))) + "\n" for r in records)


def cell(value: Any) -> str:
    value = plain(value)
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return str(value)


def to_csv(header: list[str], rows: list) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    w.writerows([cell(v) for v in r] for r in rows)
    return out.getvalue()


def to_table(header: list[str], rows: list) -> str:
    """Columns aligned by characters under a dashed rule."""
    cells = [header, *([cell(v).replace("\n", " ") for v in r] for r in rows)]
    width = [max(map(len, col)) for col in zip(*cells)]
    cells.insert(1, ["-" * w for w in width])
    return "".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() + "\n" for r in cells)


# --- TOON -----------------------------------------------------------------------------------------
_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
_SPECIAL = re.compile(r'[:"\\\[\]{},\x00-\x1f]')


def _toon_escape(s: str) -> str:
    names = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    return "".join(names.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s)


def toon_string(s: str) -> str:
    bare = s and s[0] not in " \t-#" and s[-1] not in " \t" and s not in ("true", "false", "null") and not _NUMBER.fullmatch(s) and not _SPECIAL.search(s)
    return s if bare else f'"{_toon_escape(s)}"'


def _toon_key(k: str) -> str:
    return k if _KEY.fullmatch(k) else f'"{_toon_escape(k)}"'


def _scalar(v: Any) -> bool:
    return v is None or isinstance(v, (str, int, float, bool))


def _toon_value(v: Any) -> str:
    return toon_string(v) if isinstance(v, str) else json.dumps(v)


def _columns(rows: list) -> tuple[list[str], list[list[str]]] | None:
    """Header and paths of equally shaped objects whose leaves are scalars."""
    if not rows or not all(isinstance(r, dict) for r in rows) or not rows[0]:
        return None
    names = sorted(rows[0])
    if any(sorted(r) != names for r in rows):
        return None
    head, paths = [], []
    for n in names:
        values = [r[n] for r in rows]
        if all(map(_scalar, values)):
            head.append(_toon_key(n))
            paths.append([n])
            continue
        inner = _columns(values)
        if inner is None:
            return None
        head.append(f"{_toon_key(n)}{{{','.join(inner[0])}}}")
        paths += [[n, *p] for p in inner[1]]
    return head, paths


def _toon_array(prefix: str, items: list, depth: int, table: bool = True) -> list[str]:
    pad, head = "  " * depth, f"{prefix}[{len(items)}]"
    if all(map(_scalar, items)):
        return [f"{pad}{head}: {','.join(map(_toon_value, items))}"]
    spec = _columns(items) if table else None
    if spec:
        out = [f"{pad}{head}{{{','.join(spec[0])}}}:"]
        for row in items:
            leaves = []
            for path in spec[1]:
                v = row
                for k in path:
                    v = v[k]
                leaves.append(_toon_value(v))
            out.append(f"{pad}  {','.join(leaves)}")
        return out
    out = [f"{pad}{head}:"]
    for v in items:
        mark = "  " * (depth + 1) + "- "
        if isinstance(v, dict):
            sub = _toon_object(v, depth + 2)
            out += [mark + sub[0].lstrip(" "), *sub[1:]] if sub else [mark.rstrip()]
        elif isinstance(v, list):
            sub = _toon_array("", v, depth + 1, False) if v else []
            out += [mark + sub[0].lstrip(" "), *sub[1:]] if sub else [mark + "[0]:"]
        else:
            out.append(mark + _toon_value(v))
    return out


def _toon_object(m: dict, depth: int) -> list[str]:
    out, pad = [], "  " * depth
    for k in sorted(m):
        v, name = m[k], _toon_key(k)
        if isinstance(v, dict):
            out += [f"{pad}{name}:", *_toon_object(v, depth + 1)]
        elif isinstance(v, list):
            out += _toon_array(name, v, depth) if v else [f"{pad}{name}: []"]
        else:
            out.append(f"{pad}{name}: {_toon_value(v)}")
    return out


def to_toon(data: Any, meta: dict | None = None) -> str:
    return "".join(x + "\n" for x in _toon_object(plain({"data": data, "meta": meta or {}}), 0))


# --- distributed sinks --------------------------------------------------------------------------
def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).csv(path, header=True, emptyValue="")


def _cells(df: DataFrame) -> list:
    return [F.to_json(c) if t.startswith(("struct", "array", "map")) else F.col(c).cast("string") for c, t in df.dtypes]


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as a CSV line, formatted in the JVM."""
    return df.select(F.concat_ws(",", *map(csv_cell, _cells(df))).alias("line"))


def toon_lines(df: DataFrame) -> DataFrame:
    """Each row as the cells of a TOON table row; numbers and booleans bare."""
    bare = ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("null")) if t in bare else toon_cell(x) for (c, t), x in zip(df.dtypes, _cells(df))]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def write_markdown(df: DataFrame, path: str, text_col: str = "markdown", force: bool = False) -> None:
    """Documents as text files; an existing folder is an error unless force."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite" if force else "errorifexists").text(path)
